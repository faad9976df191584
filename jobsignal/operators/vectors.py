"""Nearest vectors of many queries at once: cells around centroids, probed and ranked by exact similarity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stored import stored

#: Vectors that centroids are fitted on at most, taken by hash; every vector is assigned to a cell.
SAMPLE = 50_000
#: Queries and vectors of a cell that are multiplied as one block, on average; queries at a time; pairs summed at a time.
QUERY_BLOCK, VECTOR_BLOCK, AT_ONCE, SUMMED = 8_192, 16_384, 256, 100_000


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def unit(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): vectors as unit ones; null, empty and zero vectors and those with null or non-finite components have no
    direction and are left out."""
    x = F.col(vector).cast("array<double>")
    v = vectors.select(F.col(key).alias("id"), x.alias("x")).where(F.size("x") > 0).where(F.forall("x", lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf"))))
    v = v.withColumn("n", F.sqrt(_dot(F.col("x"), F.col("x")))).where("n > 0")
    return v.select("id", F.transform("x", lambda y: y / F.col("n")).alias("v"))


def _best(k: int):
    """Kernel over a block of queries and one of vectors: of each query the k best, ties to smaller ids.

    A matrix product finds all that may be among them; their similarities are then summed component by component, so
    that equal vectors tie wherever they lie."""

    def matrix(c: pa.ChunkedArray) -> np.ndarray:
        return pc.list_flatten(c).to_numpy().reshape(len(c), -1)

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        schema = pa.schema([queries.schema.field("query_id"), vectors.schema.field("id"), pa.field("similarity", pa.float64())])
        if not queries.num_rows or not vectors.num_rows:
            return schema.empty_table()
        vectors = vectors.sort_by("id")
        q, v = matrix(queries["q"]), matrix(vectors["v"])
        self_at = pc.index_in(queries["query_id"], vectors["id"].combine_chunks()).to_numpy(zero_copy_only=False)
        who, which, score = [], [], []
        for at in range(0, len(q), AT_ONCE):
            s = q[at : at + AT_ONCE] @ v.T
            own = self_at[at : at + AT_ONCE]
            has = np.flatnonzero(~np.isnan(own.astype(float)))
            s[has, own[has].astype(np.int64)] = -np.inf
            least = np.partition(s, -k, axis=1)[:, -k] if s.shape[1] > k else np.full(len(s), -np.inf)
            i, j = np.nonzero((s >= least[:, None] - 1e-9) & (s > -np.inf))
            exact = np.zeros(len(i))
            for a in range(0, len(i), SUMMED):
                x, y, part = q[at + i[a : a + SUMMED]], v[j[a : a + SUMMED]], exact[a : a + SUMMED]
                for c in range(x.shape[1]):
                    part += x[:, c] * y[:, c]
            order = np.lexsort((j, -exact, i))
            first = np.searchsorted(i[order], i[order])  # where a query's pairs begin
            order = order[np.arange(len(order)) - first < k]
            who.append(at + i[order])
            which.append(j[order])
            score.append(exact[order])
        return pa.Table.from_arrays([queries["query_id"].take(pa.array(np.concatenate(who))), vectors["id"].take(pa.array(np.concatenate(which))), pa.array(np.concatenate(score))], schema=schema)

    return run


@dataclass
class Cells:
    """Unit vectors (cell, id, v) as a stored table, and the centroids by cell."""

    vectors: DataFrame
    centres: list[list[float]]

    @staticmethod
    def of(vectors: DataFrame, key: str, vector: str, cells: int, seed: int = 1) -> Cells:
        u = stored(unit(vectors, key, vector), "unit-vectors")
        some = u.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select(array_to_vector("v").alias("features"))
        model = KMeans(k=cells, seed=seed, maxIter=10).fit(some)
        assigned = model.transform(u.withColumn("features", array_to_vector("v"))).select(F.col("prediction").alias("cell"), "id", "v")
        return Cells(stored(assigned, "cells"), [[float(x) for x in c] for c in model.clusterCenters()])

    def search(self, queries: DataFrame, key: str, vector: str, k: int, probes: int | None = None) -> DataFrame:
        """(query_id, rank, id, similarity): of each query the k most similar vectors but itself, ties to smaller ids, out
        of the ``probes`` cells whose centroids are nearest; out of all of them, that is exactly, by default.

        Queries and vectors of a cell meet in blocks of bounded size, as matrix products, which keep k a query; vectors
        of another length are no candidates."""
        n = len(self.centres)
        near = F.transform(F.array(*(F.struct(F.array(*map(F.lit, c)).alias("c"), F.lit(i).alias("i")) for i, c in enumerate(self.centres))), lambda c: F.struct((F.lit(0.0) - _dot(F.col("q"), c["c"]) + _dot(c["c"], c["c"]) / 2).alias("d"), c["i"].alias("i")))
        q = unit(queries, key, vector).select(F.col("id").alias("query_id"), F.col("v").alias("q"))
        q = stored(q.select("query_id", "q", F.explode(F.slice(F.sort_array(near), 1, min(probes or n, n))).alias("c")).select("query_id", "q", F.col("c.i").alias("cell")), "probes")
        asked = q.select("query_id").distinct().count()
        most = self.vectors.groupBy("cell").count().agg(F.max("count")).first()[0] or 0
        qs, vs = -(-asked // QUERY_BLOCK) or 1, -(-most // VECTOR_BLOCK) or 1
        block = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
        by = ["cell", "qb", "vb", "width"]
        left = q.select("query_id", "q", "cell", F.size("q").alias("width"), block("query_id", qs).alias("qb"), every(vs).alias("vb"))
        right = self.vectors.select("id", "v", "cell", F.size("v").alias("width"), block("id", vs).alias("vb"), every(qs).alias("qb"))
        kinds = dict(q.dtypes)["query_id"], dict(self.vectors.dtypes)["id"]
        pairs = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(_best(k), f"query_id {kinds[0]}, id {kinds[1]}, similarity double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id"))
        return pairs.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")
