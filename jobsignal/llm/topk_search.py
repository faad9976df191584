"""Exact top-k inner-product search by pivot-table elimination.

Vectors are given one more component that makes their lengths equal, so the largest inner product is the smallest
distance. Pivots are chosen once, from a sample of SAMPLE vectors by hash, each the farthest from those before; a table
with every vector's distances to all of them is written once. A vector belongs to the cell of its nearest pivot; cells are
dealt into groups of about GROUP rows by a row number, so any number of equal rows is spread.

For a query, the largest difference to its own pivot distances bounds each candidate's distance from below. The k-th
score within the sample is a first threshold: cells whose range of pivot distances can't reach it are left out before the
query is sent anywhere. Each candidate travels once; queries are sent to the groups of the others. In a group, candidates whose bound
can't reach the threshold are left out, and the rest are evaluated in the order of their bounds until the k-th score can
no longer be reached. A task holds one group; queries stream past it, and thresholds are taken for QUERY_ROWS at a time.

Defined results: null vectors and ids, and vectors with null or non-finite components, take no part; shorter vectors count
as if ended by zeros; repeated rows are candidates each, and a query's own vec_id never is (of repeated query rows the
least vector counts); ties go to the smaller vec_id; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, pieces, written

PIVOTS, SAMPLE, GROUP, QUERY_ROWS, STEP = 32, 4096, 8192, 256, 64
_OUT = ("query_id", "vec_id", "score", "evaluated")


def dense(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, ended by zeros."""
    lens = lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width)[None] < lens[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


class Pivots:
    """Pivots of a sample; distances of candidates and queries to them; the sample's own scores."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, longest: float):
        self.ids, self.width, self.longest = ids, x.shape[1], longest
        self.sample = x.astype(float)
        norm = (self.sample**2).sum(1)
        rest = np.sqrt(np.maximum(longest - norm, 0))
        far, p = np.full(len(x), np.inf), [0]
        for _ in range(min(PIVOTS, len(x)) - 1):
            a = p[-1]
            far = np.minimum(far, norm + norm[a] - 2 * self.sample @ self.sample[a] + (rest - rest[a]) ** 2)
            p.append(int(far.argmax()))
        self.p, self.norm, self.rest = self.sample[p], norm[p], rest[p]

    def of_candidates(self, x: np.ndarray) -> np.ndarray:
        norm = (x**2).sum(1)
        rest = np.sqrt(np.maximum(self.longest - norm, 0))
        return np.sqrt(np.maximum(norm[:, None] + self.norm - 2 * x @ self.p.T + (rest[:, None] - self.rest) ** 2, 0))

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((q**2).sum(1)[:, None] + self.longest - 2 * q @ self.p.T, 0))

    def slack(self, qq: np.ndarray) -> np.ndarray:
        return 1e-9 * (qq + self.longest) + 1e-3

    def reach(self, qq, least):
        """Upper bound of the inner product at a lower bound of the distance."""
        return (qq + self.longest - least**2) / 2

    def thresholds(self, own: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """A score that k vectors of the sample reach, for each query."""
        s = q @ self.sample.T
        s[own[:, None] == self.ids[None]] = -np.inf
        return np.sort(s, 1)[:, -k] if s.shape[1] >= k else np.full(len(q), -np.inf)


def _table(pivots: Pivots):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId() << 36
        for batch in batches:
            d = pivots.of_candidates(dense(batch.column(1), pivots.width).astype(float))
            n = len(d)
            cols = [batch.column(0), batch.column(1), pa.array(list(d), pa.list_(pa.float64())), pa.array(d.argmin(1).astype(np.int32)), pa.array(np.arange(place, place + n))]
            place += n
            yield pa.RecordBatch.from_arrays(cols, names=["vec_id", "v", "d", "cell", "place"])

    return run


def _sent(pivots: Pivots, low: np.ndarray, high: np.ndarray, cells: np.ndarray, k: int):
    """(vec_id, v) of queries -> with distances, threshold and the cells that may reach it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, QUERY_ROWS):
            own, q = batch.column(0).to_numpy(), dense(batch.column(1), pivots.width).astype(float)
            d, qq = pivots.of_queries(q), (q**2).sum(1)
            least = pivots.thresholds(own, q, k) - pivots.slack(qq)
            gap = np.maximum(np.maximum(d[:, None] - high[None], low[None] - d[:, None]), 0).max(2)
            open_ = pivots.reach(qq[:, None], gap) >= least[:, None]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(d), pa.list_(pa.float64())), pa.array(least), pa.array([cells[o] for o in open_], pa.list_(pa.int32()))], names=["vec_id", "v", "d", "least", "cells"])

    return run


class Group:
    """Candidates of one group with their rows of the pivot table."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, table: np.ndarray):
        self.ids, self.x, self.f, self.table = ids, x, x.astype(float), table
        self.largest = np.abs(self.f).max(initial=0)

    def best(self, pivots: Pivots, own: int, q: np.ndarray, to: np.ndarray, least: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(scores and ids of the k best that reach ``least``, candidates evaluated)."""
        qf = q.astype(float)
        qq = float(qf @ qf)
        most = pivots.reach(qq, np.abs(self.table - to).max(1)) + float(pivots.slack(qq))
        order = np.flatnonzero(most >= least)
        order = order[np.argsort(-most[order], kind="stable")]
        small = self.largest * np.abs(qf).max(initial=0) * max(1, len(q)) < 2**52
        s, i, seen = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        for at in range(0, len(order), STEP):
            part = order[at : at + STEP]
            if len(s) == k and most[part[0]] < s[-1]:
                break
            score = np.rint(self.f[part] @ qf).astype(np.int64) if small else self.x[part] @ q
            seen += len(part)
            other = self.ids[part] != own
            s, i = np.concatenate([s, score[other]]), np.concatenate([i, self.ids[part][other]])
            keep = np.lexsort((i, -s))[:k]
            s, i = s[keep], i[keep]
        return s, i, seen


def _search(pivots: Pivots, k: int):
    """Rows (grp, query, ...) in that order: the candidates of each group, then its queries, which stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, group = None, [], None
        for batch in batches:
            grp, is_query, ids, least = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("grp", "query", "vec_id", "least"))
            x = dense(batch.column("v"), pivots.width)
            d = np.asarray(batch.column("d").flatten()).reshape(len(x), -1)
            cut = np.flatnonzero((grp[1:] != grp[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            out: list[list] = [[], [], [], []]
            for a, b in zip([0, *cut], [*cut, len(x)]):
                if a == b:
                    continue
                if grp[a] != key:
                    key, held, group = grp[a], [], None
                if not is_query[a]:
                    held.append((ids[a:b], x[a:b], d[a:b]))
                    continue
                if not held:  # no candidate in the group
                    continue
                group = group or Group(*(np.concatenate(c) for c in zip(*held)))
                for r in range(a, b):
                    s, i, seen = group.best(pivots, ids[r], x[r], d[r], least[r], k)
                    out[0] += [ids[r]] * (len(s) + 1)
                    out[1] += [*i, None]
                    out[2] += [*s, None]
                    out[3] += [*[0] * len(s), seen]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=list(_OUT))

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors(vec_id, v array<long>), queries alike -> (query_id, rank, vec_id, score, evaluated); ``evaluated`` counts
    the candidates of the query whose score was computed, those of the sample aside."""
    whole = "vec_id is not null and v is not null"
    vectors, queries = vectors.where(whole).select("vec_id", "v"), queries.where(whole).groupBy("vec_id").agg(F.min("v").alias("v"))
    square = F.aggregate("v", F.lit(0.0), lambda a, y: a + y.cast("double") * y.cast("double"))
    n, width, longest, m = *vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square)).first(), queries.count()
    if not n or not m:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long, evaluated long")
    width = max(width, queries.agg(F.max(F.size("v"))).first()[0])
    some = vectors.orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(SAMPLE).toArrow()
    pivots = Pivots(some["vec_id"].to_numpy(), dense(some["v"].combine_chunks(), width), longest)

    table = written(vectors.mapInArrow(_table(pivots), "vec_id long, v array<long>, d array<double>, cell int, place long"), "pivot-table")
    p = range(len(pivots.p))
    cells = table.groupBy("cell").agg(F.count(F.lit(1)), *(f(F.col("d")[i]) for f in (F.min, F.max) for i in p)).collect()  # a row per pivot
    cells = sorted(map(tuple, cells))
    names, low, high = np.array([c[0] for c in cells], np.int32), np.array([c[2 : 2 + len(p)] for c in cells]), np.array([c[2 + len(p) :] for c in cells])
    groups = F.create_map(*(F.lit(y) for c in cells for y in (c[0], -(-c[1] // GROUP))))

    grp = lambda cell, salt: F.shiftleft(cell.cast("long"), 32) + salt
    c = table.select(grp(F.col("cell"), F.pmod(F.xxhash64("place"), groups[F.col("cell")])).alias("grp"), F.lit(False).alias("query"), "vec_id", "v", "d", F.lit(0.0).alias("least"))
    q = queries.mapInArrow(_sent(pivots, low, high, names, k), "vec_id long, v array<long>, d array<double>, least double, cells array<int>")
    q = q.withColumn("cell", F.explode("cells")).withColumn("salt", F.explode(F.sequence(F.lit(0), groups[F.col("cell")] - 1)))
    q = q.select(grp(F.col("cell"), F.col("salt")).alias("grp"), F.lit(True).alias("query"), "vec_id", "v", "d", "least")
    both = c.unionByName(q).repartition("grp").sortWithinPartitions("grp", "query")
    found = written(both.mapInArrow(_search(pivots, k), "query_id long, vec_id long, score long, evaluated long"), "found")
    dropped(table)
    of = Window.partitionBy("query_id")
    out = found.withColumn("rank", F.row_number().over(of.orderBy(F.desc_nulls_last("score"), "vec_id"))).withColumn("evaluated", F.sum("evaluated").over(of))
    return out.where((F.col("rank") <= k) & F.col("vec_id").isNotNull()).select("query_id", "rank", "vec_id", "score", "evaluated")


def whole_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(vec_id, v): floor(scale * x) of the vectors whose components are all finite."""
    x = F.col("embedding").cast("array<double>")
    fine = F.col("embedding").isNotNull() & F.forall(x, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) != float("inf")))
    return embeddings.where(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda y: F.floor(scale * y).cast("long")).alias("v"))
