"""Ordered runs of a key over range partitions: positions and digests, with no key gathered in one task."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import pieces, written

#: Bytes of joined values that one row holds before they are digested.
CHUNK = 1 << 18


def _joined(keys: list[str], sep: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = [*keys, "_part", "_chunk", "_data", "_digest"]
        rows: list[tuple] = []
        key, held, size, chunk, first, types = None, [], 0, 0, True, None

        def close(whole: bool) -> None:
            nonlocal held, size, chunk
            data = sep.join(held)
            rows.append((*key, part, chunk, *((None, hashlib.sha256(data).hexdigest()) if whole else (data, None))))
            held, size, chunk = [], 0, chunk + 1

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            kinds = [*types, pa.int32(), pa.int64(), pa.binary(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=names)

        for piece in pieces(batches, 2048):
            types = [piece.schema.field(i).type for i in range(len(keys))]
            cols = [c.to_pylist() for c in piece.columns]
            for k, value in zip(zip(*cols[:-1]), cols[-1]):
                if k != key:
                    if key is not None:
                        if held or not chunk:
                            close(whole=not first and chunk == 0)
                        first = False
                    key, chunk = k, 0
                held.append(value.encode())
                size += len(held[-1]) + len(sep)
                if size >= CHUNK:
                    close(whole=False)
            if rows:
                yield out()
        if held:
            close(whole=False)
        if rows:
            yield out()

    return run


def _merged(n_keys: int, sep: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, names, types, rows = None, None, None, None, []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [*types, pa.string()])], names=[*names, "sha256"])

        for piece in pieces(batches, 64):
            names = piece.schema.names[:n_keys]
            types = [piece.schema.field(i).type for i in range(n_keys)]
            cols = [c.to_pylist() for c in piece.columns]
            for *k, data in zip(*cols[:n_keys], cols[-1]):
                if k != key:
                    if key is not None:
                        rows.append((*key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256(data)
                else:
                    sha.update(sep)
                    sha.update(data)
            if rows:
                yield out()
        if key is not None:
            rows.append((*key, sha.hexdigest()))
            yield out()

    return run


def joined_sha256(df: DataFrame, keys: list[str], order: list[str], value: str, sep: str) -> DataFrame:
    """(keys, sha256): the lower-case hex SHA-256 of each key's values, joined by sep in order (null keys are a key).

    Rows lie in range partitions of keys and order; a run that ends inside its partition is digested there, other runs
    leave as joined pieces of CHUNK bytes, which a second, much smaller exchange streams through the digest in order.
    Neither values nor pieces of a key are gathered in memory. ``df`` is read twice: give a stored table.
    """
    at = [F.col(c) for c in (*keys, *order)]
    s = df.select(*keys, *order, value).repartitionByRange(*at).sortWithinPartitions(*at).select(*keys, value)
    types = dict(df.dtypes)
    head = ", ".join(f"{k} {types[k]}" for k in keys)
    p = written(s.mapInArrow(_joined(keys, sep.encode()), f"{head}, _part int, _chunk long, _data binary, _digest string"), "digests")
    whole = p.where("_digest IS NOT NULL").select(*keys, F.col("_digest").alias("sha256"))
    open_ = p.where("_digest IS NULL").select(*keys, "_part", "_chunk", "_data").repartition(*keys).sortWithinPartitions(*keys, "_part", "_chunk")
    return whole.unionByName(open_.mapInArrow(_merged(len(keys), sep.encode()), f"{head}, sha256 string"))


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, last, count = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        new = np.ones(n, bool)
        new[1:] = keys[1:] != keys[:-1]
        new[0] = last is None or keys[0] != last
        at = np.arange(n)
        start = np.maximum.accumulate(np.where(new, at, -1))
        place = np.where(start < 0, at + count, at - start)
        last, count = keys[-1], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place, pa.int64()), pa.array(np.full(n, part), pa.int32())], names=[*batch.schema.names, "_place", "_part"])


def numbered(df: DataFrame, key: str, order: list) -> DataFrame:
    """df, whose first column is the long key without nulls, with ``_pos``: the row's place among its key's rows, from 0.

    Rows are sorted in range partitions and numbered within each; a key that runs over several partitions gets the sizes
    of its earlier parts added. Only the first run of a partition can continue a key: the offsets that are broadcast are
    one row a partition at most.
    """
    at = [F.col(key), *order]
    s = df.repartitionByRange(*at).sortWithinPartitions(*at)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    t = written(s.mapInArrow(_places, f"{fields}, _place long, _part int"), "places")
    runs = t.groupBy("_part", key).agg(F.count(F.lit(1)).alias("n"))
    edge = runs.groupBy("_part").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).select("_part", F.explode(F.array_distinct(F.array("lo", "hi"))).alias(key))
    spans = edge.join(runs.hint("merge"), ["_part", key]).collect()  # two rows a partition at most
    offsets, before = [], {}
    for r in sorted(spans, key=lambda r: (r[key], r["_part"])):
        if before.get(r[key]):
            offsets.append((r["_part"], r[key], before[r[key]]))
        before[r[key]] = before.get(r[key], 0) + r["n"]
    o = df.sparkSession.createDataFrame(offsets, f"_part int, {key} long, _before long")
    return t.join(F.broadcast(o), ["_part", key], "left").select(*df.columns, (F.col("_place") + F.coalesce("_before", F.lit(0))).alias("_pos"))
