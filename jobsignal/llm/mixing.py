"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words.

Van der Corput points, one per slot, are mapped through the cumulative target shares of the sources; slots are ranked
within their source and joined to the source's blocks, which cut its hash-shuffled documents into runs of equally many
words. Slot of rank r of a source takes block r modulo the source's number of blocks, at most twice around. A slot's rank
is counted, not sorted: the slots of an aligned run of 2**b lie evenly spaced on the unit interval, so the number of
earlier slots in a source's part is a sum of one quotient per bit of the slot.

Running sums over documents are taken in two levels (sums of hash buckets, then rows of a bucket), over sources in two
levels as well (ranges, then rows of a range), so a source with most of the rows is spread like any other and so are
millions of sources.

Defined results: null text has size 0 and takes nothing; null is a source of its own, ordered last; repeated rows are
separate documents; an empty table gives an empty table; documents are shuffled by the hash of id and text, so only
equal rows tie. Other columns stay, whatever their names; where one of them has the name of an added column, that gets
more underscores in front. Reruns agree: order and schedule depend on doc_id, text and source only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns_of, dropped, fresh, pieces, small_or_merge, written

WORD = r"[^\x20\x09-\x0D]+"
#: Words per block; least hash buckets per source and rows of a bucket beyond; least cells of the unit interval for the slot join.
BLOCK_WORDS, BUCKETS, BUCKET_ROWS, CELLS = 64, 1024, 1 << 16, 4096
#: Slots that a task makes.
TASK_SLOTS = 1 << 19
#: Slots of the mix that lie together, in order.
RUN_SLOTS = 4096
#: Words of the mix that a partition holds on average.
PARTITION_WORDS = 4 << 20
#: Bits of a point: slots may number up to 2 ** BITS.
BITS = 44
ADDED = ("_size", "_source_size", "_target", "_taken", "_start", "_slot", "_slot2")


def reversed_bits(i: np.ndarray) -> np.ndarray:
    """The van der Corput point of each slot, times 2 ** BITS."""
    out = np.zeros_like(i)
    for b in range(BITS):
        out |= ((i >> b) & 1) << (BITS - 1 - b)
    return out


def ranks(slot: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Number of slots before each one whose points lie in [lo, hi)."""
    out = np.zeros_like(slot)
    for b in range(BITS):
        part = ((slot >> b) & 1).astype(bool)  # the run of 2 ** b slots that ends where this bit is cleared
        if part.any():
            step = 1 << (BITS - b)
            first = reversed_bits((slot[part] >> b ^ 1) << b)
            out[part] += (hi[part] - first + step - 1) // step - (lo[part] - first + step - 1) // step
    return out


def _numbered(value: str):
    """Adds the row's place and the sum of ``value`` before it within its partition, and the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, k = 0, 0.0, TaskContext.get().partitionId()
        for batch in batches:
            v = batch.column(batch.schema.get_field_index(value)).to_numpy(zero_copy_only=False).astype(float)
            before = total + np.concatenate([[0.0], np.cumsum(v)[:-1]]) if len(v) else v
            cols = [pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(n, n + len(v))), pa.array(before)]
            n, total = n + len(v), total + v.sum()
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, "part", "place", "ahead"])

    return run


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size) -> with idx, target, n_blocks and the bounds lo, hi of its part of the points.

    Targets are min(most * size, level * weight) with the one level at which they add up to share * all sizes: the
    level is raised until no further source is above its cap.
    """
    s = sizes.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source")
    s = written(s.mapInArrow(_numbered("source_size"), "source string, source_size long, part int, place long, ahead double"), "source-places")
    parts = dict(s.groupBy("part").agg(F.count(F.lit(1))).collect())  # a row per partition
    first, at = [], 0
    for k in sorted(parts):
        first += [F.lit(k), F.lit(at)]
        at += parts[k]
    idx = (F.create_map(*first)[F.col("part")] if first else F.lit(0)) + F.col("place")
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("idx") % len(weights) + 1).cast("int"))
    s = s.select("source", "source_size", idx.cast("long").alias("idx")).withColumn("w", w).withColumn("cap", most * F.col("source_size"))

    total = share * (s.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        above = F.col("cap") <= level * F.col("w")
        n, caps, rest = s.agg(F.count_if(above), F.sum(F.when(above, F.col("cap")).otherwise(0.0)), F.sum(F.when(above, 0.0).otherwise(F.col("w")))).first()
        if n == capped or not rest:
            level = level if rest else float("inf")
            break
        level, capped = max(level, (total - caps) / rest), n
    s = s.withColumn("target", F.least("cap", level * F.col("w")))

    s = s.repartitionByRange("idx").sortWithinPartitions("idx").mapInArrow(_numbered("target"), "source string, source_size long, idx long, w double, cap double, target double, part int, place long, ahead double")
    s = written(s, "source-targets")
    sums = dict(s.groupBy("part").agg(F.sum("target")).collect())  # a row per partition
    first, run = [], 0.0
    for k in sorted(sums):
        first += [F.lit(k), F.lit(run)]
        run += sums[k]
    before = (F.create_map(*first)[F.col("part")] if first else F.lit(0.0)) + F.col("ahead")
    end = F.lit(1 << BITS)
    point = lambda x: F.least(end, F.round(x / run * (1 << BITS)).cast("long")) if run else F.lit(0).cast("long")
    last = s.where("target > 0").agg(F.max("idx")).first()[0]
    hi = F.when(F.col("idx") >= (last if last is not None else -1), end).otherwise(point(before + F.col("target")))
    blocks = F.ceil(F.col("source_size") / BLOCK_WORDS).cast("long")
    return s.select("source", "source_size", "idx", "target", blocks.alias("n_blocks"), point(before).alias("lo"), hi.alias("hi"))


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        slot, lo, hi, n = (batch.column(i).to_numpy() for i in (1, 2, 3, 4))
        r = ranks(slot, lo, hi)
        ok = pa.array(r < 2 * n)
        block = r % np.maximum(n, 1)
        cols = [batch.column(0), batch.column(1), pa.array(block), pa.array(r // np.maximum(n, 1))]
        yield pa.RecordBatch.from_arrays([c.filter(ok) for c in cols], names=["idx", "slot", "block", "around"])


def schedule(sources: DataFrame, n_slots: int) -> DataFrame:
    """Slots (idx, slot, block, around): each point's source, the block it takes, and whether that is its second time."""
    spark = sources.sparkSession
    cell_bits = max(CELLS, 4 * sources.count()).bit_length() - 1
    # the point is reversed in SQL, so that a task has one Python worker, for the ranks
    point = F.conv(F.reverse(F.lpad(F.bin("id"), BITS, "0")), 2, 10).cast("long")
    slots = spark.range(0, n_slots, 1, max(spark.sparkContext.defaultParallelism, n_slots // TASK_SLOTS)).select(F.col("id").alias("slot"), point.alias("x")).withColumn("cell", F.shiftright("x", BITS - cell_bits))
    low, high = F.shiftright("lo", BITS - cell_bits), F.shiftright(F.col("hi") - 1, BITS - cell_bits)
    cells = sources.where("hi > lo").withColumn("cell", F.explode(F.sequence(low, high)))
    cells = written(cells.select("cell", "idx", "lo", "hi", "n_blocks"), "cells")
    s = slots.join(small_or_merge(cells), "cell").where("x >= lo and x < hi").select("idx", "slot", "lo", "hi", "n_blocks")
    return s.mapInArrow(_ranked, "idx long, slot long, block long, around long")


def mix_sources(docs: DataFrame, keep: list[str] | None = None, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs (its columns in ``keep``, or all) with ``_size``, ``_source_size``, ``_target``, ``_taken``, ``_start`` (its
    place in its source's words), and ``_slot`` and ``_slot2``: the first slots of the mix that take words of it on the
    first and the second time around (null: none).

    A source's taken words are the first ones of its shuffled words, up to twice around.
    """
    keep = docs.columns if keep is None else keep
    added = fresh(keep, *ADDED)
    x = [f"x{i}" for i in range(len(keep))]
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    held = [c.alias(n) for c, n in zip(columns_of(keep), x)]
    rows = docs.select(*held, F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name"), size.alias("size"), F.xxhash64("doc_id", F.xxhash64("text"), F.lit(17)).alias("key"))
    rows = written(rows, "sized")
    buckets = max(BUCKETS, 1 << (rows.count() // BUCKET_ROWS).bit_length())
    rows_ = rows.withColumn("bucket", F.pmod("key", F.lit(buckets)))
    sums = written(rows_.groupBy("no", "name", "bucket").agg(F.sum("size").alias("n")), "bucket-sums")
    per = sums.groupBy("no", "name").agg(F.sum("n").alias("source_size")).select(F.when(~F.col("no"), F.col("name")).alias("source"), "source_size")
    sources = written(source_targets(per, weights, share, most), "sources")
    total = sums.agg(F.sum("n")).first()[0] or 0

    ahead = sums.withColumn("ahead", F.sum("n").over(Window.partitionBy("no", "name").orderBy("bucket")) - F.col("n")).drop("n")
    facts = sources.select(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("name"), "idx", "source_size", "target")
    ahead = ahead.join(small_or_merge(facts), ["no", "name"])
    own = Window.partitionBy("no", "name", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows_.withColumn("own", F.sum("size").over(own) - F.col("size")).join(ahead.hint("merge"), ["no", "name", "bucket"])
    placed = placed.withColumn("start", F.col("ahead") + F.col("own"))
    placed = written(placed.select(*x, "size", "source_size", "target", "idx", "start"), "placed")
    dropped(rows)

    slots = schedule(sources, round(share * total / BLOCK_WORDS))
    once = lambda k: F.min(F.when(F.col("around") == k, F.col("slot")))
    times = slots.groupBy("idx", "block").agg(F.count(F.lit(1)).alias("times"), once(0).alias("slot"), once(1).alias("slot2"))
    last = F.floor((F.col("start") + F.col("size") - 1) / BLOCK_WORDS)
    parts = placed.where("size > 0").select("idx", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / BLOCK_WORDS), last)).alias("block"))
    inside = F.least((F.col("block") + 1) * BLOCK_WORDS, F.col("start") + F.col("size")) - F.greatest(F.col("block") * BLOCK_WORDS, F.col("start"))
    got = parts.join(times.hint("merge"), ["idx", "block"])
    got = got.groupBy("idx", "start").agg(F.sum(inside * F.col("times")).cast("long").alias("taken"), F.min("slot").alias("slot"), F.min("slot2").alias("slot2")).withColumn("full", F.lit(True))
    out = placed.withColumn("full", F.col("size") > 0).join(got.hint("merge"), ["idx", "start", "full"], "left")
    new = (F.col("size"), F.col("source_size"), F.col("target"), F.coalesce("taken", F.lit(0)).cast("long"), F.col("start"), F.col("slot"), F.col("slot2"))
    return out.select(*(F.col(a).alias(b) for a, b in zip(x, keep)), *(c.alias(n) for c, n in zip(new, added)))


def _first_words(schema, at: int):
    word = re.compile(WORD)

    def cut(text: str, n: int) -> str:
        for i, m in enumerate(word.finditer(text), 1):
            if i == n:
                return text[: m.end()]
        return text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [t if n is None else cut(t, n) for t, n in zip(batch.column(at).to_pylist(), batch.column(len(schema)).to_pylist())]
            cols = [pa.array(texts, batch.column(at).type) if i == at else c for i, c in enumerate(batch.columns[:-1])]
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return run


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix as rows of docs' columns: a row for each time around that takes words of a document, cut to those.

    Rows follow the schedule: each run of RUN_SLOTS slots lies in one partition, in the order of the slots, so what reads
    the partitions in order, as packing does, sees the sources interleaved by their weights.
    """
    names = docs.columns
    x = [f"x{i}" for i in range(len(names))]
    every = columns_of(names)
    keys = [F.col("doc_id").isNull().alias("k0"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("k1"), F.xxhash64("text").alias("k2"), F.xxhash64(*every).alias("k3")]
    out = mix_sources(docs.select(*keys, "doc_id", "text", "source"), keep=["k0", "k1", "k2", "k3"], **how)
    first, second = F.least("_taken", "_size"), F.greatest(F.col("_taken") - F.col("_size"), F.lit(0))
    turn = lambda n, slot: F.struct(n.alias("n"), F.col(slot).alias("slot"))
    turns = F.explode(F.filter(F.array(turn(first, "_slot"), turn(second, "_slot2")), lambda t: t["n"] > 0)).alias("t")
    turns = written(out.select("k0", "k1", "k2", "k3", "_size", turns).select("k0", "k1", "k2", "k3", F.when(F.col("t.n") < F.col("_size"), F.col("t.n")).alias("n"), "t.slot"), "turns")
    # equal rows take turns on one of them
    # columns are renamed after the duplicates went: renamed beside a hash of them all, the optimizer would double what
    # it knows of that hash with every column
    own = fresh(names, "k0", "k1", "k2", "k3")
    whole = docs.withColumns(dict(zip(own, keys))).dropDuplicates(own)
    whole = whole.select(*(F.col(a).alias(f"k{i}") for i, a in enumerate(own)), *(c.alias(n) for c, n in zip(every, x)))
    rows = turns.join(whole.hint("merge"), ["k0", "k1", "k2", "k3"]).select(*x, "n", "slot")
    # as many partitions as the slots' words ask for, however few partitions shuffles have
    slots = (turns.agg(F.max("slot")).first()[0] or 0) + 1
    rows = rows.repartition(-(-slots * BLOCK_WORDS // PARTITION_WORDS), F.floor(F.col("slot") / RUN_SLOTS)).sortWithinPartitions("slot", *x[:1]).select(*x, "n")
    return rows.mapInArrow(_first_words(docs.schema, names.index("text")), docs.schema)
