"""Change tracking, lifecycles, duplicates, funnels, affinities, composite scores, bucketed facets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.components import components
from ..plans.stored import dropped, is_small, once, stored


def detect_changes(history: DataFrame, key: str = "jobId", order: str = "run", content: str = "contentHash") -> DataFrame:
    """Sightings whose content differs from the one before (the first included)."""
    before = F.lag(content).over(Window.partitionBy(key).orderBy(order))
    return history.withColumn("_b", before).where(F.col("_b").isNull() | (F.col("_b") != F.col(content))).drop("_b")


def lifecycle(sightings: DataFrame, runs: DataFrame, now: str, stale_hours: int = 48) -> DataFrame:
    """sightings(jobId, source, run_id, seenAt, validThrough), runs(source, run_id, seq, status) -> (jobId, state).

    Closed: expired, or absent from two complete consecutive runs of its source since it was first seen; stale: not
    seen for ``stale_hours``. Runs that are not complete never count.
    """
    facts = runs.select("source", "run_id", F.col("seq").alias("_seq"), (F.col("status") == "complete").alias("_done"))
    keys = sightings.join(facts.hint("merge"), ["source", "run_id"]).groupBy("jobId", "source").agg(F.max("seenAt").alias("seenAt"), F.max("validThrough").alias("validThrough"), F.min("_seq").alias("_first"), F.max(F.when(F.col("_done"), F.col("_seq"))).alias("_last"))
    # the last but one complete run of a source: a job last seen before it, but known by then, missed two in a row
    back = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("seq")))
    second = runs.where("status = 'complete'").withColumn("_r", back).where("_r = 2").select("source", F.col("seq").alias("_two"))
    gone = (F.col("_two") >= F.col("_first")) & (F.coalesce("_last", F.col("_first") - 1) < F.col("_two"))
    j = keys.join(second.hint("merge"), "source", "left").withColumn("gone", gone)
    at = F.lit(now).cast("timestamp_ntz")
    closed = F.coalesce("gone", F.lit(False)) | F.coalesce(F.col("validThrough") < at, F.lit(False))
    return j.select("jobId", "source", F.when(closed, "closed").when(F.col("seenAt") < at - F.expr(f"INTERVAL {stale_hours} HOURS"), "stale").otherwise("active").alias("state"))


def resolve_duplicates(df: DataFrame, key: str, equal: list[list[str]], similar: str | None = None, percent: int = 80) -> DataFrame:
    """(key, group): rows joined by equality on any of the column lists (all not null), and by five-word shingles of the
    text ``similar`` at a Jaccard similarity of ``percent``; group is the smallest key.

    Every value group is a star around its smallest key. The leg of similar texts is exact: see ``similar_links``.
    """
    keys = stored(df.select(key, *dict.fromkeys(c for cols in equal for c in cols if c != key)), "duplicate-keys")  # each leg reads them twice
    edges = keys.select(F.col(key).alias("u"), F.col(key).alias("v")).limit(0)
    for cols in equal:
        full = keys.dropna(subset=cols).select(key, *cols)
        star = full.groupBy(*cols).agg(F.min(key).alias("hub"))
        edges = edges.unionByName(full.join(star.hint("merge"), cols).select(F.col(key).alias("u"), F.col("hub").alias("v")))
    if similar:
        edges = edges.unionByName(similar_links(df, key, similar, percent))
    found = components(edges)
    own = keys.select(F.col(key).alias("node")).distinct()
    return own.join(found.hint("merge"), "node", "left").select(F.col("node").alias(key), F.coalesce("label", "node").alias("group"))


#: Different sets whose shingles are counted to order them, about, and shingles that come last for it at most.
SAMPLE_SETS, COMMON = 8192, 200_000
#: Bits of a set's parities.
BITS = 2048


def _among(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of sets whose u is one of ids. Where these are many, a bitmap of 2^25 bits, 4 MB whatever their number,
    leaves out most other rows before the exchange."""
    if is_small(ids):
        return sets.join(F.broadcast(ids), "u", "left_semi")
    spot = lambda df: df.withColumn("_p", F.pmod(F.xxhash64("u"), F.lit(1 << 25))).withColumn("_b", F.shiftright("_p", 15)).withColumn("_p", F.col("_p") % 32768)
    bits = spot(ids).groupBy("_b").agg(F.bitmap_construct_agg("_p").alias("_m"))
    one = F.conv(F.hex(F.substring("_m", (F.floor(F.col("_p") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    near = spot(sets).join(F.broadcast(bits), "_b").where(F.floor(one / F.pow(F.lit(2), F.col("_p") % 8)) % 2 == 1)
    return near.select(*sets.columns).join(ids.hint("merge"), "u", "left_semi")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, s) -> (u, n, b): of each set the parities of its shingles' numbers in BITS classes. Two sets differ in at least
    as many shingles as their parities in bits."""
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            n = pc.list_value_length(part.column(1)).to_numpy()
            x = part.column(1).flatten().to_numpy()
            odd = np.bincount(np.repeat(np.arange(len(n)), n) * BITS + (x & (BITS - 1)), minlength=len(n) * BITS) & 1
            b = np.packbits(odd.astype(np.uint8).reshape(len(n), BITS), axis=1)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int32()), pa.array([r.tobytes() for r in b], pa.binary())], names=["u", "n", "b"])


def _close(percent: int):
    """(u, v, n, m, b, c) -> (u, v): the pairs whose sizes n, m and parities b, c leave the similarity possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m, b, c = (batch.column(i) for i in range(2, 6))
            bits = [np.frombuffer(b"".join(a.to_pylist()), np.uint64).reshape(-1, BITS // 64) for a in (b, c)]
            apart = np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64)
            keep = (100 + percent) * apart <= (100 - percent) * (n.to_numpy().astype(np.int64) + m.to_numpy())
            yield batch.select([0, 1]).filter(pa.array(keep))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (u, v) of pairs whose whole sets reach the similarity. Parities leave out most others before whole sets, of what
    pairs are left only, are exchanged."""
    key = sets.schema["u"].dataType.simpleString()
    ids = lambda p: stored(p.select(F.explode(F.array("u", "v")).alias("u")).distinct(), "paired")
    pairs = stored(pairs, "pairs")
    told = stored(_among(sets, ids(pairs)).select("u", "s").mapInArrow(_signatures, f"u {key}, n int, b binary"), "parities")
    both = pairs.join(told.hint("merge"), "u").join(told.toDF("v", "m", "c").hint("merge"), "v").select("u", "v", "n", "m", "b", "c")
    pairs = stored(both.mapInArrow(_close(percent), f"u {key}, v {key}").distinct(), "close-pairs")
    some = stored(_among(sets, ids(pairs)).select("u", "s"), "paired-shingles")
    both = pairs.join(some.hint("merge"), "u").join(some.toDF("v", "t").hint("merge"), "v")
    both = both.withColumn("_o", F.size(F.array_intersect("s", "t")))
    return both.where(100 * F.col("_o") >= percent * (F.size("s") + F.size("t") - F.col("_o"))).select("u", "v")


def _prefixes(common: np.ndarray, rank: np.ndarray, percent: int):
    """(h, n, s) -> (x, h, n, place): the shingles of each set that links are looked for on, and their places in its order:
    by rank, 0 for those that aren't common, then by hash, as s is sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                h, n, x = part.column(0).to_numpy(), part.column(1).to_numpy(), part.column(2).flatten().to_numpy()
                row = np.repeat(np.arange(len(n)), n)
                if len(common):
                    spot = np.minimum(np.searchsorted(common, x), len(common) - 1)
                    r = np.where(common[spot] == x, rank[spot], 0)
                    x = x[np.lexsort((r, row))]
                place = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                first = n - (n.astype(np.int64) * percent + 99) // 100 + 1
                keep = place < first[row]
                row, x, place = row[keep], x[keep], place[keep]
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(h[row]), pa.array(n[row], pa.int32()), pa.array(place, pa.int32())], names=["x", "h", "n", "place"])

    return run


def similar_links(df: DataFrame, key: str, text: str, percent: int = 80, words: int = 5) -> DataFrame:
    """(u, v): verified links whose components are those of all links between texts' shingle sets.

    Equal sets are one, told by a 64-bit hash. Shingles are ordered by hash, those that are common among a sample of the
    sets last; two sets that reach the similarity share one within the first (100 - percent) % of each, in any order, so
    the sample decides how much work there is, not what is found. Rows meet on those shingles only. First each list's
    rows are compared with one of them, which joins groups of near copies in linear work; then lists that still hold
    several components compare rows of different ones, within bounds that sizes and places set. Whole sets are written
    once, and exchanged only for pairs.
    """
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("u"), w.alias("w")).where(F.size("w") > 0)
    spots = F.sequence(F.lit(1), F.greatest(F.size("w") - words + 1, F.lit(1)))
    s = F.array_distinct(F.transform(spots, lambda i: F.xxhash64(F.slice("w", i, words))))
    sets = stored(once(rows, s=F.array_sort(s)).select("u", "s", F.size("s").alias("n"), F.xxhash64("s").alias("h")), "shingles")
    same = stored(sets.groupBy("h").agg(F.min("u").alias("v")), "distinct-shingles")
    copies = sets.select("u", "h").join(same.hint("merge"), "h").where("u <> v").select("u", "v")

    sample = same.where(F.pmod("h", F.lit(same.count() // SAMPLE_SETS + 1)) == 0).select("h", F.col("v").alias("u"))
    often = sets.join(F.broadcast(sample), ["u", "h"], "left_semi").select(F.explode("s").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("c")).where("c > 2")
    common = often.orderBy(F.desc("c"), "x").limit(COMMON).toArrow().sort_by("x")
    told = sets.select("h", "n", "s").mapInArrow(_prefixes(common["x"].to_numpy(), common["c"].to_numpy(), percent), "x long, h long, n int, place int")
    one = told.repartition("x").groupBy("x", "h").agg(F.first("n").alias("n"), F.first("place").alias("place"))  # copies tell the same
    of = Window.partitionBy("x")
    met = one.withColumn("hub", F.min(F.struct("h", "n", "place")).over(of)).withColumn("_m", F.max("h").over(of)).where("hub.h <> _m")
    lists = stored(met.drop("_m"), "prefixes")

    def alike(m, at):
        sizes = 100 * F.least("n", m) >= percent * F.greatest(F.col("n"), m)
        return sizes & ((100 + percent) * F.least(F.col("n") - F.col("place"), m - at) >= percent * (F.col("n") + m))

    pairs = lists.where((F.col("h") != F.col("hub.h")) & alike(F.col("hub.n"), F.col("hub.place"))).select("h", F.col("hub.h").alias("g")).distinct()
    ends = pairs.join(same.withColumnRenamed("v", "u").hint("merge"), "h").join(same.withColumnRenamed("h", "g").hint("merge"), "g").select("u", "v")
    links = stored(copies.unionByName(_verified(ends, sets, percent)), "star-links")

    labels = components(links).select(F.col("node").alias("u"), "label")
    keyed = lists.select("x", "h", "n", "place").join(same.withColumnRenamed("v", "u").hint("merge"), "h").drop("h")
    told = stored(keyed.join(labels.hint("merge"), "u", "left").withColumn("label", F.coalesce("label", "u")), "labelled-prefixes")
    dropped(lists)
    several = told.groupBy("x").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("x")
    one = stored(told.join(several.hint("merge"), "x", "left_semi"), "mixed-prefixes")
    other = one.select("x", F.col("u").alias("v"), F.col("n").alias("m"), F.col("place").alias("at"), F.col("label").alias("other"))
    pairs = one.join(other.hint("merge"), "x").where((F.col("u") < F.col("v")) & (F.col("label") != F.col("other")) & alike(F.col("m"), F.col("at")))
    return links.unionByName(_verified(pairs.select("u", "v").distinct(), sets, percent))


def funnel_metrics(events: DataFrame) -> DataFrame:
    """events(user, item, kind in save|undo|draft, ts) -> saved, useful (not undone within a day), drafted (within 7 days)."""
    at = lambda k, name: F.min(F.when(F.col("kind") == k, F.col("ts"))).alias(name)
    first = events.groupBy("user", "item").agg(at("save", "s"))
    j = events.join(first.where("s IS NOT NULL"), ["user", "item"]).where("ts >= s")
    per = j.groupBy("user", "item", "s").agg(at("undo", "u"), at("draft", "d"))
    useful = F.coalesce(F.col("u") > F.col("s") + F.expr("INTERVAL 24 HOURS"), F.lit(True))
    drafted = F.coalesce(F.col("d") <= F.col("s") + F.expr("INTERVAL 7 DAYS"), F.lit(False))
    return per.agg(F.count(F.lit(1)).alias("saved"), F.count_if(useful).alias("useful"), F.count_if(drafted).alias("drafted"))


def affinity_scores(swipes: DataFrame, attributes: list[str], right: float = 1.0, left: float = -0.25, bound: float = 5.0) -> DataFrame:
    """(user, attribute, value, score): bounded sums over right and left swipes."""
    one = F.explode(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes))).alias("x")
    long = swipes.select("user", "direction", one).select("user", "direction", "x.attribute", "x.value").where("value IS NOT NULL")
    points = F.when(F.col("direction") == "right", right).otherwise(left)
    return long.groupBy("user", "attribute", "value").agg(F.greatest(F.lit(-bound), F.least(F.lit(bound), F.sum(points))).alias("score"))


WEIGHTS = {"semantic": 35.0, "skills": 25.0, "preferences": 15.0, "freshness": 15.0, "affinity": 10.0}


def composite_score(pairs: DataFrame, seen: DataFrame, top_k: int, explore: float = 0.15) -> DataFrame:
    """pairs(user, jobId, the five parts in 0..1) without seen ones -> each user's list (user, jobId, score, slot).

    The best fill all but a share of the slots; that share goes to others, by hash of the pair.
    """
    score = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    rows = pairs.join(seen.select("user", "jobId"), ["user", "jobId"], "left_anti").withColumn("score", F.round(score, 6))
    best, more = top_k - round(top_k * explore), round(top_k * explore)
    rank = F.row_number().over(Window.partitionBy("user").orderBy(F.desc("score"), "jobId"))
    ranked = rows.withColumn("_r", rank).withColumn("slot", F.when(F.col("_r") <= best, "best").otherwise("explore"))
    inner = F.row_number().over(Window.partitionBy("user", "slot").orderBy(F.sha2(F.concat_ws(":", "user", "jobId"), 256)))
    return ranked.withColumn("_x", inner).where((F.col("slot") == "best") | (F.col("_x") <= more)).select("user", "jobId", "score", "slot")


def bucket_facets(df: DataFrame, pay: str, posted: str, now: str, step: int = 50_000, top: int = 5) -> DataFrame:
    """(facet, bucket, count): pay ranges, posted ages, and the jobs outside the commonest pay ranges."""
    age = F.timestamp_diff("DAY", F.col(posted), F.lit(now).cast("timestamp_ntz"))
    days = F.when(age <= 7, "0-7").when(age <= 30, "8-30").when(age <= 90, "31-90").otherwise("90+")
    lows = F.coalesce((F.floor(F.col(pay) / step) * step).cast("long").cast("string"), F.lit("unknown"))
    counts = df.select(F.explode(F.array(F.struct(F.lit("pay").alias("facet"), lows.alias("bucket")), F.struct(F.lit("age").alias("facet"), days.alias("bucket")))).alias("x")).groupBy("x.facet", "x.bucket").agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), "bucket"))
    ranked = counts.withColumn("_r", rank)
    rest = ranked.where(F.col("_r") > top).groupBy("facet").agg(F.sum("count").alias("count")).select("facet", F.lit("(others)").alias("bucket"), "count")
    return ranked.where(F.col("_r") <= top).select("facet", "bucket", "count").unionByName(rest)


def haversine_km(lat1, lon1, lat2, lon2):
    """Great-circle distance of two points in degrees."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * 6371.0088 * F.asin(F.sqrt(a))
