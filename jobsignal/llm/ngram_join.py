"""N-gram Jaccard join: size-aware heavy-light join over word-shingle sets, exact up to 64-bit shingle hashes.

Small sets (at most ``x`` shingles) enumerate fixed-size subsets: two sets reach the threshold only if they share a
subset of the needed overlap, and within one subset's group every set is linked by a star from the smallest one, so a
group of any size costs its own length. Large sets scan inverted lists of their prefix shingles; lists are split into
blocks, and a parity bitmap bounds the symmetric difference from below before any set is fetched. ``x`` is the size
at which the counted cost of subsets passes that of lists. Equal sets are one node from the start.

Defined results: null or empty texts have no shingles and link with nothing; fewer words than ``k`` make one shingle;
repeated rows and ties fall into one class whose id is the smallest doc_id; a null doc_id takes the component of its
text's class (null if no row there has an id); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesets import mix, shingle_rows
from .shared import columns_of, components, dropped, fresh, pieces, small_or_merge, written

#: Largest set that may enumerate subsets, and the most subsets one set may make.
SUBSET_SET, SUBSET_KEYS = 28, 400
#: Rows of an inverted list compared in one block; parity bits of a bitmap.
LIST_BLOCK, BITMAP_WORDS = 256, 8
#: A shingle in the prefix of so many sets moves to the end of the order; at most so many of them are named.
HEAVY_SETS, HEAVY_NAMED = 64, 100_000
_U = np.uint64
#: Sets above so many shingles carry counts of their shingles in so many buckets, for a second bound on each pair.
BUCKETS_ABOVE, BUCKETS = 256, 512
_DIGEST = "doc_id long, th long, n int, h1 long, h2 long, bits binary, buckets binary, prefix array<long>"


def needed(a, b, percent: int):
    """Least overlap at which sets of a and b elements reach the threshold."""
    return -(-percent * (a + b) // (100 + percent))


def _digests(k: int, percent: int, heavy: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            n, h1, h2, bits, buckets, prefix, lens = [], [], [], [], [], [], [0]
            for _, u in shingle_rows(batch.column(2), k):
                m = len(u)
                n.append(m)
                h1.append(u.sum(dtype=_U))
                h2.append(mix(u ^ _U(0x2545F4914F6CDD1D)).sum(dtype=_U))
                par = np.bincount((u % _U(64 * BITMAP_WORDS)).astype(np.int64), minlength=64 * BITMAP_WORDS) & 1
                bits.append(np.packbits(par.astype(np.uint8)).tobytes())
                held = np.minimum(np.bincount((u % _U(BUCKETS)).astype(np.int64), minlength=BUCKETS), 255) if m > BUCKETS_ABOVE else None
                buckets.append(None if held is None else held.astype(np.uint8).tobytes())
                p = m if m <= SUBSET_SET else m - (percent * m + 99) // 100 + 1
                if len(heavy) and m:
                    i = np.minimum(np.searchsorted(heavy, u), len(heavy) - 1)
                    late = heavy[i] == u
                    u = np.concatenate([u[~late], u[late]])
                prefix.append(u[:p].view(np.int64))
                lens.append(lens[-1] + min(p, m))
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            as_long = lambda x: pa.array(np.array(x, _U).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int32()), as_long(h1), as_long(h2), pa.array(bits, pa.binary()), pa.array(buckets, pa.binary()), pa.ListArray.from_arrays(pa.array(lens, pa.int32()), pa.array(flat))],
                names=["doc_id", "th", "n", "h1", "h2", "bits", "buckets", "prefix"],
            )

    return run


def subset_overlaps(n: int, x: int, percent: int) -> list[int]:
    """Overlaps that a set of n elements needs with any partner of at most x elements."""
    sizes = [b for b in range(1, x + 1) if 100 * min(n, b) >= percent * max(n, b)]
    return sorted({int(needed(n, b, percent)) for b in sizes})


def subset_cost(n: int, x: int, percent: int) -> int:
    return sum(comb(n, n - o) for o in subset_overlaps(n, x, percent))


def _subsets(x: int, percent: int):
    plan = {n: subset_overlaps(n, x, percent) for n in range(1, x + 1)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, n, sets = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            keys, size, who, overlap = [], [], [], []
            for i in range(len(n)):
                u = mix(np.asarray(sets[i].values.to_numpy(zero_copy_only=False)).view(_U))
                total, m = u.sum(dtype=_U), int(n[i])
                for o in plan[m]:
                    gone = [u[list(c)].sum(dtype=_U) for c in combinations(range(m), m - o)]
                    keys.append(mix((total - np.array(gone, _U)) ^ _U(o * 0x9E37)))
                    size.append(np.full(len(gone), m, np.int32))
                    who.append(np.full(len(gone), rep[i], np.int64))
                    overlap.append(np.full(len(gone), o, np.int32))
            cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0, t))
            key = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key), cat(overlap, np.int32), cat(size, np.int32), cat(who, np.int64)], names=["key", "o", "n", "rep"])

    return run


def subset_links(reps: DataFrame, x: int, percent: int) -> DataFrame:
    """Verified links among sets of at most x elements: each subset's smallest set to those that need no more overlap."""
    small = reps.where(F.col("n").between(1, x)).select("rep", "n", "prefix")
    keys = written(small.mapInArrow(_subsets(x, percent), "key long, o int, n int, rep long"), "subsets")
    first = keys.groupBy("key", "o").agg(F.min(F.struct("n", "rep")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    first = first.select("key", "o", F.col("f.n").alias("fn"), F.col("f.rep").alias("v")).hint("merge")
    hit = keys.join(first, ["key", "o"]).where(F.col("rep") != F.col("v"))
    hit = hit.where((100 + percent) * F.col("o") >= percent * (F.col("n") + F.col("fn")))
    return hit.select(F.least("rep", "v").alias("u"), F.greatest("rep", "v").alias("v"))


def _pairs(x: int, percent: int, labelled: bool):
    """Kernel over (token, i, j) groups that lie together: pairs that sizes and bitmaps let pass.

    Without labels: (u, v) of a spanning forest of the passing pairs by bitmap distance, and (u, null) for each node
    of a passing pair outside the forest. With labels: every passing pair whose labels differ.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(a: int) -> int:
            while (b := up.get(a, a)) != a:
                up[a] = up.get(b, b)
                a = b
            return a

        def of(t: pa.Table) -> Iterator[pa.RecordBatch]:
            if not t.num_rows:
                return
            col = {c: t[c].combine_chunks() for c in t.column_names}
            tok, bi, bj, own, rep, n = (col[c].to_numpy() for c in ("token", "bi", "bj", "own", "rep", "n"))
            lab = col["label"].to_numpy() if labelled else None
            bits = np.frombuffer(b"".join(col["bits"].to_pylist()), _U).reshape(-1, BITMAP_WORDS)
            new = np.ones(len(tok), bool)
            new[1:] = (tok[1:] != tok[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1])
            g = np.cumsum(new)
            us, vs, ds = [], [], []
            i = np.arange(len(tok))
            d = 1
            while len(i := i[i + d < len(tok)]) and len(i := i[g[i] == g[i + d]]):
                j = i + d
                a, b = n[i], n[j]
                ok = (100 * np.minimum(a, b) >= percent * np.maximum(a, b)) & (np.maximum(a, b) > x) & (rep[i] != rep[j])
                ok &= (bi[i] == bj[i]) | (own[i] != own[j])
                if labelled:
                    ok &= lab[i] != lab[j]
                p, q = i[ok], j[ok]
                if len(p):
                    far = np.bitwise_count(bits[p] ^ bits[q]).sum(1)
                    a, b = n[p].astype(np.int64), n[q].astype(np.int64)
                    near = far <= a + b - 2 * needed(a, b, percent)
                    us.append(np.minimum(rep[p], rep[q])[near])
                    vs.append(np.maximum(rep[p], rep[q])[near])
                    ds.append(far[near])
                d += 1
            if not us or not sum(map(len, us)):
                return
            uv = np.stack([np.concatenate(us), np.concatenate(vs)], 1)
            uv, at = np.unique(uv, axis=0, return_index=True)
            if not labelled:
                order = np.argsort(np.concatenate(ds)[at], kind="stable")
                keep, rest = [], set()
                for k, (u, v) in zip(order.tolist(), uv[order].tolist()):
                    a, b = root(u), root(v)
                    if a != b:
                        up[max(a, b)] = min(a, b)
                        keep.append(k)
                    else:
                        rest |= {u, v}
                uv = uv[keep]
                if rest:
                    r = pa.array(sorted(rest), pa.int64())
                    yield pa.RecordBatch.from_arrays([r, pa.nulls(len(r), pa.int64())], names=["u", "v"])
            yield pa.RecordBatch.from_arrays([pa.array(uv[:, 0]), pa.array(uv[:, 1])], names=["u", "v"])

        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            tok, bi, bj = (t[c].to_numpy() for c in ("token", "bi", "bj"))
            last = np.flatnonzero((tok != tok[-1]) | (bi != bi[-1]) | (bj != bj[-1])) if len(tok) else []
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield from of(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield from of(rest)

    return run


def _listed(entries: DataFrame, facts: DataFrame, x: int, percent: int, labelled: bool) -> DataFrame:
    """Entries (token, c, rep) dealt to blocks of their lists and compared there; facts: (rep, n, bits[, label])."""
    blocks = F.ceil(F.col("c") / LIST_BLOCK).cast("int")
    e = entries.withColumn("nb", blocks).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("nb")).cast("int"))
    e = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    e = e.select("token", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "own", "rep")
    e = e.join(facts.hint("merge"), "rep")
    e = e.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj")
    return e.mapInArrow(_pairs(x, percent, labelled), "u long, v long")


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            us = [u.view(np.int64) for _, u in shingle_rows(batch.column(1), k)]
            lens = np.concatenate([[0], np.cumsum([len(u) for u in us])]).astype(np.int32)
            flat = pa.array(np.concatenate(us) if us else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(lens), flat)], names=["rep", "s"])

    return run


def _bucketed(percent: int):
    """(u, v, n, m, a, b) -> (u, v) of the pairs whose bucket counts differ no more than the threshold allows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u, v, n, m, a, b = batch.columns
            total = n.to_numpy().astype(np.int64) + m.to_numpy()
            both = np.array([x.is_valid and y.is_valid for x, y in zip(a, b)], bool)
            ok = np.ones(len(total), bool)
            x, y = (np.frombuffer(b"".join(c.filter(pa.array(both)).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16) for c in (a, b))
            ok[both] = np.abs(x - y).sum(1) <= (total - 2 * needed(total, 0, percent))[both]
            yield pa.RecordBatch.from_arrays([u.filter(pa.array(ok)), v.filter(pa.array(ok))], names=["u", "v"])

    return run


def verified(pairs: DataFrame, docs: DataFrame, facts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose whole sets reach the threshold; only the texts of documents in a pair are hashed again."""
    a = facts.select(F.col("rep").alias("u"), "n", F.col("buckets").alias("a")).hint("merge")
    b = facts.select(F.col("rep").alias("v"), F.col("n").alias("m"), F.col("buckets").alias("b")).hint("merge")
    pairs = pairs.distinct().join(a, "u").join(b, "v").select("u", "v", "n", "m", "a", "b")
    pairs = written(pairs.mapInArrow(_bucketed(percent), "u long, v long").distinct(), "pairs")
    nodes = pairs.select(F.col("u").alias("doc_id")).union(pairs.select("v")).distinct()
    texts = docs.select("doc_id", "text").join(small_or_merge(nodes), "doc_id", "left_semi")
    # repeated ids keep every text's set; a pair counts if any of them reaches the threshold
    sets = written(texts.mapInArrow(_sets(k), "rep long, s array<long>"), "sets")
    a = sets.select(F.col("rep").alias("u"), F.col("s").alias("a")).hint("merge")
    b = sets.select(F.col("rep").alias("v"), F.col("s").alias("b")).hint("merge")
    both = pairs.join(a, "u").join(b, "v").withColumn("o", F.size(F.array_intersect("a", "b")))
    links = written(both.where(100 * F.col("o") >= percent * (F.size("a") + F.size("b") - F.col("o"))).select("u", "v"), "links")
    dropped(sets)
    dropped(pairs)
    return links


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_shingles, component_id, boundary), one row per row of docs.

    Links join documents whose distinct k-word shingle sets have 100 * intersection >= percent * union.
    """
    return _labelled(docs, k, percent)[0].select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "boundary")


def _labelled(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows (doc_id, th, n, h1, h2, component_id, boundary), the written tables that they come from)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    heavy = np.zeros(0, _U)
    digest = written(docs.mapInArrow(_digests(k, percent, heavy), _DIGEST), "digest")
    classes = digest.where("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    classes = written(classes, "classes")

    def representatives(d: DataFrame) -> DataFrame:
        r = classes.where("rep is not null").select(F.col("rep").alias("doc_id"), "h1", "h2", "n").hint("merge")
        return d.join(r, ["doc_id", "h1", "h2", "n"]).dropDuplicates(["doc_id", "h1", "h2"]).withColumnRenamed("doc_id", "rep")

    def entries_of(r: DataFrame) -> DataFrame:
        m = F.col("n") - F.ceil(percent * F.col("n") / 100).cast("int") + 1
        return r.select("rep", "n", F.explode(F.slice("prefix", 1, m)).alias("token"))

    reps = written(representatives(digest), "reps")
    counts = written(entries_of(reps).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")
    named = [r.token for r in counts.where(F.col("c") >= HEAVY_SETS).orderBy(F.desc("c"), "token").limit(HEAVY_NAMED).select("token").collect()]
    if named:  # the order of shingles is free, so naming only some of them loses nothing
        heavy = np.sort(np.array(named, np.int64).view(_U))
        only = classes.where("rep is not null").select(F.col("rep").alias("doc_id")).hint("merge")
        again = docs.join(only, "doc_id", "left_semi").mapInArrow(_digests(k, percent, heavy), _DIGEST)
        dropped(reps)
        reps = written(representatives(again), "reps")
        dropped(counts)
        counts = written(entries_of(reps).groupBy("token").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "counts")

    # the boundary: at most SUBSET_SET + 1 counted sizes and the mean length that a scanned list entry meets
    sizes = {r.n: r.c for r in reps.where(F.col("n") <= SUBSET_SET).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    met = counts.agg(F.sum(F.col("c") * F.col("c")) / F.sum("c")).first()[0] or 1.0

    def cost(x: int) -> float:
        lists = sum(c * (n - (percent * n + 99) // 100 + 1) * (1 + met) for n, c in sizes.items() if 100 * n > percent * x)
        return sum(c * subset_cost(n, x, percent) for n, c in sizes.items() if n <= x) + lists

    open_x = [x for x in range(SUBSET_SET + 1) if all(subset_cost(n, x, percent) <= SUBSET_KEYS for n in range(1, x + 1))]
    x = min(open_x, key=lambda x: (cost(x), x))

    found = []
    if x:
        found.append(written(subset_links(reps, x, percent), "subset-links"))
    large = entries_of(reps).where(100 * F.col("n") > percent * x)
    entries = written(large.join(counts.hint("merge"), "token").select("token", "c", "rep"), "entries")
    facts = reps.select("rep", "n", "bits")
    first = written(_listed(entries, facts, x, percent, False), "forest")
    found.append(verified(first.where("v is not null"), docs, reps, k, percent))
    links = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    links = written(links.distinct(), "links")
    comp = components(links)

    # pairs outside the forest: only those that its verified links have not joined yet
    open_nodes = first.where("v is null").select(F.col("u").alias("rep")).distinct()
    if not open_nodes.isEmpty():
        some = entries.join(small_or_merge(open_nodes), "rep", "left_semi")
        lab = facts.join(comp.select(F.col("node").alias("rep"), "label").hint("merge"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        late = written(_listed(some, lab, x, percent, True), "late")
        if not late.isEmpty():
            more = verified(late, docs, reps, k, percent)
            dropped(comp)
            comp = components(links.unionByName(more))
        dropped(late)
    for t in (entries, first, counts, reps, links, *found):
        dropped(t)

    # a label per class, then the rows of each class: the one join whose key may be hot is last, where it can be split
    of = classes.join(comp.hint("merge"), classes.rep == comp.node, "left").select("h1", "h2", F.coalesce("label", "rep").alias("component_id"))
    out = digest.select("doc_id", "th", "n", "h1", "h2").join(of.hint("merge"), ["h1", "h2"], "left")
    return out.select("doc_id", "th", "n", "h1", "h2", "component_id", F.lit(x).alias("boundary")), [digest, classes, comp]


def near_duplicates_kept(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component, with its columns: that of the smallest doc_id (none is last), then text hash.

    Rows without any word are copies of nothing but rows of the same id and text; repeated rows leave one.
    """
    did, th = fresh(docs.columns, "_did", "_th")
    last = (1 << 63) - 1
    rows, tables = _labelled(docs, k, percent)
    own = F.coalesce("doc_id", F.lit(last))
    kind = F.when(F.col("n") == 0, 0).when(F.col("component_id").isNull(), 1).otherwise(2)
    a = F.when(F.col("n") == 0, own).otherwise(F.coalesce("component_id", "h1"))
    b = F.when(F.col("n") == 0, F.col("th")).when(F.col("component_id").isNull(), F.col("h2")).otherwise(0)
    keep = rows.groupBy(kind.alias("kind"), a.alias("a"), b.alias("b")).agg(F.min(F.struct(own.alias("did"), "th")).alias("r"))
    keep = written(keep.select(F.col("r.did").alias(did), F.col("r.th").alias(th)), "kept")
    for t in tables:
        dropped(t)
    # one exchange by both serves the join and the repeated rows
    named = docs.withColumn(did, F.coalesce(F.col("doc_id").cast("long"), F.lit(last))).withColumn(th, F.xxhash64("text"))
    return named.dropDuplicates([did, th]).join(keep.hint("merge"), [did, th], "left_semi").select(*columns_of(docs.columns))


__all__ = ["jaccard_components", "near_duplicates_kept", "needed", "subset_cost", "subset_overlaps"]
