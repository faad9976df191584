"""Line dedup: lines equal or within one edit of an earlier line are removed, by a deletion-neighbourhood join.

A line is compared after stripping ASCII white space and lower-casing A-Z. Distinct lines keep their earliest
occurrence in (doc_id, text hash, line number) order. A line of any length also goes if an earlier one lies within one
insertion, deletion or substitution (``min_chars`` exempts lines below a length, of which none are by default). Every
surviving candidate emits the hashes of its one-character deletions with their positions: equal variants at equal
positions are substitutions, a variant equal to a whole line is an insertion. The earliest partner by each variant is
then verified by edit distance on the texts; a line goes if any of its partners passes. Only lines that share half of
their characters with another line emit variants, which loses nothing: one edit leaves one half untouched. A line's
variants leave its task in slices, so a text that is one very long line is held once and no more.

Defined results: null and empty texts have no lines and stay; blank lines are never removed; repeated rows (same
doc_id and text) share their fate; null doc_ids come last in the order; an empty table gives an empty table. Columns of
the input stay as they are, whatever their names; where one of them has the name of an added column, that gets more
underscores in front.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesets import mix, powers, slices
from .shared import columns_of, dropped, fresh, pieces, plain_named, small_or_merge, written

_U = np.uint64
_LEN = _U(0xA24BAED4963EE407)
_LAST = (1 << 63) - 1
_SPACES = (0x20, *range(0x09, 0x0E))
_ASCII = np.arange(128, dtype=np.uint32)
_ASCII[65:91] += 32
_IS_SPACE = np.zeros(128, bool)
_IS_SPACE[list(_SPACES)] = True


class Lines:
    """Stripped, lower-cased lines of a slice of texts as spans of code points, with prefix sums for their hashes."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        lead = (data & 0xC0) != 0x80
        cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        if len(cp) != int(lead.sum()):
            raise ValueError("a text is not valid UTF-8")
        at = np.concatenate([[0], np.cumsum(lead)])[off]  # code point offsets of rows
        low = cp < 128
        cp = np.where(low, _ASCII[np.where(low, cp, 0)], cp)
        nl = np.flatnonzero(cp == 10)
        s = np.sort(np.concatenate([at[:-1], nl + 1]))
        e = np.concatenate([s[1:] - 1, [len(cp)]]) if len(s) else s
        ends = np.zeros(len(s), bool)
        if len(s):
            ends[:-1] = ~np.isin(s[1:] - 1, nl)
            e[:-1][ends[:-1]] = s[1:][ends[:-1]]
        self.cp = cp
        ink = np.flatnonzero(~(low & _IS_SPACE[np.where(low, cp, 0)]))
        i, j = np.searchsorted(ink, s), np.searchsorted(ink, e)
        full = j > i
        pad = np.concatenate([ink, [0]])
        self.a = np.where(full, pad[np.minimum(i, len(ink))], s)
        self.b = np.where(full, pad[np.maximum(j - 1, 0)] + 1, s)
        p, self.q = powers(len(cp) + 2)
        self.c = np.zeros(len(cp) + 1, _U)
        np.cumsum(mix(cp.astype(_U) + _U(1)) * p[: len(cp)], out=self.c[1:])

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.c[b] - self.c[a]) * self.q[a] + (b - a).astype(_U) * _LEN)

    def variants(self, a: int, b: int, lo: int, hi: int) -> np.ndarray:
        """Hashes of the line without its i-th character, for each i from lo to hi."""
        i = np.arange(a + lo, min(b, a + hi))
        left = (self.c[i] - self.c[a]) * self.q[a]
        return mix(left + (self.c[b] - self.c[i + 1]) * self.q[a + 1] + np.array([b - a - 1], _U) * _LEN)


def row_lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _slice_lines(texts: pa.Array) -> Iterator[tuple[Lines, np.ndarray, np.ndarray]]:
    """(lines, row of each, number within its row) for each slice."""
    for first, data, off in slices(texts):
        x = Lines(data, off)
        count = np.add.reduceat(np.concatenate([data == 10, [False]]).astype(np.int64), np.minimum(off[:-1], len(data))) if len(off) > 1 else np.zeros(0, np.int64)
        count = np.where(np.diff(off) > 0, count, 0) + 1
        row = np.repeat(np.arange(len(off) - 1), count)
        start = np.cumsum(count) - count
        yield x, first + row, np.arange(len(row)) - start[row]


def _occurrences(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for x, row, no in _slice_lines(batch.column(2)):
                n = x.b - x.a
                full = n > 0
                a, b, n, row, no = x.a[full], x.b[full], n[full], row[full], no[full]
                low, high = (n - 1) // 2, (n + 1) // 2
                long_keys = []
                for tag, s, e in ((1, a, a + low), (1, a, a + high), (2, b - n // 2, b), (2, b - high, b)):
                    k = mix(x.hashes(s, e) ^ _U(tag)).view(np.int64)
                    long_keys.append(pa.array(k, mask=n < min_chars))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did[row]), pa.array(th[row]), pa.array(no.astype(np.int32)), pa.array(x.hashes(a, b).view(np.int64)), pa.array(n.astype(np.int32)), *long_keys],
                    names=["did", "th", "no", "lh", "n", "k1", "k2", "k3", "k4"],
                )

    return run


#: Variants that leave a task at once.
VARIANT_ROWS = 1 << 16


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(did, th, text, nos) -> of each line in nos its whole row (pos -1, with its text) and its deletions."""
    for batch in pieces(batches):
        texts, nos = batch.column(2), batch.column(3).to_pylist()
        for x, row, no in _slice_lines(texts):
            wanted = [set(v) for v in nos]
            vh, pos, lh, line, held = [], [], [], [], 0

            def taken() -> pa.RecordBatch:
                longs = (pa.array(np.concatenate(c).view(np.int64)) for c in (vh, lh))
                out = [next(longs), pa.array(np.concatenate(pos)), next(longs), pa.array(line, pa.string())]
                for c in (vh, pos, lh, line):
                    c.clear()
                return pa.RecordBatch.from_arrays(out, names=["vh", "pos", "lh", "line"])

            for k, (r, i) in enumerate(zip(row.tolist(), no.tolist())):
                if i in wanted[r]:
                    a, b = int(x.a[k]), int(x.b[k])
                    whole = x.hashes(np.array([a]), np.array([b]))
                    vh.append(whole)
                    pos.append(np.array([-1], np.int32))
                    lh.append(whole)
                    line.append(x.cp[a:b].tobytes().decode("utf-32-le", "replace"))
                    for lo in range(0, b - a, VARIANT_ROWS):
                        v = x.variants(a, b, lo, lo + VARIANT_ROWS)
                        vh.append(v)
                        pos.append(np.arange(lo, lo + len(v), dtype=np.int32))
                        lh.append(np.full(len(v), whole[0]))
                        line += [None] * len(v)
                        held += len(v) + 1
                        if held >= VARIANT_ROWS:
                            yield taken()
                            held = 0
            if vh:
                yield taken()


def near_lines(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(lh) of the distinct lines that lie within one edit of an earlier one.

    docs(did, th, text); lines(lh, first(did, th, no), k1..k4), one row per distinct line.
    """
    keys = lines.select("lh", F.explode(F.array_distinct(F.array("k1", "k2", "k3", "k4"))).alias("key")).where("key is not null")
    keys = written(keys, "halves")
    shared = keys.groupBy("key").agg(F.min("lh").alias("lo"), F.max("lh").alias("hi")).where("lo <> hi").select("key").hint("merge")
    some = keys.join(shared, "key", "left_semi").select("lh").distinct()
    some = written(lines.join(some.hint("merge"), "lh", "left_semi").select("lh", "first"), "halfway")
    dropped(keys)
    by_doc = some.groupBy("first.did", "first.th").agg(F.collect_list("first.no").alias("nos"))
    by_doc = written(by_doc, "halfway-docs")
    hit = docs.join(small_or_merge(by_doc), ["did", "th"]).select("did", "th", "text", "nos")
    v = written(hit.mapInArrow(_variants, "vh long, pos int, lh long, line string"), "variants")
    dropped(by_doc)

    met = v.select("vh", "lh").groupBy("vh").agg(F.min("lh").alias("lo"), F.max("lh").alias("hi")).where("lo <> hi").select("vh").hint("merge")
    order = some.select("lh", F.struct("first.did", "first.th", "first.no", "lh").alias("o")).hint("merge")
    near = v.join(met, "vh", "left_semi").select("vh", "pos", "lh").distinct().join(order, "lh")
    near = written(near, "met")
    cut, whole = near.where("pos >= 0"), near.where("pos < 0").select("vh", F.col("lh").alias("wl"), F.col("o").alias("wo"))
    first = cut.groupBy("vh", "pos").agg(F.min("o").alias("p")).hint("merge")
    swapped = cut.join(first, ["vh", "pos"]).select("lh", "o", "p")
    grown = written(cut.join(whole.hint("merge"), "vh").select("lh", "o", "wl", "wo"), "grown")
    both = swapped.unionByName(grown.select("lh", "o", F.col("wo").alias("p"))).unionByName(grown.select(F.col("wl").alias("lh"), F.col("wo").alias("o"), F.col("o").alias("p")))
    best = written(both.where("p < o").select("lh", F.col("p.lh").alias("partner")).distinct(), "partners")
    text = v.where("pos < 0").groupBy("lh").agg(F.min("line").alias("line"))
    left = best.join(text.hint("merge"), "lh")
    right = text.select(F.col("lh").alias("partner"), F.col("line").alias("other")).hint("merge")
    pairs = left.join(right, "partner").where(F.levenshtein("line", "other", 1).between(0, 1))
    out = written(pairs.select("lh").distinct(), "near-lines")
    for t in (v, near, grown, best, some):
        dropped(t)
    return out


def _without(names: list[str], added: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            t = batch.column(names.index("text")).to_pylist()
            gone = batch.column(len(names)).to_pylist()
            near = batch.column(len(names) + 1).to_pylist()
            out, n, cut = [], [], []
            for x, g in zip(t, gone):
                lines = row_lines(x)
                n.append(0 if x is None else len(lines))
                cut.append(len(g or ()))
                if g:
                    g = set(g)
                    x = "\n".join(y for i, y in enumerate(lines) if i not in g)
                out.append(x)
            cols = [pa.array(out, batch.schema.field(i).type) if c == "text" else batch.column(i) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int64()), pa.array(cut, pa.int64()), pa.array([x or 0 for x in near], pa.int64())], names=[*names, *added])

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """docs with ``text`` cleared of repeated lines, plus ``_n_lines``, ``_n_removed`` and ``_n_near`` (long)."""
    names = docs.columns
    did, th, gone_at, near_n, *added = fresh(names, "_did", "_th", "_gone", "_near", "_n_lines", "_n_removed", "_n_near")
    rows = docs.withColumn(did, F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST))).withColumn(th, F.xxhash64("text"))
    texts = rows.select(F.col(did).alias("did"), F.col(th).alias("th"), "text")
    occ = "did long, th long, no int, lh long, n int, k1 long, k2 long, k3 long, k4 long"
    occ = written(texts.mapInArrow(_occurrences(min_chars), occ), "lines")
    keyed = [F.min(k).alias(k) for k in ("k1", "k2", "k3", "k4")]
    lines = occ.groupBy("lh").agg(F.min(F.struct("did", "th", "no")).alias("first"), F.count(F.lit(1)).alias("c"), *keyed)
    lines = written(lines, "distinct-lines")
    near = near_lines(texts, lines.where("k1 is not null"))
    marked = lines.join(near.withColumn("near", F.lit(True)).hint("merge"), "lh", "left").where("c > 1 or near").select("lh", "first", F.coalesce("near", F.lit(False)).alias("near"))
    marked = written(marked, "repeated-lines")  # dealt anew for the join, so that a very common line can be split
    hit = occ.select("did", "th", "no", "lh").join(marked.hint("merge"), "lh")
    hit = hit.where(F.col("near") | (F.struct("did", "th", "no") != F.col("first")))
    gone = hit.groupBy("did", "th").agg(F.collect_set("no").alias("gone"), F.count_if("near").cast("long").alias("near"))
    gone = written(gone.select(F.col("did").alias(did), F.col("th").alias(th), F.col("gone").alias(gone_at), F.col("near").alias(near_n)), "removed-lines")
    for t in (occ, lines, near, marked):
        dropped(t)
    out = plain_named(rows.join(gone.hint("merge"), [did, th], "left").select(*columns_of(names), gone_at, near_n))
    schema = T.StructType(list(docs.schema.fields))
    for c in added:
        schema = schema.add(c, "long")
    return out.mapInArrow(_without(names, added), schema)


def keep_first_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """The columns of docs with repeated lines removed; rows that had lines and lost all of them go."""
    out = dedup_lines(docs, min_chars)
    removed = out.columns[-2]
    left = F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) > 0
    return out.where((F.col(removed) == 0) | left).select(*columns_of(docs.columns))
