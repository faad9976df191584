"""Quality rules by tokenizer fertility: characters per token, byte-fallback share and token entropy against bands.

Two public vocabularies, one with byte fallback and one of byte-level pairs for many languages, tokenize every word of
every whole text (the second as a word after a space). For each language (the script of the text's letters where no
language is given) and size class (power of two of the word count) the corpus itself gives each measure a band around the
median, from quantiles over all documents that pass the base rules; documents outside any band go. A class's quantiles
are drawn towards its language's, and a language's towards those of all documents, as if ``PRIOR`` documents had those,
so small classes need no rule of their own.

Defined results: null and empty texts have no words and fail the base rules; languages compare exactly, null is told by
script; without a document that passes the base rules there are no bands; repeated rows each return a row; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytesets import slices
from .docstats import counts_of
from .shared import small_or_merge, written
from .wordtokens import word_measures

#: Robust standard deviations that a measure may lie from its band's median; documents that a parent's quantiles count for.
BAND, PRIOR = 5.0, 30.0
KINDS = ("chars_per_token", "byte_share", "entropy")
#: The measures of the vocabulary with byte fallback, then those of the byte-level one.
MEASURES = (*KINDS, *(f"{k}_2" for k in KINDS))
#: Least spread of each measure, so that a band of equal values is not a point.
LEAST_SPREAD = {"chars_per_token": 0.05, "byte_share": 0.005, "entropy": 0.05}
SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Han", "Hiragana", "Katakana", "Hangul", "Thai")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_FACTS = "doc_id long, lang string, " + ", ".join(f"{c} long" for c in (*COUNTS, "n_tokens", "n_tokens_2")) + ", " + ", ".join(f"{m} double" for m in MEASURES)


def _measures(piece_path: str, rank_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_measures(piece_path, rank_path)
        for batch in batches:
            texts = batch.column(2)
            parts = [c for _, c in counts_of(texts)]
            cat = lambda k: np.concatenate([p[k] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64)
            got = {k: cat(k) for k in COUNTS}
            found = [tokens.of([data[a:b].tobytes().split() for a, b in zip(off[:-1], off[1:])]) for _, data, off in slices(texts)]
            out = {}
            for v, tail in enumerate(("", "_2")):
                n, byte, ent = (np.concatenate([f[v][i] for f in found]) if found else np.zeros(0) for i in range(3))
                out |= {f"n_tokens{tail}": n.astype(np.int64), f"chars_per_token{tail}": got["word_chars"] / np.maximum(n, 1), f"byte_share{tail}": byte, f"entropy{tail}": ent}
            names = [f"n_tokens{t}" for t in ("", "_2")] + list(MEASURES)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(v) for v in got.values()), *(pa.array(out[k]) for k in names)], names=["doc_id", "lang", *COUNTS, *names])

    return run


def language(lang: Column, text: Column) -> Column:
    """The language given, else the script with the most of the text's letters."""
    counts = [F.struct(F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(SCRIPTS)]
    return F.coalesce(lang, F.array_max(F.array(*counts))["s"])


def _quantiles(facts: DataFrame, by: list[str], name: str) -> DataFrame:
    q = [F.percentile_approx(m, [0.1, 0.5, 0.9], 1000).alias(m) for m in MEASURES]
    return facts.where("not base_failed").groupBy(*by).agg(F.count(F.lit(1)).cast("double").alias("n"), *q).select(*by, F.struct("n", *MEASURES).alias(name))


def bands(facts: DataFrame) -> DataFrame:
    """(lang, size_class, band): a struct (lo, hi) per measure."""
    every = _quantiles(facts, [], "every").first()["every"]
    of_lang = written(_quantiles(facts, ["lang"], "whole"), "lang-quantiles")
    fine = _quantiles(facts, ["lang", "size_class"], "fine").join(of_lang.hint("merge"), "lang")

    def drawn(m: str, i: int) -> Column:
        n, k = F.col("fine.n"), F.col("whole.n")
        parent = (k * F.col(f"whole.{m}")[i] + PRIOR * F.lit(every[m][i] if every[m] else None)) / (k + PRIOR)
        return (n * F.col(f"fine.{m}")[i] + PRIOR * parent) / (n + PRIOR)

    def band(m: str) -> Column:
        wide = BAND * F.greatest((drawn(m, 2) - drawn(m, 0)) / 2.563, F.lit(LEAST_SPREAD[m.removesuffix("_2")]))
        return F.struct((drawn(m, 1) - wide).alias("lo"), (drawn(m, 1) + wide).alias("hi")).alias(m)

    return fine.select("lang", "size_class", F.struct(*map(band, MEASURES)).alias("band"))


def fertility_rules(docs: DataFrame, piece_path: str, rank_path: str) -> DataFrame:
    """docs(doc_id, text, lang, ...) -> counts, base_failed, the measures and kept, a row per row of docs."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language(F.col("lang"), F.coalesce("text", F.lit(""))).alias("lang"), "text")
    facts = texts.mapInArrow(_measures(piece_path, rank_path), _FACTS)
    facts = facts.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    facts = written(facts.withColumn("size_class", F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")), "fertility")
    out = facts.join(small_or_merge(written(bands(facts), "bands")), ["lang", "size_class"], "left")
    inside = F.lit(True)
    for m in MEASURES:
        inside = inside & F.coalesce(F.col(m).between(F.col(f"band.{m}.lo"), F.col(f"band.{m}.hi")), F.lit(True))
    return out.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & inside).alias("kept"), F.col("lang").alias("language"), "n_tokens", "n_tokens_2", *MEASURES)
