"""Training-corpus pipeline: quality classifier, line dedup, near-duplicate join, source mixing, packing.

All stages take odd rows as their operators do: null texts count as empty ones, null ids and sources are kept apart from
all others, extra columns stay whatever their names (the last stage returns pieces only), and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobsignal.llm import line_dedup, mixing, ngram_join, packing, quality
from jobsignal.llm.queries import table, tokenizer_path
from jobsignal.llm.shared import written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. Null and empty texts are scored like any other and go if
    they fall below the threshold; repeated rows share their fate; without labelled rows every score is 0.5 and goes."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier line, or lie within one edit of one, go; documents left without any word by that go
    with them. Null and empty texts have no lines and stay; repeated rows share their fate; ties don't arise, as lines
    are ordered by (doc_id, text hash, line number), null ids last."""
    return line_dedup.keep_first_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a Jaccard similarity of 0.8: that of the smallest id,
    then text hash. Texts without words stay, once per id; repeated rows leave one; of texts without an id that are
    equal in words one stays."""
    return ngram_join.near_duplicates_kept(docs, k=5, percent=80)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents left out, cut at the end of the mix, or returned twice, in the order
    of the schedule's slots. Texts without words take no slot and go; repeated rows are documents each."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, filled in the order of the mix. An empty text is its end token alone; repeated
    rows are packed once each."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", lines_once),
    ("ngram_jaccard_join", near_duplicates),
    ("mix_sources", source_mix),
    ("harmonic_packing", packed),
]

#: The stages rest on trained models, tokenizers and similarity joins, which SQL doesn't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
