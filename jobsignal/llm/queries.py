"""Registered queries of the training-data operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conv_repair, fertility, license_scan, line_dedup, main_text, mixing, ngram_join, packing, pii, prefix_trie, quality, topk_search, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_near").alias("n_near"))


#: Key of the registered query only; a caller's own key makes surrogates that nobody else can draw.
PII_KEY = b"op2 registered query"


def op2_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return out.select("doc_id", "text", F.col("_n_entities").alias("n_entities"), F.col("_kinds").alias("kinds"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op3_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_tokenizer_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), tokenizer_path("byte_bpe_multi_50k.tiktoken"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk_search.whole_vectors(table(spark, sf_dir, "embeddings"))
    return topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.col("_slot").alias("slot"), F.col("_slot2").alias("slot2"))


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_repair.repair(conv_repair.damaged(table(spark, sf_dir, "conversations")))


def op12_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", F.col("_text").alias("text"), F.col("_n_chars").alias("n_chars"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_pii_surrogates, op3_harmonic_packing, op4_license_scan, op5_ngram_jaccard_join, op6_tokenizer_fertility, op7_quality_classifier, op8_exact_topk_search, op9_toxicity, op10_mix_sources, op11_conversation_repair, op12_main_text, op13_prefix_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": license_scan.oracle_sql()}
