"""Scans, idempotent upserts and the run ledger."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stored import folder


def scan_postings(spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet") -> DataFrame:
    """A run's items without all-null rows, with the file they come from. Splitting files into tasks replaces paging."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.format(fmt).load(path)
    return df.select("*", F.col("_metadata.file_name").alias("source_file")).where(reduce(lambda a, b: a | b, (F.col(c).isNotNull() for c in df.columns)))


def stream_postings(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_trigger).load(path)


def upsert_postings(current: DataFrame, batch: DataFrame, key: str, order: str, required: dict | None = None, present: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(next state, failures (key, rule), counts (attempted, succeeded, failed)).

    The last row of a key in ``order`` wins. Columns in ``present`` (all by default) overwrite, nulls included; others
    keep the old value. ``required`` maps rule names to conditions a row must meet.
    """
    rules = required or {}
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()))) if rules else F.array().cast("array<string>")
    judged = batch.withColumn("_failed", failed)
    failures = judged.where(F.size("_failed") > 0).select(key, F.explode("_failed").alias("rule"))
    counts = judged.agg(F.count(F.lit(1)).alias("attempted"), F.count_if(F.size("_failed") == 0).alias("succeeded"), F.count_if(F.size("_failed") > 0).alias("failed"))
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    new = judged.where(F.size("_failed") == 0).withColumn("_rn", last).where("_rn = 1").drop("_rn", "_failed")
    columns = [c for c in current.columns if c != key]
    given = [c for c in (present or columns) if c in columns]
    both = current.withColumn("_old", F.lit(True)).alias("o").join(new.select(key, *given).withColumn("_new", F.lit(True)).alias("n"), key, "full")
    merged = [F.when(F.col("_new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in given else F.col(f"o.{c}").alias(c) for c in columns]
    return both.select(key, *merged), failures, counts


def bucketed(df: DataFrame, name: str, key: str, buckets: int | None = None) -> DataFrame:
    """df as a table in buckets of its key, sorted by it, so that joins and groups on the key exchange and sort the other
    side alone. As many buckets as shuffles have partitions by default: with fewer, Spark would deal the table anew."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    unique = f"{name}_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", f"{folder(spark)}/bucketed/{unique}").saveAsTable(unique)
    return spark.table(unique)


def plan_runs(runs: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Runs that still need work: those without a complete ledger row, or all of them when forced."""
    return runs if force else runs.join(ledger.where("status = 'complete'").select("run_id").hint("merge"), "run_id", "left_anti")


_COUNTS = ("collected", "accepted", "rejected", "indexed", "failed")


def _ledger_rows(runs: DataFrame, seq: int, status: str, at: str, **fixed) -> DataFrame:
    """Ledger rows (run_id, seq, status, finished_at, counts, error); counts that runs lack are zero."""
    values = [fixed.get(c, F.col(c) if c in runs.columns else F.lit(0)) for c in _COUNTS]
    counts = [v.cast("long").alias(c) for v, c in zip(values, _COUNTS)]
    return runs.select("run_id", F.lit(seq).cast("long").alias("seq"), F.lit(status).alias("status"), F.lit(at).cast("timestamp").alias("finished_at"), *counts, F.lit(fixed.get("error")).cast("string").alias("error"))


def started_rows(runs: DataFrame, seq: int, at: str) -> DataFrame:
    """A row for each run that begins: partial, with zeros, so that a run that dies is done again."""
    return _ledger_rows(runs.select("run_id"), seq, "partial", at)


def ended_rows(report: DataFrame, seq: int, at: str) -> DataFrame:
    """A row for each run of a report: complete, or partial if a write failed."""
    out = _ledger_rows(report, seq, "complete", at)
    return out.withColumn("status", F.when(F.col("failed") == 0, "complete").otherwise("partial"))


def failed_rows(runs: DataFrame, seq: int, at: str, error: str) -> DataFrame:
    """A row for each run that broke off."""
    return _ledger_rows(runs.select("run_id"), seq, "failed", at, failed=F.lit(1), error=error)


def append_ledger(ledger: DataFrame, rows: DataFrame) -> DataFrame:
    """The ledger with new rows; a run's latest row is its state."""
    return ledger.unionByName(rows, allowMissingColumns=True)


def ledger_state(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("run_id").agg(F.max_by(F.struct(*[c for c in ledger.columns if c != "run_id"]), "seq").alias("s")).select("run_id", "s.*")
