"""Run reports and inventories."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def run_report(runs: DataFrame, accepted: DataFrame, rejected: DataFrame, failures: DataFrame, listed: int = 25) -> DataFrame:
    """Per run: collected, accepted, rejected, indexed, failed, status, and its first rejections and failures by index.

    A run is complete unless a write failed; rejections leave it complete. Runs without rows report zeros.
    """
    count = lambda df, name: df.groupBy("run_id").agg(F.count(F.lit(1)).alias(name))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("index", "code"))

    def first(df: DataFrame, name: str) -> DataFrame:
        """Counts, and the first rows only, cut before they are gathered."""
        few = df.withColumn("_r", place).where(F.col("_r") <= listed).groupBy("run_id").agg(F.sort_array(F.collect_list(F.struct("index", "code"))).alias(f"first_{name}"))
        return count(df, name).join(few, "run_id", "left")

    j = runs.select("run_id").distinct().join(count(accepted, "accepted"), "run_id", "left").join(first(rejected, "rejected"), "run_id", "left").join(first(failures, "failed"), "run_id", "left")
    j = j.fillna(0, ["accepted", "rejected", "failed"])
    return j.select("run_id", (F.col("accepted") + F.col("rejected")).alias("collected"), "accepted", "rejected", (F.col("accepted") - F.col("failed")).alias("indexed"), "failed", F.when(F.col("failed") == 0, "complete").otherwise("partial").alias("status"), "first_rejected", "first_failed")


def inventory_counts(tables: dict[str, DataFrame | None], ledger: DataFrame | None = None) -> DataFrame:
    """(name, rows, latest_run): row counts, 0 for absent tables, and the ledger's latest run."""
    spark = next(t for t in tables.values() if t is not None).sparkSession
    counts = [t.agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("rows")) if t is not None else spark.range(1).select(F.lit(n).alias("name"), F.lit(0).cast("long").alias("rows")) for n, t in tables.items()]
    out = reduce(DataFrame.unionByName, counts)
    if ledger is None:
        return out.withColumn("latest_run", F.lit(None).cast("string"))
    return out.crossJoin(F.broadcast(ledger.agg(F.max_by("run_id", "finished_at").alias("latest_run"))))  # one row
