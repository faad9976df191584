"""Facets of any range of days from sketches that are kept for each day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch: ranks are right to about 1.65 / KLL_K ** 0.9 of the rows (0.013 at 200, 0.001 at 4096).
KLL_K = 1024
#: Bits of a distinct-count sketch: counts are right to about 1.04 / 2 ** (HLL_BITS / 2) (one standard error, 0.016 at 12).
HLL_BITS = 14


def daily_sketches(df: DataFrame, day: str, pay: str, company: str) -> DataFrame:
    """(day, jobs, paid, pay, companies): a row a day with a quantile sketch of pay and a distinct-count sketch of
    companies. Null pay and companies count in jobs alone. Rows of a day are summed where they lie; sketches of a few
    kilobytes are exchanged."""
    per = df.groupBy(F.col(day).cast("date").alias("day"))
    return per.agg(F.count(F.lit(1)).alias("jobs"), F.count(pay).alias("paid"), F.kll_sketch_agg_double(F.col(pay).cast("double"), F.lit(KLL_K)).alias("pay"), F.hll_sketch_agg(F.col(company), F.lit(HLL_BITS)).alias("companies"))


def range_facets(sketches: DataFrame, ranges: DataFrame, shares: list[float]) -> DataFrame:
    """ranges(range, first, last) -> (range, jobs, paid, quantiles, companies): the days' sketches merged, without reading
    the rows that they were made of. Ranges of days without rows are left out; without pay, quantiles are null."""
    j = sketches.join(F.broadcast(ranges), (F.col("day") >= F.col("first")) & (F.col("day") <= F.col("last")))  # asked ranges, a handful
    merged = j.groupBy("range").agg(F.sum("jobs").alias("jobs"), F.sum("paid").alias("paid"), F.kll_merge_agg_double(F.when(F.col("paid") > 0, F.col("pay"))).alias("pay"), F.hll_union_agg("companies").alias("companies"))
    quantiles = F.when(F.col("paid") > 0, F.array(*(F.kll_sketch_get_quantile_double("pay", F.lit(float(s))) for s in shares)))
    return merged.select("range", "jobs", "paid", quantiles.alias("quantiles"), F.hll_sketch_estimate("companies").alias("companies"))
