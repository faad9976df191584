"""Job-shaped views of the shared test tables, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2001-08-02 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job per order: customer and nation joined in, its lines' parts gathered in sets."""
    t = lambda name: table(spark, sf_dir, name)
    parts = t("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_returnflag", "l_shipdate").join(parts, "l_partkey")
    per = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sort_array(F.collect_set("p_brand")).alias("skills"),
        F.sort_array(F.collect_set("p_type")).alias("industries"),
        F.sort_array(F.collect_set("l_returnflag")).alias("employmentType"),
        F.max("l_shipdate").alias("collectedAt"),
    )
    who = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "n_name")
    jobs = t("orders").join(who, "o_custkey").join(per, "o_orderkey", "left")
    empty = F.array().cast("array<string>")
    return jobs.select(
        F.col("o_orderkey").alias("jobId"),
        F.col("o_orderstatus").alias("workMode"),
        F.col("o_orderpriority").alias("seniority"),
        F.col("c_mktsegment").alias("titleFamily"),
        F.col("n_name").alias("companyName"),
        *(F.coalesce(c, empty).alias(c) for c in ("skills", "industries", "employmentType")),
        F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("annualMax"),
        F.col("o_orderdate").alias("postedAt"),
        "collectedAt",
        F.when(F.col("o_orderkey") % 17 == 0, "closed").otherwise("active").alias("status"),
    )


ORDERS_WIDE_SQL = """
per AS (
  SELECT l_orderkey, list_sort(list(DISTINCT p_brand)) AS skills, list_sort(list(DISTINCT p_type)) AS industries,
         list_sort(list(DISTINCT l_returnflag)) AS "employmentType", max(l_shipdate) AS "collectedAt"
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey),
jobs AS (
  SELECT o_orderkey AS "jobId", o_orderstatus AS "workMode", o_orderpriority AS seniority, c_mktsegment AS "titleFamily", n_name AS "companyName",
         coalesce(skills, []) AS skills, coalesce(industries, []) AS industries, coalesce("employmentType", []) AS "employmentType",
         CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS "annualMax", o_orderdate AS "postedAt", "collectedAt",
         CASE WHEN o_orderkey % 17 = 0 THEN 'closed' ELSE 'active' END AS status
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey LEFT JOIN per ON o_orderkey = l_orderkey)
"""
