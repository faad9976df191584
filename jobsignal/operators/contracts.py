"""Declarative row contracts: rules, violations and their counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.requests import FILTER_BOUNDS


def failed_rules(rules: dict[str, Column]) -> Column:
    """Names of the rules whose condition is not true, in the order given."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def validate_contract(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every rule that a row breaks."""
    return df.select(key, F.explode(failed_rules(rules)).alias("rule"))


def keeps(rules: dict[str, Column]) -> Column:
    """Whether a row keeps all rules."""
    return reduce(lambda a, b: a & b, (F.coalesce(ok, F.lit(False)) for ok in rules.values()), F.lit(True))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with ``failed``, the rules they break."""
    fine = keeps(rules)
    return df.where(fine), df.where(~fine).withColumn("failed", failed_rules(rules))


def job_rules(statuses=("active", "closed", "stale"), modes=("remote", "hybrid", "onsite", "unknown")) -> dict[str, Column]:
    """The canonical job's contract."""
    text = lambda c: F.length(F.trim(F.col(c))) > 0
    url = lambda c: F.col(c).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/\s]+")
    amount = lambda c: F.col(f"salary.{c}").isNull() | (F.col(f"salary.{c}") >= 0)
    return {
        "job_id": F.length("jobId") >= 8, "source": text("source"), "source_url": url("sourceUrl"), "apply_url": url("applyUrl"), "title": text("title"), "company": text("companyName"),
        "location": text("location"), "work_mode": F.col("workMode").isin(*modes), "status": F.col("status").isin(*statuses), "description": text("description"), "content_hash": F.length("contentHash") == 64,
        "currency": F.col("salary.currency").isNull() | (F.length("salary.currency") == 3), "salary": amount("min") & amount("max") & amount("annualMin") & amount("annualMax"),
        "website": F.col("companyWebsite").isNull() | url("companyWebsite"), "run": text("sourceRunId"), "family": text("titleFamily"), "seniority": text("seniority"), "collected": F.col("collectedAt").isNotNull(), "search_text": text("searchText"),
    }


def _no_longer(than: int):
    return lambda v: F.length(v).between(1, than)


def filter_rules() -> dict[str, Column]:
    """Bounds of the lists of logged search requests, one array column per filter; null lists count as empty."""
    rules = {}
    for name, (most, longest) in FILTER_BOUNDS.items():
        fine = F.forall(name, (lambda v: v.isin("remote", "hybrid", "onsite")) if name == "workModes" else _no_longer(longest))
        rules[name] = F.col(name).isNull() | ((F.size(name) <= most) & fine)
    return rules


def request_rules() -> dict[str, Column]:
    """Bounds of logged search requests (query, minimumSalary, postedWithinDays, pageSize, sort)."""
    within = lambda c, lo, hi: F.col(c).isNull() | F.col(c).between(lo, hi)
    return {"query": F.length(F.trim(F.coalesce("query", F.lit("")))) <= 500, "salary": within("minimumSalary", 0, 10_000_000), "days": within("postedWithinDays", 1, 365), "page": within("pageSize", 1, 50), "sort": F.col("sort").isNull() | F.col("sort").isin("relevance", "newest", "salary")}
