"""Filters, facets, pages, contracts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts, search
from ..plans.jobs_view import NOW, ORDERS_WIDE_SQL, orders_wide, table
from ..plans.requests import FACETS, FILTER_BOUNDS, SearchRequest

REQUEST = SearchRequest(filters={"workModes": ("o", "P"), "skills": ("brand#2", "BRAND#17", "brand#4"), "seniority": ("1-urgent", "2-HIGH", "3-medium")}, minimum_salary=50_000, posted_within_days=365)
_BASE = f"""status = 'active' AND (round("annualMax", 2) >= 50000 OR "annualMax" IS NULL) AND "postedAt" >= TIMESTAMP '{NOW}' - INTERVAL 365 DAYS"""
_TERMS = {
    "workModes": """lower("workMode") IN ('o', 'p')""",
    "seniority": "lower(seniority) IN ('1-urgent', '2-high', '3-medium')",
    "skills": "list_has_any(list_transform(skills, lambda x: lower(x)), ['brand#2', 'brand#17', 'brand#4'])",
}
_ALL = " AND ".join([_BASE, *_TERMS.values()])


def f1_filter_jobs(spark, d):
    return search.filter_jobs(orders_wide(spark, d), REQUEST, NOW).select("jobId", "workMode", "seniority", F.array_join("skills", ",").alias("skills"), "annualMax")


def a1_facet_counts(spark, d):
    return search.facet_counts(orders_wide(spark, d), REQUEST, NOW)


def a2_freshness(spark, d):
    return search.freshness(search.filter_jobs(orders_wide(spark, d), REQUEST, NOW)).select(F.date_format("freshness", "yyyy-MM-dd HH:mm:ss").alias("freshness"))


def _page(df):
    return df.select("jobId", "annualMax", F.date_format("postedAt", "yyyy-MM-dd").alias("posted"))


def t1_ranked_page(spark, d):
    return _page(search.ranked_page(search.filter_jobs(orders_wide(spark, d), SearchRequest(posted_within_days=None), NOW), "salary", 50))


def t2_next_page(spark, d):
    jobs = search.filter_jobs(orders_wide(spark, d), SearchRequest(posted_within_days=365), NOW)
    first = search.ranked_page(jobs, "newest", 25)
    return _page(search.next_page(jobs, "newest", search.page_after(first, "newest", 25), 25))


def a5_disclosed_pay_report(spark, d):
    return search.disclosed_pay_report(orders_wide(spark, d), "building")


def r1_dedupe_latest(spark, d):
    return search.dedupe_latest(table(spark, d, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


def order_rules():
    return {"price": F.col("o_totalprice") >= 1000, "priority": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "recent": F.year("o_orderdate") >= 1996, "status": F.col("o_orderstatus").isin("O", "F")}


def n8_validate_contract(spark, d):
    return contracts.validate_contract(table(spark, d, "orders"), "o_orderkey", order_rules()).groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


def _requests(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", F.repeat("event_type", (F.col("event_id") % 130).cast("int")).alias("query"), (F.floor("value") * 100000).alias("minimumSalary"), (F.col("user_id") * 4).alias("postedWithinDays"), (F.col("event_id") % 60).alias("pageSize"), F.when(F.col("event_id") % 3 == 0, "newest").when(F.col("event_id") % 7 == 0, "oldest").alias("sort"))


def f2_validate_requests(spark, d):
    _, bad = contracts.split_valid(_requests(spark, d), contracts.request_rules())
    return bad.select("event_id", F.array_join("failed", ",").alias("failed"))


def f2_validate_filters(spark, d):
    """Bounds of the filter lists of requests logged as events: a value that many times, of that many characters."""
    e = table(spark, d, "events")
    logged = lambda n, size: F.array_repeat(F.repeat(F.col("event_type"), size.cast("int")), n.cast("int"))
    k = F.col("event_id")
    lists = {name: logged(k % (most + 3 + i), k % (longest // 4 + 2)) for i, (name, (most, longest)) in enumerate(FILTER_BOUNDS.items()) if name != "workModes"}
    modes = F.slice(F.array(*map(F.lit, ("remote", "hybrid", "onsite", "remote", "unknown"))), (k % 5 + 1).cast("int"), (k % 4).cast("int"))
    requests = e.select("event_id", modes.alias("workModes"), *(F.when(k % 11 != 0, x).alias(n) for n, x in lists.items()))
    return contracts.validate_contract(requests, "event_id", contracts.filter_rules()).groupBy("rule").agg(F.count(F.lit(1)).alias("requests"), F.sum("event_id").alias("ids"))


def _facet_sql():
    parts = []
    for facet, column, n in FACETS:
        where = " AND ".join([_BASE, *(t for f, t in _TERMS.items() if f != facet)])
        value = f'unnest(list_distinct(list_transform("{column}", lambda x: lower(x))))' if column in ("skills", "employmentType", "industries") else f'lower("{column}")'
        inner = f"SELECT value, count(*) AS c FROM (SELECT {value} AS value FROM jobs WHERE {where}) GROUP BY value"
        parts.append(f"""SELECT '{facet}' AS facet, value, c AS "count", row_number() OVER (ORDER BY c DESC, value) AS rank FROM ({inner}) QUALIFY rank <= {n}""")
    return f"WITH {ORDERS_WIDE_SQL} " + " UNION ALL ".join(parts)


_PAGE = """SELECT "jobId", "annualMax", strftime("postedAt", '%Y-%m-%d') AS posted FROM jobs"""
_RULES_SQL = "[CASE WHEN NOT coalesce(o_totalprice >= 1000, false) THEN 'price' END, CASE WHEN NOT coalesce(o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM'), false) THEN 'priority' END, CASE WHEN NOT coalesce(year(o_orderdate) >= 1996, false) THEN 'recent' END, CASE WHEN NOT coalesce(o_orderstatus IN ('O', 'F'), false) THEN 'status' END]"

QUERIES = {f.__name__: f for f in (f1_filter_jobs, a1_facet_counts, a2_freshness, t1_ranked_page, t2_next_page, a5_disclosed_pay_report, r1_dedupe_latest, n8_validate_contract, f2_validate_requests, f2_validate_filters)}
SQL = {
    "f1_filter_jobs": f"""WITH {ORDERS_WIDE_SQL} SELECT "jobId", "workMode", seniority, array_to_string(skills, ',') AS skills, "annualMax" FROM jobs WHERE {_ALL}""",
    "a1_facet_counts": _facet_sql(),
    "a2_freshness": f"""WITH {ORDERS_WIDE_SQL} SELECT strftime(max("collectedAt"), '%Y-%m-%d %H:%M:%S') AS freshness FROM jobs WHERE {_ALL}""",
    "t1_ranked_page": f"""WITH {ORDERS_WIDE_SQL} {_PAGE} WHERE status = 'active' ORDER BY "annualMax" DESC NULLS LAST, "postedAt" DESC NULLS LAST, "jobId" LIMIT 50""",
    "t2_next_page": f"""WITH {ORDERS_WIDE_SQL} {_PAGE} WHERE status = 'active' AND "postedAt" >= TIMESTAMP '{NOW}' - INTERVAL 365 DAYS ORDER BY "postedAt" DESC NULLS LAST, "jobId" LIMIT 25 OFFSET 25""",
    "a5_disclosed_pay_report": f"""WITH {ORDERS_WIDE_SQL} SELECT "companyName", count(*) AS jobs, min("annualMax") AS lowest, max("annualMax") AS highest FROM jobs WHERE status = 'active' AND lower("titleFamily") = 'building' AND "annualMax" IS NOT NULL GROUP BY 1""",
    "r1_dedupe_latest": "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "n8_validate_contract": f"SELECT rule, count(*) AS violations FROM (SELECT unnest({_RULES_SQL}) AS rule FROM orders) WHERE rule IS NOT NULL GROUP BY rule",
    "f2_validate_filters": "SELECT rule, count(*) AS requests, sum(event_id)::BIGINT AS ids FROM (" + " UNION ALL ".join(
        ["SELECT 'workModes' AS rule, event_id FROM events WHERE len(list_filter(['remote', 'hybrid', 'onsite', 'remote', 'unknown'][(event_id % 5 + 1):(event_id % 5 + event_id % 4)], lambda x: x = 'unknown')) > 0"]
        + [f"SELECT '{name}', event_id FROM events WHERE event_id % 11 <> 0 AND event_id % {most + 3 + i} > 0 AND (event_id % {most + 3 + i} > {most} OR length(event_type) * (event_id % {longest // 4 + 2}) NOT BETWEEN 1 AND {longest})" for i, (name, (most, longest)) in enumerate(FILTER_BOUNDS.items()) if name != "workModes"]
    ) + ") GROUP BY rule",
    "f2_validate_requests": """
SELECT event_id, array_to_string(f, ',') AS failed FROM (
  SELECT event_id, list_filter([
    CASE WHEN length(repeat(event_type, (event_id % 130)::INT)) > 500 THEN 'query' END,
    CASE WHEN NOT floor(value) * 100000 BETWEEN 0 AND 10000000 THEN 'salary' END,
    CASE WHEN NOT user_id * 4 BETWEEN 1 AND 365 THEN 'days' END,
    CASE WHEN NOT event_id % 60 BETWEEN 1 AND 50 THEN 'page' END,
    CASE WHEN event_id % 3 <> 0 AND event_id % 7 = 0 THEN 'sort' END], lambda x: x IS NOT NULL) AS f FROM events) WHERE len(f) > 0""",
}
