"""Filters, facets, ordering and keyset pages over a job table."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.requests import ARRAY_COLUMNS, FACETS, SearchRequest

#: Values of a keyword longer than this never match a filter and are never listed.
KEYWORD_LIMITS = {"skills": 512, "industries": 512}


def keyword(column: str) -> Column:
    """Lower-cased values of a facet column as an array, without over-long ones."""
    values = F.col(column) if column in ARRAY_COLUMNS else F.array(column)
    return F.transform(F.filter(values, lambda v: v.isNotNull() & (F.length(v) <= KEYWORD_LIMITS.get(column, 256))), F.lower)


def term_filter(request: SearchRequest, facet: str, column: str) -> Column | None:
    wanted = sorted({v.lower() for v in request.filters.get(facet, ())})
    if not wanted:
        return None
    if column in ARRAY_COLUMNS:
        return F.coalesce(F.arrays_overlap(keyword(column), F.array(*map(F.lit, wanted))), F.lit(False))
    return F.coalesce(F.lower(column).isin(wanted) & (F.length(column) <= KEYWORD_LIMITS.get(column, 256)), F.lit(False))


def base_filters(df: DataFrame, request: SearchRequest, now: str) -> DataFrame:
    """Status, salary and age: the predicates that no facet leaves out. They reach the scan where columns are stored."""
    df = df.where(F.col("status") == "active")
    if request.minimum_salary is not None:
        enough = F.round("annualMax", 2) >= request.minimum_salary
        df = df.where(enough | F.col("annualMax").isNull() if request.include_unknown_salary else enough)
    if request.posted_within_days is not None:
        df = df.where(F.col("postedAt") >= F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {request.posted_within_days} DAYS"))
    return df


def filter_jobs(df: DataFrame, request: SearchRequest, now: str, omit: str | None = None) -> DataFrame:
    """Jobs that satisfy every filter of the request, or all but the one named."""
    df = base_filters(df, request, now)
    for facet, column, _ in FACETS:
        if facet != omit and (c := term_filter(request, facet, column)) is not None:
            df = df.where(c)
    return df


def tagged(facet: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(facet).alias("facet"), v.alias("value")))


def facet_counts(df: DataFrame, request: SearchRequest, now: str, query_scope: DataFrame | None = None) -> DataFrame:
    """(facet, value, count, rank): each facet's commonest values, ignoring only its own selection.

    One pass: a row counts for every facet if no selection fails, and for one facet if only that one's fails.
    ``query_scope`` (jobId) restricts the rows to those a query matched.
    """
    rows = base_filters(df, request, now)
    if query_scope is not None:
        rows = rows.join(query_scope.select("jobId"), "jobId", "left_semi")
    fails = [F.when(~c, F.lit(facet)) for facet, column, _ in FACETS if (c := term_filter(request, facet, column)) is not None]
    rows = rows.withColumn("failed", F.array_compact(F.array(*fails)) if fails else F.array().cast("array<string>")).where(F.size("failed") <= 1)
    own = [tagged(facet, F.array_distinct(keyword(column))) for facet, column, _ in FACETS]
    pairs = rows.select(F.get("failed", F.lit(0)).alias("only"), F.explode(F.concat(*own)).alias("p")).select("only", "p.facet", "p.value")
    counts = pairs.where(F.col("only").isNull() | (F.col("only") == F.col("facet"))).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))
    size = F.element_at(F.create_map(*(F.lit(x) for f, _, n in FACETS for x in (f, n))), F.col("facet"))
    rank = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= size)


def freshness(df: DataFrame) -> DataFrame:
    """The latest collection time of a result."""
    return df.agg(F.max("collectedAt").alias("freshness"))


def order_of(sort: str, has_query: bool) -> list[tuple[str, bool]]:
    """(column, descending) of a sort; descending columns put nulls last."""
    if sort == "salary":
        return [("annualMax", True), ("postedAt", True), ("jobId", False)]
    if sort == "relevance" and has_query:
        return [("score", True), ("postedAt", True), ("jobId", False)]
    return [("postedAt", True), ("jobId", False)]


def ranked_page(df: DataFrame, sort: str = "newest", page_size: int = 20, has_query: bool = False) -> DataFrame:
    """The first rows in the sort's order (one TakeOrdered, no full sort)."""
    return df.orderBy(*(F.desc_nulls_last(c) if down else F.asc(c) for c, down in order_of(sort, has_query))).limit(page_size)


def after_tuple(order: list[tuple[str, bool]], last: dict) -> Column:
    """Rows strictly after the sort tuple ``last``, nulls last."""
    after, equal = F.lit(False), F.lit(True)
    for c, down in order:
        v = last[c]
        if v is None:
            step, same = F.lit(False), F.col(c).isNull()
        else:
            v = F.lit(v)
            step = (F.col(c) < v) | F.col(c).isNull() if down else F.col(c) > v
            same = F.coalesce(F.col(c) == v, F.lit(False))
        after, equal = after | (equal & step), equal & same
    return after


def fingerprint(request: SearchRequest, mode: str = "lexical") -> str:
    """What a cursor is bound to: the request without its cursor, and the mode."""
    body = {k: v for k, v in vars(request).items() if k != "cursor"} | {"mode": mode}
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=list).encode()).hexdigest()


def encode_cursor(request: SearchRequest, last: dict, now_ms: int, mode: str = "lexical") -> str:
    return json.dumps({"f": fingerprint(request, mode), "t": now_ms, "after": last}, default=str, sort_keys=True)


def decode_cursor(request: SearchRequest, now_ms: int, mode: str = "lexical") -> dict:
    """The sort tuple of the request's cursor; ValueError INVALID_CURSOR if it is another request's, or a day old."""
    try:
        c = json.loads(request.cursor or "")
        fine = c["f"] == fingerprint(request, mode) and 0 <= now_ms - c["t"] <= 86_400_000
    except (ValueError, KeyError, TypeError):
        fine = False
    if not fine:
        raise ValueError("INVALID_CURSOR")
    return c["after"]


def next_page(df: DataFrame, sort: str, after: dict | None, page_size: int, has_query: bool = False) -> DataFrame:
    """The page strictly after a sort tuple (the first page for None)."""
    order = order_of(sort, has_query)
    rows = df if after is None else df.where(after_tuple(order, after))
    return ranked_page(rows, sort, page_size, has_query)


def page_after(page: DataFrame, sort: str, page_size: int, has_query: bool = False) -> dict | None:
    """The sort tuple of a full page's last row (at most one page is collected)."""
    order = order_of(sort, has_query)
    rows = page.select(*(c for c, _ in order)).collect()
    return rows[-1].asDict() if len(rows) == page_size else None


def dedupe_latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key: the last by ``order``, nulls first; rows are reduced before they are exchanged."""
    last = F.max_by(F.struct(*df.columns), F.struct(F.col(order).isNotNull(), F.col(order)))
    return df.groupBy(F.col(key).alias("_k")).agg(last.alias("_row")).select("_row.*")


def disclosed_pay_report(df: DataFrame, family: str) -> DataFrame:
    """Active jobs of a family with known pay, by company."""
    rows = df.where((F.col("status") == "active") & (F.lower("titleFamily") == family.lower()) & F.col("annualMax").isNotNull())
    return rows.groupBy("companyName").agg(F.count(F.lit(1)).alias("jobs"), F.min("annualMax").alias("lowest"), F.max("annualMax").alias("highest"))
