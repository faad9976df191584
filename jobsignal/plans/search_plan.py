"""A whole search: filter, score, page, facets, freshness, total, highlights."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lexical, search
from .requests import SearchRequest
from .stored import stored


@dataclass
class SearchResult:
    items: DataFrame
    facets: DataFrame
    summary: DataFrame
    highlights: DataFrame
    degraded: bool


def run_search(jobs: DataFrame, index: lexical.Index, request: SearchRequest, now: str, vectors: DataFrame | None = None, query_vector: list[float] | None = None, mode: str = "lexical", after: dict | None = None) -> SearchResult:
    """``after`` is a decoded cursor. A hybrid search without vectors runs lexically from the first page, degraded.

    With a query, the jobs that it finds are joined with their scores once, in a stored table that items, facets, totals
    and highlights read. Highlights mark the terms that matched, those within some edits of the query's words too.
    """
    degraded, words = False, []
    query = request.query.strip()
    if query:
        found = lexical.found_terms(index, query)
        hits = lexical.lexical_search(index, query, found=found)
        if mode == "hybrid":
            hits, degraded = lexical.hybrid_search(hits, vectors, query_vector, request.page_size * 10)
            after = None if degraded else after
        jobs = stored(jobs.join(hits.withColumnRenamed("doc", "jobId").hint("merge"), "jobId"), "found-jobs")
        words = sorted({r.term for r in found if r.field not in lexical.KEYWORD_FIELDS} | set(lexical.said(query)))
    base = search.filter_jobs(jobs, request, now)
    items = search.next_page(base, request.sort, after, request.page_size, bool(query))
    summary = base.agg(F.count(F.lit(1)).alias("total"), F.max("collectedAt").alias("freshness")).withColumn("degraded", F.lit(degraded))
    texts = [c for c in ("description", "requirements") if c in jobs.columns]
    marks = lexical.highlight(items, "jobId", words, "title", tuple(texts)) if "title" in jobs.columns else items.select("jobId", F.array().cast("array<string>").alias("highlights"))
    return SearchResult(items, search.facet_counts(jobs, request, now), summary, marks, degraded)
