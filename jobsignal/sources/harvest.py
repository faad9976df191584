"""Postings out of page tables: JSON-LD scripts, board payloads, embedded application data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.variants import field, items, string
from ..plans.stored import once, stored

_SCRIPT = r"(?is)<script[^>]*type\s*=\s*[\"']application/ld\+json[\"'][^>]*>(.*?)</script\s*>"
_CANONICAL = r"(?i)<link[^>]*rel\s*=\s*[\"']canonical[\"'][^>]*href\s*=\s*[\"']([^\"']+)[\"']"


#: Levels of nesting that one pass walks within a row.
LEVELS = 8


def _walked(nodes: DataFrame, inner, keep) -> DataFrame:
    """nodes (..., path, node) with all that lie below them, to any depth: a row's nodes go down LEVELS levels in place, and
    what lies deeper goes on from a stored table, until none is left.

    ``inner`` gives a node's children, and ``keep`` says which nodes are wanted. (A recursive query would do the same under
    a bound on its rows, and keep its levels in executors.)
    """
    names = [c for c in nodes.columns if c not in ("path", "node")]
    listed = "array<struct<path:array<int>,node:variant>>"
    found = nodes.where("false")

    def step(acc: Column, _: Column) -> Column:
        below = F.transform(acc["level"], lambda x: F.transform(inner(x["node"]), lambda c, i: F.struct(F.concat(x["path"], F.array(i)).alias("path"), c.alias("node"))))
        return F.struct(F.flatten(below).cast(listed).alias("level"), F.concat(acc["found"], F.filter(acc["level"], lambda x: keep(x["node"]))).cast(listed).alias("found"))

    while True:
        start = F.struct(F.array(F.struct("path", "node")).cast(listed).alias("level"), F.array().cast(listed).alias("found"))
        walk = F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), start, step)
        level = stored(once(nodes, _w=walk).select(*names, "_w.level", "_w.found"), "json-level")
        found = found.unionByName(level.select(*names, F.inline("found")))
        deeper = level.where(F.size("level") > 0)
        if deeper.isEmpty():
            return found
        nodes = deeper.select(*names, F.inline("level"))


def _listed(node: Column) -> Column:
    """Elements of an array, or of a record's @graph."""
    return F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.try_variant_get(node, '$["@graph"]', "array<variant>"), F.array().cast("array<variant>"))


def harvest_jsonld(pages: DataFrame, page_url: str = "url", html: str = "html") -> DataFrame:
    """(page_url, canonicalUrl, script_index, jobPosting JSON): each page's JobPosting nodes, each identity once.

    Scripts that do not parse are skipped. Nodes are found through arrays and @graph to any depth.
    """
    canonical = F.nullif(F.regexp_extract(html, _CANONICAL, 1), F.lit(""))
    scripts = pages.where(F.col(html).contains("ld+json")).select(F.col(page_url).alias("page_url"), F.coalesce(canonical, F.col(page_url)).alias("canonicalUrl"), F.posexplode(F.regexp_extract_all(html, F.lit(_SCRIPT), F.lit(1))).alias("script_index", "_body"))
    nodes = scripts.select("page_url", "canonicalUrl", "script_index", F.array().cast("array<int>").alias("path"), F.try_parse_json("_body").alias("node")).where("node IS NOT NULL")
    is_posting = lambda node: F.coalesce(F.exists(F.transform(items(field(node, "@type")), string), lambda t: F.coalesce(t == "JobPosting", F.lit(False))), F.lit(False))
    found = _walked(nodes, _listed, is_posting)
    part = lambda name: F.coalesce(F.to_json(F.struct(field(F.col("node"), name).alias("x"))), F.lit(""))
    identity = F.sha2(F.concat_ws("\u0001", part("url"), part("identifier"), part("title"), part("datePosted")), 256)
    first = F.row_number().over(Window.partitionBy("page_url", "_identity").orderBy("script_index", "path"))
    out = found.withColumn("_identity", identity).withColumn("_rn", first).where("_rn = 1")
    return out.select("page_url", "canonicalUrl", "script_index", F.to_json("node").alias("jobPosting"))


BOARD_SCHEMA = "struct<jobs:array<struct<id:string,title:string,absolute_url:string,content:string,first_published:string,updated_at:string,location:struct<name:string>>>>"


def explode_board_payload(payloads: DataFrame, url: str = "url", payload: str = "payload") -> DataFrame:
    """One posting per complete element of a board's jobs; the company is the path segment after ``boards``."""
    jobs = payloads.select(F.col(url).alias("board_url"), F.explode(F.from_json(payload, BOARD_SCHEMA)["jobs"]).alias("j")).select("board_url", "j.*")
    full = lambda c: F.length(F.coalesce(c, F.lit(""))) > 0
    segment = F.regexp_extract("board_url", r"/boards/([^/?#]+)", 1)
    company = F.concat(F.upper(F.substring(segment, 1, 1)), F.substring(segment, 2, 1000))
    return jobs.where(full("id") & full("title") & full("absolute_url") & full("content")).select("board_url", "id", "title", F.col("absolute_url").alias("url"), F.col("content").alias("description"), company.alias("companyName"), F.coalesce("first_published", "updated_at").alias("datePosted"), F.col("location.name").alias("location"))


UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"


def _children(node: Column) -> Column:
    return F.coalesce(F.try_variant_get(node, "$", "array<variant>"), F.map_values(F.try_variant_get(node, "$", "map<string,variant>")), F.array().cast("array<variant>"))


def discover_embedded_jobs(pages: DataFrame, root: str, page_url: str = "url", html: str = "html", name: str = "__appData") -> DataFrame:
    """(page_url, url): a detail URL for every object with a UUID id and a title, at any depth of the data."""
    body = F.regexp_extract(html, rf"(?s){name}\s*=\s*(\{{.*?\}})\s*;?\s*</script", 1)
    data = pages.where(F.col(html).contains(name)).select(F.col(page_url).alias("page_url"), F.array().cast("array<int>").alias("path"), F.try_parse_json(body).alias("node")).where("node IS NOT NULL")
    job = lambda node: F.coalesce(string(field(node, "id")).rlike(UUID), F.lit(False)) & string(field(node, "title")).isNotNull()
    found = _walked(data, _children, job)
    return found.select("page_url", F.concat(F.lit(root.rstrip("/") + "/"), string(field(F.col("node"), "id"))).alias("url")).distinct()
