"""Links on pages and the screening of URL lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..plans.stored import once, small_or_merge

_HREF = r"(?is)<a\b[^>]*?\bhref\s*=\s*[\"']([^\"']*)[\"']"


def discover_links(pages: DataFrame, rules: DataFrame, max_links: int = 2000, page_url: str = "url", html: str = "html", strip_apply: tuple[str, ...] = ()) -> DataFrame:
    """(page_url, url, position, provider): a page's distinct links of its own provider that lead to job details.

    rules(host, provider, path_regex). The cap counts distinct links in document order, before the self link goes.
    """
    parts = urls.base_parts(F.col("page_url"))
    of_page = once(pages.select(F.col(page_url).alias("page_url"), F.col(html).alias("html")), page_host=urls.host(F.col("page_url")), **parts)
    found = of_page.select("page_url", "page_host", *parts, F.posexplode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("position", "href"))
    found = once(found, h=F.regexp_replace(F.trim("href"), r"#.*$", ""))
    found = once(found, joined=urls.resolved(F.col("h"), *map(F.col, parts))).select("page_url", "page_host", "position", "joined")
    found = once(found, url=urls.valid(F.col("joined"))).where("url IS NOT NULL").drop("joined")
    found = once(found, host=urls.host(F.col("url")))
    if strip_apply:
        found = found.withColumn("url", F.when(F.col("host").isin(*strip_apply), F.regexp_replace("url", r"/apply/?(\?|$)", "$1")).otherwise(F.col("url")))
    own = rules.select(F.col("host").alias("page_host"), F.col("provider").alias("page_provider"))
    kept = found.join(small_or_merge(own), "page_host").join(small_or_merge(rules), "host").where(F.col("provider") == F.col("page_provider"))
    path = F.regexp_replace(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+([^?#]*)", 1), "/+$", "")
    kept = kept.withColumn("path", path).where(F.expr("path rlike path_regex"))
    first = kept.groupBy("page_url", "url", "provider").agg(F.min("position").alias("position"))
    rank = F.row_number().over(Window.partitionBy("page_url").orderBy("position"))
    self_link = F.col("url") == urls.valid(F.regexp_replace("page_url", "#.*$", ""))
    return first.withColumn("_r", rank).where(F.col("_r") <= max_links).where(~self_link).drop("_r")


def discovery_edges(links: DataFrame) -> DataFrame:
    return links.groupBy("url").agg(F.count_distinct("page_url").alias("pages"))


def screen_urls(lists: DataFrame, allow: DataFrame, col: str = "urls", strict_network: bool = False) -> tuple[DataFrame, DataFrame]:
    """(accepted (url, provider, pos), rejected (url, reason)) of newline- or comma-separated lists; allow(host, provider).

    Accepted URLs are lower-cased in the host, without fragment, each once, at their first place.
    """
    one = lists.select(F.posexplode(F.split(col, r"[\n,]")).alias("pos", "raw")).select("pos", F.trim("raw").alias("raw")).where("raw <> ''")
    one = one.withColumn("url", urls.valid(F.regexp_replace("raw", "#.*$", ""))).withColumn("host", urls.host(F.col("url")))
    ok = allow.select(F.lower(F.trim("host")).alias("host"), "provider").distinct()
    j = one.join(small_or_merge(ok), "host", "left")
    reason = F.when(F.col("url").isNull() | F.col("host").isNull(), "invalid_url").when(~F.lower("url").startswith("https:"), "not_https").when(urls.has_credentials(F.col("url")), "has_credentials")
    if strict_network:
        p = urls.port(F.col("url"))
        reason = reason.when(p.isNotNull() & (p != "443"), "bad_port").when(F.col("host").rlike(urls.PRIVATE_HOST), "private_host")
    reason = reason.when(F.col("provider").isNull(), "host_not_allowed")
    j = j.withColumn("reason", reason)
    accepted = j.where("reason IS NULL").groupBy("url", "provider").agg(F.min("pos").alias("pos"))
    return accepted, j.where("reason IS NOT NULL").select(F.col("raw").alias("url"), "reason")
