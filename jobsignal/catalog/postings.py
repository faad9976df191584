"""Scans, harvest, links, normalization."""

from __future__ import annotations

import html
from html import entities

from pyspark.sql import functions as F

from ..operators import normalize, salary, titles
from ..plans.jobs_view import table
from ..sources import harvest, links, store

NOW = "2001-08-02 00:00:00"


def s1_scan_postings(spark, d):
    return store.scan_postings(spark, f"{d}/documents.parquet").groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.sum("n_chars").alias("chars"))


def _halves(spark, d):
    """All documents as the current state, and all of them again under ids that mostly are there as well."""
    current = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")
    batch = current.select((F.col("doc_id") + 100).alias("doc_id"), F.upper("lang").alias("lang"), F.when((F.col("doc_id") + 100) % 5 != 0, F.col("source")).alias("source"), F.lit(0).cast("long").alias("n_chars"), (F.col("doc_id") + 100).alias("item_index"))
    return current, batch


def _rules():
    return {"has_source": F.col("source").isNotNull(), "lang": F.col("lang").isin("EN", "FR", "DE")}


def s8_upsert_postings(spark, d):
    current, batch = _halves(spark, d)
    return store.upsert_postings(current, batch, "doc_id", "item_index", _rules(), ["lang", "source"])[0]


def s8_bucketed_upsert(spark, d):
    """The same upsert with the current state in buckets, which no exchange reads."""
    current, batch = _halves(spark, d)
    return store.upsert_postings(store.bucketed(current, "current_docs", "doc_id"), batch, "doc_id", "item_index", _rules(), ["lang", "source"])[0]


def s8_upsert_failures(spark, d):
    current, batch = _halves(spark, d)
    _, failures, counts = store.upsert_postings(current, batch, "doc_id", "item_index", _rules(), ["lang", "source"])
    return failures.groupBy("rule").agg(F.count(F.lit(1)).alias("rows")).unionByName(counts.select(F.lit("attempted").alias("rule"), F.col("attempted").alias("rows")))


def s9_plan_runs(spark, d):
    docs = table(spark, d, "documents")
    runs = docs.groupBy(F.col("source").alias("run_id")).agg(F.count(F.lit(1)).alias("items"))
    ledger = docs.select(F.col("source").alias("run_id"), F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 7 == 0, "partial").otherwise("complete").alias("status"))
    return store.plan_runs(runs, store.ledger_state(ledger))


def s9_append_ledger(spark, d):
    docs = table(spark, d, "documents")
    runs = docs.select(F.col("source").alias("run_id")).distinct()
    ledger = docs.groupBy(F.col("source").alias("run_id")).agg(F.lit(0).cast("long").alias("seq"), F.lit("failed").alias("status"))
    started = store.append_ledger(ledger, store.started_rows(runs, 1, NOW))
    fine = docs.where("lang <> 'es'").groupBy(F.col("source").alias("run_id")).agg(F.count(F.lit(1)).alias("collected"), F.count_if(F.col("n_chars") >= 200).alias("accepted"), F.count_if(F.col("n_chars") < 200).alias("rejected"), F.count_if(F.col("n_chars") >= 200).alias("indexed"), F.lit(0).cast("long").alias("failed"))
    ended = store.ended_rows(fine.where("collected % 2 = 0"), 2, NOW).unionByName(store.failed_rows(fine.where("collected % 2 = 1").select("run_id"), 2, NOW, "source is gone"))
    out = store.ledger_state(store.append_ledger(started, ended))
    return out.select("run_id", "seq", "status", "collected", "accepted", "rejected", "indexed", "failed", "error")


def _posting_pages(spark, d):
    """Pages with a JSON-LD script for each part: a plain node, a graph, 21 levels of nesting; and a broken script."""
    p = _spread(table(spark, d, "part"), "p_partkey")
    node = F.to_json(F.struct(F.when(F.col("p_partkey") % 2 == 0, F.lit("JobPosting")).otherwise("Thing").alias("@type"), F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("identifier"), F.concat(F.lit("https://jobs.example.com/"), F.col("p_partkey").cast("string")).alias("url")))
    graph = F.concat(F.lit('{"@context":"x","@graph":[['), node, F.lit("],"), node, F.lit("]}"))
    deep = F.concat(F.lit('[{"@graph":[' * 7), node, F.lit("]}]" * 7))
    body = F.when(F.col("p_partkey") % 5 == 4, deep).when(F.col("p_partkey") % 3 == 0, graph).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("["), node, F.lit("]"))).otherwise(node)
    html = F.concat(F.lit("<html><script type='application/ld+json'>{broken</script><script type=\"application/ld+json\">"), body, F.lit("</script></html>"))
    return p.select(F.concat(F.lit("https://pages.example.com/"), F.col("p_partkey").cast("string")).alias("url"), html.alias("html"))


def s3_harvest_jsonld(spark, d):
    h = harvest.harvest_jsonld(_posting_pages(spark, d))
    return h.select("page_url", "script_index", F.get_json_object("jobPosting", "$.title").alias("title"), F.get_json_object("jobPosting", "$.identifier").alias("identifier"))


def s4_explode_board_payload(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    job = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.col("s_name").alias("title"), F.concat(F.lit("https://b.example.com/"), F.col("s_suppkey").cast("string")).alias("absolute_url"), F.when(F.col("s_suppkey") % 5 != 0, F.lit("text")).alias("content"), F.when(F.col("s_suppkey") % 2 == 0, F.lit("2026-07-01")).alias("first_published"), F.lit("2026-07-09").alias("updated_at"))
    boards = s.join(n, s.s_nationkey == n.n_nationkey).groupBy("n_name").agg(F.to_json(F.struct(F.collect_list(job).alias("jobs"))).alias("payload"))
    boards = boards.select(F.concat(F.lit("https://api.example.com/v1/boards/"), F.lower("n_name"), F.lit("/jobs")).alias("url"), "payload")
    return harvest.explode_board_payload(boards).select("id", "title", "url", "companyName", "datePosted")


def s6_discover_embedded_jobs(spark, d):
    p = _spread(table(spark, d, "part"), "p_partkey")
    uuid = F.concat(F.lpad(F.col("p_partkey").cast("string"), 8, "0"), F.lit("-0000-4000-8000-000000000000"))
    data = F.concat(F.lit('{"board":{"teams":[{"id":"x","jobs":[{"id":"'), uuid, F.lit('","title":"'), "p_name", F.lit('"},{"id":"'), uuid, F.lit('","name":1}]}]}}'))
    data = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit('{"n":[' * 7), data, F.lit("]}" * 7))).otherwise(data)  # 14 levels more
    pages = p.select(F.concat(F.lit("https://a.example.com/"), F.col("p_partkey").cast("string")).alias("url"), F.concat(F.lit("<script>window.__appData = "), data, F.lit(";</script>")).alias("html"))
    return harvest.discover_embedded_jobs(pages, "https://a.example.com/board")


def _page_rules(pages):
    from ..functions import urls

    return pages.select(urls.host(F.col("url")).alias("host")).distinct().select("host", F.concat(F.lit("p"), F.length("host") % 3).alias("provider"), F.lit("^/[a-zA-Z]+$").alias("path_regex"))


def s5_discover_links(spark, d):
    pages = table(spark, d, "pages")
    return links.discover_links(pages, _page_rules(pages))


def _url_lists(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey").cast("string")
    one = F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("http://a.example.com/"), k)).when(F.col("o_orderkey") % 6 == 1, F.concat(F.lit("https://A.example.com/"), k, F.lit("#top"))).when(F.col("o_orderkey") % 6 == 2, F.concat(F.lit("https://u:p@a.example.com/"), k)).when(F.col("o_orderkey") % 6 == 3, F.lit("no url")).when(F.col("o_orderkey") % 6 == 4, F.concat(F.lit("https://b.example.com:444/"), k)).otherwise(F.concat(F.lit("https://10.0.0.1/"), k))
    return o.select(F.concat_ws(",", one, F.lit(" "), one).alias("urls"))


def s7_screen_urls(spark, d):
    allow = table(spark, d, "region").select(F.when(F.col("r_regionkey") == 0, "a.example.com").when(F.col("r_regionkey") == 1, "b.example.com").otherwise("c.example.com").alias("host"), F.lit("x").alias("provider"))
    ok, bad = links.screen_urls(_url_lists(spark, d), allow, strict_network=True)
    return ok.select("url", F.lit("accepted").alias("reason")).unionByName(bad)


def _spread(df, key):
    """The rows of a small file dealt to all cores, as the files of a real run are."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism, key)


def _raw_items(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = _spread(o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey), "o_orderkey")  # the join's own partitions may be few
    key = F.col("o_orderkey")
    title = F.concat(F.when(key % 3 == 0, "Senior ").when(key % 3 == 1, "Junior ").otherwise(""), F.lower("c_mktsegment"), F.lit(" engineer"))
    pay = F.struct(F.lit("usd").alias("currency"), F.struct((20 + key % 80).alias("minValue"), (100 + key % 80).alias("maxValue"), F.lit("HOUR").alias("unitText")).alias("value"))
    posting = F.struct(
        F.when(key % 11 != 0, title).alias("title"), F.concat(F.lit("<p>Work with &amp;amp; <b>Python</b> and SQL in region "), key.cast("string"), F.lit("</p>")).alias("description"),
        F.struct(F.col("c_name").alias("name")).alias("hiringOrganization"), F.struct(F.struct(F.col("n_name").alias("addressLocality"), F.lit("US").alias("addressCountry")).alias("address")).alias("jobLocation"),
        F.struct(key.cast("string").alias("value")).alias("identifier"), F.when(key % 4 == 0, F.lit("TELECOMMUTE")).alias("jobLocationType"), F.array(F.lit("FULL_TIME"), F.lit("FULL_TIME")).alias("employmentType"), F.when(key % 5 != 0, pay).alias("baseSalary"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("datePosted"),
    )
    envelope = F.struct(F.when(key % 17 == 0, F.concat(F.lit("https://./"), key.cast("string"))).when(key % 13 != 0, F.concat(F.lit("https://www.jobs.example.com/"), key.cast("string"))).alias("sourceUrl"), posting.alias("jobPosting"))
    return j.select(key.alias("item"), F.to_json(envelope).alias("payload"))


def n1_normalize_postings(spark, d):
    j = normalize.judge_postings(_raw_items(spark, d), "run", NOW)
    fine = F.col("code").isNull()
    kept = {c: F.col(c) for c in ("jobId", "title", "seniority", "titleFamily", "companyName", "location", "locationCountry", "workMode")}
    kept |= {"skills": F.array_join("skills", ","), "types": F.array_join("employmentType", ","), "annualMin": F.col("salary.annualMin"), "annualMax": F.col("salary.annualMax"), "currency": F.col("salary.currency"), "source": F.col("source"), "description": F.col("description"), "posted": F.date_format("postedAt", "yyyy-MM-dd")}
    return j.select("item", *(F.when(fine, c).alias(n) for n, c in kept.items()), "code")


def n2_clean_html_text(spark, d):
    clean, _ = normalize.clean_html_text(table(spark, d, "pages"), "html")
    return clean.select("page_id", "html")


def n2_size_report(spark, d):
    return normalize.clean_html_text(table(spark, d, "pages").withColumn("host", F.regexp_extract("url", "://([^/]+)", 1)), "html", "host")[1]


def n3_annualize_salary(spark, d):
    o = table(spark, d, "orders")
    unit = F.element_at(F.array(*map(F.lit, ("HOUR", "per day", "Weekly", "monthly", "annual", "piece"))), (F.col("o_orderkey") % 6 + 1).cast("int"))
    rows = o.select("o_orderkey", F.when(F.col("o_orderkey") % 10 != 0, F.col("o_totalprice")).alias("min"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") + 10.5).alias("max"), unit.alias("unitText"))
    return salary.annualize_salary(rows).select("o_orderkey", "period", "annualMin", "annualMax")


def n4_extract_disclosed_salary(spark, d):
    o = _spread(table(spark, d, "orders"), "o_orderkey")
    lo, hi = 20 + F.col("o_orderkey") % 700, 30 + F.col("o_orderkey") % 900
    text = F.concat(F.lit("Budgets of $50,000-$90,000 monthly. "), F.repeat(F.lit("filler "), 40), F.when(F.col("o_orderkey") % 2 == 0, "In Colorado the annual base salary range is $").otherwise("The yearly bonus pool of our California office, base pay $"), lo.cast("string"), F.lit(",000 - $"), hi.cast("string"), F.lit(",000 USD. Thanks."))
    rows = o.select(F.col("o_orderkey").alias("jobId"), text.alias("description"), F.lit("Denver").alias("location"), F.lit("US").alias("locationCountry"))
    return salary.extract_disclosed_salary(rows).select("jobId", "annualMin", "annualMax", "sourceText", "score")


_WORDS = ("the", "de", "und", "of", "que", "la")


def n5_tag_skills(spark, d):
    docs = table(spark, d, "documents")
    vocab = spark.range(len(_WORDS)).select(F.col("id").alias("rank"), F.element_at(F.array(*map(F.lit, _WORDS)), (F.col("id") + 1).cast("int")).alias("term"))
    return normalize.tag_skills(docs, vocab, "doc_id", "text").select("doc_id", F.array_join("skills", ",").alias("skills"))


def n6_classify_titles(spark, d):
    p = table(spark, d, "part")
    title = F.concat(F.when(F.col("p_size") % 5 == 0, "Senior ").when(F.col("p_size") % 5 == 1, "VP of ").when(F.col("p_size") % 5 == 2, "Junior ").otherwise(""), "p_name", F.when(F.col("p_size") % 3 == 0, " data engineer").when(F.col("p_size") % 3 == 1, " designer").otherwise(" html writer"))
    return titles.class_counts(titles.classify_titles(p.select(title.alias("title"))))


def n7_assign_identity(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.when(F.col("o_orderkey") % 3 == 0, F.col("o_custkey").cast("string")).alias("sourceJobId"), F.lit("jobs.example.com").alias("source"), F.col("o_orderpriority").alias("companyName"), F.col("o_orderstatus").alias("title"), F.col("o_custkey").cast("string").alias("location"), F.lit("https://x.example.com/").alias("applyUrl"), F.col("o_orderkey").alias("key"))
    ids, _ = normalize.assign_identity(rows, ("title", "companyName", "location"))
    return ids.select("key", "jobId", "contentHash")


def n7_identity_collisions(spark, d):
    o = table(spark, d, "orders")
    rows = o.select(F.col("o_custkey").cast("string").alias("sourceJobId"), F.lit("h").alias("source"), F.col("o_orderstatus").alias("title"), *(F.lit("x").alias(c) for c in ("companyName", "location", "applyUrl")))
    return normalize.assign_identity(rows, ("title",))[1].select("jobId", "hashes")


def n9_card_view(spark, d):
    o = table(spark, d, "orders")
    m = F.col("o_orderkey") % 4
    num = F.expr("CAST(NULL AS double)")
    pay = F.struct(num.alias("min"), num.alias("max"), F.when(m == 1, "USD").when(m == 2, "EUR").alias("currency"), F.when(m != 3, F.floor("o_totalprice") + 0.0).alias("annualMin"), F.when(m != 2, F.floor("o_totalprice") + 1000.0).alias("annualMax"), F.when(F.col("o_orderkey") % 9 == 0, "as told").alias("sourceText"))
    rows = o.select(F.col("o_orderkey").alias("jobId"), F.lit("").alias("companyName"), F.col("o_orderstatus").alias("title"), F.col("o_orderpriority").alias("location"), F.when(m == 0, "unknown").otherwise("remote").alias("workMode"), pay.alias("salary"), F.col("o_orderdate").alias("postedAt"), F.col("o_orderdate").alias("collectedAt"))
    return normalize.card_view(rows, "2001-08-02 00:01:00")


QUERIES = {f.__name__: f for f in (s1_scan_postings, s3_harvest_jsonld, s4_explode_board_payload, s5_discover_links, s6_discover_embedded_jobs, s7_screen_urls, s8_upsert_postings, s8_bucketed_upsert, s8_upsert_failures, s9_plan_runs, s9_append_ledger, n1_normalize_postings, n2_clean_html_text, n2_size_report, n3_annualize_salary, n4_extract_disclosed_salary, n5_tag_skills, n6_classify_titles, n7_assign_identity, n7_identity_collisions, n9_card_view)}

_BATCH = """batch AS (SELECT doc_id + 100 AS doc_id, upper(lang) AS lang, CASE WHEN (doc_id + 100) % 5 <> 0 THEN source END AS source FROM documents),
judged AS (SELECT *, [CASE WHEN source IS NULL THEN 'has_source' END, CASE WHEN NOT coalesce(lang IN ('EN', 'FR', 'DE'), false) THEN 'lang' END] AS f FROM batch)"""
_FINE = "len(list_filter(f, lambda x: x IS NOT NULL)) = 0"
_REF = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
_told = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
#: What a character reference r stands for, by the rules and tables of HTML 5: numbers, named ones, and those without a
#: semicolon, which may be only the beginning of what was read.
_DECODED = f"""CASE WHEN r IS NULL THEN '' WHEN r[2] = '#' THEN list_transform([CASE WHEN lower(r[3]) = 'x' THEN try_cast('0x' || rtrim(r[4:], ';') AS BIGINT) ELSE try_cast(rtrim(r[3:], ';') AS BIGINT) END],
    lambda n: CASE WHEN n IS NULL OR n > 1114111 THEN chr(65533) WHEN odd[n] IS NOT NULL THEN odd[n] WHEN n BETWEEN 55296 AND 57343 THEN chr(65533) WHEN list_contains({sorted(html._invalid_codepoints)}, n) THEN '' ELSE chr(n::INT) END)[1]
  ELSE coalesce(names[r[2:]], list_transform(list_filter(range(length(r) - 2, 1, -1), lambda k: names[r[2:k + 1]] IS NOT NULL), lambda k: names[r[2:k + 1]] || r[k + 2:])[1], r) END"""


def _decoded(n: int, before: str) -> str:
    """CTE d<n>: ``before`` with the references in t decoded once."""
    return f"""c{n} AS (SELECT * EXCLUDE (t), regexp_extract_all(t, '{_REF}') AS refs, regexp_split_to_array(t, '{_REF}') AS parts FROM {before}),
d{n} AS (SELECT * EXCLUDE (refs, parts, names, odd), CASE WHEN html IS NOT NULL THEN array_to_string(list_transform(list_zip(parts, list_transform(refs, lambda r: {_DECODED})), lambda z: z[1] || coalesce(z[2], '')), '') END AS t FROM c{n}, known)"""


_BODIES = "|".join(rf"<{t}\b[^>]*>.*?</{t}\s*>" for t in ("script", "style", "textarea", "option"))
_CLEANED = rf"""known AS (SELECT map({_told(entities.html5)}, {_told(entities.html5.values())}) AS names, map({list(html._invalid_charrefs)}, {_told(html._invalid_charrefs.values())}) AS odd),
p AS (SELECT *, html AS t FROM pages), {_decoded(1, "p")}, {_decoded(2, "d1")},
clean AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(t, '(?is){_BODIES}|<!--.*?-->', ' ', 'g'), '(?s)<[/!?a-zA-Z][^>]*>', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS text FROM d2)"""
_HOST = "regexp_extract(url, '://([^/?#:]*)', 1)"
SQL = {
    "s1_scan_postings": "SELECT source, count(*) AS items, sum(n_chars)::BIGINT AS chars FROM documents GROUP BY source",
    "s3_harvest_jsonld": "SELECT 'https://pages.example.com/' || p_partkey AS page_url, 1 AS script_index, p_name AS title, p_partkey::VARCHAR AS identifier FROM part WHERE p_partkey % 2 = 0",
    "s4_explode_board_payload": """SELECT s_suppkey::VARCHAR AS id, s_name AS title, 'https://b.example.com/' || s_suppkey AS url, upper(lower(n_name)[1]) || lower(n_name)[2:] AS "companyName",
      CASE WHEN s_suppkey % 2 = 0 THEN '2026-07-01' ELSE '2026-07-09' END AS "datePosted" FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> 0""",
    "s5_discover_links": f"""
WITH a AS (SELECT url AS page_url, regexp_extract_all(html, '<a [^>]*?href="([^"]*)"', 1) AS h, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS root, {_HOST} AS host FROM pages),
l AS (SELECT page_url, host, root, unnest(h) AS href, generate_subscripts(h, 1) - 1 AS position FROM a),
f AS (SELECT page_url, root || regexp_replace(href, '#.*$', '') AS url, host, min(position) AS position FROM l WHERE regexp_matches(regexp_replace(regexp_replace(regexp_replace(href, '#.*$', ''), '[?].*$', ''), '/+$', ''), '^/[a-zA-Z]+$') GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY page_url ORDER BY position) AS rn FROM f)
SELECT page_url, url, 'p' || (length(host) % 3) AS provider, position::INT AS position FROM r WHERE rn <= 2000 AND url <> regexp_replace(page_url, '#.*$', '')""",
    "s6_discover_embedded_jobs": "SELECT 'https://a.example.com/' || p_partkey AS page_url, 'https://a.example.com/board/' || lpad(p_partkey::VARCHAR, 8, '0') || '-0000-4000-8000-000000000000' AS url FROM part",
    "s7_screen_urls": """
WITH o AS (SELECT o_orderkey AS k, unnest([1, 2]) AS twice FROM orders)
SELECT DISTINCT 'https://a.example.com/' || k AS url, 'accepted' AS reason FROM o WHERE k % 6 = 1
UNION ALL SELECT CASE k % 6 WHEN 0 THEN 'http://a.example.com/' || k WHEN 2 THEN 'https://u:p@a.example.com/' || k WHEN 3 THEN 'no url' WHEN 4 THEN 'https://b.example.com:444/' || k ELSE 'https://10.0.0.1/' || k END,
  CASE k % 6 WHEN 0 THEN 'not_https' WHEN 2 THEN 'has_credentials' WHEN 3 THEN 'invalid_url' WHEN 4 THEN 'bad_port' ELSE 'private_host' END FROM o WHERE k % 6 <> 1""",
    "s8_upsert_postings": f"""WITH {_BATCH}, good AS (SELECT * FROM judged WHERE {_FINE}), cur AS (SELECT * FROM documents)
SELECT coalesce(c.doc_id, g.doc_id) AS doc_id, CASE WHEN g.doc_id IS NOT NULL THEN g.lang ELSE c.lang END AS lang, CASE WHEN g.doc_id IS NOT NULL THEN g.source ELSE c.source END AS source, c.n_chars FROM cur c FULL JOIN good g ON c.doc_id = g.doc_id""",
    "s8_upsert_failures": f"WITH {_BATCH}, u AS (SELECT unnest(f) AS rule FROM judged) SELECT rule, count(*) AS \"rows\" FROM u WHERE rule IS NOT NULL GROUP BY rule UNION ALL SELECT 'attempted', count(*) FROM batch",
    "s9_plan_runs": "SELECT source AS run_id, count(*) AS items FROM documents GROUP BY source HAVING max(doc_id) % 7 = 0",
    "s9_append_ledger": """
WITH r AS (SELECT source AS run_id, count(*) FILTER (lang <> 'es') AS n, count(*) FILTER (lang <> 'es' AND n_chars >= 200) AS a FROM documents GROUP BY source)
SELECT run_id, CASE WHEN n = 0 THEN 1 ELSE 2 END::BIGINT AS seq, CASE WHEN n = 0 THEN 'partial' WHEN n % 2 = 0 THEN 'complete' ELSE 'failed' END AS status, CASE WHEN n % 2 = 0 THEN n ELSE 0 END AS collected, CASE WHEN n % 2 = 0 THEN a ELSE 0 END AS accepted,
  CASE WHEN n % 2 = 0 THEN n - a ELSE 0 END AS rejected, CASE WHEN n % 2 = 0 THEN a ELSE 0 END AS indexed, CASE WHEN n % 2 = 0 THEN 0 ELSE 1 END::BIGINT AS failed, CASE WHEN n % 2 = 1 THEN 'source is gone' END AS error FROM r""",
    "n1_normalize_postings": f"""
WITH j AS (SELECT *, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Junior ' ELSE '' END || lower(c_mktsegment) || ' engineer' AS t FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT k AS item, sha256('jobs.example.com:' || k)[1:32] AS "jobId", t AS title, CASE k % 3 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Entry' ELSE 'Mid-level' END AS seniority, CASE WHEN regexp_matches(t, 'mobile') THEN 'Mobile' ELSE 'Software Engineering' END AS "titleFamily", c_name AS "companyName",
  n_name || ', US' AS location, 'US' AS "locationCountry", CASE WHEN k % 4 = 0 THEN 'remote' ELSE 'onsite' END AS "workMode", 'Python,SQL' AS skills, 'FULL_TIME' AS types,
  CASE WHEN k % 5 <> 0 THEN (20 + k % 80) * 2080.0::DOUBLE END AS "annualMin", CASE WHEN k % 5 <> 0 THEN (100 + k % 80) * 2080.0::DOUBLE END AS "annualMax", CASE WHEN k % 5 <> 0 THEN 'USD' END AS currency,
  'jobs.example.com' AS source, 'Work with & Python and SQL in region ' || k AS description, strftime(o_orderdate, '%Y-%m-%d') AS posted, NULL::VARCHAR AS code FROM j WHERE k % 13 <> 0 AND k % 11 <> 0 AND k % 17 <> 0
UNION ALL SELECT k, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN k % 17 <> 0 AND k % 13 = 0 THEN 'missing_url' WHEN k % 11 = 0 THEN 'missing_core_fields' ELSE 'unknown' END FROM j WHERE k % 13 = 0 OR k % 11 = 0 OR k % 17 = 0""",
    "n2_clean_html_text": f"WITH {_CLEANED} SELECT page_id, text AS html FROM clean",
    "n2_size_report": f"WITH {_CLEANED} SELECT regexp_extract(url, '://([^/]+)', 1) AS host, count(*) AS pages, sum(length(html))::BIGINT AS before, sum(length(text))::BIGINT AS after FROM clean GROUP BY 1",
    "n3_annualize_salary": """
WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS lo, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice + 10.5 END AS hi, ['hour', 'day', 'week', 'month', 'year', 'unknown'][o_orderkey % 6 + 1] AS period, [2080, 260, 52, 12, 1, 1][o_orderkey % 6 + 1] AS f FROM orders)
SELECT o_orderkey, period, floor(lo * f + 0.5)::BIGINT AS "annualMin", floor(coalesce(hi, lo) * f + 0.5)::BIGINT AS "annualMax" FROM r""",
    "n4_extract_disclosed_salary": """
WITH r AS (SELECT o_orderkey AS k, 20 + o_orderkey % 700 AS lo, 30 + o_orderkey % 900 AS hi FROM orders)
SELECT k AS "jobId", lo * 1000 AS "annualMin", hi * 1000 AS "annualMax", '$' || lo || ',000 - $' || hi || ',000 USD' AS "sourceText", (CASE WHEN k % 2 = 0 THEN 3 ELSE 7 END)::INT AS score FROM r WHERE hi >= lo AND (k % 2 = 0 OR true)""",
    "n5_tag_skills": f"""
WITH d AS (SELECT doc_id, ' ' || lower(text) || ' ' AS t FROM documents), v AS (SELECT unnest({list(_WORDS)}) AS term, generate_subscripts({list(_WORDS)}, 1) AS rank)
SELECT doc_id, string_agg(term, ',' ORDER BY rank) AS skills FROM d JOIN v ON regexp_matches(t, '[^a-z0-9+#]' || term || '[^a-z0-9+#]') GROUP BY doc_id""",
    "n6_classify_titles": """
SELECT CASE p_size % 5 WHEN 0 THEN 'Senior' WHEN 1 THEN 'Leadership' WHEN 2 THEN 'Entry' ELSE 'Mid-level' END AS seniority, CASE p_size % 3 WHEN 1 THEN 'Design' ELSE 'Data & AI' END AS "titleFamily", count(*) AS jobs FROM part GROUP BY 1, 2""",
    "n7_assign_identity": """
SELECT o_orderkey AS key, sha256(CASE WHEN o_orderkey % 3 = 0 THEN 'jobs.example.com:' || o_custkey ELSE lower(o_orderpriority || '|' || o_orderstatus || '|' || o_custkey || '|https://x.example.com/') END)[1:32] AS "jobId",
  sha256('{"title":"' || o_orderstatus || '","companyName":"' || o_orderpriority || '","location":"' || o_custkey || '"}') AS "contentHash" FROM orders""",
    "n7_identity_collisions": """SELECT sha256('h:' || o_custkey)[1:32] AS "jobId", count(DISTINCT o_orderstatus) AS hashes FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1""",
    "n9_card_view": """
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 4 AS m, floor(o_totalprice) AS p, *, date_diff('minute', o_orderdate, TIMESTAMP '2001-08-02 00:01:00') AS mins FROM orders),
l AS (SELECT *, CASE WHEN p >= 1000 THEN floor(p / 1000 + 0.5)::BIGINT || 'k' ELSE p::BIGINT::VARCHAR END AS lo, floor((p + 1000) / 1000 + 0.5)::BIGINT || 'k' AS hi, CASE m WHEN 1 THEN '$' WHEN 2 THEN 'EUR ' ELSE '' END AS cur FROM r)
SELECT k AS "jobId", 'Company undisclosed' AS company, o_orderstatus AS title, o_orderpriority || CASE WHEN m = 0 THEN '' ELSE ' · remote' END AS place,
  CASE WHEN k % 9 = 0 THEN 'as told' WHEN m = 2 THEN cur || lo || '+' WHEN m = 3 THEN 'Up to ' || cur || hi ELSE cur || lo || '–' || hi END AS pay,
  CASE WHEN mins < 2 THEN 'Just indexed' WHEN mins < 60 THEN mins || 'm ago' WHEN mins < 1440 THEN (mins // 60) || 'h ago' ELSE (mins // 1440) || 'd ago' END AS age FROM l""",
}
SQL["s8_bucketed_upsert"] = SQL["s8_upsert_postings"]
