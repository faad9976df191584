"""Profiles, matches, lookups, applications, reports, model outputs, streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import applications, lookups, outputs, profiles, reports
from ..plans.jobs_view import ORDERS_WIDE_SQL, orders_wide, table
from ..plans.stored import folder, small_or_merge, stored
from ..streaming import apps, runs

NOW = "2024-02-01 00:00:00"
_SKILLS = {"Rust": ("the", "le"), "Go": ("und der", "und"), "SQL": ("de la", "de"), "React": ("that",), "AWS": ("of",), "Java": ("queue",)}
_ROLES = (("Backend Role", ("Go", "Rust", "Java")), ("Data Role", ("SQL", "Go", "Rust")), ("Front Role", ("React", "AWS")), ("Cloud Role", ("AWS", "SQL")))


def _pages(spark, d):
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text")


def c1_gate_documents(spark, d):
    ok, bad = profiles.gate_documents(_pages(spark, d))
    return ok.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages")).withColumn("code", F.lit("ok")).unionByName(bad.withColumn("pages", F.lit(None).cast("long")))


def _evidence(spark, d):
    return profiles.extract_skill_evidence(profiles.gate_documents(_pages(spark, d))[0], profiles.alias_table(spark, _SKILLS))


def c2_extract_skill_evidence(spark, d):
    return _evidence(spark, d).select("doc_id", "skill", "page", "start", F.lower("matchedText").alias("matched"))


def c3_infer_roles(spark, d):
    r = profiles.infer_roles(_evidence(spark, d), profiles.signal_table(spark, _ROLES), _pages(spark, d))
    return r.select("doc_id", F.array_join("roles", ",").alias("roles"))


def _year_pages(spark, d):
    e = table(spark, d, "events")
    text = F.concat(F.lit("Led teams. "), (F.col("event_id") % 70).cast("string"), F.when(F.col("event_id") % 3 == 0, "+ years of professional experience").when(F.col("event_id") % 3 == 1, " year experience").otherwise(" years old"))
    return e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("page"), text.alias("text"))


def c4_extract_years_experience(spark, d):
    return profiles.extract_years_experience(_year_pages(spark, d))


def c5_build_profiles(spark, d):
    p = _pages(spark, d)
    ev = _evidence(spark, d)
    roles = profiles.infer_roles(ev, profiles.signal_table(spark, _ROLES), p)
    some = p.select("doc_id").distinct()
    null = lambda t: F.expr(f"CAST(NULL AS {t})")
    prefs = some.where("doc_id % 4 = 0").select("doc_id", F.when(F.col("doc_id") % 8 == 0, F.array(F.lit("Chief"))).alias("targetRoles"), F.when(F.col("doc_id") % 3 == 0, "Rome").alias("city"), null("string").alias("region"), F.lit(5).alias("radiusMiles"), F.when(F.col("doc_id") % 5 == 0, F.array(F.lit("onsite"))).alias("workModes"))
    years = profiles.extract_years_experience(p)
    out = profiles.build_profiles(some, ev, roles, years, prefs)
    return out.select("doc_id", F.array_join("targetRoles", ",").alias("roles"), "rolesSource", "location.city", "location.region", "location.radiusMiles", F.array_join("workModes", ",").alias("modes"), "workModesSource", F.size("skills").alias("n_skills"), "summary")


def _candidates(spark, d):
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("candidate"), F.array(F.concat(F.lit("BRAND#"), F.col("c_custkey") % 25 + 1), F.concat(F.lit("Brand#"), F.col("c_nationkey") % 25 + 1)).alias("skills"), F.array(F.concat(F.lower("c_mktsegment"), F.lit(" of"))).alias("roles"), F.array(F.lit("O")).alias("workModes"))


def j4_match_candidates(spark, d):
    jobs = orders_wide(spark, d).select("jobId", F.col("titleFamily").alias("title"), "skills", "workMode")
    return lookups.match_candidates(_candidates(spark, d), jobs, 10).select("candidate", "jobId", "score", "rank", F.array_join("reasons", ";").alias("reasons"))


def _materials(spark, d):
    docs = table(spark, d, "documents")
    return outputs.build_source_material(docs.select(F.col("doc_id").alias("jobId"), F.col("lang").alias("title"), F.col("source").alias("companyName"), F.lit(" ").alias("location"), F.col("text").alias("description"), F.lit("").alias("requirements"), F.array(F.lit("a"), F.lit("b")).alias("skills")))


def n10_build_source_material(spark, d):
    return _materials(spark, d).select("jobId", F.length("material").alias("chars"), F.md5(F.encode("material", "utf-8")).alias("digest"))


def _raw_outputs(spark, d):
    k = F.col("doc_id")
    body = F.concat(F.lit('{"oneLiner":"A line of text","mission":"A mission text","highlights":["one","two"],"mustHaveSkills":[],"whyYouMightLoveIt":"Because it is","interviewSignals":[],"evidence":['), F.lit('{"claim":"claim","sourceText":"'), F.when(k % 2 == 0, F.lit("of the")).otherwise("nowhere to be found"), F.lit('"}]'), F.when(k % 7 == 0, F.lit(',"more":1')).otherwise(""), F.when(k % 11 == 0, F.lit("")).otherwise("}"))
    raw = F.when(k % 13 == 0, F.lit("")).when(k % 5 == 0, F.lit("no json here")).otherwise(F.concat(F.lit("```json\n"), body, F.lit("\n```")))
    return table(spark, d, "documents").select(k.alias("jobId"), raw.alias("raw"))


def n11_parse_model_profiles(spark, d):
    ok, bad = outputs.parse_model_profiles(_raw_outputs(spark, d))
    return ok.select("jobId", F.lit("ok").alias("code")).unionByName(bad)


def j5_verify_evidence(spark, d):
    ok, _ = outputs.parse_model_profiles(_raw_outputs(spark, d))
    return lookups.verify_evidence(ok.select("jobId", "evidence"), _materials(spark, d)).select("jobId", F.size("evidence").alias("kept"), "dropped")


def w1_verify_runs(spark, d):
    e = table(spark, d, "events")
    runs = e.select(F.col("event_id").alias("run_id"), "event_type", F.concat(F.lit("actor"), F.col("user_id") % 3).alias("actor_id"), F.when(F.col("event_type") == "purchase", "SUCCEEDED").when(F.col("event_type") == "view", F.lit(None)).otherwise("SUCCEEDED").alias("status"), F.when(F.col("event_type") != "click", "ds").alias("dataset_id"))
    allowed = table(spark, d, "region").where("r_regionkey < 2").select(F.concat(F.lit("actor"), "r_regionkey").alias("actor_id"))
    return lookups.verify_runs(runs, allowed).groupBy(F.coalesce("reason", F.lit("ok")).alias("reason")).agg(F.count(F.lit(1)).alias("runs"))


def _applications(spark, d):
    e = table(spark, d, "events").select(F.concat(F.lit("s"), F.col("user_id") % 3).alias("sessionHash"), F.floor(F.col("event_id") / 4).alias("jobId"), "event_type")
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("jobId"), F.when(F.col("o_orderkey") % 17 == 0, "closed").otherwise("active").alias("status"), *(F.lit("x").alias(c) for c in lookups.SNAPSHOT))
    old = e.where("event_type = 'signup'").select("sessionHash", "jobId").distinct()
    existing = old.select(lookups.application_id("sessionHash", "jobId").alias("applicationId"), "sessionHash", "jobId")
    return e.where("event_type <> 'signup'"), jobs, existing


def w2_save_applications(spark, d):
    created, there, bad = lookups.save_applications(*_applications(spark, d), NOW)
    a = created.select("applicationId", "sessionHash", "jobId", F.lit("created").alias("outcome"))
    b = there.select("applicationId", "sessionHash", "jobId", F.lit("existing").alias("outcome"))
    return a.unionByName(b).unionByName(bad.select(F.lit(None).cast("string").alias("applicationId"), "sessionHash", "jobId", F.col("reason").alias("outcome")))


def t3_list_applications(spark, d):
    e = table(spark, d, "events")
    apps_ = e.select(F.col("event_id").alias("applicationId"), F.concat(F.lit("s"), F.col("user_id") % 5).alias("sessionHash"), F.col("ts").alias("savedAt"))
    items, total = applications.list_applications(apps_, "s1")
    return items.select("applicationId").crossJoin(F.broadcast(total))  # one row


def w3_split_profile_cache(spark, d):
    docs = table(spark, d, "documents")
    jobs = docs.select(F.col("doc_id").alias("jobId"), F.md5(F.encode("text", "utf-8")).alias("contentHash"))
    stored_ = docs.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("jobId"), F.when(F.col("doc_id") % 2 == 0, F.md5(F.encode("text", "utf-8"))).otherwise("old").alias("sourceContentHash"))
    hits, misses = lookups.split_profile_cache(jobs, stored_)
    return hits.select("jobId", F.lit("hit").alias("cache")).unionByName(misses.select("jobId", F.lit("miss").alias("cache")))


def w4_audit_submissions(spark, d):
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    leases = o.select(k.alias("applicationId"), F.col("o_orderdate").alias("expiresAt"), (k % 7 != 0).alias("hasToken"), (k % 5 != 0).alias("submissionAuthorized"), (k % 11 == 0).alias("priorSubmission"))
    approvals = o.where("o_orderkey % 3 <> 0").select(k.alias("applicationId"), F.when(k % 13 == 0, "all").otherwise("single_application").alias("scope"), F.date_add("o_orderdate", 100).cast("timestamp_ntz").alias("expiresAt"))
    return lookups.audit_submissions(leases, approvals, "1998-01-01 00:00:00").groupBy("verdict").agg(F.count(F.lit(1)).alias("leases"))


_ACTIONS = {"view": "package_ready", "click": "request_approval", "purchase": "approve", "error": "system:queued", "signup": "system:actor_running"}


def _app_events(spark, d):
    action = F.element_at(F.create_map(*(F.lit(x) for kv in _ACTIONS.items() for x in kv)), F.col("event_type"))
    return table(spark, d, "events").select(F.col("user_id").alias("applicationId"), "ts", F.col("event_id").alias("seq"), action.alias("action"))


def v1_fold_applications(spark, d):
    state, _ = applications.fold_applications(_app_events(spark, d))
    return state.select("applicationId", "status", "n_rejected", F.date_format("approvedAt", "yyyy-MM-dd HH:mm:ss").alias("approved"))


def v1_rejected_actions(spark, d):
    return applications.fold_applications(_app_events(spark, d))[1].groupBy("action", "status").agg(F.count(F.lit(1)).alias("rejections"))


def _stream(spark, d, name):
    path = f"{d}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(f"{path}*")


def _work(spark, name):
    return f"{folder(spark)}/streams/{name}-{uuid.uuid4().hex}"


def _shuffled(spark, df, end, name):
    """df as a stream of FILES files of rows in no order, one a batch, then one file with the row that ends it."""
    pieces = stored(df.repartition(FILES, F.xxhash64("seq")), name)
    end.select(*(F.col(f.name).cast(f.dataType) for f in pieces.schema)).coalesce(1).write.mode("append").parquet(pieces.stored_path)
    return spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", 1).parquet(pieces.stored_path)


def v2_stream_applications(spark, d):
    events = _app_events(spark, d)
    end = events.agg((F.max("ts") + F.expr("INTERVAL 100 DAYS")).alias("ts")).select(F.lit(None).alias("applicationId"), "ts", F.lit(None).alias("seq"), F.lit(None).alias("action"))
    stream = apps.stream_applications(_shuffled(spark, events, end, "v2-events"), 40 * apps.DAY, 40 * apps.DAY)
    rows = apps.drain(stream, _work(spark, "v2-out"), _work(spark, "v2")).where("applicationId IS NOT NULL")
    return rows.groupBy("applicationId").agg(F.max_by("status", F.struct("us", "seq")).alias("status"), F.count_if(~F.col("accepted")).alias("n_rejected"))


#: Batches that the streamed runs are spread over, and about how many bytes of text a file of them holds at most.
FILES, FILE_BYTES = 3, 64 << 20

#: Columns of the canonical job, as ingestion keeps them.
_JOB = "jobId string, title string, companyName string, location string, sourceUrl string, sourceRunId string, status string, contentHash string, searchText string"


def _ingested(spark, d):
    """Documents as runs of raw items, one run a source, in FILES batches that each hold a part of each run, of as
    many files as their size asks for; one run's actor isn't allowed, one hasn't succeeded."""
    docs = table(spark, d, "documents")
    totals = docs.groupBy("source").agg(F.count(F.lit(1)).alias("total"))
    posting = F.struct(F.when(F.col("doc_id") % 9 != 0, F.concat(F.lit("Engineer "), F.floor(F.col("doc_id") / 2))).alias("title"), F.col("text").alias("description"), F.struct(F.coalesce("lang", F.lit("")).alias("name")).alias("hiringOrganization"), F.struct(F.floor(F.col("doc_id") / 2).cast("string").alias("value")).alias("identifier"))
    payload = F.to_json(F.struct(F.concat(F.lit("https://jobs.example.com/"), F.col("doc_id").cast("string")).alias("sourceUrl"), posting.alias("jobPosting")))
    items = docs.join(small_or_merge(totals), "source").select(F.col("source").alias("run_id"), F.when(F.length("source") % 4 == 3, "other").otherwise("crawler").alias("actor_id"), F.when(F.length("source") % 4 == 2, "FAILED").otherwise("SUCCEEDED").alias("run_status"), F.lit("ds").alias("dataset_id"), "total", F.col("doc_id").alias("item"), payload.alias("payload"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    per = max(1, -(-size // (FILES * FILE_BYTES)))
    pieces = stored(items.repartition(FILES * per), "crawled")
    stream = spark.readStream.schema(pieces.schema).option("maxFilesPerTrigger", per).parquet(pieces.stored_path)
    allowed = spark.range(1).select(F.lit("crawler").alias("actor_id"))
    root = _work(spark, "v3")
    target = runs.Target(spark, f"{root}/target", "jobId")
    schema = spark.createDataFrame([], _JOB).schema
    runs.stream_ingest(stream, root, target, allowed, "item_index", NOW, schema)
    return target, schema


def v3_stream_ingest(spark, d):
    target, schema = _ingested(spark, d)
    return target.latest(schema).groupBy("sourceRunId").agg(F.count(F.lit(1)).alias("jobs"), F.max("title").alias("last"))


def v3_ingest_ledger(spark, d):
    target, _ = _ingested(spark, d)
    return runs.read_ledger(spark, target).select("run_id", "status", "collected", "accepted", "rejected", "indexed", "failed", "error")


def v4_dedupe_deliveries(spark, d):
    events = _stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"), F.concat_ws("-", (F.col("event_id") / 2).cast("long"), F.lit("run")).alias("delivery"))
    rows = apps.drain(apps.dedupe_deliveries(events, "delivery", "at", "60 days"), _work(spark, "v4-out"), _work(spark, "v4"))
    return rows.select("delivery")


def v5_cadence_counts(spark, d):
    c = apps.cadence_counts(table(spark, d, "events"), "ts", "10 minutes")
    return c.select(F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), "items")


def v5_stream_cadence(spark, d):
    events = _stream(spark, d, "events").select(F.col("ts").cast("timestamp").alias("at"))
    rows = apps.drain(apps.stream_cadence(events, "at"), _work(spark, "v5-out"), _work(spark, "v5"), "complete")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("slot"), "items")


def a3_run_report(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("run_id"), F.col("doc_id").alias("index"), "lang", "n_chars")
    bad, fine = docs.where("n_chars < 200").withColumn("code", F.lit("short")), docs.where("n_chars >= 200")
    failed = fine.where("lang = 'es' AND index % 50 = 0").withColumn("code", F.lit("strict"))
    r = reports.run_report(docs, fine, bad, failed)
    first = lambda c: F.array_join(F.transform(c, lambda x: x["index"].cast("string")), ",")
    return r.select("run_id", "collected", "accepted", "rejected", "indexed", "failed", "status", first("first_rejected").alias("first"))


def a4_inventory_counts(spark, d):
    led = table(spark, d, "events").select(F.col("event_id").cast("string").alias("run_id"), F.col("ts").alias("finished_at"))
    return reports.inventory_counts({"jobs": table(spark, d, "orders"), "profiles": table(spark, d, "customer"), "applications": None}, led)


QUERIES = {f.__name__: f for f in (c1_gate_documents, c2_extract_skill_evidence, c3_infer_roles, c4_extract_years_experience, c5_build_profiles, j4_match_candidates, n10_build_source_material, n11_parse_model_profiles, j5_verify_evidence, w1_verify_runs, w2_save_applications, t3_list_applications, w3_split_profile_cache, w4_audit_submissions, v1_fold_applications, v1_rejected_actions, v2_stream_applications, v3_stream_ingest, v3_ingest_ledger, v4_dedupe_deliveries, v5_cadence_counts, v5_stream_cadence, a3_run_report, a4_inventory_counts)}

_CLEAN = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
_GATE = rf"""
p AS (SELECT conv_id AS doc_id, turn AS page, {_CLEAN} AS text FROM conversations),
g AS (SELECT doc_id, count(*) AS pages, sum(length(text)) AS chars, sum(length(regexp_replace(text, '\s', '', 'g'))) AS ink FROM p GROUP BY doc_id),
judged AS (SELECT *, CASE WHEN pages NOT BETWEEN 1 AND 12 THEN 'RESUME_PAGE_LIMIT' WHEN chars > 100000 THEN 'RESUME_TEXT_LIMIT' WHEN ink < 40 THEN 'RESUME_TEXT_EMPTY' END AS code FROM g)"""
_ALIASES = ", ".join(f"('{s}', '{a}')" for s, al in _SKILLS.items() for a in al)
_EVIDENCE = rf"""{_GATE},
al AS (SELECT * FROM (VALUES {_ALIASES}) AS t(skill, alias)),
hits AS (SELECT p.doc_id, page, skill, alias, length(regexp_extract(' ' || lower(text) || ' ', '^(?s)(.*?[^\p{{L}}\p{{N}}])' || alias || '[^\p{{L}}\p{{N}}]', 1)) - 1 AS start
  FROM p JOIN judged USING (doc_id) CROSS JOIN al WHERE code IS NULL AND regexp_matches(' ' || lower(text) || ' ', '[^\p{{L}}\p{{N}}]' || alias || '[^\p{{L}}\p{{N}}]')),
ev AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, skill ORDER BY page, length(alias) DESC, start) = 1)"""
_SIGNALS = ", ".join(f"('{r}', {i}, '{s}')" for i, (r, ss) in enumerate(_ROLES) for s in ss)
_ROLES_SQL = f"""{_EVIDENCE},
sig AS (SELECT * FROM (VALUES {_SIGNALS}) AS t(role, ord, skill)),
rk AS (SELECT doc_id, role, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, ord) AS r FROM ev JOIN sig USING (skill) GROUP BY doc_id, role, ord),
roles AS (SELECT d.doc_id, coalesce(string_agg(role, ',' ORDER BY r) FILTER (WHERE r <= 3), 'Software Engineer') AS roles FROM (SELECT DISTINCT conv_id AS doc_id FROM conversations) d LEFT JOIN rk USING (doc_id) GROUP BY d.doc_id)"""
_MATERIAL = """m AS (SELECT doc_id AS "jobId", trim(regexp_replace(regexp_replace(regexp_replace(concat_ws(chr(10), trim(lang), trim(source), nullif(trim(text), ''), 'a, b'), '&[a-zA-Z#0-9]+;', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))[1:9000] AS material FROM documents)"""
_CODE = "CASE WHEN k % 13 = 0 THEN 'empty' WHEN k % 5 = 0 THEN 'no_json' WHEN k % 11 = 0 THEN 'invalid_json' WHEN k % 7 = 0 THEN 'contract' ELSE 'ok' END"
_CASES = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _ACTIONS.items())
_MOVES = " ".join(f"WHEN action = '{a}' AND st IN ({', '.join(repr(x) for x in (after, *before))}) THEN '{after}'" for a, (after, before) in applications.MOVES.items())
_FOLD = f"""
RECURSIVE e AS (SELECT user_id AS app, ts, CASE event_type {_CASES} END AS action, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
f(app, n, st, ok, rej, action, was) AS (
  SELECT DISTINCT app, 0::BIGINT, 'saved', NULL::TIMESTAMP, 0, NULL::VARCHAR, NULL::VARCHAR FROM e
  UNION ALL SELECT app, n, coalesce(t, st), CASE WHEN t = 'approved' AND st <> 'approved' THEN ts ELSE ok END, rej + (t IS NULL)::INT, action, CASE WHEN t IS NULL THEN st END
  FROM (SELECT e.app, e.n, f.st, f.ok, f.rej, e.ts, e.action, CASE {_MOVES.replace('action =', 'e.action =').replace(' st IN', ' f.st IN')} END AS t FROM f JOIN e ON e.app = f.app AND e.n = f.n + 1))"""
_LAST = "SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY app ORDER BY n DESC) = 1"

_INGEST = r"""i AS (SELECT *, CASE length(source) % 4 WHEN 3 THEN 'actor' WHEN 2 THEN 'status' END AS reason, doc_id % 9 <> 0 AND trim(regexp_replace(text, '\s+', ' ', 'g')) <> '' AND trim(coalesce(lang, '')) <> '' AS fine FROM documents),
good AS (SELECT * FROM i WHERE reason IS NULL AND fine)"""

SQL = {
    "c1_gate_documents": f"WITH {_GATE} SELECT doc_id, coalesce(code, 'ok') AS code, CASE WHEN code IS NULL THEN pages END AS pages FROM judged",
    "c2_extract_skill_evidence": f"WITH {_EVIDENCE} SELECT doc_id, skill, page, start::INT AS start, alias AS matched FROM ev",
    "c3_infer_roles": f"WITH {_ROLES_SQL} SELECT doc_id, roles FROM roles",
    "c4_extract_years_experience": """
WITH r AS (SELECT user_id AS doc_id, event_id AS page, event_id % 70 AS years FROM events WHERE event_id % 3 < 2 AND event_id % 70 <= 50)
SELECT doc_id, page, years::INT AS years, 11 AS start FROM r QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page) = 1""",
    "c5_build_profiles": f"""WITH {_ROLES_SQL},
sk AS (SELECT doc_id, list(skill ORDER BY page, start, skill) AS s FROM ev GROUP BY doc_id)
SELECT doc_id, t AS roles, CASE WHEN doc_id % 8 = 0 THEN 'user_preference' ELSE 'resume_inference' END AS "rolesSource", CASE WHEN doc_id % 12 = 0 THEN 'Rome' ELSE 'Austin' END AS city, 'Texas' AS region,
  CASE WHEN doc_id % 12 = 0 THEN 5 ELSE 50 END AS "radiusMiles", CASE WHEN doc_id % 20 = 0 THEN 'onsite' ELSE 'remote,hybrid' END AS modes, CASE WHEN doc_id % 20 = 0 THEN 'user_preference' ELSE 'demo_default' END AS "workModesSource",
  coalesce(len(s), 0)::INT AS n_skills, 'Candidate profile aligned to ' || replace(t, ',', ', ') || '.' || CASE WHEN s IS NULL THEN ' No technology claims were inferred without direct resume evidence.' ELSE ' Evidence in the resume includes ' || array_to_string(s[1:6], ', ') || '.' END AS summary
FROM (SELECT *, CASE WHEN doc_id % 8 = 0 THEN 'Chief' ELSE roles END AS t FROM roles LEFT JOIN sk USING (doc_id))""",
    "j4_match_candidates": f"""WITH {ORDERS_WIDE_SQL},
c AS (SELECT c_custkey AS candidate, list_distinct(['brand#' || (c_custkey % 25 + 1), 'brand#' || (c_nationkey % 25 + 1)]) AS cs, lower(c_mktsegment) AS seg FROM customer),
x AS (SELECT candidate, "jobId", list_filter(list_transform(skills, lambda s: lower(s)), lambda s: list_contains(cs, s)) AS m, contains(lower("titleFamily"), seg) AS role, "workMode" = 'O' AS mode FROM c CROSS JOIN jobs),
s AS (SELECT *, least(99, 20 + least(60, 12 * len(m)) + CASE WHEN role THEN 15 ELSE 0 END + CASE WHEN mode THEN 5 ELSE 0 END)::INT AS score FROM x)
SELECT candidate, "jobId", score, row_number() OVER (PARTITION BY candidate ORDER BY score DESC, "jobId") AS rank,
  array_to_string(list_concat(list_transform(m[1:4], lambda s: 'Resume evidence: ' || s), CASE WHEN role THEN ['Target-role alignment'] ELSE [] END, CASE WHEN mode THEN ['O preference'] ELSE [] END), ';') AS reasons
FROM s QUALIFY rank <= 10""",
    "n10_build_source_material": f"""WITH {_MATERIAL} SELECT "jobId", length(material)::INT AS chars, md5(material) AS digest FROM m""",
    "n11_parse_model_profiles": f"""SELECT k AS "jobId", {_CODE} AS code FROM (SELECT doc_id AS k FROM documents)""",
    "j5_verify_evidence": f"""WITH {_MATERIAL}, x AS (SELECT "jobId" AS k, contains(lower(material), CASE WHEN "jobId" % 2 = 0 THEN 'of the' ELSE 'nowhere to be found' END) AS hit FROM m)
SELECT k AS "jobId", hit::INT AS kept, (NOT hit)::INT AS dropped FROM x WHERE {_CODE} = 'ok'""",
    "w1_verify_runs": """SELECT CASE WHEN event_type = 'view' THEN 'not_found' WHEN user_id % 3 >= 2 THEN 'actor_not_allowed' WHEN event_type = 'click' THEN 'no_dataset' ELSE 'ok' END AS reason, count(*) AS runs FROM events GROUP BY 1""",
    "w2_save_applications": """
WITH e AS (SELECT DISTINCT 's' || (user_id % 3) AS s, event_id // 4 AS j, event_type = 'signup' AS old FROM events),
a AS (SELECT s, j, bool_or(old) AS was, bool_or(NOT old) AS asked FROM e GROUP BY s, j HAVING bool_or(NOT old)),
r AS (SELECT *, CASE WHEN was THEN 'existing' WHEN o_orderkey IS NULL THEN 'JOB_NOT_FOUND' WHEN j % 17 = 0 THEN 'JOB_NOT_ACTIVE' ELSE 'created' END AS outcome FROM a LEFT JOIN (SELECT o_orderkey FROM orders) ON j = o_orderkey)
SELECT CASE WHEN outcome IN ('created', 'existing') THEN 'app_' || sha256('application:' || s || ':' || j)[1:40] END AS "applicationId", s AS "sessionHash", j AS "jobId", outcome FROM r""",
    "t3_list_applications": """SELECT event_id AS "applicationId", count(*) OVER () AS total FROM events WHERE user_id % 5 = 1 ORDER BY ts DESC, event_id LIMIT 200""",
    "w3_split_profile_cache": """SELECT doc_id AS "jobId", CASE WHEN doc_id % 3 <> 0 AND doc_id % 2 = 0 THEN 'hit' ELSE 'miss' END AS cache FROM documents""",
    "w4_audit_submissions": """
SELECT CASE WHEN k % 11 = 0 THEN 'already_submitted' WHEN o_orderdate <= lim THEN 'lease_expired' WHEN k % 7 = 0 THEN 'no_token' WHEN k % 5 = 0 THEN 'not_authorized' WHEN k % 3 = 0 THEN 'no_approval' WHEN k % 13 = 0 THEN 'wrong_scope'
  WHEN o_orderdate + INTERVAL 100 DAYS <= lim THEN 'approval_expired' ELSE 'allowed' END AS verdict, count(*) AS leases FROM (SELECT *, o_orderkey AS k, TIMESTAMP '1998-01-01 00:00:05' AS lim FROM orders) GROUP BY 1""",
    "v1_fold_applications": f"""WITH {_FOLD}, l AS ({_LAST}) SELECT app AS "applicationId", st AS status, rej AS n_rejected, strftime(ok, '%Y-%m-%d %H:%M:%S') AS approved FROM l""",
    "v1_rejected_actions": f"WITH {_FOLD} SELECT action, was AS status, count(*) AS rejections FROM f WHERE was IS NOT NULL GROUP BY 1, 2",
    "v2_stream_applications": f"""WITH {_FOLD}, l AS ({_LAST}) SELECT app AS "applicationId", st AS status, rej::BIGINT AS n_rejected FROM l""",
    "v3_stream_ingest": f"WITH {_INGEST}, l AS (SELECT * FROM good QUALIFY row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id DESC) = 1) SELECT source AS \"sourceRunId\", count(*) AS jobs, max('Engineer ' || (doc_id // 2)) AS last FROM l GROUP BY source",
    "v3_ingest_ledger": f"""WITH {_INGEST}, r AS (SELECT source, any_value(reason) AS reason, count(*) AS n, count(*) FILTER (fine) AS a FROM i GROUP BY source)
SELECT source AS run_id, CASE WHEN reason IS NULL THEN 'complete' ELSE 'failed' END AS status, CASE WHEN reason IS NULL THEN n ELSE 0 END AS collected, CASE WHEN reason IS NULL THEN a ELSE 0 END AS accepted, CASE WHEN reason IS NULL THEN n - a ELSE 0 END AS rejected,
  CASE WHEN reason IS NULL THEN a ELSE 0 END AS indexed, CASE WHEN reason IS NULL THEN 0 ELSE 1 END::BIGINT AS failed, CASE WHEN reason IS NOT NULL THEN 'not verified' END AS error FROM r""",
    "v4_dedupe_deliveries": "SELECT DISTINCT (event_id // 2) || '-run' AS delivery FROM events",
    "v5_stream_cadence": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS slot, count(*) AS items FROM events GROUP BY 1",
    "v5_cadence_counts": """
WITH s AS (SELECT time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01') AS slot, count(*) AS items FROM events GROUP BY 1),
g AS (SELECT unnest(generate_series((SELECT min(slot) FROM s), (SELECT max(slot) FROM s), INTERVAL '10 minutes')) AS slot)
SELECT strftime(slot, '%Y-%m-%d %H:%M') AS slot, coalesce(items, 0) AS items FROM g LEFT JOIN s USING (slot)""",
    "a3_run_report": """
WITH d AS (SELECT *, n_chars < 200 AS bad, n_chars >= 200 AND lang = 'es' AND doc_id % 50 = 0 AS fail FROM documents),
f AS (SELECT source, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS first FROM (SELECT * FROM d WHERE bad QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 25) GROUP BY source)
SELECT d.source AS run_id, count(*) AS collected, count(*) FILTER (NOT bad) AS accepted, count(*) FILTER (bad) AS rejected, count(*) FILTER (NOT bad) - count(*) FILTER (fail) AS indexed, count(*) FILTER (fail) AS failed,
  CASE WHEN count(*) FILTER (fail) = 0 THEN 'complete' ELSE 'partial' END AS status, any_value(f.first) AS first FROM d LEFT JOIN f ON d.source = f.source GROUP BY d.source""",
    "a4_inventory_counts": """SELECT name, n AS "rows", (SELECT max_by(event_id, ts)::VARCHAR FROM events) AS latest_run FROM (SELECT 'jobs' AS name, count(*) AS n FROM orders UNION ALL SELECT 'profiles', count(*) FROM customer UNION ALL SELECT 'applications', 0)""",
}
