"""Operators on small rows: plain versions and cases that the shared tables don't hold."""

import datetime
import json
from dataclasses import replace

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from jobsignal.functions import urls
from jobsignal.operators import contracts, lexical, lookups, normalize, outputs, planned, salary, search, vectors
from jobsignal.plans import components, stored
from jobsignal.plans.requests import SearchRequest
from jobsignal.sources import harvest, store

NOW = "2026-07-31 00:00:00"


def item(**over):
    posting = {"title": "Senior Platform Engineer", "description": "<p>Go and Kubernetes</p>", "hiringOrganization": {"name": "Acme"}, "jobLocation": {"address": {"addressLocality": "Austin", "addressRegion": "TX", "addressCountry": "US"}}}
    return json.dumps({"sourceUrl": "https://jobs.example.com/1", "jobPosting": posting | over})


def judged(spark, payloads):
    rows = spark.createDataFrame(list(enumerate(payloads)), "item long, payload string")
    return {r["item"]: r for r in normalize.judge_postings(rows, "run", NOW).collect()}


def test_judged_postings_are_compiled(spark):
    """A generator that holds a lambda is interpreted as a whole; a record's fields are read together, not by their paths."""
    rows = spark.createDataFrame([(1, item())], "item long, payload string")
    plan = normalize.judge_postings(rows, "run", NOW)._jdf.queryExecution().optimizedPlan().toJSON()
    nodes = json.loads(plan)
    assert '"postedAt"' in plan or "postedAt" in plan
    assert not any("Generate" in n["class"] and "LambdaFunction" in json.dumps(n["generator"]) for n in nodes)


def test_judged_places(spark):
    got = judged(spark, [item(jobLocation=[{"address": {}}, {"address": {"addressLocality": ["", "Rome"], "addressCountry": {"name": "IT"}}}]), item(jobLocation="x"), item(jobLocation={"addressRegion": "TX"})])
    assert [got[i]["location"] for i in range(3)] == ["Rome", "Location not specified", "TX"]


def test_contract_rejects(spark):
    told = {"baseSalary": {"currency": "USD", "value": {"minValue": 75, "maxValue": 100, "unitText": "HOUR"}}}
    text = "The annual base salary range for this role is $168,000 - $205,000 USD."
    got = judged(spark, [item(), json.dumps({"sourceUrl": "https://jobs.example.com/1"}), "no json", json.dumps(json.loads(item()) | {"sourceUrl": "https://./1"}), item(**told), item(description=text), json.dumps(json.loads(item()) | {"sourceUrl": None})])
    assert [got[i]["code"] for i in range(7)] == [None, "missing_core_fields", "missing_url", "unknown", None, None, "missing_url"]
    assert got[0].salary.min is None and got[0].location == "Austin, TX, US" and list(got[0].skills) == ["Go", "Kubernetes"] and len(got[0].contentHash) == 64
    assert (got[4].salary.annualMin, got[4].salary.annualMax, got[4].salary.period) == (156000.0, 208000.0, "hour")
    assert (got[5].salary.min, got[5].salary.annualMax, got[5].salary.sourceText) == (168000.0, 205000.0, "$168,000 - $205,000 USD")


def test_best_range(spark):
    rows = [
        (1, "In Colorado the salary range is $120k-$140k. In California the base salary range is $155k-$190k.", 155000.0), (2, "$50,000-$100,000 monthly cloud budgets", None), (3, "no pay", None), (4, None, None),
        (5, "Pay is $40 - $55 per hour, or $2,000 - $3,000 per hour.", None), (6, "Hourly $40k", None),
    ]
    df = spark.createDataFrame([(i, t, "Denver", "US") for i, t, _ in rows], "jobId long, description string, location string, locationCountry string")
    got = {r.jobId: r.min for r in salary.extract_disclosed_salary(df).collect()}
    assert got == {i: x for i, _, x in rows if x is not None}


def test_request_bounds(spark):
    for bad in ({"skills": tuple("x" * 31)}, {"skills": ("x" * 81,)}, {"workModes": ("remote", "hybrid", "onsite", "remote")}, {"companies": ("",)}):
        with pytest.raises(ValueError):
            SearchRequest(filters=bad)
    with pytest.raises(ValueError):
        SearchRequest(cursor="x" * 4097)
    names = list(contracts.FILTER_BOUNDS)
    row = lambda **over: [over.get(n) for n in names]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate([row(), row(skills=["a"] * 31), row(seniority=["x" * 81]), row(workModes=["unknown"]), row(companies=[""]), row(industries=["a"])])], "id long, " + ", ".join(f"{n} array<string>" for n in names))
    assert {(r.id, r.rule) for r in contracts.validate_contract(df, "id", contracts.filter_rules()).collect()} == {(1, "skills"), (2, "seniority"), (3, "workModes"), (4, "companies")}


def test_cursor_life():
    request = SearchRequest(query="engineer")
    cursor = search.encode_cursor(request, {"postedAt": None, "jobId": 7}, 1_000)
    asked = replace(request, cursor=cursor)
    assert search.decode_cursor(asked, 1_000 + 86_400_000) == {"postedAt": None, "jobId": 7}
    for bad, now, mode in ((asked, 1_001 + 86_400_000, "lexical"), (asked, 999, "lexical"), (asked, 2_000, "hybrid"), (replace(asked, query="other"), 2_000, "lexical"), (replace(asked, cursor="{"), 2_000, "lexical"), (request, 2_000, "lexical")):
        with pytest.raises(ValueError, match="INVALID_CURSOR"):
            search.decode_cursor(bad, now, mode)


def test_fuzzy_and_empty_queries(spark):
    docs = spark.createDataFrame([(1, "Data engineer", "x"), (2, "Daat enginere", "x"), (3, None, None), (4, "--", "--"), (5, "database", "engineers")], "doc long, title string, body string")
    index = lexical.Index.of(docs, "doc", ["title", "body"])
    found = lambda q, **how: {r.doc for r in lexical.lexical_search(index, q, {"title": 6.0, "body": 1.0}, **how).collect()}
    assert found("data engineer") == {1, 2} and found("data engineer", fuzzy=False) == {1}  # swapped neighbours are one edit
    assert found("  ") == {1, 2, 3, 4, 5} and found("nothing here") == set()
    phrase = lexical.phrase_hits(spark.createDataFrame([("title", "a", 1, [0, 3]), ("title", "b", 1, [2, 4]), ("title", "a", 2, [0]), ("title", "b", 2, [2])], "field string, term string, doc long, positions array<int>"), "title", ["a", "b"])
    assert [r.doc for r in phrase.collect()] == [1]


def test_saved_index(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} common", "b") for i in range(50)], "doc long, title string, body string")
    index = lexical.Index.of(docs, "doc", ["title", "body"])
    a, b = (sorted(map(tuple, lexical.lexical_search(x, "word3", {"title": 6.0}).collect())) for x in (index, index.saved(f"file://{tmp_path}/i")))
    assert a == b and index.saved(f"file://{tmp_path}/i").docs.count() == 50


def test_vector_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 8)
    monkeypatch.setattr(vectors, "VECTOR_BLOCK", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 6))
    x[30:60] = x[7]  # equal vectors tie
    rows = [(i, [float(y) for y in x[i]]) for i in range(90)] + [(90, None), (91, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    cells = vectors.Cells.of(df, "vec_id", "embedding", 3)
    out = cells.search(df.where("vec_id % 3 = 0"), "vec_id", "embedding", 4)
    assert "CoGroup" in out._jdf.queryExecution().executedPlan().toString()  # blocks, not a row a pair
    u = x / np.sqrt((x * x).sum(1))[:, None]
    got = {}
    for r in out.collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.id, round(r.similarity, 9))
    for i in range(0, 90, 3):
        s = np.round(u @ u[i], 9)
        want = sorted((j for j in range(90) if j != i), key=lambda j: (-s[j], j))[:4]
        assert [got[i][n] for n in (1, 2, 3, 4)] == [(j, s[j]) for j in want], i
    assert len(got) == 30


def test_index_for_query(spark):
    docs = spark.createDataFrame([(i, f"data engineer {i % 7} enginere", ["Go", "engineer"] if i % 2 else None) for i in range(30)] + [(30, None, [None, "x"])], "doc long, title string, skills array<string>")
    whole = lexical.Index.of(docs, "doc", ["title", "skills"])
    for q in ("Engineer", "data engineer", "go", "enginer data", "nothing"):
        part = lexical.Index.for_query(docs, "doc", ["title", "skills"], q)
        a, b = (sorted(map(tuple, lexical.lexical_search(x, q, {"title": 6.0, "skills": 4.0}).collect())) for x in (whole, part))
        assert a == b and (len(a) > 0) == (q != "nothing")
        assert part.terms.count() <= 4 and part.docs.count() == 31


def test_index_grows_with_its_words(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ab " + "x" * 300, "b a b"), (2, None, "A"), (3, "--", "")], "doc long, title string, body string")
    index = lexical.Index.of(docs, "doc", ["title", "body"])
    assert "Exchange" not in index.postings._jdf.queryExecution().executedPlan().toString()
    rows = sorted((r.field, r.term, r.doc, r.tf, list(r.positions), r.length) for r in index.postings.collect())
    assert rows == [("body", "a", 1, 1, [1], 3), ("body", "a", 2, 1, [0], 1), ("body", "b", 1, 2, [0, 2], 3), ("title", "ab", 1, 1, [0], 2), ("title", "x" * 300, 1, 1, [1], 2)]
    index.saved(f"file://{tmp_path}/i")
    assert sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")) < 100_000  # what is left of a long word without two characters would be 13 MB
    near = lexical.expansions(index.terms, ["x" * 299 + "y", "ba", "xab", "bda"])
    assert sorted((r.field, r.q, r.term, r.edits) for r in near.collect()) == [("title", 0, "x" * 300, 1), ("title", 2, "ab", 1)]
    assert [(r.term, r.edits) for r in lexical.expansions(spark.createDataFrame([("t", "abdcef", 1, 6), ("t", "badcef", 1, 6), ("t", "badcfe", 1, 6)], "field string, term string, df long, size int"), ["abcdef"]).orderBy("term").collect()] == [("abdcef", 1), ("badcef", 2)]


def test_highlight_plain(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    page = docs.select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.get(F.split("text", "\n", 2), F.lit(1)).alias("description"))
    terms = ["the", "that"]
    got = {r.doc_id: list(r.highlights) for r in lexical.highlight(page, "doc_id", terms, "title", ("description",)).collect()}
    pattern = regex.compile(r"(?i)(?<![\p{L}\p{N}])(that|the)(?![\p{L}\p{N}])")
    for r in page.collect():
        want = [pattern.sub(r"<mark>\1</mark>", r.title)] if pattern.search(r.title or "") else []
        parts = regex.findall(r"(?s)\S.{0,179}(?=\s|$)|\S{180,}", r.description or "")
        hits = sorted((-len({m.lower() for m in pattern.findall(p)}), i, p) for i, p in enumerate(parts) if pattern.search(p))[:2]
        want += [pattern.sub(r"<mark>\1</mark>", p) for _, _, p in sorted(hits, key=lambda h: h[1])]
        assert got.get(r.doc_id, []) == want, r.doc_id


def test_components(spark, monkeypatch):
    names = []
    monkeypatch.setattr(components, "stored", lambda df, name, f=components.stored: names.append(name) or f(df, name))
    chain = spark.range(1000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.label for r in components.components(chain).collect()} == {0} and names.count("parents") <= 15


def test_resolve_duplicates(spark):
    text = [f"w{i}" for i in range(60)]
    near = text[:59] + ["other"]
    rows = [(1, "a", "u1", " ".join(text)), (2, "a", "u2", None), (3, "b", "u2", "x"), (4, "c", None, " ".join(near)), (5, None, None, " ".join(reversed(text))), (6, "d", "u6", "y")]
    df = spark.createDataFrame(rows, "id long, source string, url string, description string")
    groups = lambda **how: {r.id: r.group for r in planned.resolve_duplicates(df, "id", [["source"], ["url"]], **how).collect()}
    assert groups() == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 6}
    assert groups(similar="description") == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6}


def _similar_brute(rows):
    sets = {}
    for key, text in rows:
        w = (text or "").lower().split()
        sets[key] = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}
    up = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and up[a] != up[b]:
                x, y = up[a], up[b]
                up = {i: min(x, y) if g in (x, y) else g for i, g in up.items()}
    return up


def test_similar_duplicates_brute(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.group for r in planned.resolve_duplicates(docs, "doc_id", [["text"]], similar="text").collect()}
    want = _similar_brute([(r.doc_id, r.text) for r in docs.collect()])
    assert got == want and any(i != g for i, g in want.items())


def test_similar_duplicates_past_the_hub(spark):
    """Versions that drift from the smallest key: links that no comparison with it shows; nulls, empty and short texts."""
    words = [f"w{i}" for i in range(60)]
    said = lambda lo, hi: " ".join([*words[:lo], *(f"x{i}" for i in range(lo, hi)), *words[hi:]])
    rows = [(1, said(0, 0)), (2, said(10, 22)), (3, said(10, 23)), (4, said(30, 36)), (5, said(31, 36)), (6, None), (7, ""), (8, " \n"), (9, "One two"), (10, "one  TWO"), (11, said(10, 26)), (12, said(40, 41)), (12, said(40, 41))]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.group for r in planned.resolve_duplicates(df, "id", [], similar="text").collect()}
    assert got == _similar_brute(rows) and got[3] == got[2] != 1 and got[10] == 9


@pytest.mark.parametrize("small", [True, False])
def test_similar_duplicates_exchange_pairs_only(spark, monkeypatch, small):
    """Texts of which all share a passage and five are near copies; also with a small sample and by merge joins."""
    tables = {}
    monkeypatch.setattr(planned, "stored", lambda df, name: tables.setdefault(name, []).append(stored.stored(df, name)) or tables[name][-1])
    if not small:
        monkeypatch.setattr(planned, "is_small", lambda df: False)
        monkeypatch.setattr(planned, "SAMPLE_SETS", 20)
        monkeypatch.setattr(planned, "COMMON", 5)
    shared, own = [f"s{i}" for i in range(30)], lambda k: [f"d{k}w{i}" for i in range(40)]
    rows = [(k, " ".join(shared + own(k))) for k in range(200)] + [(200 + k, " ".join(shared + own(7)[: 40 - k])) for k in range(4)]
    got = {r.id: r.group for r in planned.resolve_duplicates(spark.createDataFrame(rows, "id long, text string"), "id", [], similar="text").collect()}
    assert got == _similar_brute(rows) and got[203] == 7
    assert tables["shingles"][0].count() == 204 and sum(t.count() for t in tables["paired-shingles"]) <= 8


def test_lifecycle(spark):
    at = lambda day: datetime.datetime(2024, 1, day)
    runs = [("s", f"r{i}", i, "partial" if i == 4 else "complete") for i in range(1, 7)] + [("t", "r1", 1, "complete")]
    seen = [(1, "s", "r6", at(30)), (2, "s", "r1", at(1)), (3, "s", "r5", at(29)), (4, "s", "r3", at(3)), (5, "t", "r1", at(30)), (6, "s", "r4", at(29))]
    s = spark.createDataFrame([(*x, at(2) if x[0] == 5 else None) for x in seen], "jobId long, source string, run_id string, seenAt timestamp_ntz, validThrough timestamp_ntz")
    r = spark.createDataFrame(runs, "source string, run_id string, seq int, status string")
    got = {x.jobId: x.state for x in planned.lifecycle(s, r, "2024-01-30 12:00:00").collect()}
    assert got == {1: "active", 2: "closed", 3: "active", 4: "closed", 5: "closed", 6: "closed"}


def test_jobs_alike_are_scored_once(spark, monkeypatch):
    tables = {}
    monkeypatch.setattr(lookups, "stored", lambda df, name: tables.setdefault(name, stored.stored(df, name)))
    jobs = spark.range(500).select((F.col("id") + 1).alias("jobId"), F.lit("Clerk").alias("title"), F.array(F.lit("Go")).alias("skills"), F.lit("remote").alias("workMode"))
    people = spark.createDataFrame([(1, ["go"], ["Clerk"], None)], "candidate long, skills array<string>, roles array<string>, workModes array<string>")
    got = lookups.match_candidates(people, jobs, 3)
    assert sorted((r["rank"], r.jobId, r.score) for r in got.collect()) == [(1, 1, 47), (2, 2, 47), (3, 3, 47)]
    assert tables["jobs-to-match"].count() == 3


@pytest.mark.parametrize("limits", [{}, {"PASS": 9, "BLOCK": 4, "ROWS": 16}])
def test_match_candidates(spark, monkeypatch, limits):
    import random

    for name, value in limits.items():
        monkeypatch.setattr(lookups, name, value)
    rng = random.Random(5)
    pool = [f"S{i}" for i in range(24)]
    people = [(i, rng.sample(pool, rng.randrange(0, 20)), rng.sample(["Data Lead", "web dev", "Data of"], rng.randrange(0, 3)), rng.sample(["remote", "onsite"], rng.randrange(0, 3))) for i in range(40)]
    # skills repeat, up to 20 a job
    jobs = [(i, rng.choice(["Senior database lead", "Web design", "Data of things", "Clerk", None]), rng.choices([p.lower() for p in pool] + ["S1"], k=rng.choice([0, 1, 3, 20])), rng.choice(["remote", "hybrid", "onsite", None])) for i in range(300)]
    jobs += [(1000 + i, "Clerk", ["go"], None) for i in range(10)] + [(2000, "Clerk", ["Go", "go"], None), (2001, None, None, None)]
    people += [(100, ["GO"], [], []), (101, None, None, None)]
    got = lookups.match_candidates(spark.createDataFrame(people, "candidate long, skills array<string>, roles array<string>, workModes array<string>"), spark.createDataFrame(jobs, "jobId long, title string, skills array<string>, workMode string").repartition(5), 3)
    got = {(r.candidate, r["rank"]): (r.jobId, r.score, list(r.reasons)) for r in got.collect()}
    assert got[100, 1][:2] == (2000, 44)
    for c, skills, roles, modes in people:
        words, mine, out = {w for x in roles or () for w in x.lower().split() if len(w) > 3}, {s.lower() for s in skills or ()}, []
        for j, title, has, mode in jobs:
            hit, role = [s.lower() for s in has or () if s.lower() in mine], any(w in (title or "").lower() for w in words)
            score = min(99, 20 + min(60, 12 * len(hit)) + 15 * role + 5 * (mode in (modes or ())))
            out.append((-score, j, [f"Resume evidence: {s}" for s in hit[:4]] + ["Target-role alignment"] * role + [f"{mode} preference"] * (mode in (modes or ()))))
        for n, (score, j, reasons) in enumerate(sorted(out)[:3], 1):
            assert got[c, n] == (j, -score, reasons), (c, n)


def test_ledger(spark):
    runs = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    ledger = store.started_rows(runs, 0, NOW)
    report = spark.createDataFrame([("a", 5, 4, 1, 4, 0), ("b", 5, 5, 0, 3, 2)], "run_id string, collected long, accepted long, rejected long, indexed long, failed long")
    ledger = store.append_ledger(store.append_ledger(ledger, store.ended_rows(report, 1, NOW)), store.failed_rows(runs.where("run_id = 'c'"), 1, NOW, "gone"))
    state = {r.run_id: (r.status, r.collected, r.failed, r.error) for r in store.ledger_state(ledger).collect()}
    assert state == {"a": ("complete", 5, 0, None), "b": ("partial", 5, 2, None), "c": ("failed", 0, 1, "gone")}
    assert {r.run_id for r in store.plan_runs(runs, store.ledger_state(ledger)).collect()} == {"b", "c"} and store.plan_runs(runs, ledger, force=True).count() == 3


def test_private_hosts(spark):
    hosts = {"fc00::1": True, "[fd12:3::1]": True, "fcbarcelona.example": False, "fdic.example": False, "10.1.2.3": True, "172.20.0.1": True, "172.200.0.1": False, "localhost": True}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: r.p for r in df.select("h", F.col("h").rlike(urls.PRIVATE_HOST).alias("p")).collect()} == hosts


def test_latest_row(spark):
    df = spark.createDataFrame([(1, 2, "a"), (1, 3, None), (2, None, "b"), (None, 1, "c")], "k int, o int, v string")
    assert sorted(map(str, map(tuple, search.dedupe_latest(df, "k", "o").collect()))) == sorted(map(str, [(1, 3, None), (2, None, "b"), (None, 1, "c")]))


def test_columns_computed_once(spark):
    df = stored.once(spark.range(3), a=F.col("id") + 1, b=F.upper(F.lit("x")))
    assert [tuple(r) for r in df.where("a > 1").collect()] == [(1, 2, "X"), (2, 3, "X")]


def test_bucketed_side_is_not_exchanged(spark):
    current = spark.range(1000).select("id", F.lit("a").alias("v"))
    batch = spark.range(500, 1500).select("id", F.lit("b").alias("v"), F.col("id").alias("at"))
    kept = store.bucketed(current, "kept_rows", "id")
    out = store.upsert_postings(kept, batch, "id", "at")[0]
    assert {r.v: r["count"] for r in out.groupBy("v").count().collect()} == {"a": 500, "b": 1000}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan


def test_harvest_walks_several_levels_a_pass(spark, monkeypatch):
    names = []
    monkeypatch.setattr(harvest, "stored", lambda df, name: names.append(name) or stored.stored(df, name))
    node = {"@type": "JobPosting", "title": "Deep"}
    for _ in range(20):
        node = [node]
    page = f'<script type="application/ld+json">{json.dumps(node)}</script>'
    assert harvest.harvest_jsonld(spark.createDataFrame([("u", page)], "url string, html string")).count() == 1
    assert len(names) == 3  # 21 levels, 8 a pass


def test_harvest_to_any_depth(spark):
    job = {"@type": "JobPosting", "title": "Deep"}
    node = job
    for i in range(12):
        node = [node] if i % 2 else {"@graph": [node, {"@type": "Thing"}]}
    page = f'<script type="application/ld+json">{json.dumps(node)}</script><script type="application/ld+json">{json.dumps([job, {"@graph": {"@type": "JobPosting"}}])}</script>'
    got = harvest.harvest_jsonld(spark.createDataFrame([("u", page), ("v", None), ("w", "ld+json")], "url string, html string")).collect()
    assert [(r.page_url, r.script_index, json.loads(r.jobPosting)) for r in got] == [("u", 0, job)]
    data = {"id": "0000000a-0000-4000-8000-000000000000", "title": "T"}
    for _ in range(15):
        data = {"x": [1, data, None]}
    page = f"<script>window.__appData = {json.dumps(data)};</script>"
    got = harvest.discover_embedded_jobs(spark.createDataFrame([("u", page)], "url string, html string"), "https://a.example.com/b/").collect()
    assert [tuple(r) for r in got] == [("u", "https://a.example.com/b/0000000a-0000-4000-8000-000000000000")]


def test_probed_cells_recall(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    cells = vectors.Cells.of(e, "vec_id", "embedding", 16)
    found = lambda probes: {(r.query_id, r.id) for r in cells.search(e.where("vec_id % 20 = 0"), "vec_id", "embedding", 10, probes).collect()}
    exact, some = found(None), found(12)
    assert len(exact & some) >= 0.9 * len(exact)
    odd = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, []), (5, [float("nan"), 1.0]), (6, [3.0, 4.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in vectors.unit(odd, "vec_id", "embedding").collect()] == [(6, [0.6, 0.8])]


@pytest.mark.parametrize("few", [32, 0])
def test_tag_skills_either_way(spark, monkeypatch, few):
    """Terms sought one by one and terms met by tokens give the same rows."""
    monkeypatch.setattr(normalize, "FEW_TERMS", few)
    vocab = spark.createDataFrame([(0, "C++"), (1, "Go"), (2, "Machine Learning"), (3, ".net"), (4, "--"), (5, "Go"), (6, None)], "rank int, term string")
    rows = [(1, "C++, go"), (2, "go+ ago gob c++x"), (3, "MACHINE LEARNING. -- and\n.NET\n"), (4, None), (5, ""), (6, "a.net go"), (6, "c++"), (7, "x go\n")]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r.id: r.skills for r in normalize.tag_skills(df, vocab, "id", "text").collect()}
    assert got == {1: ["C++", "Go", "Go"], 3: ["Machine Learning", ".net"], 6: ["C++", "Go", "Go"], 7: ["Go", "Go"]}


def test_answers_are_parsed_once(spark):
    ok, _ = outputs.parse_model_profiles(spark.createDataFrame([(1, "{}")], "jobId long, raw string"))
    assert ok._jdf.queryExecution().optimizedPlan().toJSON().count("expressions.JsonToStructs\"") == 1


def test_keys_of_duplicates_are_stored_once(spark, monkeypatch):
    names = []
    monkeypatch.setattr(planned, "stored", lambda df, name: names.append(name) or stored.stored(df, name))
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", None)], "id long, a string, b string")
    got = {r.id: r.group for r in planned.resolve_duplicates(df, "id", [["a"], ["b"]]).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4} and names == ["duplicate-keys"]


def test_plain_texts_stay_out_of_python(spark):
    df = spark.createDataFrame([(1, "a &amp;lt; b"), (2, "plain"), (3, None)], "id long, t string").withColumn("d", normalize.decoded(F.col("t")))
    assert [r.d for r in df.orderBy("id").collect()] == ["a < b", "plain", None]
    plan = df._jdf.queryExecution().optimizedPlan().toJSON()
    assert "EvalPython" in plan and "expressions.Contains" in plan
