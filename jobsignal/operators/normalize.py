"""Raw crawl items to canonical jobs, with rejects; HTML cleaning; identities; skills; cards."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls
from ..functions.variants import field, fields, first_text, given, is_kind, items, number, record, string, texts_list
from ..plans.stored import is_small, once
from . import contracts, salary, titles

# The flat skill vocabulary, in output order.
SKILLS = (
    "AWS", "Azure", "C#", "C++", "Docker", "Elasticsearch", "GCP", "Go", "GraphQL", "Java", "JavaScript", "Kotlin", "Kubernetes", "LLM", "Machine Learning", "Node.js", "PostgreSQL", "Python", "React", "Redis",
    "Ruby", "Rust", "SQL", "Swift", "Terraform", "TypeScript",
)
NO_PLACE = "Location not specified"


@F.pandas_udf(T.StringType())
def decode_entities(texts: pd.Series) -> pd.Series:
    """Character references decoded at most twice."""
    return texts.map(lambda t: None if t is None else html.unescape(html.unescape(t)) if "&" in t else t)


def decoded(text: Column) -> Column:
    """``decode_entities`` of a column; texts without a reference don't go to Python."""
    return F.coalesce(decode_entities(F.when(F.contains(text, F.lit("&")), text)), text)


def strip_markup(decoded: Column) -> Column:
    """Text without comments, tags and the bodies of script, style, textarea and option; white space collapsed."""
    out = F.regexp_replace(decoded, r"(?is)<(script|style|textarea|option)\b[^>]*>.*?</\1\s*>|<!--.*?-->", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"(?s)<[/!?a-zA-Z][^>]*>", ""), r"\s+", " "))


def clean_html_text(pages: DataFrame, col: str, host: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages with col cleaned, sizes before and after by host)."""
    clean = pages.withColumn("_raw", F.length(col)).withColumn(col, strip_markup(decoded(F.col(col))))
    sizes = clean.groupBy(F.col(host) if host else F.lit("all").alias("host")).agg(F.count(F.lit(1)).alias("pages"), F.sum("_raw").alias("before"), F.sum(F.length(col)).alias("after"))
    return clean.drop("_raw"), sizes


def _quoted(term: str) -> str:
    return "".join(f"\\{c}" if c in r".*+?^${}()|[]\#" else c for c in term)


def skill_pattern(skill: str) -> str:
    """The skill between characters that are part of no skill. The word comes first, so that it is what is searched for."""
    word = _quoted(skill.lower())
    return rf"{word}(?<![a-z0-9+#]{word})(?![a-z0-9+#])"


def skills_of(text: Column, vocabulary=SKILLS) -> Column:
    """The vocabulary's skills found in a lower-cased text, in vocabulary order."""
    return F.array_compact(F.array(*(F.when(F.contains(text, F.lit(s.lower())) & text.rlike(skill_pattern(s)), F.lit(s)) for s in vocabulary)))


#: Terms up to which each text is searched for every one.
FEW_TERMS = 32


def tag_skills(df: DataFrame, vocab: DataFrame, key: str, text: str) -> DataFrame:
    """(key, skills): terms of vocab(term, rank) found in each text, by rank; texts without any are left out.

    Few terms are looked for in each text one by one. More of them meet texts on a term's first token, then the exact
    boundary pattern is verified: a vocabulary that is measured as small is broadcast, and nothing but hits is exchanged;
    with a larger one tokens travel without texts, and the texts of hits are fetched.
    """
    texts = df.select(key, F.lower(text).alias("_t"))
    some = vocab.where(F.lower("term").rlike("[a-z0-9+#]")).select("rank", "term").limit(FEW_TERMS + 1)
    few = some.collect()
    if 0 < len(few) <= FEW_TERMS:
        rank = some.schema["rank"].dataType
        each = (F.when(F.contains("_t", F.lit(r.term.lower())) & F.col("_t").rlike(skill_pattern(r.term)), F.struct(F.lit(r["rank"]).cast(rank).alias("rank"), F.lit(r.term).alias("term"))) for r in few)
        return _by_rank(texts.select(key, F.explode(F.array_compact(F.array(*each))).alias("e")).select(key, "e.*"), key)
    tokens = texts.select(key, "_t", F.explode(F.array_distinct(F.split("_t", r"[^a-z0-9+#]+"))).alias("token")).where("token <> ''")
    plain = F.regexp_replace(F.lower("term"), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    v = vocab.select("term", "rank", F.get(F.filter(F.split(F.lower("term"), r"[^a-z0-9+#]+"), lambda x: x != ""), F.lit(0)).alias("token"), F.concat(plain, F.lit("(?<![a-z0-9+#]"), plain, F.lit(")(?![a-z0-9+#])")).alias("pattern"))
    if is_small(v):
        met = tokens.join(F.broadcast(v), "token")
    else:
        met = tokens.drop("_t").join(v.hint("merge"), "token").join(texts.hint("merge"), key)
    return _by_rank(met.where(F.expr("_t rlike pattern")), key)


def _by_rank(hit: DataFrame, key: str) -> DataFrame:
    return hit.groupBy(key).agg(F.transform(F.sort_array(F.collect_set(F.struct("rank", "term"))), lambda x: x["term"]).alias("skills"))


def job_id(source_id: Column, host: Column, company: Column, title: Column, location: Column, apply_url: Column) -> Column:
    seed = F.when(source_id.isNotNull() & (source_id != ""), F.concat(host, F.lit(":"), source_id)).otherwise(F.lower(F.concat_ws("|", company, title, location, apply_url)))
    return F.substring(F.sha2(seed, 256), 1, 32)


HASHED = ("title", "companyName", "location", "workMode", "employmentType", "description", "requirements", "salary", "postedAt", "validThrough", "applyUrl")


def assign_identity(df: DataFrame, hashed=HASHED) -> tuple[DataFrame, DataFrame]:
    """(df with jobId and contentHash, ids that carry more than one content hash)."""
    body = F.to_json(F.struct(*(F.col(c) for c in hashed)), {"ignoreNullFields": "false"})
    out = df.withColumn("jobId", job_id(*(F.col(c) for c in ("sourceJobId", "source", "companyName", "title", "location", "applyUrl")))).withColumn("contentHash", F.sha2(body, 256))
    return out, out.groupBy("jobId").agg(F.count_distinct("contentHash").alias("hashes")).where("hashes > 1")


def when_of(x: Column) -> Column:
    t = string(x)
    forms = [F.try_to_timestamp(t)] + [F.try_to_timestamp(t, F.lit(f)) for f in ("MMM d, yyyy", "MMMM d, yyyy", "yyyy/MM/dd")]
    return F.coalesce(*forms)


def places(locations: Column) -> Column:
    """Locality, region and country of each place, joined; those without any are left out."""
    address = F.transform(items(locations), lambda place: F.coalesce(record(field(place, "address")), place))
    told = F.transform(address, lambda a: fields(a, "addressLocality", "addressRegion", "addressCountry"))
    texts = F.transform(told, lambda a: F.array_join(F.filter(F.array(*(first_text(a[c]) for c in ("addressLocality", "addressRegion", "addressCountry"))), lambda t: t != ""), ", "))
    return F.filter(texts, lambda t: t != "")


def work_mode(kind: Column, description: Column, location: Column) -> Column:
    marker = F.lower(F.concat_ws(" ", kind, F.substring(description, 1, 3000), location))
    return F.when(marker.rlike("telecommute|remote"), "remote").when(marker.contains("hybrid"), "hybrid").when(location == NO_PLACE, "unknown").otherwise("onsite")


_NO_PAY = "named_struct('min', CAST(NULL AS double), 'max', CAST(NULL AS double), 'currency', CAST(NULL AS string), 'period', 'unknown', 'annualMin', CAST(NULL AS double), 'annualMax', CAST(NULL AS double), 'sourceText', CAST(NULL AS string))"


#: Fields that are read of an item and of its posting.
_ITEM = ("jobPosting", "job", "identifier", "jobId", "hiringOrganization", "baseSalary", "salary", "sourceUrl", "url", "applyUrl", "title", "companyName", "company", "companyWebsite", "description", "text", "requirements", "location", "employmentType", "industry", "datePosted", "postedAt", "validThrough", "scrapedAt", "collectedAt", "expired")
_POSTING = ("url", "sameAs", "title", "hiringOrganization", "description", "qualifications", "experienceRequirements", "jobLocation", "jobLocationType", "identifier", "baseSalary", "employmentType", "industry", "datePosted", "validThrough", "expired")


def _then(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns. Unlike ``once`` it leaves lambdas as the only parts that are not compiled; the optimizer keeps
    such steps apart where a later one uses a column several times."""
    return df.select("*", *(c.alias(n) for n, c in columns.items()))


def judge_postings(raw: DataFrame, run_id: str, now: str, item: str = "item", payload: str = "payload") -> DataFrame:
    """raw(item, payload JSON) -> canonical jobs with ``code``, null for those that keep the job contract.

    One pass without an exchange; columns that several others rest on are computed once each, and a record's fields are
    read together.
    """
    s = _then(raw.select(F.col(item).alias("item"), F.col(payload).alias("json")), whole=F.try_parse_json("json")).drop("json")
    s = _then(s, v=fields(F.col("whole"), *_ITEM))
    s = _then(s, posting=given(F.col("v.jobPosting"), F.col("v.job"), F.col("whole"))).drop("whole")
    s = _then(s, p=F.when(is_kind(F.col("posting"), "OBJECT"), fields(F.col("posting"), *_POSTING))).drop("posting")
    v, p = lambda n: F.col(f"v.{n}"), lambda n: F.col(f"p.{n}")
    either = lambda a, b: given(p(a), v(b))
    url = lambda *xs: F.coalesce(*(urls.valid(string(x)) for x in xs))
    s = _then(s, org=fields(either("hiringOrganization", "hiringOrganization"), "name", "sameAs", "url"), ident=given(p("identifier"), v("identifier"), v("jobId")), place=F.get(items(p("jobLocation")), F.lit(0)), wage=given(p("baseSalary"), v("baseSalary"), v("salary")))
    pay_fields = ("minValue", "min", "maxValue", "max", "unitText", "currency")
    s = _then(s, pay=fields(F.col("wage"), "value", "period", "sourceText", "text", *pay_fields), named=fields(F.col("ident"), "value", "name"), address=field(F.col("place"), "address"))
    s = _then(s, inner=fields(F.coalesce(record(F.col("pay.value")), F.when(F.col("pay.value").isNull(), F.col("wage"))), *pay_fields), country=field(F.coalesce(record(F.col("address")), F.col("place")), "addressCountry")).drop("wage", "place", "address")
    ident, org, pay, inner, country = F.col("ident"), F.col("org"), F.col("pay"), F.col("inner"), F.col("country")
    id_text = F.coalesce(F.when(~is_kind(ident, "OBJECT") & ~is_kind(ident, "ARRAY"), F.try_variant_get(ident, "$", "string")), F.nullif(first_text(F.col("named.value"), F.col("named.name")), F.lit("")))
    bound = lambda a, b: number(F.coalesce(inner[a], inner[b], pay[a], pay[b]))
    s = _then(
        s,
        sourceUrl=url(v("sourceUrl"), v("url"), p("url"), p("sameAs")),
        told_apply=url(v("applyUrl"), p("url")),
        title=first_text(p("title"), v("title")),
        companyName=first_text(org["name"], v("companyName"), v("company")),
        companyWebsite=url(org["sameAs"], org["url"], v("companyWebsite")),
        html=first_text(p("description"), v("description"), v("text")),
        reqHtml=first_text(p("qualifications"), p("experienceRequirements"), v("requirements")),
        location=F.coalesce(F.get(places(p("jobLocation")), F.lit(0)), F.nullif(first_text(v("location"), p("jobLocationType")), F.lit("")), F.lit(NO_PLACE)),
        locationCountry=F.coalesce(string(country), F.nullif(first_text(field(country, "name")), F.lit(""))),
        sourceJobId=id_text,
        employmentType=texts_list(either("employmentType", "employmentType")),
        industries=texts_list(either("industry", "industry")),
        placeType=first_text(p("jobLocationType")),
        postedAt=when_of(F.coalesce(p("datePosted"), v("datePosted"), v("postedAt"))),
        validThrough=when_of(either("validThrough", "validThrough")),
        collectedAt=F.coalesce(when_of(F.coalesce(v("scrapedAt"), v("collectedAt"))), F.lit(now).cast("timestamp")),
        expired=F.coalesce(F.try_variant_get(v("expired"), "$", "boolean"), F.lit(False)) | F.coalesce(F.try_variant_get(p("expired"), "$", "boolean"), F.lit(False)),
        lo=bound("minValue", "min"), hi=bound("maxValue", "max"),
        period=salary.period_of(first_text(inner["unitText"], pay["unitText"], pay["period"])),
        code3=F.upper(F.trim(first_text(pay["currency"], inner["currency"]))),
        payText=F.nullif(first_text(pay["sourceText"], pay["text"]), F.lit("")),
    ).drop("v", "p", "org", "ident", "named", "country", "pay", "inner")
    s = _then(s, applyUrl=F.coalesce("told_apply", "sourceUrl"), plain=decoded(F.col("html")), reqPlain=decoded(F.col("reqHtml"))).drop("told_apply", "html", "reqHtml")
    s = _then(s, description=strip_markup(F.col("plain")), requirements=strip_markup(F.col("reqPlain"))).drop("plain", "reqPlain")
    lo, hi, f = F.col("lo"), F.coalesce("hi", "lo"), salary.factor_of(F.col("period"))
    told = F.struct(lo.alias("min"), hi.alias("max"), F.when(F.col("code3").rlike("^[A-Z]{3}$"), F.col("code3")).alias("currency"), F.col("period").alias("period"), salary.half_up(lo * f).cast("double").alias("annualMin"), salary.half_up(hi * f).cast("double").alias("annualMax"), F.col("payText").alias("sourceText"))
    s = _then(s, best=F.when(hi.isNull() & F.contains("description", F.lit("$")), salary.best_range(F.col("description"), F.col("location"), F.col("locationCountry"))), low=F.lower(F.concat_ws("\n", "title", "description", "requirements")))
    best = F.col("best")
    found = F.struct(best["min"].alias("min"), best["max"].alias("max"), best["currency"].alias("currency"), best["period"].alias("period"), best["annualMin"].cast("double").alias("annualMin"), best["annualMax"].cast("double").alias("annualMax"), best["sourceText"].alias("sourceText"))
    closed = F.col("expired") | F.coalesce(F.col("validThrough") < F.lit(now).cast("timestamp"), F.lit(False))
    s = _then(
        s,
        salary=F.when(hi.isNotNull(), told).when(best.isNotNull(), found).otherwise(F.expr(_NO_PAY)),
        workMode=work_mode(F.col("placeType"), F.col("description"), F.col("location")),
        skills=skills_of(F.col("low")),
        seniority=titles.seniority(F.col("title")), titleFamily=titles.family(F.col("title")),
        source=urls.bare_host(F.col("sourceUrl")), sourceRunId=F.lit(run_id),
        status=F.when(closed, "closed").otherwise("active"), verifiedAt=F.lit(now).cast("timestamp"), schemaVersion=F.lit(1).cast("short"),
    ).drop("expired", "placeType", "lo", "hi", "period", "code3", "payText", "best", "low")
    parts = [F.nullif(c, F.lit("")) for c in (F.col("title"), F.col("companyName"), F.col("titleFamily"), F.col("seniority"), F.col("location"), F.col("workMode"), F.array_join("employmentType", " "), F.array_join("skills", " "), F.col("requirements"), F.col("description"))]
    s = assign_identity(_then(s, searchText=F.concat_ws("\n", *parts)))[0]
    blank = (F.col("title") == "") | (F.col("companyName") == "") | (F.col("description") == "")
    judged = _then(s, told=F.when(F.col("sourceUrl").isNull() | F.col("applyUrl").isNull(), "missing_url").when(blank, "missing_core_fields").when(~contracts.keeps(contracts.job_rules()), "unknown"))
    return once(judged, code=F.col("told")).drop("told")  # filters on the code stay above what it rests on


def normalize_postings(raw: DataFrame, run_id: str, now: str, item: str = "item", payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """raw(item, payload JSON) -> (canonical jobs, rejects (item, code)); ``unknown`` is a job that breaks the contract."""
    judged = judge_postings(raw, run_id, now, item, payload)
    return judged.where("code IS NULL").drop("code"), judged.where("code IS NOT NULL").select("item", "code")


def compact(x: Column) -> Column:
    return F.when(x >= 1000, F.concat(salary.half_up(x / 1000).cast("string"), F.lit("k"))).otherwise(F.regexp_replace(x.cast("string"), r"\.0$", ""))


def pay_label(s: str = "salary") -> Column:
    lo, hi = F.coalesce(f"{s}.annualMin", f"{s}.min"), F.coalesce(f"{s}.annualMax", f"{s}.max")
    cur = F.when(F.col(f"{s}.currency") == "USD", "$").when(F.length(f"{s}.currency") > 0, F.concat(F.col(f"{s}.currency"), F.lit(" "))).otherwise("")
    text = F.nullif(F.col(f"{s}.sourceText"), F.lit(""))
    return (
        F.when(text.isNotNull(), text).when(lo.isNotNull() & hi.isNotNull(), F.concat(cur, compact(lo), F.lit("–"), compact(hi))).when(lo.isNotNull(), F.concat(cur, compact(lo), F.lit("+")))
        .when(hi.isNotNull(), F.concat(F.lit("Up to "), cur, compact(hi))).otherwise("Salary not listed")
    )


def age_label(when: Column, now: Column) -> Column:
    m = F.greatest(F.timestamp_diff("MINUTE", when, now), F.lit(0))
    text = lambda n, u: F.concat(F.floor(n).cast("string"), F.lit(f"{u} ago"))
    return F.when(when.isNull(), "Freshness unknown").when(m < 2, "Just indexed").when(m < 60, text(m, "m")).when(m < 1440, text(m / 60, "h")).otherwise(text(m / 1440, "d"))


def card_view(df: DataFrame, now: str) -> DataFrame:
    """(jobId, company, title, place, pay, age) as a card shows them."""
    or_else = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    place = F.concat_ws(" · ", F.nullif("location", F.lit("")), F.when(F.col("workMode") != "unknown", F.nullif("workMode", F.lit(""))))
    seen = F.coalesce("postedAt", "collectedAt").cast("timestamp")
    return df.select("jobId", or_else("companyName", "Company undisclosed").alias("company"), or_else("title", "Untitled role").alias("title"), F.when(place == "", "Location not listed").otherwise(place).alias("place"), pay_label().alias("pay"), age_label(seen, F.lit(now).cast("timestamp")).alias("age"))
