"""Candidate profiles from tables of résumé page texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stored import is_small, small_or_merge

MAX_PAGES, MAX_CHARS, MIN_INK, CONTEXT = 12, 100_000, 40, 55

# Skills with their aliases, and the roles that skills point to, both in order.
SKILL_ALIASES = {
    "Elasticsearch": ("elasticsearch", "elastic search"), "TypeScript": ("typescript",), "JavaScript": ("javascript",), "Node.js": ("node.js", "nodejs", "node"), "Next.js": ("next.js", "nextjs"),
    "React": ("react.js", "reactjs", "react"), "Python": ("python",), "Java": ("java",), "C#": ("c#", "c sharp"), "C++": ("c++",), ".NET": (".net", "dotnet"), "Go": ("golang", "go"), "Rust": ("rust",), "SQL": ("sql",),
    "PostgreSQL": ("postgresql", "postgres"), "MySQL": ("mysql",), "MongoDB": ("mongodb",), "Redis": ("redis",), "GraphQL": ("graphql",), "REST APIs": ("restful api", "rest api", "rest apis"), "Fastify": ("fastify",),
    "AWS": ("amazon web services", "aws"), "Azure": ("microsoft azure", "azure"), "Google Cloud": ("google cloud platform", "google cloud", "gcp"), "Docker": ("docker",), "Kubernetes": ("kubernetes", "k8s"),
    "Terraform": ("terraform",), "Apache Kafka": ("apache kafka", "kafka"), "Apache Spark": ("apache spark", "spark"), "GitHub Actions": ("github actions",), "Apify": ("apify",),
}
ROLE_SIGNALS = (
    ("Backend Software Engineer", ("Node.js", "Python", "Java", "C#", ".NET", "Go", "Rust", "REST APIs", "GraphQL", "Fastify", "PostgreSQL", "MySQL", "MongoDB", "Redis", "Apache Kafka")),
    ("Full Stack Software Engineer", ("TypeScript", "JavaScript", "React", "Next.js", "Node.js", "REST APIs", "GraphQL", "PostgreSQL")),
    ("Frontend Software Engineer", ("TypeScript", "JavaScript", "React", "Next.js")),
    ("Cloud Platform Engineer", ("AWS", "Azure", "Google Cloud", "Docker", "Kubernetes", "Terraform", "GitHub Actions")),
    ("Data Engineer", ("Python", "SQL", "PostgreSQL", "Apache Kafka", "Apache Spark")),
    ("Search Engineer", ("Elasticsearch", "Python", "Java", "Node.js")),
)
YEARS = r"(?i)\b(\d{1,2})\+?\s+years?(?:\s+of)?\s+(?:professional\s+)?experience\b"


def alias_table(spark: SparkSession, skills=None) -> DataFrame:
    rows = [(name, a) for name, aliases in (skills or SKILL_ALIASES).items() for a in aliases]
    return spark.createDataFrame(rows, "skill string, alias string")


def signal_table(spark: SparkSession, roles=ROLE_SIGNALS) -> DataFrame:
    rows = [(role, i, s, j) for i, (role, skills) in enumerate(roles) for j, s in enumerate(skills)]
    return spark.createDataFrame(rows, "role string, role_order int, skill string, skill_order int")


def cleaned(text):
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", " "), r"\s+", " "))


def gate_documents(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pages(doc_id, page, text) -> (pages of accepted documents with cleaned text, rejected (doc_id, code))."""
    p = pages.select("doc_id", "page", cleaned(F.coalesce("text", F.lit(""))).alias("text"))
    facts = p.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.length("text")).alias("chars"), F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("ink"))
    code = F.when(~F.col("pages").between(1, MAX_PAGES), "RESUME_PAGE_LIMIT").when(F.col("chars") > MAX_CHARS, "RESUME_TEXT_LIMIT").when(F.col("ink") < MIN_INK, "RESUME_TEXT_EMPTY")
    judged = facts.withColumn("code", code)
    return p.join(judged.where("code IS NULL").select("doc_id"), "doc_id", "left_semi"), judged.where("code IS NOT NULL").select("doc_id", "code")


def extract_skill_evidence(pages: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, skill, page, start, end, matchedText, context): per skill the earliest page with an alias, on it the
    longest alias, there the first place between characters that are no letters or digits. Offsets count from 0."""
    tokens = pages.select("doc_id", "page", "text", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("token"))
    anchor = F.coalesce(F.get(F.filter(F.split("alias", r"[^\p{L}\p{N}]+"), lambda x: x != ""), F.lit(0)), F.col("alias"))
    quoted = F.regexp_replace("alias", r"([.*+?^${}()|\[\]\\#])", r"\\$1")
    a = aliases.select("skill", "alias", anchor.alias("token"), F.concat(F.lit(r"(?<![\p{L}\p{N}])"), quoted, F.lit(r"(?![\p{L}\p{N}])")).alias("pattern"))
    if is_small(a):
        found = tokens.join(F.broadcast(a), "token").drop("token")
    else:  # the text comes in only for pages with an alias's first token
        found = tokens.drop("text").join(a.hint("merge"), "token").select("doc_id", "page", "skill", "alias", "pattern").join(pages.select("doc_id", "page", "text").hint("merge"), ["doc_id", "page"])
    hit = found.withColumn("start", F.expr("regexp_instr(lower(text), pattern)") - 1).where("start >= 0")
    best = F.row_number().over(Window.partitionBy("doc_id", "skill").orderBy("page", F.desc(F.length("alias")), "start"))
    hit = hit.withColumn("_r", best).where("_r = 1").withColumn("end", F.col("start") + F.length("alias"))
    left = F.greatest(F.col("start") - CONTEXT, F.lit(0))
    return hit.select("doc_id", "skill", "page", "start", "end", F.substring("text", F.col("start") + 1, F.length("alias")).alias("matchedText"), F.substring("text", left + 1, F.col("end") + CONTEXT - left).alias("context"))


def infer_roles(evidence: DataFrame, signals: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, roles, evidence): the three roles with most matched skills; without any, the default role."""
    hit = evidence.select("doc_id", "skill", "page", "start").join(small_or_merge(signals), "skill")
    first = F.slice(F.sort_array(F.collect_list(F.struct("skill_order", "page", "start", "skill"))), 1, 2)
    per = hit.groupBy("doc_id", "role", "role_order").agg(F.count(F.lit(1)).alias("n"), first.alias("two"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("n"), "role_order"))
    top = per.withColumn("rank", rank).where("rank <= 3").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("rank", "role", "two"))).alias("t"))
    spans = F.array_distinct(F.transform(F.flatten(F.transform("t", lambda x: x["two"])), lambda e: F.struct(e["page"].alias("page"), e["start"].alias("start"), e["skill"].alias("skill"))))
    top = top.select("doc_id", F.transform("t", lambda x: x["role"]).alias("roles"), spans.alias("evidence"))
    out = docs.select("doc_id").distinct().join(top.hint("merge"), "doc_id", "left")
    return out.withColumn("roles", F.coalesce("roles", F.array(F.lit("Software Engineer"))))


def extract_years_experience(pages: DataFrame) -> DataFrame:
    """(doc_id, page, years, start): the first page whose first mention of years is at most 50."""
    found = pages.select("doc_id", "page", F.regexp_extract("text", YEARS, 1).try_cast("int").alias("years"), (F.regexp_instr("text", F.lit(YEARS)) - 1).alias("start")).where("years <= 50")
    return found.groupBy("doc_id").agg(F.min(F.struct("page", "years", "start")).alias("m")).select("doc_id", "m.page", "m.years", "m.start")


def build_profiles(docs: DataFrame, evidence: DataFrame, roles: DataFrame, years: DataFrame, preferences: DataFrame) -> DataFrame:
    """One profile per document; stated preferences (doc_id, targetRoles, city, region, radiusMiles, workModes) win."""
    skills = evidence.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("page", "start", "skill"))), lambda x: x["skill"]).alias("skills"))
    j = docs.select("doc_id").distinct().join(skills.hint("merge"), "doc_id", "left").join(roles.select("doc_id", "roles").hint("merge"), "doc_id", "left").join(years.select("doc_id", "years").hint("merge"), "doc_id", "left").join(preferences.hint("merge"), "doc_id", "left")
    stated = F.size(F.coalesce("targetRoles", F.array().cast("array<string>"))) > 0
    j = j.withColumn("skills", F.coalesce("skills", F.array().cast("array<string>"))).withColumn("target", F.when(stated, F.col("targetRoles")).otherwise(F.coalesce("roles", F.array(F.lit("Software Engineer")))))
    told = F.concat(F.lit(" Evidence in the resume includes "), F.array_join(F.slice("skills", 1, 6), ", "), F.lit("."))
    phrase = F.when(F.size("skills") > 0, told).otherwise(" No technology claims were inferred without direct resume evidence.")
    where = F.when(F.col("city").isNotNull(), F.struct("city", F.coalesce("region", F.lit("Texas")).alias("region"), F.col("radiusMiles").cast("int").alias("radiusMiles"), F.lit("user_preference").alias("source")))
    default = F.struct(F.lit("Austin").alias("city"), F.lit("Texas").alias("region"), F.lit(50).alias("radiusMiles"), F.lit("demo_default").alias("source"))
    return j.select(
        "doc_id", "skills", F.col("target").alias("targetRoles"), F.when(stated, "user_preference").otherwise("resume_inference").alias("rolesSource"), F.coalesce(where, default).alias("location"),
        F.coalesce("workModes", F.array(F.lit("remote"), F.lit("hybrid"))).alias("workModes"), F.when(F.col("workModes").isNotNull(), "user_preference").otherwise("demo_default").alias("workModesSource"), "years",
        F.concat(F.lit("Candidate profile aligned to "), F.array_join("target", ", "), F.lit("."), phrase).alias("summary"),
    )
