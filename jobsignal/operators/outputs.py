"""Prompt source texts and the answers of a text model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stored import once

ITEM = "array<string>"
SCHEMA = f"struct<oneLiner:string,mission:string,highlights:{ITEM},mustHaveSkills:{ITEM},whyYouMightLoveIt:string,interviewSignals:{ITEM},evidence:array<struct<claim:string,sourceText:string>>>"
#: Length bounds of texts; count bounds of lists with the bounds of their items.
TEXTS = {"oneLiner": (10, 220), "mission": (10, 500), "whyYouMightLoveIt": (10, 400)}
LISTS = {"highlights": (2, 5, 3, 220), "mustHaveSkills": (0, 10, 1, 220), "interviewSignals": (0, 6, 3, 180)}
EVIDENCE = (10, {"claim": (3, 180), "sourceText": (3, 300)})


def build_source_material(jobs: DataFrame, limit: int = 9000) -> DataFrame:
    """(jobId, material): the job's texts without markup, at most ``limit`` characters."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in (F.col("title"), F.col("companyName"), F.col("location"), F.col("description"), F.col("requirements"), F.array_join("skills", ", "))]
    text = F.regexp_replace(F.regexp_replace(F.concat_ws("\n", *parts), r"&[a-zA-Z#0-9]+;", " "), r"<[^>]*>", " ")
    return jobs.select("jobId", F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, limit).alias("material"))


def _long(x: Column, lo: int, hi: int) -> Column:
    return F.coalesce(F.length(F.trim(x)).between(lo, hi), F.lit(False))


def parse_model_profiles(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """outputs(jobId, raw) -> (jobId and the parsed fields, rejected (jobId, code))."""
    bare = F.trim(F.regexp_replace(F.coalesce("raw", F.lit("")), r"```[a-zA-Z]*", ""))
    o = outputs.select("jobId", bare.alias("t"))
    first, last = F.instr("t", "{"), F.length("t") - F.instr(F.reverse("t"), "}") + 1
    body = F.when((first > 0) & (last > first) & F.contains("t", F.lit("}")), F.substring("t", first, last - first + 1))
    o = once(o, body=body)
    o = once(o, v=F.try_parse_json("body"), p=F.from_json("body", SCHEMA))  # or each use of a field would parse again
    p = F.col("p")
    allowed = (*TEXTS, *LISTS, "evidence")
    known = F.size(F.array_except(F.json_object_keys("body"), F.array(*map(F.lit, allowed)))) == 0
    fine = known
    for c, (lo, hi) in TEXTS.items():
        fine = fine & _long(p[c], lo, hi)
    for c, (few, many, lo, hi) in LISTS.items():
        fine = fine & F.coalesce(F.size(p[c]).between(few, many) & _all_long(p[c], lo, hi), F.lit(False))
    most, parts = EVIDENCE
    entry = lambda e: _long(e["claim"], *parts["claim"]) & _long(e["sourceText"], *parts["sourceText"])
    fine = fine & F.coalesce((F.size(p["evidence"]) <= most) & F.forall(p["evidence"], entry), F.lit(False))
    code = F.when(F.col("t") == "", "empty").when(F.col("body").isNull(), "no_json").when(F.col("v").isNull(), "invalid_json").when(~F.coalesce(fine, F.lit(False)), "contract")
    o = once(o, code=code)
    return o.where("code IS NULL").select("jobId", "p.*"), o.where("code IS NOT NULL").select("jobId", "code")


def _all_long(x: Column, lo: int, hi: int) -> Column:
    return F.forall(x, lambda e: _long(e, lo, hi))
