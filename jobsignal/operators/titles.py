"""Title classes: seniority and family by ordered patterns, over distinct titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Classes in order; the first pattern found in the lower-cased title names the class.
SENIORITY = (
    ("Intern", r"\b(intern|internship)\b"),
    ("Entry", r"\b(junior|jr\.?|entry)\b"),
    ("Principal", r"\b(principal|distinguished|fellow)\b"),
    ("Staff", r"\b(staff)\b"),
    ("Senior", r"\b(senior|sr\.?)\b"),
    ("Leadership", r"\b(lead|manager|director|head|vp|vice president)\b"),
)
FAMILY = (
    ("Platform & Infrastructure", "platform|infrastructure|site reliability|sre|devops"),
    ("Data & AI", "data|analytics|machine learning|ml|ai "),
    ("Security", "security"),
    ("Mobile", "mobile|ios|android"),
    ("Product", "product manager|product lead"),
    ("Design", "design|designer"),
    ("Software Engineering", "engineer|developer|software"),
)


def first_class(title: Column, classes, other: str) -> Column:
    low, out = F.lower(title), None
    for name, pattern in classes:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return out.otherwise(other)


def seniority(title: Column) -> Column:
    return first_class(title, SENIORITY, "Mid-level")


def family(title: Column) -> Column:
    return first_class(title, FAMILY, "Other")


def classify_titles(df: DataFrame, title: str = "title") -> DataFrame:
    """df with seniority and titleFamily; patterns run once for each distinct title."""
    classes = df.select(title).distinct().withColumn("seniority", seniority(F.col(title))).withColumn("titleFamily", family(F.col(title)))
    return df.join(classes, df[title].eqNullSafe(classes[title]), "left").drop(classes[title])


def class_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("seniority", "titleFamily").agg(F.count(F.lit(1)).alias("jobs"))
