"""Pay: annual bounds of structured pay and ranges disclosed in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a year by period of pay, looked for in this order.
PERIODS = (("hour", "hour", 2080), ("day", "day", 260), ("week", "week", 52), ("month", "month", 12), ("year", "year|annual", 1))

# Patterns of disclosed pay.
_AMOUNT = r"(\d{1,3}(?:,\d{3})+(?:\.\d{1,2})?|\d+(?:\.\d{1,2})?\s*[kK])"
RANGE = rf"(?i)(?:\b(?:USD|US)\s*)?\$\s*{_AMOUNT}\s*(?:-|–|—|\bto\b)\s*(?:\b(?:USD|US)\s*)?\$?\s*{_AMOUNT}(?:\s*\bUSD\b)?"
US_PLACE = r"(?i)\b(?:california|united states|u\.s\.|usa)\b|,\s*CA\b"
HOURLY = r"(?i)\b(?:hourly|per hour|an hour)\b|/\s*(?:hr|hour)\b"
ANNUAL = r"(?i)\b(?:annual|annually|yearly|per year|base salary|salary range)\b|/\s*(?:yr|year)\b"
LOOSELY_ANNUAL = r"(?i)\b(?:base pay|compensation range)\b"
USD_HERE = r"(?i)\bUSD\b|\bUS\s*\$"
USD_NEAR = r"(?i)\bUSD\b|\bUS base (?:salary|pay)\b"
HOME_STATE = r"(?i)\b(?:california|san francisco|bay area|los angeles|san jose|san diego)\b|,\s*CA\b"
PAY_WORDS = r"(?i)\b(?:base salary|salary range|base pay|compensation range)\b"


def period_of(unit: Column) -> Column:
    out = F.lit("unknown")
    for name, pattern, _ in reversed(PERIODS):
        out = F.when(F.lower(unit).rlike(pattern), name).otherwise(out)
    return out


def factor_of(period: Column) -> Column:
    out = F.lit(1)
    for name, _, units in PERIODS:
        out = F.when(period == name, units).otherwise(out)
    return out


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def annualize_salary(df: DataFrame, low: str = "min", high: str = "max", unit: str = "unitText") -> DataFrame:
    """df with period, annualMin and annualMax; the upper bound falls back to the lower one."""
    good = lambda c: F.when(F.expr(f"try_cast(`{c}` AS double)") >= 0, F.expr(f"try_cast(`{c}` AS double)"))
    out = df.withColumn("period", period_of(F.coalesce(unit, F.lit("")))).withColumn("_lo", good(low)).withColumn("_hi", F.coalesce(good(high), F.col("_lo")))
    f = factor_of(F.col("period"))
    return out.withColumn("annualMin", half_up(F.col("_lo") * f)).withColumn("annualMax", half_up(F.col("_hi") * f)).drop("_lo", "_hi")


def amount(text: Column) -> Column:
    plain = F.regexp_replace(text, r"[,\s]", "")
    return F.expr("1.0D") * F.regexp_replace(plain, "[kK]$", "").try_cast("double") * F.when(plain.rlike("[kK]$"), 1000).otherwise(1)


def with_offsets(matches: Column, text: Column) -> Column:
    """(text, 0-based offset) of matches found from left to right."""
    start = F.struct(F.lit(1).alias("p"), F.array().cast("array<struct<m:string,at:int>>").alias("xs"))

    def step(acc, m):
        at = F.call_function("locate", m, text, acc["p"])
        return F.struct((at + F.length(m)).alias("p"), F.concat(acc["xs"], F.array(F.struct(m.alias("m"), (at - 1).alias("at")))).alias("xs"))

    return F.aggregate(matches, start, step, lambda acc: acc["xs"])


def best_range(text: Column, location: Column, country: Column) -> Column:
    """The best range of a text that counts as pay, as a struct; null without one.

    Each match is parsed once: transforms nest, so that no step is written out again for every use of its result.
    """
    found = F.when(F.contains(text, F.lit("$")), F.regexp_extract_all(text, F.lit(RANGE), F.lit(0)))
    spots = with_offsets(F.coalesce(found, F.array().cast("array<string>")), text)
    cut = lambda a, b: F.substring(text, F.greatest(a, F.lit(0)) + 1, b - F.greatest(a, F.lit(0)))
    read = F.transform(spots, lambda x: F.struct(x["m"].alias("m"), x["at"].alias("at"), amount(F.regexp_extract(x["m"], RANGE, 1)).alias("min"), amount(F.regexp_extract(x["m"], RANGE, 2)).alias("max"), cut(x["at"] - 140, x["at"]).alias("before"), cut(x["at"] - 180, x["at"] + F.length(x["m"]) + 120).alias("near")))
    read = F.filter(read, lambda x: (x["max"] >= x["min"]) & (x["max"] <= 10_000_000))
    us = F.coalesce(F.upper(country) == "US", F.lit(False)) | F.coalesce(location, F.lit("")).rlike(US_PLACE)

    def judged(x):
        near, big = x["near"], (x["min"] >= 10_000) & (x["max"] >= 10_000)
        period = F.when(near.rlike(HOURLY), "hour").when(near.rlike(ANNUAL), "year").when(near.rlike(LOOSELY_ANNUAL) & big, "year")
        return F.struct(x["m"].alias("m"), x["at"].alias("at"), x["min"].alias("min"), x["max"].alias("max"), period.alias("period"), (x["m"].rlike(USD_HERE) | near.rlike(USD_NEAR)).alias("usd"), x["before"].rlike(HOME_STATE).alias("home"), near.rlike(PAY_WORDS).alias("told"))

    fine = F.filter(F.transform(read, judged), lambda x: ((x["period"] == "year") & (x["min"] >= 10_000)) | ((x["period"] == "hour") & (x["max"] <= 1000)))
    fine = F.filter(fine, lambda x: x["usd"] | us)
    points = lambda cond, n: F.when(cond, n).otherwise(0)

    def scored(x):
        f = factor_of(x["period"])
        score = points(x["home"], 4) + points(x["told"], 2) + points(x["usd"], 1)
        return F.struct(score.alias("score"), (-x["at"]).alias("before"), x["min"].alias("min"), x["max"].alias("max"), F.lit("USD").alias("currency"), x["period"].alias("period"), half_up(x["min"] * f).alias("annualMin"), half_up(x["max"] * f).alias("annualMax"), F.trim(x["m"]).alias("sourceText"))

    return F.array_max(F.transform(fine, scored))


def extract_disclosed_salary(df: DataFrame, key: str = "jobId", text: str = "description", location: str = "location", country: str = "locationCountry") -> DataFrame:
    """The best disclosed range of each posting that has one: one pass without an exchange."""
    best = df.where(F.contains(F.col(text), F.lit("$"))).select(key, F.explode(F.array_compact(F.array(best_range(F.col(text), F.col(location), F.col(country))))).alias("x"))
    return best.select(key, "x.min", "x.max", "x.currency", "x.period", "x.annualMin", "x.annualMax", "x.sourceText", "x.score", (-F.col("x.before")).alias("offset"))
