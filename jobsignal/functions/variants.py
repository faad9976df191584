"""Typed access to open JSON records held as VARIANT columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def field(record: Column, name: str) -> Column:
    """A field of a record; null for a missing field or a value that is no record."""
    return F.try_variant_get(record, f'$["{name}"]', "variant")


def fields(record: Column, *names: str) -> Column:
    """A struct of a record's fields, read in one pass; each is what ``field`` gives."""
    return F.try_variant_get(record, "$", "struct<" + ",".join(f"`{n}`:variant" for n in names) + ">")


def given(*values: Column) -> Column:
    """The first value that is neither missing nor JSON null."""
    return F.coalesce(*(F.when(~F.is_variant_null(x), x) for x in values))


def is_kind(x: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(x).startswith(kind), F.lit(False))


def record(x: Column) -> Column:
    return F.when(is_kind(x, "OBJECT"), x)


def items(x: Column) -> Column:
    """Elements of an array, or the value alone."""
    return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), F.array(x))


def string(x: Column) -> Column:
    return F.when(is_kind(x, "STRING"), F.try_variant_get(x, "$", "string"))


def first_text(*values: Column) -> Column:
    """The first string that is not blank, trimmed; arrays are looked into; empty if there is none."""

    def text(x: Column) -> Column:
        listed = F.try_variant_get(x, "$", "array<variant>")
        return F.when(is_kind(x, "STRING"), F.nullif(F.trim(F.try_variant_get(x, "$", "string")), F.lit(""))).when(listed.isNotNull(), F.get(F.filter(F.transform(listed, lambda v: F.trim(string(v))), lambda t: t != ""), F.lit(0)))

    return F.coalesce(*map(text, values), F.lit(""))


def number(x: Column) -> Column:
    """A non-negative finite number, given as number or numeric string."""
    n = F.try_variant_get(x, "$", "double")
    return F.when((n >= 0) & (n < float("inf")), n)


def texts_list(x: Column) -> Column:
    """An array's values as text, or a string cut at commas and bars; trimmed, without blanks, each once."""
    cut = F.split(string(x), "[,|]")
    listed = F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda v: F.try_variant_get(v, "$", "string"))
    return F.array_distinct(F.filter(F.transform(F.coalesce(listed, cut, F.array().cast("array<string>")), F.trim), lambda t: t != ""))
