"""Queries over the driver tables and their SQL, gathered from the operator families."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .catalog import candidates, postings, search, texts

FAMILIES = (search, postings, candidates, texts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for family in FAMILIES for name, f in family.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for family in FAMILIES for name, q in family.SQL.items()}
