"""Runs a query and its SQL on the same tables and compares rows, column names and values."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def differences(spark, name, query, sql, sf_dir, con) -> str:
    df = query(spark, sf_dir)
    a = rows_of(df.columns, df.collect())
    rel = con.sql(sql)
    b = rows_of(rel.columns, rel.fetchall())
    if a[0] != b[0]:
        return f"{name}: columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{name}: {len(a[1])} and {len(b[1])} rows; {[x for x in a[1] if x not in b[1]][:2]} {[x for x in b[1] if x not in a[1]][:2]}"
    bad = [(x, y) for x, y in zip(a[1], b[1]) if x != y]
    return f"{name}: {len(bad)} of {len(a[1])} rows differ: {bad[:2]}" if bad else ""
