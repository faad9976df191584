"""Intermediate tables in the folder that driver and executors share, columns that are computed once, measured joins."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows and bytes up to which a side that has just been measured may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a temporary folder under a local master, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return found.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: its plan is cut and its rows are computed once."""
    path = f"{folder(df.sparkSession)}/stored/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def hadoop_path(spark: SparkSession, path: str):
    """(path, its file system) of the cluster's storage."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def dropped(df: DataFrame | None) -> None:
    """Deletes the files of a stored table that nothing reads any more."""
    path = getattr(df, "stored_path", None)
    if path:
        p, fs = hadoop_path(df.sparkSession, path)
        fs.delete(p, True)


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of their values)."""
    width = F.lit(0).cast("long")
    for f in df.schema.fields:
        c = F.col("`" + f.name.replace("`", "``") + "`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            w = F.octet_length(c)
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            w = F.length(F.to_json(F.struct(c)))
        else:
            w = F.lit(16)
        width = width + F.coalesce(w, F.lit(0)) + 16
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n, size


def is_small(df: DataFrame) -> bool:
    """Whether df may be broadcast: at most BROADCAST_ROWS rows and BROADCAST_BYTES bytes, both measured just now."""
    n, size = measured(df)
    return n <= BROADCAST_ROWS and size <= BROADCAST_BYTES


def small_or_merge(df: DataFrame) -> DataFrame:
    """df with the hint for the smaller side of a join: a broadcast if it is small, a merge join beyond."""
    return F.broadcast(df) if is_small(df) else df.hint("merge")


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each computed once however often it is used: a generator of one row keeps the optimizer
    from writing their expressions out again in every use."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))
