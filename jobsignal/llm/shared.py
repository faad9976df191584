"""Shared-folder tables and bounded joins for the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import components

__all__ = ["columns_of", "components", "dropped", "fresh", "measured", "pieces", "plain_named", "shared_dir", "small_or_merge", "written"]

#: Rows and bytes up to which a side that has just been measured may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder stands in
    under a local master, as in tests; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _FALLBACK:
            _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        found = _FALLBACK[0]
    return found.rstrip("/")


_FALLBACK: list[str] = []


def fresh(names: list[str], *wanted: str) -> list[str]:
    """The wanted column names, each with underscores in front until it clashes with none of ``names``."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


def columns_of(names: list[str]) -> list[Column]:
    """Columns by their exact names, dots included."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def plain_named(df: DataFrame) -> DataFrame:
    """df with its columns named x0, x1, ...: what map functions need where names repeat or hold dots."""
    return df.select(*(c.alias(f"x{i}") for i, c in enumerate(columns_of(df.columns))))


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of so many rows, without copies: what a kernel holds of its own stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Deletes the files of a table made by ``written`` that nothing reads any more."""
    path = getattr(df, "written_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def measured(df: DataFrame) -> tuple[int, int]:
    """(rows, bytes of their values)."""
    width = F.lit(0).cast("long")
    for f, c in zip(df.schema.fields, columns_of(df.columns)):
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            w = F.octet_length(c)
        elif isinstance(f.dataType, T.ArrayType):
            w = F.length(F.to_json(F.struct(c)))
        else:
            w = F.lit(16)
        width = width + F.coalesce(w, F.lit(0)) + 16
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return n, size


def small_or_merge(df: DataFrame) -> DataFrame:
    """Hint for the smaller side of a join: broadcast up to BROADCAST_ROWS rows and BROADCAST_BYTES bytes, both just
    measured, a merge join beyond."""
    n, size = measured(df)
    return F.broadcast(df) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df.hint("merge")
