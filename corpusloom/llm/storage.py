"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder. Where none is set, an own one if driver and executors
    are one process, as in tests; on a cluster that is an error, as executors would write to
    their own disks and later reads would miss rows."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
        folder = _own[0]
    return folder.rstrip("/")


def columns(df: DataFrame) -> list[Column]:
    """df's columns, whatever their names."""
    return [column(df, name) for name in df.columns]


def column(df: DataFrame, name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, but: tuple[str, ...] = ("doc_id", "text")) -> list[Column]:
    """The columns besides, as one struct `carried`; none if there are none."""
    rest = [column(df, c).alias(c) for c in df.columns if c not in but]
    return [F.struct(*rest).alias("carried")] if rest else []


def schema(fixed: str, df: DataFrame) -> StructType:
    """The fixed columns and, where df has it, `carried` with its type."""
    out = StructType.fromDDL(fixed)
    return out.add("carried", df.schema["carried"].dataType) if "carried" in df.columns else out


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """df(doc_id, text, carried) with like's columns in like's order."""
    field = lambda name: F.col("carried").getField(name)
    return df.select(*[column(df, c) if c in ("doc_id", "text") else field(c).alias(c) for c in like.columns])


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_scopes: list[list[str]] = []


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end whatever `written` wrote inside."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back: no lineage, and no partitioning that keeps a
    join on it from being split where a key is hot."""
    path = new_path(df.sparkSession, label)
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._corpusloom_path = path
    return out


#: Rows of a few longs that may be sent to every executor, some tens of megabytes.
SMALL_ROWS = 1_000_000


def small(df: DataFrame) -> DataFrame:
    """A written key table, marked for a broadcast if its counted rows allow that; else the
    join shuffles."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def drop(*frames: DataFrame) -> None:
    """Delete what `written` wrote; a frame of other origin is left alone."""
    for df in frames:
        if path := getattr(df, "_corpusloom_path", None):
            delete(df.sparkSession, path)


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def delete(spark: SparkSession, path: str) -> None:
    files, target = _place(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, target = _place(spark, path)
    return files.exists(target)
