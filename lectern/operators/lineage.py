"""Tables written between the rounds of an iteration, under the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"  # a query's shuffle files go when it has ended


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session, as in tests, gets one of its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet and read again: a lost executor costs a reread. The files go with the session, those of its shuffles at once."""
    return saved_in_parts(lambda p: df, 1, name)


def saved_in_parts(part: Callable[[int], DataFrame], parts: int, name: str, compression: str | None = None) -> DataFrame:
    """The rows of part(0), part(1), ... written one after the other: the disk holds the shuffles of one part at a time."""
    first = part(0)
    spark = first.sparkSession
    path = f"{folder(spark)}/lectern/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_RELEASE, None)
    spark.conf.set(_RELEASE, "true")
    try:
        for p in range(parts):
            rows = part(p) if p else first
            writer = rows.write.mode("append")
            (writer.option("compression", compression) if compression else writer).parquet(path)
    finally:
        spark.conf.unset(_RELEASE) if before is None else spark.conf.set(_RELEASE, before)
    _file_system(spark, path).deleteOnExit(_hadoop_path(spark, path))
    out = spark.read.schema(first.schema).parquet(path)
    out._saved_at = path
    return out


def in_part(df: DataFrame, key: str, parts: int, p: int) -> DataFrame:
    """The rows of part p: those whose key falls there by hash, so that equal keys of two tables are in the same part."""
    return df if parts == 1 else df.where(F.pmod(F.xxhash64(key), F.lit(parts)) == p)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of saved() that nothing reads any more."""
    for t in tables:
        _file_system(t.sparkSession, t._saved_at).delete(_hadoop_path(t.sparkSession, t._saved_at), True)


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _file_system(spark: SparkSession, path: str):
    return _hadoop_path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
