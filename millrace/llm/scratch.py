"""Intermediate tables in the folder that driver and executors share.

A written table cuts lineage as a checkpoint does: losing an executor costs a reread, not a recomputation.  Tables are deleted when the session
ends, or earlier with :func:`drop` and :func:`during`.
"""

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, set[str]] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where it is unset, a temporary folder, in local mode only."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _OWN[app]


def _place(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table."""
    spark = df.sparkSession
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    fs, where = _place(spark, path)
    fs.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    fs, where = _place(spark, path)
    fs.delete(where, True)
    _WRITTEN.get(spark.sparkContext.applicationId, set()).discard(path)


def drop(df: DataFrame) -> None:
    """Delete a table that :func:`cut` wrote, once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def during(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """The written result of ``make``; all other tables that were written meanwhile are deleted."""
    own = _WRITTEN.setdefault(spark.sparkContext.applicationId, set())
    before = set(own)
    out = cut(make(), name)
    for path in own - before - {out._scratch_path}:
        _delete(spark, path)
    return out
