"""Intermediate tables that are written once and then read: they cut lineage and fix what depends on how rows were dealt out."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only local mode, where that is unset, gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master, app = spark.sparkContext.master, spark.sparkContext.applicationId
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="millrace-")
    return _OWN[app]


def place(spark: SparkSession, name: str) -> str:
    """A new path there, which goes when the session ends."""
    path = f"{folder(spark)}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(where)
    fs.deleteOnExit(where)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in that folder."""
    spark = df.sparkSession
    path = place(spark, name) + "/rows"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
