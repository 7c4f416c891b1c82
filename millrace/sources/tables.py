"""Parquet tables of a folder, as DataFrames and as views for SQL."""

import re

from pyspark.sql import DataFrame, SparkSession

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, *names: str) -> tuple[DataFrame, ...]:
    return tuple(table(spark, sf_dir, n) for n in names)


def sql(spark: SparkSession, sf_dir: str, text: str, **args: object) -> DataFrame:
    """SQL over the folder's tables; only those that the text names are opened.  ``args`` fill ``:name`` parameters."""
    for name in NAMES:
        if re.search(rf"\b{name}\b", text, re.IGNORECASE):
            table(spark, sf_dir, name).createOrReplaceTempView(name)
    return spark.sql(text, args=args or None)
