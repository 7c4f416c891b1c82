"""Named queries and, for each, the SQL that gives the same rows on another engine."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a function (spark, sf_dir) under its name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def sql_query(name: str, text: str, oracle: str | None = None) -> None:
    """Register SQL over the tables' views; ``oracle`` only where the other engine needs another text."""
    from millrace.sources import tables

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tables.sql(spark, sf_dir, text)

    run.__name__ = name
    QUERIES[name] = run
    ORACLES[name] = oracle or text
