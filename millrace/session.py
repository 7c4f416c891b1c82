"""Spark sessions with the engine's settings."""

from pyspark.sql import SparkSession

#: UTC so that timestamps mean the same everywhere; ANSI so that bad casts fail; adaptive execution to merge, split and re-plan shuffles.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(app: str = "millrace", master: str | None = None, **settings: str) -> SparkSession:
    """A session with ``DEFAULTS``; ``settings`` use ``__`` for dots.  Partition counts stay with the cluster's configuration."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
