"""Running aggregates over a growing table, with Structured Streaming."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def follow(spark: SparkSession, path: str, files_at_once: int | None = None) -> DataFrame:
    """A table's folder as a stream: files that are there and that come."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(path)


def windowed_counts(events: DataFrame, time_col: str, by: str, length: str, late: str) -> DataFrame:
    """Counts by tumbling window and key; rows later than ``late`` behind the newest are left out and windows close by then."""
    stamped = events.withColumn("__t", F.col(time_col).cast("timestamp"))
    return stamped.withWatermark("__t", late).groupBy(F.window("__t", length), by).agg(F.count("*").alias("n"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Write everything that is available now to a Parquet table, exactly once across restarts."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
