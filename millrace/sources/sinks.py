"""Exports: SQL scripts, CSV and JSON, and an append-only change log."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _literal(name: str, kind: T.DataType) -> Column:
    value = F.col(f"`{name}`")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        text = value.cast("string")
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("ARRAY["), F.array_join(F.transform(value, lambda x: F.coalesce(x.cast("string"), F.lit("NULL"))), ", "), F.lit("]"))
    else:
        text = F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))
    return F.coalesce(text, F.lit("NULL"))


def insert_statements(rows: DataFrame, table: str, batch: int = 500) -> DataFrame:
    """(part, statement): INSERT statements of up to ``batch`` rows each, made on the executors."""
    values = F.concat(F.lit("("), F.concat_ws(", ", *[_literal(f.name, f.dataType) for f in rows.schema]), F.lit(")"))
    head = f"INSERT INTO {table} ({', '.join(rows.columns)}) VALUES "
    numbered = rows.select(values.alias("v"), F.monotonically_increasing_id().alias("n"))
    grouped = numbered.groupBy((F.floor(F.col("n") / batch)).alias("part")).agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("vs"))
    return grouped.select("part", F.concat(F.lit(head), F.array_join(F.transform("vs", lambda x: x["v"]), ", "), F.lit(";")).alias("statement"))


def create_statement(rows: DataFrame, table: str) -> str:
    names = {"string": "VARCHAR", "int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "boolean": "BOOLEAN", "tinyint": "TINYINT", "smallint": "SMALLINT", "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP"}
    columns = ", ".join(f"{f.name} {names.get(f.dataType.simpleString(), f.dataType.simpleString().upper())}{'' if f.nullable else ' NOT NULL'}" for f in rows.schema)
    return f"CREATE TABLE {table} ({columns});"


def dump_sql(rows: DataFrame, table: str, path: str, batch: int = 500, transaction: bool = True) -> None:
    """A SQL script as text files in ``path``, in order of their names: the table anew, then its rows."""
    spark = rows.sparkSession
    head = [f"DROP TABLE IF EXISTS {table};", create_statement(rows, table)] + ["BEGIN;"] * transaction
    first = spark.createDataFrame([(-len(head) + i, s) for i, s in enumerate(head)], "part long, statement string")
    out = first.unionByName(insert_statements(rows, table, batch))
    if transaction:
        out = out.unionByName(spark.createDataFrame([((1 << 63) - 1, "COMMIT;")], "part long, statement string"))
    out.orderBy("part").select("statement").write.mode("overwrite").text(path)


def export(rows: DataFrame, path: str, kind: str) -> None:
    """``kind``: csv (with header), json, parquet or orc."""
    writer = rows.write.mode("overwrite")
    if kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("json", "parquet", "orc"):
        writer.format(kind).save(path)
    else:
        raise ValueError(f"unknown kind {kind!r}")


def _segments(spark: SparkSession, path: str) -> list[int]:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("segment="))


def log_changes(path: str, table: str, event: str, rows: DataFrame) -> None:
    """Append row events (insert, update, delete) with a checksum to the newest segment of the change log in ``path``."""
    data = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]))
    segment = max([1, *_segments(rows.sparkSession, path)])
    events = rows.select(F.lit(table).alias("table_name"), F.lit(event).alias("event"), data.alias("row_json"), F.crc32(data.cast("binary")).alias("checksum"), F.current_timestamp().alias("at"))
    events.write.mode("append").parquet(f"{path}/segment={segment}")


def rotate_log(spark: SparkSession, path: str) -> int:
    """Begin a new segment; returns its number."""
    number = max([0, *_segments(spark, path)]) + 1
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segment={number}")
    where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)
    return number


def purge_log(spark: SparkSession, path: str, before: int) -> int:
    """Delete the segments with a number below ``before``, but never the newest; returns how many went."""
    old = [n for n in _segments(spark, path)[:-1] if n < before]
    for n in old:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/segment={n}")
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(old)


#: Columns of the change log.
LOG = "table_name string, event string, row_json string, checksum long, at timestamp"


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """The change log with the number of each event's segment; rows whose checksum doesn't fit are marked."""
    log = spark.read.schema(LOG + ", segment int").parquet(path)
    return log.withColumn("is_intact", F.crc32(F.col("row_json").cast("binary")) == F.col("checksum"))
