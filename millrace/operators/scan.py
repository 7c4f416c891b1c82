"""Scans and index-like access.

Tables have no indexes: a lookup is a filter, which Parquet answers with row-group statistics; :func:`lay_out` sorts a table so that they exclude much.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, column: str, keys: Sequence) -> DataFrame:
    """Rows whose key is one of ``keys``."""
    return rows.where(F.col(column).isin(list(keys)))


def key_range(rows: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Rows from ``start`` to ``end``, both included; an end that is left out is open."""
    out = rows
    if start is not None:
        out = out.where(F.col(column) >= start)
    return out if end is None else out.where(F.col(column) <= end)


def prefix_lookup(rows: DataFrame, **key: object) -> DataFrame:
    """Rows with these values in the leading columns of a composite key."""
    out = rows
    for column, value in key.items():
        out = out.where(F.col(column) == F.lit(value))
    return out


def ordered_scan(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.orderBy(*columns)


def lay_out(rows: DataFrame, path: str, *columns: str, files: int | None = None) -> None:
    """Write ``rows`` range-partitioned and sorted by ``columns``, for scans that filter on them."""
    dealt = rows.repartitionByRange(files, *columns) if files else rows.repartitionByRange(*columns)
    dealt.sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def bucket(rows: DataFrame, table: str, buckets: int, *columns: str) -> None:
    """Write ``rows`` as a bucketed table: joins and groupings on ``columns`` then need no shuffle."""
    rows.write.mode("overwrite").bucketBy(buckets, *columns).sortBy(*columns).saveAsTable(table)


def project(rows: DataFrame, **columns: Column | str) -> DataFrame:
    return rows.select(*[(F.expr(e) if isinstance(e, str) else e).alias(n) for n, e in columns.items()])
