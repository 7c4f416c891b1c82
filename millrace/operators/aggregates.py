"""Grouping.  Partial aggregation on the map side is Spark's; helpers here cover what needs a stated order or rule."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aggregate(rows: DataFrame, by: Sequence[Column | str], having: Column | None = None, **measures: Column) -> DataFrame:
    """Groups (null is a group) with named measures; ``having`` filters on their names."""
    out = rows.groupBy(*by).agg(*[m.alias(n) for n, m in measures.items()])
    return out if having is None else out.where(having)


def count_or_null(column: str) -> Column:
    """The number of values, null for none: the strict form of count."""
    return F.nullif(F.count(column), F.lit(0))


def first_by(value: str, *order: str) -> Column:
    """The value of the first row in the order given (which should be total)."""
    return F.min_by(value, F.struct(*order))


def last_by(value: str, *order: str) -> Column:
    return F.max_by(value, F.struct(*order))


def distinct(rows: DataFrame, *columns: str) -> DataFrame:
    return (rows.select(*columns) if columns else rows).distinct()


def salted_sum(rows: DataFrame, by: Sequence[str], value: str, salts: int = 64) -> DataFrame:
    """Sums in two stages for aggregates that can't be combined on the map side before them (after an explode, say) and have hot keys."""
    first = rows.groupBy(*by, F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).alias("__salt")).agg(F.sum(value).alias("s"))
    return first.groupBy(*by).agg(F.sum("s").alias(value))
