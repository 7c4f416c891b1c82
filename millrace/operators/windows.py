"""Window functions and top rows of groups."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def over(by: Sequence[str] = (), order: Sequence[Column | str] = (), rows: tuple[int, int] | None = None, span: tuple[int, int] | None = None) -> WindowSpec:
    """A window; without ``rows`` or ``span`` (a RANGE) the frame is the default: with an order up to the current row and its ties, else all."""
    spec = Window.partitionBy(*by).orderBy(*order) if order else Window.partitionBy(*by)
    if rows:
        spec = spec.rowsBetween(*rows)
    return spec.rangeBetween(*span) if span else spec


def rank_within(rows: DataFrame, name: str, by: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    return rows.withColumn(name, F.rank().over(over(by, order)))


def top_per_group(rows: DataFrame, by: Sequence[str], order: Sequence[Column | str], n: int, ties: bool = False) -> DataFrame:
    """The first ``n`` rows of each group; ``ties``: and those that tie with the last.  Spark cuts groups before the shuffle (window group limit)."""
    number = (F.rank() if ties else F.row_number()).over(over(by, order))
    return rows.withColumn("__n", number).where(F.col("__n") <= n).drop("__n")
