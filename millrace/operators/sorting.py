"""Order and limits."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def order_key(expression: str, descending: bool = False, nulls: str | None = None) -> Column:
    """By default nulls come first ascending and last descending."""
    c = F.expr(expression)
    if descending:
        return c.desc_nulls_first() if nulls == "first" else c.desc_nulls_last()
    return c.asc_nulls_last() if nulls == "last" else c.asc_nulls_first()


def sort(rows: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    return rows.orderBy(*order)


def limit(rows: DataFrame, n: int | None = None, offset: int = 0) -> DataFrame:
    """``n`` negative or None: no limit."""
    out = rows.offset(offset) if offset else rows
    return out if n is None or n < 0 else out.limit(n)


def top_n(rows: DataFrame, order: Sequence[Column | str], n: int, offset: int = 0) -> DataFrame:
    """A bounded top-n in each task and one merge; no full sort."""
    return limit(rows.orderBy(*order), n, offset)
