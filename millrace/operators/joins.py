"""Joins.  Catalyst picks the strategy by the sides' sizes; nothing is forced here but the salted join for known hot keys."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full", "full": "full", "cross": "cross", "semi": "left_semi", "anti": "left_anti"}


def join(left: DataFrame, right: DataFrame, on: Column | Sequence[str] | None = None, kind: str = "inner") -> DataFrame:
    """``on``: an expression (any theta condition) or common column names (USING).  Null keys never match."""
    if kind == "cross" or on is None:
        return left.crossJoin(right)
    return left.join(right, on if isinstance(on, Column) else list(on), KINDS[kind])


def natural_join(left: DataFrame, right: DataFrame, kind: str = "inner") -> DataFrame:
    """On all columns that both sides have; a cross product if there are none."""
    return join(left, right, [c for c in left.columns if c in right.columns] or None, kind)


def equi_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], kind: str = "inner", residual: Column | None = None) -> DataFrame:
    """On pairs of columns, with an optional further condition."""
    condition = F.lit(True)
    for a, b in keys:
        condition = condition & (left[a] == right[b])
    return left.join(right, condition if residual is None else condition & residual, KINDS[kind])


def salted_join(left: DataFrame, right: DataFrame, keys: Sequence[str], salts: int, kind: str = "inner") -> DataFrame:
    """An inner or left join for a left side with hot keys: its rows are spread over ``salts`` parts, the right side's rows are repeated for each.
    The right side should have few rows a key."""
    if kind not in ("inner", "left"):
        raise ValueError("only the left side may be salted")
    name = "__salt"
    spread = left.withColumn(name, F.pmod(F.xxhash64(*left.columns), F.lit(salts)))
    repeated = right.withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return spread.join(repeated, [*keys, name], kind).drop(name)


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points with the ranges that hold them (both ends included), over cells of ``width`` instead of all pairs."""
    cell = "__cell"
    p = points.withColumn(cell, F.floor(F.col(point) / width))
    r = ranges.withColumn(cell, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    return p.join(r, cell).where((F.col(point) >= F.col(low)) & (F.col(point) <= F.col(high))).drop(cell)
