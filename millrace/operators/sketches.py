"""Sketches: distinct counts and frequencies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_sketch(rows: DataFrame, by: list[str], column: str, lg_k: int = 12) -> DataFrame:
    """A HyperLogLog sketch for each group; sketches merge with :func:`merge_distinct`."""
    return rows.groupBy(*by).agg(F.hll_sketch_agg(column, lg_k).alias("sketch"))


def merge_distinct(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    return sketches.groupBy(*(by or [])).agg(F.hll_union_agg("sketch").alias("sketch")).withColumn("n_distinct", F.hll_sketch_estimate("sketch"))


class CountMin:
    """A count-min sketch as a table (row, cell, n): width * depth rows at most, so merging is adding and estimates never fall below the true count."""

    def __init__(self, width: int, depth: int, cells: DataFrame):
        if width <= 0 or depth <= 0:
            raise ValueError("width and depth must be positive")
        self.width, self.depth, self.cells = width, depth, cells

    @staticmethod
    def _places(column: Column, width: int, depth: int) -> Column:
        places = [F.struct(F.lit(r).alias("row"), F.pmod(F.xxhash64(F.lit(r), column), F.lit(width)).alias("cell")) for r in range(depth)]
        return F.explode(F.array(*places))

    @classmethod
    def of(cls, rows: DataFrame, column: str, width: int = 2048, depth: int = 5) -> "CountMin":
        """One pass: each task sums up its own cells, so what is shuffled is bounded by cells and tasks, not by values."""
        placed = rows.where(F.col(column).isNotNull()).select(cls._places(F.col(column), width, depth).alias("p"))
        return cls(width, depth, placed.groupBy("p.row", "p.cell").agg(F.count("*").alias("n")))

    def merge(self, other: "CountMin") -> "CountMin":
        if (self.width, self.depth) != (other.width, other.depth):
            raise ValueError("the sketches' dimensions differ")
        both = self.cells.unionByName(other.cells).groupBy("row", "cell").agg(F.sum("n").alias("n"))
        return CountMin(self.width, self.depth, both)

    def count(self, candidates: DataFrame, column: str) -> DataFrame:
        """(column, n): the estimate for each distinct candidate."""
        asked = candidates.select(column).distinct().select(column, self._places(F.col(column), self.width, self.depth).alias("p")).select(column, "p.row", "p.cell")
        found = asked.join(self.cells, ["row", "cell"], "left")
        return found.groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("n"))

    def top(self, candidates: DataFrame, column: str, k: int) -> DataFrame:
        return self.count(candidates, column).orderBy(F.desc("n"), column).limit(k)
