"""Observed-remove sets: replicas that are changed apart and merged in any order, where an addition wins over a removal that hasn't seen it."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ObservedRemoveSet:
    """``added`` (value, tag): every addition with its unique tag; ``removed``: the additions that removals have seen.  Both only grow, so
    merging is a union; an element is there while one of its additions isn't removed."""

    def __init__(self, added: DataFrame, removed: DataFrame | None = None):
        self.added = added.select("value", "tag")
        self.removed = self.added.limit(0) if removed is None else removed.select("value", "tag")

    def live(self) -> DataFrame:
        return self.added.join(self.removed, ["value", "tag"], "left_anti")

    def add(self, rows: DataFrame) -> "ObservedRemoveSet":
        """``rows`` (value, tag); tags are unique over all replicas."""
        return ObservedRemoveSet(self.added.unionByName(rows.select("value", "tag")), self.removed)

    def remove(self, values: DataFrame) -> "ObservedRemoveSet":
        """All additions of the values that this replica knows; values that it doesn't know change nothing."""
        seen = self.live().join(values.select("value").distinct(), "value", "left_semi")
        return ObservedRemoveSet(self.added, self.removed.unionByName(seen))

    def merge(self, other: "ObservedRemoveSet") -> "ObservedRemoveSet":
        return ObservedRemoveSet(self.added.unionByName(other.added).distinct(), self.removed.unionByName(other.removed).distinct())

    def elements(self) -> DataFrame:
        return self.live().select("value").distinct()

    def contains(self, values: DataFrame) -> DataFrame:
        """(value, is_there) for each distinct value asked for."""
        there = self.elements().withColumn("is_there", F.lit(True))
        return values.select("value").distinct().join(there, "value", "left").withColumn("is_there", F.coalesce("is_there", F.lit(False)))
