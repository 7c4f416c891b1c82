"""Paths in an edge table, hop by hop."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.sources.staging import written


def k_hops(edges: DataFrame, hops: int, src: str = "src", dst: str = "dst", distance: str = "distance") -> DataFrame:
    """(src, dst, distance, steps): the shortest distance over at most ``hops`` edges and the fewest edges that give it.

    Only the best path of a pair is kept after each hop, so the table stays within the number of connected pairs.  Edges with a null distance don't count.
    """
    one = edges.where(F.col(distance).isNotNull()).select(F.col(src).alias("src"), F.col(dst).alias("dst"), F.col(distance).alias("distance"))
    best = one.groupBy("src", "dst").agg(F.min("distance").alias("distance")).withColumn("steps", F.lit(1))
    hop = one.select(F.col("src").alias("mid"), F.col("dst").alias("to"), F.col("distance").alias("more"))
    for _ in range(hops - 1):
        known = written(best, "hops")
        longer = known.join(hop, known["dst"] == hop["mid"]).select("src", F.col("to").alias("dst"), (F.col("distance") + F.col("more")).alias("distance"), (F.col("steps") + 1).alias("steps"))
        best = known.unionByName(longer).groupBy("src", "dst").agg(F.min(F.struct("distance", "steps")).alias("b")).select("src", "dst", "b.distance", "b.steps")
    return best
