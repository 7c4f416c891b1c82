"""Connected components of a link table, by alternating large-star and small-star rounds.

Each round takes minima by node and joins them back.  Nodes with more than their share of links are dealt over ``SALTS`` tasks, where their minimum is repeated;
there are at most ``HUBS`` such nodes, whatever the table, so their list is broadcast.  Nothing goes to the driver but two numbers a round.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import cut, drop

#: Links of a node from which it is dealt out, at least; such nodes at most; tasks it is dealt over.
LEAST, HUBS, SALTS = 512, 100_000, 32


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _with_low(links: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """Links (u, v) with the minimum m of their u; ``low`` has u, m and u's number of links, d, which add up to 2 n at most."""
    many = max(LEAST, 2 * n // HUBS)
    hubs = low.where(F.col("d") > many).select("u", F.lit(True).alias("is_hub"))
    if hubs.isEmpty():
        return links.join(low.drop("d"), "u")
    # fewer than 2 n / many <= HUBS rows
    dealt = links.join(F.broadcast(hubs), "u", "left").select("u", "v", F.when(F.col("is_hub"), F.pmod(F.xxhash64("v"), F.lit(SALTS))).otherwise(0).cast("int").alias("s"))
    spread = low.select("u", "m", F.explode(F.sequence(F.lit(0), F.when(F.col("d") > many, SALTS - 1).otherwise(0))).alias("s"))
    return dealt.join(spread, ["u", "s"]).drop("s")


def _large_star(links: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node links to the smallest node of its neighbourhood."""
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = cut(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")).select("u", F.least("u", "m").alias("m"), "d"), "low")
    return _with_low(both.where("v > u"), low, n).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame, n: int) -> DataFrame:
    """Every node and its smaller neighbours link to the smallest of them (links point from larger to smaller)."""
    low = cut(links.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d")), "low")
    moved = _with_low(links, low, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``links`` has long columns a and b.  Returns (node, root), one row for each node that has a link to another
    node; root is the smallest node reachable.  Rows with a null end or both ends equal are ignored."""
    ends = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = cut(ends, "links")
    state = _state(now)
    while state[0]:
        large = cut(_large_star(now, state[0]), "stars")
        after = cut(_small_star(large, state[0]), "stars")
        drop(large)
        then = _state(after)
        drop(now)
        now = after
        if then == state:
            break
        state = then
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
