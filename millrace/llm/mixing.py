"""Mixing sources to target weights by Sainte-Laguë apportionment.

A source's documents are dealt over shards by a seeded hash and laid end to end in seeded order; blocks are equal runs of words of that
stream.  Blocks are allocated to sources, and a source's blocks to its shards, by the highest quotients size / (2 k + 1).  A shard that
gets q of its n blocks takes its whole stream q // n times and then the first q % n blocks: in a seeded order that is a random choice.

Equal rows (id, source, size and content) are counted first and told apart by a number, which is part of what is hashed: neither a repeated id nor a null
one puts many rows into one shard, and as equal rows are interchangeable, the mix does not depend on the layout of the files.

Nothing is collected.  One task takes in a row for each source, one task a source's shards, about one for each ``SHARD_DOCS`` documents; documents are
joined with that plan, which is broadcast only where Spark finds it small, and a hot source is spread over its shards.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import cut
from millrace.llm.words import word_count

#: Documents in a shard, about; beyond MAX_SHARDS shards a source's shards grow (their windows spill to disk).
SHARD_DOCS = 4096
MAX_SHARDS = 1 << 18
#: Equal rows that one task tells apart.
EQUAL_ROWS = 1 << 20
BLOCK_WORDS = 8
WEIGHTS = (3, 1, 2)


def targets(sizes: Sequence[int], weights: Sequence[float], factor: float = 1.5, most: float = 2.0) -> list[float]:
    """Shares of ``factor`` times all sizes by weight; a share stops at ``most`` times its source's size, and the excess is
    shared again by weight among the others until none is above."""
    size, weight = np.array(sizes, float), np.array(weights, float)
    out, left, rest = np.zeros(len(size)), size > 0, factor * sum(sizes)
    while left.any():
        share = rest * weight / weight[left].sum()
        over = left & (share > most * size)
        if not over.any():
            out[left] = share[left]
            break
        out[over] = most * size[over]
        rest -= sum(out[over].tolist())
        left &= ~over
    return out.tolist()


def sainte_lague(votes: Sequence[float], caps: Sequence[int], seats: int) -> list[int]:
    """``seats`` given one by one to the highest quotient votes / (2 k + 1), k the seats held; never above a cap.
    Ties go to the earlier entry.  A divisor just too large gives nearly all seats at once, the highest quotients the last few."""
    vote, cap = np.array(votes, float), np.where(np.array(votes, float) > 0, np.array(caps, np.int64), 0)
    seats = min(seats, int(cap.sum()))

    def given(d: float) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.minimum(cap, np.floor(np.minimum(vote / d, 2.0**62) + 0.5).astype(np.int64))

    low, high = 0.0, 4.0 * max(1.0, vote.max(initial=1.0))
    while low < (mid := (low + high) / 2) < high:
        if int(given(mid).sum()) > seats:
            low = mid
        else:
            high = mid
    out = given(high)
    while (missing := seats - int(out.sum())) > 0:  # what lies between two neighbouring divisors: equal quotients
        quotient = np.where(out < cap, vote / (2 * out + 1), -1.0)
        best = np.lexsort((np.arange(len(vote)), -quotient))
        out[best[: min(missing, int((quotient == quotient[best[0]]).sum()))]] += 1
    return out.tolist()


def _allotted(sources: DataFrame, weights: Sequence[float], factor: float, most: float, block: int) -> DataFrame:
    """(source, source_size, target, seats) of a table (source, words, blocks), a row for each source."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["words"] for r in rows]
        goal = targets(sizes, [weights[i % len(weights)] for i in range(len(rows))], factor, most)
        caps = [int(most) * r["blocks"] for r in rows]
        seats = sainte_lague(goal, caps, int(min(factor, most) * sum(sizes) / block + 0.5))
        yield pa.record_batch([pa.array([r["source"] for r in rows], pa.string()), pa.array(sizes, pa.int64()), pa.array(goal, pa.float64()), pa.array(seats, pa.int64())], ["source", "source_size", "target", "seats"])

    return sources.select("source", "words", "blocks").coalesce(1).mapInArrow(run, "source string, source_size long, target double, seats long")


def _quotas(shards: DataFrame, most: float) -> DataFrame:
    """(source, shard, source_size, target, quota, blocks) of (source, shard, words, blocks, source_size, target, seats)."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("shard")
        quota = sainte_lague(t.column("words").to_pylist(), (t.column("blocks").to_numpy() * int(most)).tolist(), t.column("seats")[0].as_py())
        return t.select(["source", "shard", "source_size", "target"]).append_column("quota", pa.array(quota, pa.int64())).append_column("blocks", t.column("blocks"))

    return shards.groupBy("source").applyInArrow(run, "source string, shard int, source_size long, target double, quota long, blocks long")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[float] = WEIGHTS, factor: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: str = "mix-1") -> DataFrame:
    """(id_col, size, source_size, target, taken), one row for each row of ``docs``.

    Sources in code point order, null last, take the weights in turn.  ``taken`` counts the words the mix takes, repeats included, at most ``most``
    (a whole number) times the size.  A null or empty text has size 0 and gives nothing; so has a source of such texts the target 0.
    Rows with equal ids, null ids included, are separate rows; the order within a shard is by seeded hash, then id, then size, so reruns agree,
    whatever the layout of the files.  An empty table gives no rows.  Other columns are ignored.
    """
    size = word_count(docs[text_col])
    sized = docs.select(docs[id_col].alias("id"), docs[source_col].cast("string").alias("source"), size.alias("size"))
    counted = cut(sized.groupBy("id", "source", "size").agg(F.count("*").alias("rows")).withColumn("content", F.lit(0)), "sizes")
    return _mixed(counted, weights, factor, most, block_words, seed).select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _mixed(counted: DataFrame, weights, factor, most, block, seed) -> DataFrame:
    """``counted`` has id, source, size, content and the number of such rows; one row for each with source_size, target and taken, and the columns of ``counted``."""
    own = counted.columns
    few = counted.where(F.col("rows") <= EQUAL_ROWS).withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    many = counted.where(F.col("rows") > EQUAL_ROWS).withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(EQUAL_ROWS).cast("long"))))
    many = many.repartition("id", "first").withColumn("nth", F.explode(F.sequence(F.col("first"), F.least(F.col("rows"), F.col("first") + EQUAL_ROWS) - 1))).drop("first")
    rows = few.unionByName(many)
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("size").cast("string"), F.col("content").cast("string"), F.col("nth").cast("string"))
    sources = counted.groupBy("source").agg(F.sum("rows").alias("docs")).select("source", F.least(F.lit(MAX_SHARDS), F.ceil(F.col("docs") / SHARD_DOCS)).cast("int").alias("n"))
    sources = cut(sources, "sources")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    dealt = rows.withColumn("k", F.md5(name)).join(sources, same(rows, sources)).drop(sources["source"])
    dealt = dealt.withColumn("shard", F.pmod(F.conv(F.substring("k", 1, 8), 16, 10).cast("long"), F.col("n")).cast("int")).drop("n")
    shards = cut(dealt.groupBy("source", "shard").agg(F.sum("size").alias("words")).withColumn("blocks", F.ceil(F.col("words") / block).cast("long")), "shards")
    totals = cut(_allotted(shards.groupBy("source").agg(F.sum("words").alias("words"), F.sum("blocks").alias("blocks")), weights, factor, most, block), "seats")
    plan = cut(_quotas(shards.join(totals, same(shards, totals)).drop(totals["source"]), most), "plan")
    before = Window.partitionBy("source", "shard").orderBy("k", "id", "size")
    ranged = dealt.withColumn("at", F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size"))
    passes = F.when(F.col("blocks") > 0, F.expr("quota div blocks")).otherwise(0)
    part = F.when(F.col("blocks") > 0, F.expr("quota % blocks")).otherwise(0) * block
    once_more = F.greatest(F.lit(0), F.least(F.col("size"), part - F.col("at")))
    joined = ranged.join(plan, same(ranged, plan) & (ranged["shard"] == plan["shard"])).drop(plan["source"], plan["shard"])
    return joined.select(*own, "source_size", "target", (passes * F.col("size") + once_more).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights: Sequence[float] = WEIGHTS, factor: float = 1.5, most: float = 2.0, block_words: int = BLOCK_WORDS, seed: str = "mix-1") -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, all columns.  Documents stay whole: a share that is no
    multiple of the size is rounded (at most one document of a shard has such a share).  Rows of size 0 are taken once.

    A row's seed is a hash of all its columns, so the same rows in another order or other files give the same mix; rows that are equal in all columns are
    interchangeable, so one of them stands for all and is repeated as often as they are taken together.
    """
    columns = docs.columns
    src = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    ident, text, source = (f"c{columns.index(c)}" for c in (id_col, text_col, source_col))
    whole = cut(src.withColumn("uid", F.monotonically_increasing_id()), "documents")
    sized = whole.select("uid", F.col(ident).alias("id"), F.col(source).cast("string").alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(*[f"c{i}" for i in range(len(columns))]).alias("content"))
    counted = cut(sized.groupBy("id", "source", "size", "content").agg(F.count("*").alias("rows"), F.min("uid").alias("uid")), "sizes")
    copies = F.when(F.col("size") == 0, 1).otherwise(F.round(F.col("taken") / F.col("size"))).cast("long")
    decided = _mixed(counted, weights, factor, most, block_words, seed).groupBy("uid").agg(F.sum(copies).alias("copies")).where("copies > 0")
    out = whole.join(decided, "uid").withColumn("one", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
