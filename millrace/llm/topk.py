"""Exact top-k search by inner product with multi-resolution segment statistics.

Vectors are turned by a rotation, which changes no inner product, onto the leading directions of a bounded sample, so that the first components say most; any
rotation gives the same result.  At each resolution the leading components are segments of their own and the rest is cut into a few segments.
With a segment's mean m and deviation s, the distance of two segments of w components is at least w ((m - m')² + (s - s')²), so their inner
product is at most w (m m' + s s').  From coarse to fine, a candidate goes as soon as its bound can't reach the query's k-th score so far;
only survivors are multiplied out, each with its own query, in whole numbers.

All rows are packed into blocks once.  The query set is taken in groups of bounded size, each broadcast and held against every block by one scan, so
neither rows nor queries are multiplied in a shuffle.  A task keeps k rows a query from block to block, and with them the score that must be reached.
"""

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import cut

#: Bytes of vectors in a block of rows, and of the queries that are broadcast together, about.
BLOCK_BYTES, QUERY_BYTES = 1 << 22, 1 << 25
#: Share of the components that are segments of their own, coarse to fine, and segments of the rest.
LEVELS, REST = (0.25, 0.5, 0.75, 0.875), 4
#: Queries compared at once inside a task; rows that a rotation and a first k-th score are taken from; vector lengths that get these.
AT_ONCE, SEEDS, LENGTHS = 256, 2048, 16
#: Longer vectors aren't rotated, so that matrices stay small.
ROTATED = 1024
#: Relative slack of bounds for rounding.
SLACK = 1e-9
#: Stands for a null id, last in the order.
NO_ID = np.iinfo(np.int64).max


def is_usable(vector: Column, scale: float = 1.0) -> Column:
    """Not null, not empty, and every component a finite number, also when multiplied by ``scale``."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """(rows, 2 * segments): means and deviations, scaled so that a product of two such rows bounds the inner product."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    out = [np.zeros((len(x), 0))]
    for a, b in zip(edges, edges[1:]):
        out += [(x[:, a:b].mean(1) * np.sqrt(b - a))[:, None], (x[:, a:b].std(1) * np.sqrt(b - a))[:, None]]
    return np.concatenate(out, 1)


def rotation(x: np.ndarray) -> np.ndarray:
    """(d, d): orthogonal, the directions in which the rows of ``x`` are largest first."""
    top = np.abs(x).max(initial=0)
    if not len(x) or not top or x.shape[1] > ROTATED:
        return np.eye(x.shape[1])
    x = x / top
    return np.ascontiguousarray(np.linalg.eigh(x.T @ x)[1][:, ::-1])


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Integer inner products as float64 where that is exact, else as Python integers."""
    top = (np.abs(q).max(initial=0) * np.abs(x).max(initial=0)) * x.shape[-1]
    if top < 2**53:
        return x @ q
    whole = np.frompyfunc(int, 1, 1)
    return whole(x) @ whole(q)


@dataclass
class Rows:
    """Rows as whole numbers (float64), their numbers and ids (``NO_ID``: null), and their bounds' parts."""

    uid: np.ndarray
    id: np.ndarray
    whole: np.ndarray
    turn: np.ndarray

    def __post_init__(self):
        with np.errstate(all="ignore"):
            self.turned = self.whole @ self.turn
            self.norm = np.sqrt((self.whole * self.whole).sum(1))
            d = self.whole.shape[1]
            self.heads = sorted({int(d * share) for share in LEVELS})
            self.rests = [statistics(self.turned[:, h:], REST) for h in self.heads]


@dataclass
class Best:
    """The k best rows of each query so far, and the score that a row must reach at least."""

    k: int
    least: np.ndarray
    found: list = field(default_factory=list)
    pairs: int = 0
    multiplied: int = 0

    def offer(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        both = [*self.found[i], *zip(scores.tolist(), ids.tolist())]
        both.sort(key=lambda s: (-s[0], s[1]))
        self.found[i] = both[: self.k]
        if len(both) >= self.k:
            self.least[i] = max(self.least[i], float(self.found[i][-1][0]))


def search(q: Rows, x: Rows, best: Best) -> None:
    """Hold the rows ``x`` against the queries ``q``; a query's own row, by its number, doesn't count."""
    for at in range(0, len(q.uid), AT_ONCE):
        some = slice(at, at + AT_ONCE)
        n = len(q.uid[some])
        with np.errstate(all="ignore"):
            slack = SLACK * q.norm[some, None] * x.norm[None] + 1e-6
            part, done = np.zeros((n, len(x.uid))), 0
            alive = q.uid[some, None] != x.uid[None]
            for h, mine, theirs in zip(q.heads, q.rests, x.rests):
                part += q.turned[some, done:h] @ x.turned[:, done:h].T
                done = h
                # a bound that is no number rules nothing out
                alive &= ~(part + mine[some] @ theirs.T + slack < best.least[some, None])
        best.pairs += alive.size
        for i in np.flatnonzero(alive.any(1)).tolist():
            left = np.flatnonzero(alive[i])
            if not np.isfinite(best.least[at + i]) and len(left) > 4 * best.k:  # the best by the last bound give a first score
                first = left[np.argpartition(-np.nan_to_num(part[i, left], nan=np.inf), 2 * best.k)[: 2 * best.k]]
                kth = np.sort(_exact(q.whole[at + i], x.whole[first]))[-best.k]
                best.least[at + i] = float(kth)
                with np.errstate(all="ignore"):
                    rest = part[i, left] + x.rests[-1][left] @ q.rests[-1][at + i] + slack[i, left]
                    left = left[~(rest < best.least[at + i])]
            best.multiplied += len(left)
            scores = _exact(q.whole[at + i], x.whole[left])
            if len(left) > best.k:  # ties at the k-th score stay for the ids to decide
                reach = np.sort(scores)[-best.k]
                scores, left = scores[scores >= reach], left[scores >= reach]
            best.offer(at + i, scores, x.id[left])


def _packed(rows: DataFrame, size: int, kind: str) -> DataFrame:
    """Blocks of rows of equal length with about ``size`` bytes of vectors: (dims, uids, ids, vectors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def row(dims: int) -> pa.RecordBatch:
            uids, ids, vectors = zip(*held.pop(dims))
            packed = np.array(uids, np.int64).tobytes(), np.array(ids, np.int64).tobytes(), np.concatenate(vectors).astype(kind).tobytes()
            return pa.record_batch([pa.array([dims], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)], ["dims", "uids", "ids", "vectors"])

        for b in batches:
            vectors = b.column("vector")
            flat, offsets = vectors.values.to_numpy(zero_copy_only=False), vectors.offsets.to_numpy()
            ids = b.column("id").fill_null(int(NO_ID)).to_pylist()
            for u, i, a, e in zip(b.column("uid").to_pylist(), ids, offsets.tolist(), offsets[1:].tolist()):
                own = held.setdefault(e - a, [])
                own.append((u, i, flat[a:e].copy()))
                if len(own) >= max(1, size // ((e - a) * int(kind[-1]))):
                    yield row(e - a)
        for dims in list(held):
            yield row(dims)

    return rows.select("uid", "id", "vector").mapInArrow(run, "dims int, uids binary, ids binary, vectors binary")


def top_k(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that ``is_query`` the k other rows with the highest inner product of
    floor(scale * component), ties to the smaller id.

    Vectors that are null, empty or hold a null or non-finite component (also once scaled) take no part; vectors of another
    length than the query's aren't compared.  Rows count by themselves: of two rows with one id each is a candidate of the other and, where it asks, a query with k
    rows of its own.  A null id comes last among ties.  Scores beyond a long are held at its ends.  An empty table gives no rows; other columns are ignored.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    vector = F.col("vector") if element in ("float", "double") else F.col("vector").cast("array<double>")
    src = vectors.select(F.monotonically_increasing_id().alias("uid"), vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = cut(src.where(is_usable(F.col("vector"), scale)).withColumn("vector", vector), "vectors")
    blocks = cut(_packed(rows, BLOCK_BYTES, kind).withColumn("block", F.monotonically_increasing_id()), "rows")
    asks = rows.where("asks")
    size = asks.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0)).alias("n")).first()["n"] * int(kind[-1])
    asked = cut(_packed(asks.repartition(max(1, -(-size // QUERY_BYTES)), F.xxhash64("uid")), QUERY_BYTES, kind).withColumn("block", F.monotonically_increasing_id()), "queries")

    def unpack(row, turn: np.ndarray) -> Rows:
        uid, ident = np.frombuffer(row["uids"], np.int64), np.frombuffer(row["ids"], np.int64)
        return Rows(uid, ident, np.floor(scale * np.frombuffer(row["vectors"], kind).astype(float)).reshape(len(uid), -1), turn)

    # one block for each of the commonest lengths comes to the driver
    common = blocks.groupBy("dims").agg(F.count("*").alias("n"), F.min("block").alias("block")).orderBy(F.desc("n"), "dims").limit(LENGTHS)
    turns, seeds = {}, {}
    for r in blocks.join(F.broadcast(common.select("block")), "block", "left_semi").toLocalIterator():
        plain = unpack(r, np.eye(r["dims"]))
        turns[r["dims"]] = turn = rotation(plain.whole[:SEEDS])
        seeds[r["dims"]] = Rows(plain.uid[:SEEDS], plain.id[:SEEDS], plain.whole[:SEEDS], turn)
    turned = blocks.sparkSession.sparkContext.broadcast(turns)

    def scan(queries: list) -> DataFrame:
        asking = {}
        for r in queries:
            q = unpack(r, turns.get(r["dims"], np.eye(r["dims"])))
            seed = Best(k, np.full(len(q.uid), -np.inf), [[] for _ in q.uid])
            if r["dims"] in seeds:
                search(q, seeds[r["dims"]], seed)
            asking.setdefault(r["dims"], []).append((dict(r.asDict()), seed.least))
        shipped = blocks.sparkSession.sparkContext.broadcast(asking)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            turns, state = turned.value, {}
            for b in batches:
                for i in range(b.num_rows):
                    dims = b.column("dims")[i].as_py()
                    if dims not in shipped.value:
                        continue
                    turn = turns.get(dims, np.eye(dims))
                    if dims not in state:
                        state[dims] = [(unpack(r, turn), Best(k, least.copy(), [[] for _ in least])) for r, least in shipped.value[dims]]
                    x = unpack({c: b.column(c)[i].as_py() for c in ("uids", "ids", "vectors")}, turn)
                    for q, best in state[dims]:
                        search(q, x, best)
            for own in state.values():
                for q, best in own:
                    n = [len(f) for f in best.found]
                    score = [min(max(int(s), -(2**63)), 2**63 - 1) for f in best.found for s, _ in f]
                    ids = np.array([i for f in best.found for _, i in f], np.int64)
                    columns = [pa.array(np.repeat(q.uid, n)), pa.array(np.repeat(q.id, n), mask=np.repeat(q.id, n) == NO_ID), pa.array(ids, mask=ids == NO_ID), pa.array(score, pa.int64())]
                    yield pa.record_batch(columns, ["q", "query_id", "vec_id", "score"])

        return blocks.mapInArrow(run, "q long, query_id long, vec_id long, score long")

    numbers = [r["block"] for r in asked.select("block").orderBy("block").toLocalIterator()]
    groups = [scan(asked.where(F.col("block") == number).collect()) for number in numbers] or [blocks.sparkSession.createDataFrame([], "q long, query_id long, vec_id long, score long")]
    if len(groups) > 1:  # one group's scan at a time, so that only its queries are held
        groups = [cut(g, "near") for g in groups]
    near = functools.reduce(DataFrame.union, groups)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
