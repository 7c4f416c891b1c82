"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors whose cosine is at least c lie within eps = sqrt(2 - 2 c).  Equal vectors are collapsed, the rest are projected on their leading
principal directions (a projection never lengthens a distance, so any loss of precision there only costs pruning), cut into grid cells of width eps
and sorted by cells within their label.  Consecutive intervals of that order become blocks, ``FAN`` consecutive ones a longer interval, and so on up to the
whole label.  From the top, an interval is joined with another by joining their parts, and parts whose boxes are further apart than eps go no further: over the table
for intervals down to blocks, and inside a task by halving two blocks again and again.  A task
returns for each vector the number of vectors it links with and one link of a spanning forest, not the pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.components import components
from millrace.llm.ranks import ranked
from millrace.llm.scratch import cut
from millrace.llm.topk import is_usable

#: Principal directions with grid cells.
DIRECTIONS = 6
#: Bytes of vectors in a block, about; rows at which an interval is no longer halved; parts of an interval of blocks.
BLOCK_BYTES, LEAF, FAN = 1 << 19, 128, 16
#: Components that directions are fitted on, at most, and vector lengths for which they are: others take their first components.
FITTED, LENGTHS = 512, 16
#: Slack on eps and cosine bounds for rounding in the projection.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Arrow lists of one length as float64 rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    dims = batch.column("dims").to_numpy()
    for d in np.unique(dims):
        yield int(d), batch.take(pa.array(np.flatnonzero(dims == d)))


def principal_directions(classes: DataFrame, k: int) -> dict[int, np.ndarray]:
    """For the commonest vector lengths d, (d, k) leading eigenvectors of the covariance of the unit vectors' first ``FITTED`` components;
    its sums come to the driver."""
    common = classes.groupBy("dims").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").limit(LENGTHS)
    lengths = {r["dims"] for r in common.collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for d, part in _by_length(b):
                if d in lengths:
                    x = np.c_[_unit(_matrix(part.column("vector")))[:, :FITTED], np.ones(part.num_rows)]
                    sums[d] = sums.get(d, 0) + x.T @ x
        for d, s in sums.items():
            i, j = np.indices(s.shape)
            yield pa.record_batch([pa.array(np.full(s.size, d, np.int32)), pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(s.ravel())], ["dims", "i", "j", "s"])

    total = classes.select("dims", "vector").mapInArrow(run, "dims int, i int, j int, s double").groupBy("dims", "i", "j").agg(F.sum("s").alias("s"))
    out: dict[int, np.ndarray] = {}
    pdf = total.toPandas()
    for d, part in pdf.groupby("dims"):
        f = min(int(d), FITTED)
        m = np.zeros((f + 1, f + 1))
        m[part["i"], part["j"]] = part["s"]
        n = m[f, f]
        cov = m[:f, :f] / n - np.outer(m[:f, f], m[:f, f]) / n**2
        _, vectors = np.linalg.eigh((cov + cov.T) / 2)
        out[int(d)] = np.zeros((int(d), min(k, f)))
        out[int(d)][:f] = vectors[:, ::-1][:, :k]
    return out


def block_pairs(blocks: DataFrame, directions: int, least: float) -> DataFrame:
    """(x, y), x <= y, of ``blocks`` (block, label, dims, lo, hi, numbered in their order) whose boxes are within ``least`` of each other, in equal labels and dims."""
    same = ["label", "dims"]
    placed = ranked(blocks.select("block", *same, "lo", "hi"), same, [F.asc("block")], "block", "at")
    level = cut(blocks.select("block", *same, "lo", "hi").join(placed, "block").withColumn("at", F.col("at") - 1), "level-0")
    levels = [level]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) > 0:
        sides = [F.array(*[f(F.col(side)[i]) for i in range(directions)]).alias(side) for side, f in (("lo", F.min), ("hi", F.max))]
        levels.append(cut(levels[-1].groupBy(*same, F.floor(F.col("at") / FAN).alias("at")).agg(*sides), f"level-{len(levels)}"))
    pairs = levels[-1].select(*same, F.col("at").alias("x"), F.col("at").alias("y"))
    gap = "aggregate(sequence(0, size(lo) - 1), 0D, (s, i) -> s + power(greatest(0D, lo[i] - xhi[i], xlo[i] - hi[i]), 2))"
    for number, parts in reversed(list(enumerate(levels[:-1]))):
        parts = parts.withColumn("of", F.floor(F.col("at") / FAN))
        one = parts.select(*same, F.col("of").alias("x"), F.col("at").alias("x1"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
        other = parts.select(*same, F.col("of").alias("y"), F.col("at").alias("y1"), "lo", "hi")
        met = pairs.join(one, [*same, "x"]).join(other, [*same, "y"]).where((F.col("x1") <= F.col("y1")) & (F.expr(gap) <= least**2))
        pairs = cut(met.select(*same, F.col("x1").alias("x"), F.col("y1").alias("y")), f"pairs-{number}")
    number = level.select(*same, "at", "block")
    x, y = number.withColumnRenamed("at", "x").withColumnRenamed("block", "bx"), number.withColumnRenamed("at", "y").withColumnRenamed("block", "by")
    return pairs.join(x, [*same, "x"]).join(y, [*same, "y"]).select(F.col("bx").alias("x"), F.col("by").alias("y"))


class _Join:
    """Joins two intervals of the epsilon grid order; ``same``: both are one block, and each pair counts once for both ends."""

    def __init__(self, a: dict, b: dict, same: bool, least: float, eps: float):
        self.a, self.b, self.same, self.least, self.eps2 = a, b, same, least, (eps + SLACK) ** 2
        self.links_a, self.links_b = np.zeros(len(a["n"]), np.int64), np.zeros(len(b["n"]), np.int64)
        self.label = np.arange(len(a["n"]) + (0 if same else len(b["n"])))
        self.shift = 0 if same else len(a["n"])
        self._run(0, len(a["n"]), 0, len(b["n"]))

    def _distant(self, i: int, j: int, k: int, m: int) -> bool:
        p, q = self.a["p"][i:j], self.b["p"][k:m]
        gap = np.maximum(0, np.maximum(q.min(0) - p.max(0), p.min(0) - q.max(0)))
        return (gap * gap).sum() > self.eps2

    def _run(self, i: int, j: int, k: int, m: int) -> None:
        if self.same and k < i or self._distant(i, j, k, m):
            return
        if max(j - i, m - k) > LEAF:
            x = [(i, (i + j) // 2), ((i + j) // 2, j)] if j - i > LEAF else [(i, j)]
            y = [(k, (k + m) // 2), ((k + m) // 2, m)] if m - k > LEAF else [(k, m)]
            for p in x:
                for q in y:
                    self._run(*p, *q)
            return
        near = self.a["u"][i:j] @ self.b["u"][k:m].T >= self.least
        mirrored = self.same and i != k
        if self.same and i == k:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        self.links_a[i:j] += near @ self.b["n"][k:m]
        if mirrored:
            self.links_a[k:m] += near.T @ self.a["n"][i:j]
        elif not self.same:
            self.links_b[k:m] += near.T @ self.a["n"][i:j]
        x, y = np.nonzero(near)
        self._unite(x + i, y + k + self.shift)

    def _unite(self, x: np.ndarray, y: np.ndarray) -> None:
        label = self.label
        while True:
            a, b = label[x], label[y]
            if (a == b).all():
                return
            np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
            while (label[label] != label).any():
                label[:] = label[label]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, node it is joined with) of every row that has a link here."""
        node = self.a["node"] if self.same else np.r_[self.a["node"], self.b["node"]]
        links = self.links_a if self.same else np.r_[self.links_a, self.links_b]
        some = links > 0
        return node[some], links[some], node[self.label[some]]


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", *, cosine: float = 0.98, directions: int = DIRECTIONS) -> DataFrame:
    """(id_col, n_links, component_id, kept) for every row.

    Rows are compared only where labels are equal and not null, and only with vectors of the same length.  Vectors that are null, empty,
    all zero or hold a null or non-finite component link with nothing.  Repeated rows are rows of their own and link with each other; a null id
    counts as a link of others but is nobody's component_id unless all ids of the component are null; ids may be of any type with an order.
    """
    element = vectors.schema[vector_col].dataType.elementType.simpleString()
    kind = "<f4" if element == "float" else "<f8"
    eps = float(np.sqrt(2 - 2 * cosine))
    raw = vectors[vector_col] if element == "float" else vectors[vector_col].cast("array<double>")
    src = vectors.select(F.monotonically_increasing_id().alias("uid"), vectors[id_col].alias("id"), vectors[label_col].alias("label"), raw.alias("vector"))
    usable = F.col("label").isNotNull() & is_usable(F.col("vector")) & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = cut(src.withColumn("usable", usable), "vectors")
    same = ["label", "vector"]
    classes = cut(rows.where("usable").groupBy(*same).agg(F.min("uid").alias("node"), F.min("id").alias("low"), F.count("*").alias("n")).withColumn("dims", F.size("vector")), "classes")
    axes = principal_directions(classes, directions)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, part in _by_length(b):
                u = _unit(_matrix(part.column("vector")))
                p = np.zeros((len(u), directions))
                axis = axes.get(d, np.eye(d)[:, :directions])
                p[:, : axis.shape[1]] = u @ axis
                cells = np.floor(p / eps).astype(np.int32)
                keep = [part.column(c) for c in ("label", "dims", "node", "n", "vector")]
                yield pa.record_batch([*keep, *(pa.array(cells[:, i]) for i in range(directions)), pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), directions).cast(pa.list_(pa.float64()))], ["label", "dims", "node", "n", "vector", *(f"g{i}" for i in range(directions)), "p"])

    label_kind = classes.schema["label"].dataType.simpleString()
    order = ["label", "dims", *(f"g{i}" for i in range(directions))]
    in_cells = classes.select("label", "dims", "node", "n", "vector").mapInArrow(
        projected, f"label {label_kind}, dims int, node long, n long, vector array<{'float' if kind == '<f4' else 'double'}>, " + "".join(f"g{i} int, " for i in range(directions)) + "p array<double>"
    )
    ordered = in_cells.repartitionByRange(*order, "node").sortWithinPartitions(*order, "node")

    def blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            p = np.stack([np.asarray(x) for x in t.column("p").to_pylist()])
            vector = t.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(kind)
            packed = [t.column("node").to_numpy().tobytes(), t.column("n").to_numpy().tobytes(), p.tobytes(), vector.tobytes()]
            columns = [t.column("label").combine_chunks().slice(0, 1), pa.array([key[1]], pa.int32()), pa.array([p.min(0).tolist()]), pa.array([p.max(0).tolist()]), *(pa.array([x], pa.binary()) for x in packed)]
            return pa.record_batch(columns, ["label", "dims", "lo", "hi", "nodes", "counts", "points", "vectors"])

        size = 0
        for b in batches:
            keys = list(zip(b.column("label").to_pylist(), b.column("dims").to_pylist()))
            at = 0
            for i in range(len(keys) + 1):
                full = key is not None and size + (i - at) >= max(2 * LEAF, BLOCK_BYTES // (4 * key[1]))
                if i == len(keys) or full or keys[i] != key:
                    if i > at:
                        held.append(b.slice(at, i - at))
                        size += i - at
                    at = i
                    if i < len(keys):
                        if held and (full or keys[i] != key):
                            yield block()
                            held, size = [], 0
                        key = keys[i]
        if held:
            yield block()

    blocks = cut(
        ordered.mapInArrow(blocked, f"label {label_kind}, dims int, lo array<double>, hi array<double>, nodes binary, counts binary, points binary, vectors binary").withColumn("block", F.monotonically_increasing_id()),
        "blocks",
    )
    pairs = block_pairs(blocks, directions, eps + SLACK)
    side = lambda name: blocks.select(F.col("block").alias(name), *([F.col("dims")] if name == "x" else []), *[F.col(c).alias(f"{name}_{c}") for c in ("nodes", "counts", "points", "vectors")])
    tiles = pairs.join(side("x"), "x").join(side("y"), "y")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(t: dict, name: str) -> dict:
            n = np.frombuffer(t[f"{name}_counts"], np.int64)
            v = np.frombuffer(t[f"{name}_vectors"], kind).astype(float).reshape(len(n), -1)
            return {"node": np.frombuffer(t[f"{name}_nodes"], np.int64), "n": n, "p": np.frombuffer(t[f"{name}_points"], float).reshape(len(n), -1), "u": _unit(v)}

        for b in batches:
            for i in range(b.num_rows):
                t = b.slice(i, 1).to_pylist()[0]
                a = read(t, "x")
                node, links, root = _Join(a, a if t["x"] == t["y"] else read(t, "y"), t["x"] == t["y"], cosine, eps).rows()
                yield pa.record_batch([pa.array(node), pa.array(links), pa.array(root)], ["node", "links", "root"])

    found = cut(tiles.mapInArrow(joined, "node long, links long, root long"), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.select("node", "label", "vector", "low", "n").join(links, "node", "left").join(comp, "node", "left").withColumn("root", F.coalesce("root", "node"))
    known = cut(known, "linked")
    lows = known.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = known.join(lows, "root").select("label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    member = rows.where("usable").join(of_class, same).select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = member.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
