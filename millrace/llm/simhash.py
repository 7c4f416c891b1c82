"""SimHash near-duplicate groups: pigeonhole blocks, then Hamming verification.

A text's fingerprint has ``64 * lanes`` bits; a bit is set when over half of the hashes of its word shingles have it.
Equal fingerprints are collapsed first, so copies cost one row.  The other fingerprints are joined on blocks:

* one lane: the 64 bits are cut into ``max_bits + 3`` blocks; a pair within ``max_bits`` agrees in at least three of them,
  so a bucket for every choice of three blocks loses no pair (``max_bits`` 3: 20 choices of 31 to 33 bits);
* more lanes: blocks of ``band_bits`` bits; a close pair agrees in one of them with a probability that grows with the number of
  blocks (see :func:`survivors`).  Blocks widen with the logarithm of the number of classes, so that buckets of strangers stay small,
  and their number grows with them, so that the probability stays (see :func:`bands`).

A bucket's rows come sorted to one task, which emits links of a spanning forest for larger buckets rather than all pairs: n rows give fewer than
n links, and as the search begins at the smallest node, buckets of one group mostly give the same links.  A bucket only holds different fingerprints that agree in all its bits, 24 bytes each.
Buckets of more than ``TILE`` rows are dealt over parts, and every two parts meet in a task of their own, so that a bucket that holds a third of all rows is neither held nor compared by one task.

With more lanes a bucket knows the first 128 bits only, so a forest of it would hold links that all bits refuse, in place of links that they allow.  What these
bits join to a group of up to ``SMALL_BUCKET`` rows is emitted as all its pairs; the rows of a larger group meet again with all they have, and the forest is made of links that pass every check.
"""

import math
from collections import deque
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.components import components
from millrace.llm.scratch import cut
from millrace.llm.words import utf8, words

#: Buckets up to this size are compared by shifted copies of the sorted column, larger ones by a search from each row; both find the same groups.
SMALL_BUCKET = 16
#: Rows of a part of a large bucket; strangers in a bucket, on average, at most.
TILE, STRANGERS = 8192, 4
#: Large buckets are spotted among the classes with one of so many hash values.  What is spotted only says how rows are dealt.
SPOTTED = 32


def shingle_hashes(text: bytes | None, ngram: int, seed: int) -> np.ndarray:
    """XXH64 of each run of ``ngram`` words, repeats included; fewer words: of the whole sequence; none: nothing."""
    own = words(text)
    if not own:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(own), xxhash.xxh64_intdigest
    if len(own) <= ngram:
        return np.array([h(joined, seed)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = [0, *(ends[: len(own) - ngram] + 1).tolist()]
    return np.array([h(joined[a:b], seed) for a, b in zip(starts, ends[ngram - 1 :].tolist())], np.uint64)


def _lanes(hashes: np.ndarray, lanes: int) -> np.ndarray:
    """(n, lanes): the hash itself, then more hashes mixed from it (splitmix64 steps)."""
    out = np.empty((len(hashes), lanes), np.uint64)
    out[:, 0] = hashes
    if lanes > 1:
        z = hashes[:, None] + np.arange(1, lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, 1:] = z ^ (z >> np.uint64(31))
    return out


def fingerprint(text: bytes | None, ngram: int, lanes: int, seed: int) -> bytes:
    """Big-endian, lane after lane; no words: all bits zero."""
    return _majority(shingle_hashes(text, ngram, seed), lanes)


def _majority(hashes: np.ndarray, lanes: int) -> bytes:
    total = np.zeros(64 * lanes, np.int64)
    for i in range(0, len(hashes), 8192):  # bounded memory for a very long text
        total += np.unpackbits(_lanes(hashes[i : i + 8192], lanes).view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(total * 2 > len(hashes), bitorder="little").view(np.uint64).astype(">u8").tobytes()


def _class(text: bytes | None, ngram: int, lanes: int, seed: int) -> bytes:
    """The fingerprint and 16 bytes of a hash of the shingle set, as texts of other shingles may share a fingerprint; no words: the fingerprint only."""
    hashes = shingle_hashes(text, ngram, seed)
    own = _majority(hashes, lanes)
    return own + xxhash.xxh3_128_digest(np.unique(hashes).tobytes(), seed) if len(hashes) else own


def _shingle_sets(docs: DataFrame, text: str, ngram: int, seed: int) -> DataFrame:
    """(node, shingles) of ``docs`` with uid: the sorted distinct hashes, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), ngram, seed)).tobytes() for t in utf8(b, text)]
            yield pa.record_batch([b.column("uid"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return docs.select("uid", text).mapInArrow(run, "node long, shingles binary")


def _alike(one: np.ndarray, others: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the sorted sets share at least ``similarity`` of the shingles with ``one``; none is empty."""
    flat, size = np.concatenate(others), np.array([len(x) for x in others])
    found = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    both = np.add.reduceat(found, np.cumsum(size) - size, dtype=np.int64)
    return both >= similarity * (size + len(one) - both) - 1e-9


def with_fingerprints(docs: DataFrame, ngram: int, lanes: int, seed: int) -> DataFrame:
    """(uid, id, fp): uid numbers the rows, so that repeated or null ids stay apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), ngram, lanes, seed) for t in utf8(b)]
            yield pa.record_batch([b.column("uid"), b.column("id"), pa.array(fps, pa.binary())], ["uid", "id", "fp"])

    return docs.select(F.monotonically_increasing_id().alias("uid"), "id", "text").mapInArrow(run, f"uid long, id {docs.schema['id'].dataType.simpleString()}, fp binary")


def bands(classes: int, lanes: int, max_bits: int, band_bits: int, share: float = 0.95) -> tuple[int, int]:
    """(bits of a block, number of blocks) for so many classes: as many disjoint blocks of ``band_bits`` as there are bits for while their buckets
    hold ``STRANGERS`` strangers at most; beyond that wider ones, so many that a pair shares one with probability ``share`` when 15 % of its bits differ."""
    bits = 64 * lanes
    wide = max(band_bits, math.ceil(math.log2(max(1, classes) / STRANGERS)))
    agrees = (1 - min(0.15, max_bits / bits)) ** wide
    return wide, bits // wide if wide == band_bits else max(bits // wide, math.ceil(math.log(1 - share) / math.log1p(-agrees)))


def block_keys(fps: np.ndarray, max_bits: int, band_bits: int, n_bands: int | None = None) -> list[np.ndarray]:
    """Bucket keys of fingerprints (n, lanes), one array for each table; the table's number stands above the key's bits.  Blocks beyond the
    disjoint ones are cut from seeded permutations of the bits."""
    lanes = fps.shape[1]
    if lanes == 1:
        m = max_bits + 3
        edges = [64 * i // m for i in range(m + 1)]
        parts = [(fps[:, 0] >> np.uint64(a)) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:])]
        widths, keys = [b - a for a, b in zip(edges, edges[1:])], []
        for t, chosen in enumerate(combinations(range(m), 3)):
            key = np.zeros(len(fps), np.uint64)
            for p in chosen:
                key = (key << np.uint64(widths[p])) | parts[p]
            keys.append(key | (np.uint64(t) << np.uint64(48)))
        return keys
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    weight = (1 << np.arange(band_bits, dtype=np.uint64)).astype(np.uint64)
    once = bits.shape[1] // band_bits
    keys = []
    for t in range(once if n_bands is None else n_bands):
        if t and t % once == 0:
            bits = bits[:, np.random.default_rng(t).permutation(bits.shape[1])]
        at = t % once * band_bits
        keys.append((np.uint64(t) << np.uint64(band_bits)) | (bits[:, at : at + band_bits] * weight).sum(1, dtype=np.uint64))
    return keys


def _unpack(column: pa.Array, lanes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, lanes)


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Different bits of rows of words."""
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _search(n: int, near_to: Callable[[int, np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices below n) that join exactly what links for which ``near_to`` holds join: a search over what is not yet reached."""
    left, a, b = np.arange(n), [], []
    while len(left) > 1:
        queue, left = deque([left[0]]), left[1:]
        while queue and len(left):
            at = queue.popleft()
            near = near_to(at, left)
            if near.any():
                found = left[near]
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found.tolist())
                left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _forest(sig: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (indices) that join exactly what links within ``most`` bits join."""
    return _search(len(sig), lambda at, left: _distance(sig[left], sig[at]) <= most)


def _groups_of(n: int, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    """The indices below n of each tree of a forest whose links (x, y) come in the order of :func:`_search`."""
    label = np.arange(n)
    for a, b in zip(x.tolist(), y.tolist()):
        label[b] = label[a]
    order = np.argsort(label, kind="stable")
    return [g for g in np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(g) > 1]


def _bucket_links(key: np.ndarray, node: np.ndarray, sig: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the buckets of key-sorted rows."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[first, len(key)])
    a, b = [], []
    keep = np.repeat((length > 1) & (length <= SMALL_BUCKET), length)
    k, n, s = key[keep], node[keep], sig[keep]
    for d in range(1, SMALL_BUCKET):
        same = k[d:] == k[:-d]
        if not same.any():
            break
        near = np.flatnonzero(same & (_distance(s[d:], s[:-d]) <= most))
        a.append(n[near])
        b.append(n[near + d])
    for at in np.flatnonzero(length > SMALL_BUCKET):
        own = slice(first[at], first[at] + length[at])
        x, y = _forest(sig[own], most)
        a.append(node[own][x])
        b.append(node[own][y])
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _bucket_candidates(key: np.ndarray, node: np.ndarray, sig: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, group): all pairs within ``most`` bits of buckets and groups of up to SMALL_BUCKET rows, with group -1; of a larger group,
    for each row a, its smallest node b and the bucket's key as group."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    length = np.diff(np.r_[first, len(key)])
    small = np.repeat(length <= SMALL_BUCKET, length)
    out = [(*_bucket_links(key[small], node[small], sig[small], most), -1)] if small.any() else []
    for at in np.flatnonzero(length > SMALL_BUCKET):
        own = slice(first[at], first[at] + length[at])
        for g in _groups_of(length[at], *_forest(sig[own], most)):
            n = node[own][g]
            if len(g) > SMALL_BUCKET:
                out.append((n, np.full(len(n), n.min()), key[first[at]]))
            else:
                x, y = np.triu_indices(len(g), 1)
                near = _distance(sig[own][g][x], sig[own][g][y]) <= most
                out.append((n[x[near]], n[y[near]], -1))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    a, b, group = zip(*out)
    return np.concatenate(a), np.concatenate(b), np.repeat(np.array(group, np.int64), [len(x) for x in a])


def _linked(batches: Iterator[pa.RecordBatch], most: int, candidates: bool = False) -> Iterator[pa.RecordBatch]:
    """Key-sorted rows (key, node, sig and perhaps more words of it) to links, or to candidates; a bucket may span batches."""
    held: list[list[np.ndarray]] = []

    def links(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, node, *sig = (np.concatenate(x) for x in zip(*parts))
        words = np.stack(sig, 1).view(np.uint64)
        a, b, *group = _bucket_candidates(key, node, words, most) if candidates else _bucket_links(key, node, words, most)
        low, high = np.minimum(a, b), np.maximum(a, b)
        if group:  # the row and its group stay in this order
            low, high = np.where(group[0] < 0, low, a), np.where(group[0] < 0, high, b)
        return pa.record_batch([pa.array(x) for x in (low, high, *group)], ["a", "b", "group"][: 2 + len(group)])

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        last = int(np.searchsorted(cols[0], cols[0][-1]))  # where the last bucket begins
        if held and cols[0][0] != held[-1][0][-1]:
            yield links(held)
            held = []
        if last:
            yield links([*held, [c[:last] for c in cols]])
            held = []
        held.append([c[last:] for c in cols])
    if held:
        yield links(held)


def _group_links(batches: Iterator[pa.RecordBatch], links: Callable[[pa.Table], tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows (group, b, node, ...) sorted by group and b to the links (indices of rows) of each group; a group may span batches."""
    held: list[pa.RecordBatch] = []

    def done() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        node = rows.column("node").to_numpy()
        x, y = links(rows)
        return pa.record_batch([pa.array(np.minimum(node[x], node[y])), pa.array(np.maximum(node[x], node[y]))], ["a", "b"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        group, low = batch.column("group").to_numpy(), batch.column("b").to_numpy()
        edges = np.r_[0, np.flatnonzero((group[1:] != group[:-1]) | (low[1:] != low[:-1])) + 1, len(group)].tolist()
        for i, j in zip(edges, edges[1:]):
            if held and last != (group[i], low[i]):
                yield done()
                held = []
            held.append(batch.slice(i, j - i))
            last = (group[i], low[i])
    if held:
        yield done()


def _dealt(rows: DataFrame, large: DataFrame) -> DataFrame:
    """Rows of buckets in ``large`` (key, parts) get one row for each part, with a key for its own part and that one."""
    own = "pmod(xxhash64(node), parts)"
    keys = F.expr(f"CASE WHEN parts IS NULL THEN array(key) ELSE transform(sequence(0L, parts - 1), t -> xxhash64(key, least(t, {own}), greatest(t, {own}))) END")
    return rows.join(large, "key", "left").withColumn("key", F.explode(keys)).drop("parts")


def class_links(classes: DataFrame, lanes: int, max_bits: int, band_bits: int, probe_bits: int, sets: Callable[[DataFrame], DataFrame] | None = None, similarity: float = 0.0) -> DataFrame:
    """(a, b): links between the classes' nodes.  ``classes`` has node and fp, which may go on behind the fingerprint.  With several lanes and
    ``sets``, which gives (node, shingles) for a table of nodes, links also have that similarity."""
    classes = classes.select("node", F.substring("fp", 1, 8 * lanes).alias("fp"))
    n_classes = classes.count()
    wide, n_bands = bands(n_classes, lanes, max_bits, band_bits) if lanes > 1 else (0, 0)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                fps, node = _unpack(b.column("fp"), lanes), b.column("node").to_numpy()
                probe = [pa.array(fps[:, i].copy().view(np.int64)) for i in range(len(sig))]
                for key in block_keys(fps, max_bits, wide, n_bands):
                    yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(node), *probe], ["key", "node", *sig])

    most = max_bits if lanes == 1 else probe_bits
    sig = [f"sig{i}" for i in range(min(lanes, 2))]  # a pair of many lanes is looked at by its first 128 bits before all are compared
    kind = "key long, node long, " + ", ".join(f"{c} long" for c in sig)
    rows = classes.mapInArrow(keyed, kind)
    if n_classes > TILE:  # smaller tables have no larger bucket
        seen = classes.where(F.pmod(F.xxhash64("node"), F.lit(SPOTTED)) == 0).mapInArrow(keyed, kind)
        large = cut(seen.groupBy("key").agg((F.count("*") * SPOTTED).alias("size")).where(F.col("size") > TILE).select("key", F.ceil(F.col("size") / TILE).alias("parts")), "large")
        if not large.isEmpty():
            rows = _dealt(rows, large)
    met = rows.repartition("key").sortWithinPartitions("key", "node")
    if lanes == 1:
        return met.mapInArrow(lambda x: _linked(x, most), "a long, b long").distinct()
    found = cut(met.mapInArrow(lambda x: _linked(x, most, True), "a long, b long, group long"), "candidates")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = np.bitwise_count(_unpack(b.column("x"), lanes) ^ _unpack(b.column("y"), lanes)).sum(1)
                yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(d <= max_bits))

    compare = sets is not None

    def links_of(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        fps = _unpack(rows.column("fp"), lanes)
        own = [np.frombuffer(x, np.uint64) for x in rows.column("shingles").to_pylist()] if compare else []

        def near_to(at: int, left: np.ndarray) -> np.ndarray:
            near = _distance(fps[left, : len(sig)], fps[at, : len(sig)]) <= most
            near[near] = _distance(fps[left[near]], fps[at]) <= max_bits
            if compare and near.any():
                some = left[near].tolist()
                near[near] = np.concatenate([_alike(own[at], [own[j] for j in some[i : i + 256]], similarity) for i in range(0, len(some), 256)])
            return near

        return _search(len(fps), near_to)

    x = classes.select(F.col("node").alias("a"), F.col("fp").alias("x"))
    y = classes.select(F.col("node").alias("b"), F.col("fp").alias("y"))
    pairs = found.where("group < 0").select("a", "b").distinct()
    pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(verified, "a long, b long")
    members = found.where("group >= 0").select("group", "b", F.col("a").alias("node")).join(classes, "node")
    if compare:

        def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                same = [bool(_alike(np.frombuffer(x.as_py(), np.uint64), [np.frombuffer(y.as_py(), np.uint64)], similarity)[0]) for x, y in zip(b.column("x"), b.column("y"))]
                yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(same, pa.bool_()))

        pairs = cut(pairs, "pairs")
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(found.where("group >= 0").select("a")).distinct()
        own = cut(sets(ends), "shingles")
        x, y = own.select(F.col("node").alias("a"), F.col("shingles").alias("x")), own.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(alike, "a long, b long")
        members = members.join(own, "node")
    members = members.select("group", "b", "node", *[c for c in members.columns if c in ("fp", "shingles")])
    large = members.repartition("group", "b").sortWithinPartitions("group", "b", "node").mapInArrow(lambda x: _group_links(x, links_of), "a long, b long")
    return pairs.union(large)


def _groups(rows: DataFrame, lanes: int, max_bits: int, band_bits: int, probe_bits: int, sets: Callable[[DataFrame], DataFrame] | None = None, similarity: float = 0.0) -> DataFrame:
    """(fp, low_uid, component): for each fingerprint the smallest uid and the smallest id of its component."""
    classes = cut(rows.groupBy("fp").agg(F.min("uid").alias("node"), F.min("id").alias("low")), "classes")
    comp = cut(components(class_links(classes, lanes, max_bits, band_bits, probe_bits, sets, similarity)), "components")
    linked = comp.join(classes.select("node", "low"), "node")
    lows = linked.groupBy("root").agg(F.min("low").alias("low_root"))
    of_node = comp.join(lows, "root").select("node", "root", "low_root", F.lit(True).alias("is_linked"))
    return classes.join(of_node, "node", "left").select(
        "fp",
        F.coalesce("root", "node").alias("low_uid"),
        F.when(F.col("is_linked"), F.col("low_root")).otherwise(F.col("low")).alias("component"),
    )


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ngram: int = 3, max_bits: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fingerprint, component_id) for every row of ``docs``.

    Null and empty texts have the fingerprint zero and link like any other.  Rows with equal ids stay separate rows;
    ids may be of any type with an order; null ids are allowed (a component of null ids only has a null component_id).  Other columns of ``docs`` are ignored.
    """
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    rows = cut(with_fingerprints(src, ngram, 1, seed), "fingerprints")
    out = rows.join(_groups(rows, 1, max_bits, 0, 0), "fp")
    return out.select(F.col("id").alias(id_col), F.lower(F.hex("fp")).alias("fingerprint"), F.col("component").alias("component_id"))


#: The fingerprints of texts that share 0.8 of their five-word shingles differ in 15 % of the bits, of texts that share 0.7 in 19 %.
#: 1024 bits tell these apart (a standard deviation is 1.1 %), and 56 blocks of 18 bits hold 95 % of pairs at 0.8 and 99 % at 0.85.
#: Before that, of the first 128 bits 32 at most may differ: pairs at 0.8 differ in 19 (standard deviation 4), texts that merely share a passage in 40 and more.
#: The bound lets pairs below 0.8 through; links are therefore compared by their shingle sets at last.
STAGE = {"ngram": 5, "lanes": 16, "max_bits": 180, "band_bits": 18, "probe_bits": 32}


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, ngram: int = 5, lanes: int = 16, max_bits: int = 180, band_bits: int = 18, probe_bits: int = 32, seed: int = 42, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, but one for each group of near-duplicates on five-word shingles.

    A pair counts if the fingerprints agree as far as asked and the shingle sets have that Jaccard similarity.  Texts without words are left alone: each stays.  Equal texts always share a group.  The row that stays is the one
    with the smallest id of the group's smallest class; repeated rows count as copies.
    """
    columns = docs.columns
    src = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    text, ident = f"c{columns.index(text_col)}", f"c{columns.index(id_col)}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_class(t.as_py(), ngram, lanes, seed) for t in utf8(b, text)]
            yield pa.record_batch([*b.columns, pa.array(fps, pa.binary())], [*b.schema.names, "fp"])

    numbered = src.withColumn("uid", F.monotonically_increasing_id())
    schema = T.StructType([*numbered.schema.fields, T.StructField("fp", T.BinaryType())])
    whole = cut(numbered.mapInArrow(run, schema), "documents")
    rows = whole.where(F.col("fp") != F.lit(bytes(8 * lanes))).select("uid", F.col(ident).alias("id"), "fp")

    def sets(nodes: DataFrame) -> DataFrame:
        return _shingle_sets(whole.join(nodes.withColumnRenamed("node", "uid"), "uid", "left_semi"), text, ngram, seed)

    groups = _groups(rows, lanes, max_bits, band_bits, probe_bits, sets, similarity)
    member = rows.join(groups.select("fp", "low_uid"), "fp").select("low_uid", F.struct(F.col("id").isNull().alias("none"), "id", "uid").alias("who"))
    kept = member.groupBy("low_uid").agg(F.min("who.uid").alias("x"), F.min("who").alias("who")).select(F.col("who.uid").alias("uid"))
    alone = whole.where(F.col("fp") == F.lit(bytes(8 * lanes)))
    out = alone.unionByName(whole.where(F.col("fp") != F.lit(bytes(8 * lanes))).join(kept, "uid", "left_semi"))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(columns)])
