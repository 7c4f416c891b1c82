import random
import re

import numpy as np
import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_fingerprint(text, k=3):
    own = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(own[i : i + k]) for i in range(len(own) - k + 1)] or [" ".join(own)])]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps, most):
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= most:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(fps))]


def make_texts():
    rnd = random.Random(1)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = [None, "", " \t", "One", "one", "one two", "ONE TWO THREE", "É a b  c\x0bd", "x " * 30_000]
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(20, 400))]
        texts.append(" ".join(base))
        for _ in range(rnd.randint(0, 5)):
            other = list(base)
            other[rnd.randrange(len(base))] = rnd.choice(vocabulary)
            texts.append(" ".join(other))
            texts.append(" ".join(base))
    return texts


def test_groups_match_brute_force(spark):
    texts = make_texts()
    rows = [(i, t, 7) for i, t in enumerate(texts)]
    random.Random(2).shuffle(rows)
    out = {r.doc_id: r for r in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    groups = brute_groups(fps, 3)
    assert len(out) == len(texts)
    for i in range(len(texts)):
        assert out[i].fingerprint == f"{fps[i]:016x}"
        assert out[i].component_id == groups[i]


def test_large_buckets_and_runs_across_batches():
    rnd = random.Random(4)
    center = rnd.getrandbits(64)
    fps = list({center ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 9))) for _ in range(400)})
    key, node = np.zeros(len(fps), np.int64), np.arange(len(fps))
    sig = np.array(fps, np.uint64).reshape(-1, 1)
    want = brute_groups(fps, 3)
    for a, b in (simhash._bucket_links(key, node, sig, 3), simhash._forest(sig, 3)):
        label = list(range(len(fps)))
        for _ in range(len(fps)):
            for x, y in zip(a.tolist(), b.tolist()):
                label[x] = label[y] = min(label[x], label[y])
            if [label[x] for x in a.tolist()] == [label[y] for y in b.tolist()]:
                break
        assert label == want
        assert len(a) < len(fps)
    import pyarrow as pa

    batches = [pa.record_batch([pa.array(key[i : i + 50]), pa.array(node[i : i + 50]), pa.array(sig[:, 0].view(np.int64)[i : i + 50])], ["key", "node", "sig"]) for i in range(0, len(fps), 50)]
    assert sum(b.num_rows for b in simhash._linked(iter(batches), 3)) == len(simhash._forest(sig, 3)[0])


def test_every_close_pair_shares_a_block():
    rnd = random.Random(6)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << x for x in rnd.sample(range(64), rnd.randint(0, 3)))
        x, y = (simhash.block_keys(np.array([[v]], np.uint64), 3, 0) for v in (a, b))
        assert any(p[0] == q[0] for p, q in zip(x, y))
    keys = simhash.block_keys(np.array([[0]], np.uint64), 3, 0)
    assert len({int(k[0]) for k in keys}) == len(keys) == 20


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, None), (None, "q r s t u v")], "doc_id long, text string")
    out = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_groups(docs).collect())
    assert out == sorted([("None", "5"), ("5", "5"), ("5", "5"), ("7", "7"), ("None", "None")])
    assert simhash.near_groups(docs.limit(0)).count() == 0


def test_survivors_keep_one_of_each_group(spark):
    rnd = random.Random(9)
    texts, group = [], []
    for g in range(30):
        base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        for _ in range(4):
            other = list(base)
            other[rnd.randrange(200)] = f"n{rnd.randrange(5000)}"
            texts.append(" ".join(other))
            group.append(g)
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(900, None, "s"), (901, "", None), (902, " ", "s"), (0, texts[0], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = simhash.survivors(docs)
    assert out.columns == docs.columns
    kept = sorted(r.doc_id for r in out.collect())
    assert [i for i in kept if i >= 900] == [900, 901, 902]
    assert sorted(group[i] for i in kept if i < 900) == list(range(30))


@pytest.mark.parametrize("size", [15, 60])
def test_large_buckets_lose_no_link_to_one_that_all_bits_refuse(spark, size):
    """Copies within the bound of their original, which has the largest node, but not of one another; all share buckets and pass the probe."""
    rnd = random.Random(size)
    original = rnd.getrandbits(1024)
    copies = [original ^ sum(1 << b for b in rnd.sample(range(128, 1024), 150)) for _ in range(size)]
    assert all(bin(x ^ y).count("1") > 180 for x in copies for y in copies if x != y)
    fps = [np.frombuffer(v.to_bytes(128, "little"), np.uint64).astype(">u8").tobytes() for v in [*copies, original]]
    classes = spark.createDataFrame([(i, bytearray(fp)) for i, fp in enumerate(fps)], "node long, fp binary")
    links = {tuple(r) for r in simhash.class_links(classes, 16, 180, 18, 32).collect()}
    assert links == {(i, size) for i in range(size)}


def test_a_stranger_in_a_bucket_costs_no_link(spark):
    """Near copies of one another in one bucket with a stranger whose first 128 bits are theirs and whose node is the smallest."""
    rnd = random.Random(2)
    base = rnd.getrandbits(1024)
    copies = [base ^ sum(1 << b for b in rnd.sample(range(128, 1024), 40)) for _ in range(24)]
    stranger = (base & ((1 << 128) - 1)) | (rnd.getrandbits(896) << 128)
    fps = [np.frombuffer(v.to_bytes(128, "little"), np.uint64).astype(">u8").tobytes() for v in [stranger, *copies]]
    classes = spark.createDataFrame([(i, bytearray(fp)) for i, fp in enumerate(fps)], "node long, fp binary")
    groups = dict(components(simhash.class_links(classes, 16, 180, 18, 32)).collect())
    assert groups == {i: 1 for i in range(1, 25)}


def test_parts_of_large_buckets_meet(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SPOTTED", 1)
    rnd = random.Random(5)
    base = rnd.getrandbits(64)
    fps = sorted({base ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 9))) for _ in range(300)})
    classes = spark.createDataFrame([(i, bytearray(v.to_bytes(8, "big"))) for i, v in enumerate(fps)], "node long, fp binary")
    whole = dict(components(simhash.class_links(classes, 1, 3, 0, 0)).collect())
    monkeypatch.setattr(simhash, "TILE", 16)
    assert dict(components(simhash.class_links(classes, 1, 3, 0, 0)).collect()) == whole
    want = brute_groups(fps, 3)
    assert all(whole.get(i, i) == want[i] for i in range(len(fps)))


def test_blocks_widen_with_the_number_of_classes():
    assert simhash.bands(1000, 16, 180, 18) == simhash.bands(1 << 20, 16, 180, 18) == (18, 56)
    for n in (1 << 24, 1 << 30):
        wide, many = simhash.bands(n, 16, 180, 18)
        assert n / 2**wide <= simhash.STRANGERS and 1 - (1 - 0.85**wide) ** many >= 0.95
    r = np.random.default_rng(1)
    fps = r.integers(0, 1 << 63, (50, 16), dtype=np.uint64)
    keys = simhash.block_keys(fps, 180, 26, 200)
    assert len(keys) == 200 and len({int(k[0]) >> 26 for k in keys}) == 200
    other = np.packbits(np.unpackbits(fps.view(np.uint8).reshape(50, -1), axis=1) ^ (r.random((50, 1024)) < 0.15), axis=1).view(np.uint64)
    met = np.any([a == b for a, b in zip(keys, simhash.block_keys(other, 180, 26, 200))], axis=0)
    assert met.mean() > 0.85


def test_recall_of_pairs_from_the_similarity_on(spark):
    """Of all pairs of documents that share 0.8 of their shingles, at least nine in ten share a group, and every group comes from such pairs or chains of them."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5, 42).tolist()) for t in texts]
    by = {}
    for i, s in enumerate(sets):
        for h in s:
            by.setdefault(h, []).append(i)
    pairs = {(i, j) for own in by.values() if len(own) < 500 for i in own for j in own if i < j}
    close = {(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    low = list(range(len(texts)))
    for _ in range(50):
        for i, j in close:
            low[i] = low[j] = min(low[i], low[j])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in simhash.survivors(docs, **simhash.STAGE).select("doc_id").collect()}
    groups = {low[i] for i in range(len(texts))}
    gone = len(texts) - len(groups)
    assert {low[i] for i in kept} == groups  # each group keeps one at least
    assert gone > 20 and len(texts) - len(kept) >= 0.9 * gone


def test_ids_of_any_type(spark):
    docs = spark.createDataFrame([("b", "x y z"), ("a", "x y z"), (None, "q")], "doc_id string, text string")
    assert sorted(str(r.component_id) for r in simhash.near_groups(docs).collect()) == ["None", "a", "a"]
    assert sorted(str(r.doc_id) for r in simhash.survivors(docs).collect()) == ["None", "a"]


def test_survivors_below_the_similarity_stay(spark):
    rnd = random.Random(3)
    one = lambda text: np.frombuffer(simhash.fingerprint(text.encode(), 5, 16, 42), ">u8").astype(np.uint64).reshape(1, -1)
    texts = ["x " * 400 + " ".join(f"g{g}w{i}" for i in range(40)) for g in range(40)]  # one shingle has the majority: equal fingerprints
    while len(texts) < 46:
        base = [f"w{rnd.randrange(5000)}" for _ in range(200)]
        other = list(base)
        for k in range(20, 200, 30):  # six changed words: 166 of 226 shingles are common, 0.73
            other[k] = f"n{rnd.randrange(5000)}"
        x, y = one(" ".join(base)), one(" ".join(other))
        if np.bitwise_count(x ^ y).sum() <= 180 and any(a[0] == b[0] for a, b in zip(simhash.block_keys(x, 180, 18), simhash.block_keys(y, 180, 18))):
            texts += [" ".join(base), " ".join(other)]
    out = simhash.survivors(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **simhash.STAGE)
    assert sorted(r.doc_id for r in out.collect()) == list(range(46))


@pytest.mark.parametrize("n", [1, 2, 57])
def test_components_of_chains_and_stars(spark, n):
    links = [(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n + 1)] + [(5000, 5000), (None, 3)]
    out = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {k: v for k, v in out.items() if k < 1000} == {i: 0 for i in range(n + 1)}
    assert {k: v for k, v in out.items() if k >= 1000} == {1000 + i: 1000 for i in range(n + 1)}


def test_hubs_are_dealt_out(spark, monkeypatch):
    from millrace.llm import components as module

    monkeypatch.setattr(module, "LEAST", 5)
    links = [(500, i) for i in range(200)] + [(i, 600 + i) for i in range(100)] + [(900, 901), (901, 902)] + [(1000 + i, 2000) for i in range(50)]
    out = dict(components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {v for k, v in out.items() if k < 900} == {0} and {out[900], out[902]} == {900} and {v for k, v in out.items() if k >= 1000} == {1000}
    assert len(out) == 301 + 3 + 51


def test_no_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
