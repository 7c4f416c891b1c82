import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import ego, topk

NAN, INF = float("nan"), float("inf")


def make_vectors(n=300, d=8, seed=1):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        kind = i % 10
        base = r.standard_normal(d) if kind < 4 or not rows else np.array(rows[r.integers(len(rows))][1])
        noise = 0 if kind in (4, 5) else 0.06
        rows.append((i, [float(np.float32(x)) for x in base + noise * r.standard_normal(d)], int(r.integers(3)) if kind < 8 else None if kind == 9 and i % 3 == 0 else 1))
    return rows


ODD = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 8, 1), (1003, [NAN] * 8, 1), (1004, [INF, *[1.0] * 7], 1), (1005, [None, *[1.0] * 7], 1), (1006, [1.0] * 8, None), (1007, [1.0] * 8, 1), (1008, [2.0] * 8, 1), (1009, [1.0] * 4, 1), (1010, [-0.0, *[1.0] * 7], 2), (1011, [0.0, *[1.0] * 7], 2), (1007, [1.0] * 8, 1)]


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def brute_links(rows, least=0.98):
    n, links = len(rows), {}
    for i in range(n):
        links[i] = []
        for j in range(n):
            (_, a, p), (_, b, q) = rows[i], rows[j]
            if i != j and p is not None and p == q and usable(a) and usable(b) and len(a) == len(b) and any(a) and any(b):
                x, y = np.array(a, float), np.array(b, float)
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    links[i].append(j)
    low = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            m = min([low[i], *(low[j] for j in links[i])])
            if m != low[i]:
                low[i], changed = m, True
    return [(rows[i][0], len(links[i]), low[i], rows[i][0] == low[i]) for i in range(n)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_near_vectors_match_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(ego, "LEAF", 4)
    monkeypatch.setattr(ego, "BLOCK_BYTES", 512)
    rows = make_vectors() + ODD
    df = spark.createDataFrame([(*r, "x") for r in rows], f"vec_id long, embedding array<{kind}>, label int, n_links string")
    out = sorted(tuple(r) for r in ego.near_vectors(df).collect())
    want = sorted(brute_links(rows))
    assert out == want
    assert sum(w[1] > 0 for w in want) > 50


def test_block_pairs_match_brute_force_and_grow_in_proportion(spark, monkeypatch):
    monkeypatch.setattr(ego, "FAN", 4)
    r, counts = np.random.default_rng(4), []
    for n in (60, 240):
        lo = np.c_[np.arange(n) * 0.1, r.random((n, 2))]
        hi = lo + [0.1, 0.3, 0.3]
        rows = [(7 * i + (i // 50 << 33), i % 2, 8, lo[i].tolist(), hi[i].tolist()) for i in range(n)]
        out = {tuple(x) for x in ego.block_pairs(spark.createDataFrame(rows, "block long, label int, dims int, lo array<double>, hi array<double>"), 3, 0.2).collect()}
        gap = lambda i, j: sum(max(0, lo[j][k] - hi[i][k], lo[i][k] - hi[j][k]) ** 2 for k in range(3))
        assert out == {(rows[i][0], rows[j][0]) for i in range(n) for j in range(i, n) if i % 2 == j % 2 and gap(i, j) <= 0.04}
        counts.append(len(out))
    assert counts[1] < 5 * counts[0]
    assert ego.block_pairs(spark.createDataFrame([], "block long, label int, dims int, lo array<double>, hi array<double>"), 3, 0.2).count() == 0


def test_vectors_longer_than_are_fitted_and_ids_of_any_type(spark, monkeypatch):
    monkeypatch.setattr(ego, "FITTED", 3)
    monkeypatch.setattr(ego, "LENGTHS", 1)
    rows = [(f"v{i:03}", v, label) for i, v, label in make_vectors(120)] + [(f"x{i}", [1.0, 2.0 + i / 100], 1) for i in range(4)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, label int")
    assert sorted(map(str, (tuple(r) for r in ego.near_vectors(df).collect()))) == sorted(map(str, brute_links(rows)))


def test_near_vectors_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ego.near_vectors(df).count() == 0
    only = spark.createDataFrame([(1, None, 1), (None, [1.0], 1), (None, [2.0], 1)], "vec_id long, embedding array<float>, label int")
    assert sorted(map(str, ego.near_vectors(only).collect())) == sorted(["Row(vec_id=1, n_links=0, component_id=1, kept=True)", "Row(vec_id=None, n_links=1, component_id=None, kept=False)", "Row(vec_id=None, n_links=1, component_id=None, kept=False)"])


def test_one_large_group_of_copies(spark):
    r = np.random.default_rng(3)
    same, near = [float(np.float32(x)) for x in r.standard_normal(8)], None
    near = [x + 1e-3 for x in same]
    rows = [(i, same, 1) for i in range(400)] + [(500 + i, near, 1) for i in range(100)] + [(900, same, 2)]
    out = {r.vec_id: r for r in ego.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert {out[i].n_links for i in range(400)} == {499} and {out[500 + i].n_links for i in range(100)} == {499}
    assert {r.component_id for i, r in out.items() if i != 900} == {0} and out[900].n_links == 0


def brute_top(rows, k=10):
    from fractions import Fraction

    able = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if usable(v)]
    out = []
    for n, (q, a) in enumerate(able):
        if q is not None and q % 100 == 0:
            scored = sorted(((-sum(x * y for x, y in zip(a, b)), i is None, i) for m, (i, b) in enumerate(able) if m != n and len(a) == len(b)), key=lambda s: (s[0], s[1], s[2] or 0))
            out += [(q, r + 1, i, -s) for r, (s, _, i) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_matches_brute_force(spark, kind, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_BYTES", 2000)
    monkeypatch.setattr(topk, "QUERY_BYTES", 100)
    rnd = random.Random(1)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(8)]) for i in range(500)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(60)] + [(r[0] + 1000, r[1]) for r in ODD] + [(None, [1.0] * 8), (3000, [3e7] * 8), (3001, [-3e7] * 8)]
    df = spark.createDataFrame([(*r, 5) for r in rows], f"vec_id long, embedding array<{kind}>, score int")
    out = sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()), key=str)
    assert out == brute_top(rows)


def test_top_k_of_repeated_ids(spark):
    rnd = random.Random(2)
    rows = [(100, [rnd.gauss(0, 1) for _ in range(4)]) for _ in range(2)] + [(i % 9, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(24)] + [(None, [9.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = sorted((tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()), key=str)
    assert out == brute_top(rows)
    assert sum(r[0] == 100 for r in out) == 20


def test_bounds_leave_few_pairs_to_multiply():
    """On the vectors of the test tables and on ones with a falling spectrum."""
    import pyarrow.parquet as pq

    own = [v for v in pq.read_table("/root/testdata/sf0.1/embeddings.parquet")["embedding"].to_pylist() if usable(v)]
    r = np.random.default_rng(1)
    for x, share in ((np.array(own, float), 0.15), (r.standard_normal((4000, 64)) * 0.93 ** np.arange(64) @ np.linalg.qr(r.standard_normal((64, 64)))[0], 0.05)):
        x = np.floor(1024 * x)
        turn, n = topk.rotation(x[: topk.SEEDS]), np.arange(len(x))
        queries = topk.Rows(n[::100], n[::100], x[::100], turn)
        best = topk.Best(10, np.full(len(queries.uid), -np.inf), [[] for _ in queries.uid])
        for at in range(0, len(x), 1000):
            topk.search(queries, topk.Rows(n[at : at + 1000], n[at : at + 1000], x[at : at + 1000], turn), best)
        assert best.multiplied <= share * best.pairs
        scores = x[::100] @ x.T
        scores[np.arange(len(scores)), n[::100]] = -np.inf
        assert [[s for s, _ in f] for f in best.found] == np.sort(scores, 1)[:, : -11 : -1].tolist()


def test_top_k_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, -2.0]), (2, None)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_k(df, F.col("vec_id") % 100 == 0).collect()] == [(0, 1, 1, 1024 * 1024 * -3)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_segment_bounds_hold():
    r = np.random.default_rng(2)
    x, q = r.standard_normal((200, 19)) * 100, r.standard_normal((30, 19)) * 100
    for s in (1, 4, 16, 64):
        assert (topk.statistics(q, s) @ topk.statistics(x, s).T >= q @ x.T - 1e-6).all()
