import random

import pytest

from millrace.llm import mixing


def brute_seats(votes, caps, seats):
    out = [0] * len(votes)
    for _ in range(seats):
        best = [i for i in range(len(votes)) if votes[i] > 0 and out[i] < caps[i]]
        if not best:
            break
        i = max(best, key=lambda i: (votes[i] / (2 * out[i] + 1), -i))
        out[i] += 1
    return out


def test_seats_match_one_by_one_allocation():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(0, 8)
        votes = [rnd.choice([0, rnd.randint(1, 50), rnd.random() * 1000]) for _ in range(n)]
        caps = [rnd.randint(0, 40) for _ in range(n)]
        seats = rnd.randint(0, 120)
        assert mixing.sainte_lague(votes, caps, seats) == brute_seats(votes, caps, seats)


def test_targets_share_the_excess():
    got = mixing.targets([10, 100, 0, 100], [3, 1, 2, 3])
    assert got[0] == 20 and got[2] == 0 and sum(got) == pytest.approx(1.5 * 210)
    assert got[1] == pytest.approx(95) and got[3] == 200
    assert mixing.targets([], []) == [] and mixing.targets([0], [3]) == [0.0]


def make_docs(seed=2, n=600):
    rnd = random.Random(seed)
    rows = [(i, " ".join("w" * rnd.randint(1, 4) for _ in range(rnd.randint(0, 60))), rnd.choice(["a", "b", "B", "é", None, "a", "a"])) for i in range(n)]
    return rows + [(None, "x y z", "a"), (5, rows[5][1], rows[5][2]), (n + 1, None, "a"), (n + 2, "", "empty"), (n + 3, "z " * 5000, "b"), (n + 4, "one\ttwo\x0bthree é", "tiny")]


def test_mix_keeps_its_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 40)
    rows = make_docs()
    docs = spark.createDataFrame([(*r, 1.5) for r in rows], "doc_id long, text string, source string, target double")
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    import re

    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    assert sorted(r["size"] for r in out) == sorted(size)
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(k for k, r in zip(size, rows) if r[2] == s) for s in names]
    goal = dict(zip(names, mixing.targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(names))])))
    of = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(names, 0)
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["target"] == pytest.approx(goal[of[r["doc_id"]]] if r["doc_id"] is not None else goal["a"])
        taken[of[r["doc_id"]] if r["doc_id"] is not None else "a"] += r["taken"]
    for s in names:
        assert abs(taken[s] - goal[s]) <= 0.02 * goal[s] + 2 * mixing.BLOCK_WORDS
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_the_mix_of_documents_does_not_depend_on_their_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs = docs.union(docs.limit(40)).union(docs.limit(40))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(mixing.mixed_documents(docs)) == rows(mixing.mixed_documents(docs.repartition(7)))


def test_equal_and_null_ids_are_dealt_over_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_DOCS", 20)
    monkeypatch.setattr(mixing, "EQUAL_ROWS", 64)
    docs = spark.createDataFrame([(None, "one two three", "a")] * 300 + [(7, "x y", "a")] * 300 + [(8, "z " * 4, "b")] * 50, "doc_id long, text string, source string")
    out = mixing.mix(docs).collect()
    assert len(out) == 650 and len({r.taken for r in out if r.doc_id is None}) > 1
    for source, ids in (("a", {None, 7}), ("b", {8})):
        own = [r for r in out if r.doc_id in ids]
        assert abs(sum(r.taken for r in own) - own[0].target) <= len(own) // 20 * mixing.BLOCK_WORDS and all(r.taken <= 2 * r["size"] for r in own)
    whole = mixing.mixed_documents(docs).collect()
    assert {r.doc_id for r in whole} == {None, 7, 8} and 0.9 < sum(len(r.text.split()) for r in whole) / sum(r.taken for r in out) < 1.1


def test_mixed_documents_repeat_whole_rows(spark):
    rows = make_docs(3, 200)
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, n_chars int")
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    have = {tuple(r) for r in docs.collect()}
    got = [tuple(r) for r in out.collect()]
    assert set(got) <= have and 1.3 <= sum(len((t or "").split()) for _, t, _, _ in got) / sum(len((t or "").split()) for _, t, _ in rows) <= 1.7


def test_nothing_to_mix(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert {(r.doc_id, r.taken, r.target) for r in mixing.mix(blank).collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
