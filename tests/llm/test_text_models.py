import collections
import math
import os
import random
import re
import struct
import subprocess
import sys
import zlib

import numpy as np
import pytest
import sentencepiece
import xxhash

from millrace.llm import lm, pieces, toxicity
from millrace.llm.queries import PIECE_MODEL

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def model():
    with open(PIECE_MODEL, "rb") as f:
        return f.read()


ODD = ["", " ", "  two  spaces  ", "\n\n a\tb\r\n", "<s> hi </s> <unk>", "日本語 テキスト 😀😀", "▁▁ a▁b ▁", "é̀ \x00 x", "a" * 300, "<0x41>", "a  " * 50, "word " * 20_000]


def test_parity_with_the_library(spark, sf, model):
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    assert pieces.verify(model, texts) == []


def unigram_model():
    """A small unigram model file: words of a corpus and all bytes, without normalisation rules but the library's own."""

    def field(n, kind, data):
        return bytes([n << 3 | kind]) + data

    def varint(v):
        out = b""
        while v > 127:
            out, v = out + bytes([v & 127 | 128]), v >> 7
        return out + bytes([v])

    def message(n, data):
        return field(n, 2, varint(len(data)) + data)

    def piece(text, score, kind=1):
        return message(1, message(1, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, varint(kind)))

    out = piece("<unk>", 0, 2) + piece("<s>", 0, 3) + piece("</s>", 0, 3) + b"".join(piece(f"<0x{i:02X}>", 0, 6) for i in range(256))
    for i, p in enumerate(["▁", "▁the", "▁th", "e", "t", "h", "a", "b", "c", "ab", "abc", "▁ab", "bc", "cat", "▁cat", "s", "o", "n"]):
        out += piece(p, -1.5 - 0.37 * i)
    trainer = field(3, 0, varint(1)) + b"".join(varint(n << 3) + varint(v) for n, v in ((35, 1), (40, 0), (41, 1), (42, 2)))
    normaliser = message(1, b"identity") + field(3, 0, varint(1)) + field(4, 0, varint(1)) + field(5, 0, varint(1))
    return out + message(2, trainer) + message(3, normaliser)


def test_unigram_scores_and_byte_fallback():
    data = unigram_model()
    rnd = random.Random(1)
    texts = ["", "the cat", "  the  abc ", "xyz é 😀", "abcabc catthe"] + ["".join(rnd.choice("the catsbon é") for _ in range(rnd.randint(0, 40))) for _ in range(200)]
    assert pieces.verify(data, texts) == []


def test_unigram_parity_with_all_pieces_of_a_model(spark, model):
    """The pieces of the model file as a unigram model whose scores tie nowhere, on documents."""
    trainer = next(v for f, v in pieces._fields(model) if f == 2)
    data = model.replace(trainer, trainer.replace(b"\x18\x02", b"\x18\x01", 1), 1)  # field 3, the kind of model: 2 is BPE, 1 unigram
    rnd = random.Random(1)
    for i, (_, v) in enumerate(x for x in pieces._fields(model) if x[0] == 1):
        if dict(pieces._fields(v)).get(3, 1) == pieces.NORMAL:
            old = b"\x15" + dict(pieces._fields(v))[2]  # field 2, the score
            assert v.count(old) == 1
            data = data.replace(v, v.replace(old, b"\x15" + struct.pack("<f", -4 - math.log1p(i) - rnd.random())), 1)
    assert not pieces.parse(data).bpe and len(pieces.parse(data).pieces) == 32_000
    texts = ODD[:-2] + [r.text[:3000] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect() if r.text]
    assert pieces.verify(data, texts) == []
    ours, theirs = pieces.Pieces(data).encode(texts), sentencepiece.SentencePieceProcessor(model_proto=data).encode(texts)
    assert sum(x != y for x, y in zip(ours, theirs)) < 4  # "%%" "%" and "%" "%%" have equal sums
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    out = pieces.encode(docs, data, threads=3, verified=1)
    assert pieces.decode(out, data).where("decoded = text").count() >= len(texts) - 4


def test_threads_change_nothing_and_differences_stop(spark, sf, model, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    one, many = (sorted(map(str, pieces.encode(docs, model, threads=n, verified=7).collect())) for n in (1, 4))
    assert one == many
    monkeypatch.setattr(pieces, "verify", lambda data, texts, *more: [0])
    with pytest.raises(Exception, match="not what the sentencepiece library gives"):
        pieces.encode(docs, model, verified=7).count()


def test_encode_and_decode_tables(spark, model):
    rows = [(i, t, 5) for i, t in enumerate(ODD)] + [(None, None, 5), (0, "", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    out = pieces.encode(docs, model)
    got = out.collect()
    assert out.columns == ["doc_id", "text", "token_ids", "n_tokens", "is_lossless"] and len(got) == len(rows)
    for r in got:
        assert (r.token_ids is None) == (r.text is None) and r.n_tokens == len(r.token_ids or [])
        if r.text is not None and "▁" not in r.text:
            assert r.is_lossless
    back = pieces.decode(out, model).collect()
    assert all(r.decoded == r.text for r in back if r.text is None or "▁" not in r.text)
    assert pieces.encode(docs.limit(0), model).count() == 0


def test_words_are_encoded_as_in_texts(model):
    import pyarrow as pa

    own = pieces.Pieces(model)
    words = ["the", "a▁b", "▁", "日本", "x" * 300, "é\x00", "straße,", "<s>", "\U0001f600"] + [f"w{i}" for i in range(600)]
    for some in (words, words[:1], [w for w in words if "▁" not in w]):
        flat, n = own.encode_words(pa.array(some))
        got = np.split(flat, np.cumsum(n)[:-1])
        assert [x.tolist() for x in got] == [np.frombuffer(own.word_ids([w])[0], np.int32).tolist() for w in some]
    bad = pa.array([b"ok", b"\xff\xfe"], pa.binary()).view(pa.string())
    assert len(own.encode_words(bad)[1]) == 2
    assert len(own.encode_words(pa.array([], pa.string()))[1]) == 0


def brute_lm(rows):
    tokens = [WORD.findall((t or "").translate(LOWER)) + [None] for _, t in rows]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, _ in rows]
    c = collections.Counter()
    for t, h in zip(tokens, held):
        if not h:
            c.update(t)
    n, v = sum(c.values()), len(c)
    return [(i, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)) for (i, _), t, h in zip(rows, tokens, held)]


def test_base_scores_match_brute_force(spark, sf, model, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_BYTES", 20_000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(80).collect()]
    rows += [(10_001, None), (10_002, ""), (None, "The the É x"), (5, "THE the"), (10_003, "z " * 30_000), (10_004, "never seen ▁ words▁ \x00")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, score int")
    out = lm.score(docs, model).collect()
    key = lambda r: (str(r[0]), r[2], round(r[5], 6))
    got, want = sorted((tuple(r)[:6] for r in out), key=key), sorted(brute_lm(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(math.isfinite(r.score) and r.score < 0 for r in out)
    assert lm.score(docs.limit(0), model).count() == 0


def brute_score(text, words_known, n, v, m, end_id, encoder):
    """log10 probability of a text, id by id: a mixture of word counts and of the product of the word's ids under attention."""
    w, at = {}, 0
    for k, s in lm.Attention.SHAPES.items():
        w[k] = m["flat"][at : at + math.prod(s)].astype(float).reshape(s)
        at += math.prod(s)
    own_words = WORD.findall(text.translate(LOWER))
    ids, word_of = [], []
    for i, x in enumerate([*own_words, None]):
        for piece in encoder(x) if x is not None else [end_id]:
            ids.append(piece)
            word_of.append(i)
    numbers = [0] * (lm.WINDOW - lm.STRIDE + 1) + [int(m["number"][i]) for i in ids]
    each = [0.0] * (len(own_words) + 1)
    for t, i in enumerate(ids):
        start = t // lm.STRIDE * lm.STRIDE  # the window's first input, in ``numbers``
        seen = numbers[start : start + lm.WINDOW - lm.STRIDE + t % lm.STRIDE + 1]
        x = np.stack([w["embed"][g] + w["place"][j] for j, g in enumerate(seen)])
        q = np.clip(x[-1] @ w["query"] / math.sqrt(lm.WIDTH), -lm.REACH, lm.REACH)
        a = np.exp(np.clip(x @ w["key"], -lm.REACH, lm.REACH) @ q)
        h = x[-1] + (a / a.sum()) @ (x @ w["value"])
        up, low = divmod(int(m["place"][i]), lm.SIDE)
        first = m["first"][seen[-1]] + h @ w["first"]
        second = m["second"][seen[-1] * lm.SIDE + up] + h @ w["second"][up]
        each[word_of[t]] += first[up] - math.log(np.exp(first).sum()) + second[low] - math.log(np.exp(second).sum()) + m["own"][i]
    total = 0.0
    for x, own in zip([*own_words, None], each):
        c = words_known.get(x, 0)
        total += np.logaddexp(math.log(lm.WORDS * (c - lm.DISCOUNT) / n) if c else -np.inf, math.log(1 - lm.WORDS + lm.WORDS * lm.DISCOUNT * v / n) + own)
    return total / math.log(10)


def test_scores_match_brute_force(spark, sf, model, monkeypatch):
    kept, train = [], lm.train_model
    monkeypatch.setattr(lm, "train_model", lambda *a: kept.append(train(*a)) or kept[-1])
    monkeypatch.setattr(lm, "CHUNK_BYTES", 30_000)
    rows = [(r.doc_id, (r.text or "")[:1500]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()] + [(10_001, ""), (10_002, "A ▁ b\x00 日本 😀 " * 9)]
    out = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    known = collections.Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            known.update([*WORD.findall(t.translate(LOWER)), None])
    own = pieces.Pieces(model)
    encoder = lambda x: np.frombuffer(own.word_ids([x])[0], np.int32).tolist() or [own.model.unk]
    for i, t in [*rows[:12], *rows[-2:]]:
        assert out[i].score == pytest.approx(brute_score(t, known, sum(known.values()), len(known), kept[0], 2, encoder), rel=2e-4), i


@pytest.mark.parametrize("size", ["sf0.01", "sf0.1"])
def test_model_beats_the_base_on_held_out_documents(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet")
    with open(PIECE_MODEL, "rb") as f:
        out = lm.score(docs, f.read()).where("held_out").selectExpr("sum(score) / sum(n_tokens) as model", "sum(base_score) / sum(n_tokens) as base").first()
    assert out.model > out.base


def test_scores_of_any_ids(spark, model):
    rows = [("a", "one two three"), ("b", "one two"), ("a", "one two three"), (None, "four"), ("c", None)]
    out = lm.score(spark.createDataFrame(rows, "doc_id string, text string"), model).collect()
    assert sorted(r.doc_id or "" for r in out) == ["", "a", "a", "b", "c"] and out[0].held_out in (True, False)
    assert {r.doc_id: r.held_out for r in out} == {i: zlib.crc32((i or "").encode()) % 7 == 2 for i, _ in rows}


def test_workers_need_no_package(sf, tmp_path):
    """Executors whose Python can't import the package run the query all the same."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
from millrace.llm import lm
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = s.read.parquet({sf!r} + "/documents.parquet").limit(50)
print("ROWS", lm.score(docs, open({PIECE_MODEL!r}, "rb").read()).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS 50" in done.stdout, done.stderr[-3000:]


def test_windows_score_each_id_once():
    r = np.random.default_rng(1)
    for lengths in ([1], [2, lm.STRIDE, 1, lm.STRIDE + 1, 100], r.integers(1, 200, 30).tolist()):
        docs = [[*r.integers(1, 1000, n - 1).tolist(), 0] for n in lengths]  # the last is the end
        layout = lm.Layout(np.array(lengths))
        inputs, target = layout.windows(np.concatenate(docs), np.concatenate(docs) + 1)
        assert len(inputs) == sum(-(-n // lm.STRIDE) for n in lengths)
        assert target.ravel()[layout.targets].tolist() == [i + 1 for d in docs for i in d]
        w = 0
        for d in docs:
            before = [0] * (lm.WINDOW - lm.STRIDE + 1) + d[:-1]
            for at in range(0, len(d), lm.STRIDE):
                some = before[at : at + lm.WINDOW]
                assert inputs[w][: len(some)].tolist() == some
                w += 1


def test_a_stream_trains_each_id_once():
    for n in (0, 1, lm.WINDOW, 3 * lm.WINDOW + 5):
        ids = np.arange(1, n + 1)
        inputs, target, counted = lm.stream(ids, ids)
        parts = [[x[i :: lm.ROUNDS] for x in (inputs, target, counted)] for i in range(lm.ROUNDS)]
        assert sorted(np.concatenate([t[c] for _, t, c in parts]).tolist()) == ids.tolist()
        assert inputs[counted].tolist() == [0, *ids[:-1]][:n]


def test_words_of_a_chunk():
    import pyarrow as pa

    texts = [None, "", " The  the\x0bTHE\n", "É é\xa0x", "a\tb\x0cc\rd", "\x1cz \u2003 y"]
    word, at, sizes = lm._numbered_words([pa.array(texts[:2], pa.string()), pa.array(texts[2:], pa.string())])
    own = word.to_pylist()
    want = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and [own[i] for i in at.tolist()] == [x for w in want for x in w]
    data, length = lm._bytes_of(word)
    h = lm._word_hash(data, length)
    assert len(h) == len(own) and h.min() >= 0 and h.max() < 1 << 24 and lm._word_hash(data[: length[0]], length[:1])[0] == h[0]
    for kind in (np.int32, np.int64):
        x = np.array([0, 1, 255, 256, 70_000, 2**31 - 1], kind)
        assert lm._from_planes(lm._planes(x), kind).tolist() == x.tolist()


def small_net(kind=np.float32):
    r = np.random.default_rng(1)
    after = np.zeros((lm.GROUPS, lm.GROUPS))
    after[:40, :90] = r.integers(0, 9, (40, 90))
    return lm.Attention(*lm.bigram(after), kind=kind), r.integers(0, 40, (3, lm.WINDOW)), r.integers(0, 90, (3, lm.STRIDE))


def test_attention_is_causal_and_its_gradient_right():
    net, inputs, target = small_net()
    counted = np.ones(target.shape, bool)
    before = net.log_likelihood(inputs, target)
    changed = inputs.copy()
    changed[:, -1] = (changed[:, -1] + 1) % 40
    assert np.allclose(net.log_likelihood(changed, target)[:, :-1], before[:, :-1], atol=1e-5)
    total = sum(np.exp(net.log_likelihood(inputs, np.full_like(target, k))) for k in range(lm.GROUPS))
    assert np.allclose(total, 1, atol=1e-3)
    net, *_ = small_net(np.float64)
    g, at = net.gradient(inputs, target, counted), 0
    output = net.gradient(inputs, target, counted, whole=False)
    assert np.allclose(output, g[-len(output) :])
    for name, w in net.w.items():
        for i in {0, w.size // 2, w.size - 1, int(np.argmax(np.abs(g[at : at + w.size])))}:
            keep = net.flat[at + i]
            net.flat[at + i] = keep + 1e-4
            up = -net.log_likelihood(inputs, target).mean()
            net.flat[at + i] = keep - 1e-4
            down = -net.log_likelihood(inputs, target).mean()
            net.flat[at + i] = keep
            assert abs((up - down) / 2e-4 - g[at + i]) < 1e-6, name
        at += w.size
    assert at == len(g)


def test_training_learns_a_pattern():
    net, *_ = small_net()
    ids = np.tile([1, 2, 3, 3, 2], 20_000)
    inputs, target, counted = lm.stream(ids, ids)
    before = net.log_likelihood(inputs, target).mean()
    parts = [[x[at : at + 700] for x in (inputs, target, counted)] for at in range(0, len(inputs), 700)]
    assert net.train(parts, len(inputs)) == len(ids)
    assert net.log_likelihood(inputs, target).mean() > before + 0.8


def labelled(n, seed):
    rnd = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, low = rnd.random() < 0.2, rnd.random() < 0.3
        own = [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(5, 80))]
        if toxic:
            own += rnd.sample(["idiot", "Moron,", "SCUM", "trash!"], 2)
        if low:
            own += ["$$$", "%%%"]
        rnd.shuffle(own)
        rows.append((i, " ".join(own)))
        labels.append((i, int(not low), int(toxic)))
    return rows, labels


def test_chain_holds_out_well(spark):
    rows, labels = labelled(900, 1)
    docs = spark.createDataFrame(rows + [(5000, None), (5001, "")], "doc_id long, text string")
    known = spark.createDataFrame(labels[:600] + [(5000, None, 1), (None, 1, 1), (7777, 1, 1)], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, known, toxicity.standard_categories())
    assert chain.categories == ("low_quality", "toxic") and len(chain.weights[1]) == len(chain.vocabulary) + 2
    out = {r.doc_id: r for r in toxicity.score(docs, chain).collect()}
    assert len(out) == 902
    right = [((out[i].p_toxic >= 0.5) == bool(t), (out[i].p_low_quality >= 0.5) != bool(q)) for i, q, t in labels[600:]]
    assert np.mean([r[0] for r in right]) > 0.98 and np.mean([r[1] for r in right]) > 0.98
    assert out[5000].p_toxic < 0.5 and out[5001].p_toxic == out[5000].p_toxic
    kept = toxicity.accepted(docs.withColumnRenamed("doc_id", "p_toxic"), chain)
    assert kept.columns == ["p_toxic", "text"] and kept.count() == sum(r.p_toxic < 0.5 for r in out.values())


def brute_chain(rows, labels, least=toxicity.EVIDENCE, folds=3):
    """Probabilities of all rows by a chain fitted on the labelled ones, with dense matrices and every selection made anew."""

    def held(text):
        raw = {w.encode() for w in WORD.findall((text or "").translate(LOWER))}
        own = {w.strip(toxicity.PUNCTUATION) for w in raw}
        return raw | own | {w[:6] + b"*" for w in own if len(w) > 6}

    of = dict(rows)
    known = [(i, 1 - q, t) for i, q, t in labels if i in of]
    fold = [xxhash.xxh64_intdigest(of[i].encode(), 42) for i, *_ in known]
    fold = np.array([(f - (1 << 64) if f >> 63 else f) % folds for f in fold])
    texts = [held(of[i]) for i, *_ in known]
    y_all = np.array([k[1:] for k in known], float)

    def selected(inside, k):
        out = []
        n, rate = inside.sum(), y_all[inside, k].mean()
        for w in sorted(set().union(*texts)):
            have = np.array([w in t for t in texts]) & inside
            m, pos = have.sum(), y_all[have, k].sum()
            score = sum(2 * x * math.log(x / (m * share)) for x, share in ((pos, rate), (m - pos, 1 - rate)) if x)
            if n and m and score >= least:
                out.append(w)
        return out

    def fit(inside, k, earlier):
        chosen = selected(inside, k)
        design = np.array([[w in t for w in chosen] for t in texts], float).reshape(len(texts), len(chosen))
        design = np.c_[design, earlier][inside]
        y = y_all[inside, k]
        w, b = np.zeros(design.shape[1]), math.log((y.sum() + 0.5) / (len(y) + 1.5 - y.sum()))
        moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
        for step in range(1, 101):
            r = 1 / (1 + np.exp(-(design @ w + b))) - y
            g = np.append(design.T @ r / len(y) + 3e-4 * w, r.mean())
            moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
            move = 0.15 * (1 - 0.009 * step) * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
            w, b = w - move[:-1], b - move[-1]
        return chosen, w, b

    def predicted(model, some, earlier):
        chosen, w, b = model
        x = np.array([[v in t for v in chosen] for t in some], float).reshape(len(some), len(chosen))
        return 1 / (1 + np.exp(-(np.c_[x, earlier] @ w + b)))

    every, asked = np.ones(len(known), bool), [held(t) for _, t in rows]
    first = fit(every, 0, np.zeros((len(known), 0)))
    unseen = np.zeros((len(known), 1))
    for f in range(folds):
        left = fold == f
        unseen[left, 0] = predicted(fit(~left, 0, np.zeros((len(known), 0))), [t for t, x in zip(texts, left) if x], np.zeros((left.sum(), 0)))
    p = predicted(first, asked, np.zeros((len(asked), 0)))
    return np.c_[p, predicted(fit(every, 1, unseen), asked, p[:, None])]


def test_chain_matches_brute_force(spark):
    rows, labels = labelled(240, 5)
    rows = [(i, t if i % 9 else rows[0][1] + " extra") for i, t in rows]
    docs = spark.createDataFrame([*rows, rows[3], rows[3]], "doc_id long, text string")  # repeated rows count once
    chain = toxicity.train(docs, spark.createDataFrame([*labels[:200], labels[3]], "doc_id long, quality int, toxic int"), toxicity.standard_categories())
    out = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in toxicity.score(docs, chain).collect()}
    want = brute_chain(rows, labels[:200])
    assert np.allclose([out[i] for i, _ in rows], want, atol=1e-6)


def test_repeated_ids_stay_within_the_bound(spark):
    rows, labels = labelled(40, 2)
    docs = spark.createDataFrame([(i % 4, t + " " + "long " * 40_000 * (i == 1)) for i, t in rows] + [(None, "x"), (None, "x")], "doc_id long, text string")
    known = spark.createDataFrame(labels[:4], "doc_id long, quality int, toxic int")
    fitted, kept = [], toxicity.fit_chain
    try:
        toxicity.fit_chain = lambda own, *a, **k: fitted.append(len(own)) or kept(own, *a, **k)
        chain = toxicity.train(docs, known, toxicity.standard_categories(), max_rows=15)
    finally:
        toxicity.fit_chain = kept
    assert fitted == [15] and toxicity.score(docs, chain).count() == 42
    assert toxicity.accepted(docs.withColumnRenamed("text", "body"), chain, "body").columns == ["doc_id", "body"]


def test_chain_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.train(docs, none, toxicity.standard_categories())
    assert {r.p_toxic for r in toxicity.score(docs, chain).collect()} == {0.25}
    one = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.accepted(docs, toxicity.train(docs, one, toxicity.standard_categories())).count() == 2
