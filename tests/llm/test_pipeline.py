"""The pipeline against a brute-force version on documents with planted cases."""

import math
import random
import re
from collections import Counter

import sentencepiece
from test_mixing import brute_seats

import corpus_pipeline
from millrace.llm.mixing import BLOCK_WORDS
from millrace.llm.queries import PIECE_MODEL

TOXIC = ["idiot", "moron", "scum", "trash"]


def make(seed=1):
    """Rows, labels, and for each document what should become of it: None (toxic) or the number of its group of copies."""
    rnd = random.Random(seed)
    rows, labels, fate = [], [], {}

    def add(text, group):
        i = len(rows)
        source = rnd.choice(["a", "b", "c", None])
        rows.append((i, text, "en", source, len(text)))
        fate[i] = group
        if i % 2:
            labels.append((i, 1, int(group is None)))

    for g in range(260):
        own = [f"w{rnd.randrange(3000)}" for _ in range(rnd.randint(60, 300))]
        if g % 5 == 0:
            for w in rnd.sample(TOXIC, 3):
                own.insert(rnd.randrange(len(own)), w)
            add(" ".join(own), None)
            continue
        if g % 7 == 0:
            own.insert(3, "password=abcdef123456")
        add(" ".join(own), g)
        for _ in range(rnd.choice([0, 0, 1, 3])):
            other = list(own)
            if rnd.random() < 0.5:
                other[rnd.randrange(len(own))] = "changed"
            add(" ".join(other), g)
    return rows, labels, fate


def brute(rows, fate):
    kept = {}
    for i, text, lang, source, n in rows:
        if fate[i] is not None and fate[i] not in kept:
            kept[fate[i]] = (i, text, lang, source, n)
    kept = [(i, re.sub(r"password=[A-Za-z0-9]+", "[assign]", t), lang, s) for i, t, lang, s, _ in kept.values()]
    sources = sorted({r[3] for r in kept}, key=lambda s: (s is None, s or ""))
    size = {r[0]: len(r[1].split()) for r in kept}
    total = {s: sum(size[r[0]] for r in kept if r[3] == s) for s in sources}
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    target, rest, left = {}, 1.5 * sum(total.values()), list(sources)
    while left:
        w = sum(weight[s] for s in left)
        over = [s for s in left if rest * weight[s] / w > 2 * total[s]]
        if not over:
            target |= {s: rest * weight[s] / w for s in left}
            break
        for s in over:
            target[s] = 2.0 * total[s]
            rest -= target[s]
            left.remove(s)
    blocks = {s: math.ceil(total[s] / BLOCK_WORDS) for s in sources}
    seats = brute_seats([target[s] for s in sources], [2 * blocks[s] for s in sources], math.floor(1.5 * sum(total.values()) / BLOCK_WORDS + 0.5))
    return kept, size, dict(zip(sources, seats)), blocks


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, labels, fate = make()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    kept, size, seats, blocks = brute(rows, fate)
    theirs = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    want = {i: (t, lang, s, len(t), theirs.encode(t)) for i, t, lang, s in kept}
    copies = Counter(r.doc_id for r in out)
    assert {r.doc_id for r in out} <= set(want)
    for r in out:
        assert (r.text, r.lang, r.source, r.n_chars, r.token_ids) == want[r.doc_id] and r.is_lossless
    for s, q in seats.items():
        own = [i for i, *_, source in kept if source == s]
        passes, more = divmod(q, blocks[s])
        extra = [i for i in own if copies[i] != passes]
        assert all(copies[i] == passes + 1 for i in extra)
        taken = sum((copies[i] - passes) * size[i] for i in own)
        assert abs(taken - more * BLOCK_WORDS) <= max(size[i] for i in own) / 2 + BLOCK_WORDS


def test_stages_keep_columns_and_take_nothing(spark, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "sentencepiece"]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([], schema)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and docs.count() == 0
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0)], schema)
    for _, stage in corpus_pipeline.STAGES:
        odd = stage(spark, odd, str(tmp_path))
    assert odd.count() == 3
