"""Toxicity by a classifier chain.

Categories are predicted one after the other by linear models on the words a text holds; a later model also sees the earlier categories'
probabilities.  In training these are out-of-fold predictions, so that a later model learns how far to trust unseen ones: texts are dealt into folds by a
hash, so that copies share a fold, and a fold is predicted by a model whose words and weights come from the other folds only.  The models are
fitted on the driver on at most ``max_rows`` labelled texts (those with the smallest hash of their id) and ``max_words`` words for each fold left out,
those whose share of positive rows is least likely to be chance; both bounds are parameters.  Scoring reads whole texts.
"""

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.scratch import cut
from millrace.llm.words import utf8, words

MAX_ROWS = 16000
MAX_WORDS = 2048
FOLDS = 3
#: Words count as features from this log-likelihood ratio on; by chance one word in a million gets there.
EVIDENCE = 24.0
#: A text is rejected from this probability of the last category on.
THRESHOLD = 0.5


#: Stripped from both ends of a word.
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
#: Longer words also count by their beginning of this many bytes, marked with ``*``: that catches inflected and compound forms.
PREFIX = 6


def features(text: bytes | None) -> set[bytes]:
    """The words a text holds, as they are and without punctuation around them, and the beginnings of longer ones."""
    raw = set(words(text))
    own = {w.strip(PUNCTUATION) for w in raw}
    return raw | own | {w[:PREFIX] + b"*" for w in own if len(w) > PREFIX}


@dataclass
class Chain:
    """``weights[k]`` holds, for category k, one weight a word, then one for each earlier category's probability, then the bias."""

    categories: tuple[str, ...]
    vocabulary: dict[bytes, int]
    weights: list[np.ndarray]

    def probabilities(self, rows: Sequence[Sequence[int]]) -> np.ndarray:
        """(texts, categories) for lists of word numbers."""
        flat = np.fromiter((i for r in rows for i in r), np.int64)
        text = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        out, n = np.zeros((len(rows), len(self.weights))), len(self.vocabulary)
        for k, w in enumerate(self.weights):
            out[:, k] = _sigmoid(np.bincount(text, w[flat], len(rows)) + out[:, :k] @ w[n : n + k] + w[-1])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def _fit(flat: np.ndarray, text: np.ndarray, extra: np.ndarray, y: np.ndarray, use: np.ndarray, l2: float, steps: int) -> np.ndarray:
    """Logistic regression with an L2 penalty by full-batch Adam; words that ``use`` leaves out keep the weight 0; a label seen in one class only gives a constant."""
    rows, k, n_words = len(y), extra.shape[1], len(use)
    w = np.zeros(n_words + k + 1)
    rate = (y.sum() + 0.5) / (rows + 2.0)
    w[-1] = np.log(rate / (1 - rate))
    if not rows or y.min() == y.max():
        return w
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(text, w[flat], rows) + extra @ w[n_words : n_words + k] + w[-1]
        r = _sigmoid(z) - y
        g = np.r_[np.bincount(flat, r[text], n_words) * use, extra.T @ r, r.sum()] / rows
        g[:-1] += l2 * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (1 - 0.9 * step / steps) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w


def fit_chain(rows: Sequence[Sequence[int]], labels: np.ndarray, categories: Sequence[str], vocabulary: dict[bytes, int], fold: np.ndarray, use: np.ndarray, *, l2: float = 3e-4, steps: int = 100) -> Chain:
    """``rows`` are lists of word numbers, ``labels`` is (rows, categories) of 0 and 1, ``fold`` each row's fold.  ``use`` (folds + 1, categories, words) says
    which words a category's model may use: the last when it is fitted on all rows, the others when that fold is left out."""
    n, k_all = len(rows), len(categories)
    flat = np.fromiter((i for r in rows for i in r), np.int64)
    text = np.repeat(np.arange(n), [len(r) for r in rows]) if n else np.zeros(0, np.int64)
    seen, weights = np.zeros((n, k_all)), []
    for k in range(k_all):
        y, earlier = labels[:, k].astype(float), seen[:, :k]
        weights.append(_fit(flat, text, earlier, y, use[-1, k], l2, steps))
        if k + 1 == k_all:
            break
        for f in range(len(use) - 1):
            inside = fold != f
            renumbered = np.cumsum(inside) - 1
            part = inside[text]
            w = _fit(flat[part], renumbered[text[part]], earlier[inside], y[inside], use[f, k], l2, steps)
            z = np.bincount(text, w[flat], n) + earlier @ w[len(vocabulary) : len(vocabulary) + k] + w[-1]
            seen[~inside, k] = _sigmoid(z[~inside])
    return Chain(tuple(categories), vocabulary, weights)


def _distinct_words(docs: DataFrame, others: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [list(features(t)) for t in utf8(b).to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in others), pa.array(own, pa.list_(pa.binary()))], [*others, "words"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in others)
    return docs.select(*others, "text").mapInArrow(run, f"{kinds}, words array<binary>")


def _evidence(n: Column, positive: Column, rate: float) -> Column:
    """Log-likelihood ratio of a word's share of positive rows against the overall rate."""
    rate = min(max(rate, 1e-9), 1 - 1e-9)
    term = lambda k, share: F.when(k > 0, k * F.log(k / (n * share))).otherwise(0.0)
    return F.when(n > 0, 2 * (term(positive, rate) + term(n - positive, 1 - rate))).otherwise(0.0)


def _selected(sample: DataFrame, ys: Sequence[str], folds: int, max_words: int) -> tuple[dict[bytes, int], np.ndarray]:
    """Words with evidence, and which of them each category may use without each fold and with all: (folds + 1, categories, words).
    ``sample`` has fold, words and the labels; labels and counts of a fold left out take no part."""
    totals = sample.groupBy("fold").agg(F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]).collect()
    kept = [[r for r in totals if r["fold"] != f] for f in range(folds + 1)]  # of the last, none is left out
    sums = [F.count("*").alias("n"), *[F.sum(y).alias(y) for y in ys]]
    by_fold = sample.select("fold", F.explode("words").alias("w"), *ys).groupBy("w", "fold").agg(*sums)
    columns = [F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(folds + 1) for c in ("n", *ys)]
    counts = by_fold.groupBy("w").agg(*columns)
    proofs = []
    for f, rows in enumerate(kept):
        n = max(1, sum(r["n"] for r in rows))
        proofs += [_evidence(F.col(f"n_{f}"), F.col(f"{y}_{f}"), sum(r[y] or 0 for r in rows) / n).alias(f"p{f}_{y}") for y in ys]
    proven = cut(counts.select("w", *proofs), "evidence")
    best: dict[bytes, list] = {}
    use = []
    for f in range(folds + 1):
        most = F.greatest(F.lit(0.0), *[f"p{f}_{y}" for y in ys])
        use.append({bytes(r["w"]): [r[f"p{f}_{y}"] >= EVIDENCE for y in ys] for r in proven.where(most >= EVIDENCE).orderBy(most.desc(), "w").limit(max_words).collect()})
        best |= dict.fromkeys(use[-1])
    vocabulary = {w: i for i, w in enumerate(best)}
    none = [False] * len(ys)
    return vocabulary, np.array([[u.get(w, none) for w in vocabulary] for u in use], bool).reshape(folds + 1, len(vocabulary), len(ys)).transpose(0, 2, 1)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text", *, max_rows: int = MAX_ROWS, max_words: int = MAX_WORDS, folds: int = FOLDS, seed: int = 7) -> Chain:
    """``categories`` maps names, in the chain's order, to 0/1 expressions over ``labels``; rows with a null one, a null id or
    no document are left out.  Equal texts of one id with equal labels count once; different texts or labels of one id count each, and all of them together are bound by ``max_rows``.
    Without any labelled row every probability is one quarter, so nothing is rejected."""
    names = list(categories)
    ys = [f"y{i}" for i in range(len(names))]
    marked = labels.select(F.col(id_col).alias("id"), *[c.cast("int").alias(y) for y, c in zip(ys, categories.values())]).dropna().distinct()
    order = [F.xxhash64(F.lit(seed), "id"), F.col("id"), *ys]
    chosen = marked.orderBy(*order).limit(max_rows)
    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"), F.xxhash64(docs[text_col]).alias("t"))
    # at most max_rows ids and labels are broadcast
    found = cut(_distinct_words(src.join(F.broadcast(chosen), "id"), ["id", "t", *ys]).withColumn("uid", F.monotonically_increasing_id()), "labelled")
    # which rows stay is decided without their words; at most max_rows numbers are broadcast
    picked = cut(found.groupBy("id", "t", *ys).agg(F.min("uid").alias("uid")).orderBy(*order, "t").limit(max_rows).select("uid"), "picked")
    fold = F.pmod(F.col("t"), F.lit(folds)).cast("int").alias("fold")
    sample = found.join(F.broadcast(picked), "uid", "left_semi").select("id", "t", *ys, fold, "words")
    vocabulary, use = _selected(sample, ys, folds, max_words)
    numbered = _numbered(sample, vocabulary, ["id", "t", "fold", *ys]).orderBy(*order, "t").collect()
    marks = np.array([[r[y] for y in ys] for r in numbered], float).reshape(len(numbered), len(ys))
    return fit_chain([r["numbers"] for r in numbered], marks, names, vocabulary, np.array([r["fold"] for r in numbered], int), use)


def _numbered(sample: DataFrame, vocabulary: dict[bytes, int], others: Sequence[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(vocabulary[w] for w in ws if w in vocabulary) for ws in b.column("words").to_pylist()]
            yield pa.record_batch([*(b.column(c) for c in others), pa.array(own, pa.list_(pa.int32()))], [*others, "numbers"])

    kinds = ", ".join(f"{c} {sample.schema[c].dataType.simpleString()}" for c in others)
    return sample.mapInArrow(run, f"{kinds}, numbers array<int>")


def score(docs: DataFrame, chain: Chain, text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and p_<category> (double) for each category, replacing columns of these names.
    Null and empty texts hold no word and get the probabilities of a text without known words.  Texts are read whole, however long: what is held is the set of their
    different words.  Repeated rows and ids, null ids included, are scored each."""
    new = [f"p_{c}" for c in chain.categories]
    base = docs.drop(*[c for c in docs.columns if c in new])
    names, place = base.columns, base.columns.index(text_col)
    src = base.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = chain.vocabulary
        for b in batches:
            rows = [sorted(known[w] for w in known.keys() & features(t)) for t in utf8(b, f"c{place}").to_pylist()]
            p = chain.probabilities(rows)
            yield pa.record_batch([*b.columns, *(pa.array(p[:, k]) for k in range(p.shape[1]))], [*b.schema.names, *new])

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(src.schema)) + "".join(f", {c} double" for c in new)
    return src.mapInArrow(run, kinds).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *new)


def standard_categories() -> dict[str, Column]:
    """The chain over the columns of ``labels``: low quality first, toxic last."""
    return {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}


def accepted(docs: DataFrame, chain: Chain, text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, whose last category is less likely than ``threshold``."""
    last = f"p_{chain.categories[-1]}"
    src = docs.toDF(*[f"d{i}" for i in range(len(docs.columns))])
    scored = score(src, chain, f"d{docs.columns.index(text_col)}")
    return scored.where(F.col(last) < threshold).select(*[F.col(f"d{i}").alias(c) for i, c in enumerate(docs.columns)])
