"""Language-model scores: a word unigram base and a causal self-attention model on subword ids.

Documents are read once.  Each task numbers the words of chunks of about ``CHUNK_BYTES`` of text; a chunk is one row: its distinct words with their subword
ids and counts, and its documents as word numbers.  From that table come

* the base: the chunks' words are summed up by word, and every chunk gets back the counts of its own words only, so no document is multiplied by
  its words in a shuffle and no vocabulary is broadcast;
* the model of subword ids: a self-attention layer whose output is added to a bigram term counted over all learning documents.  Ids are numbered by
  frequency; the first ``GROUPS`` or so have a number of their own.  The softmax over the numbers has two levels of ``SIDE``, and numbers that follow
  alike share an upper one.  The layer is trained in numpy on all learning documents: each chunk's are strung together and cut into windows, and each round
  takes a part of them, until each id was a target once.  The last round trains the output only.  Tasks train on their own chunks and weights are averaged after each round, so the
  number of trainers grows with the corpus;
* the score: a word's probability mixes the model's (the product over its ids) with the word's count, discounted, where the rest again goes by the model.

Scoring cuts a document's ids into windows of ``WINDOW`` that overlap; each window scores its last ``STRIDE`` ids, so each id is scored once.
What goes to the driver and back are ``GROUPS`` * ``GROUPS`` counts, one count an id and the weights, whatever the size of the corpus.
"""

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.pieces import MARK, Pieces, parse, prepare
from millrace.llm.scratch import cut

CHUNK_BYTES = 12 << 20
#: Numbers of ids: 0 the end, then the most frequent ids, then ``SHARED`` for all others, by whether they begin a word and by their first letter.
GROUPS, SHARED, BITS = 1024, 16, 5
SIDE = 1 << BITS
WINDOW, STRIDE, WIDTH = 32, 28, 16
#: Distinct words of chunks that one task sums up, about.
WORD_ROWS = 1 << 20
#: Factor of the hash by which words are dealt.
SPREAD = 0x9E3779B97F4A7C15
#: Each round trains on one of so many parts of all windows; windows of a step, and when scoring; the rate at first, and the share it loses.
ROUNDS, STEP, BATCH = 2, 128, 256
RATE, DECAY = 3.8e-2, 0.9
#: Documents that a trainer strings together.
TRAINED = 256
#: Bound of a query's and a key's components, which keeps the exponentials finite.
REACH = 2.0
#: Weight of the shorter context's distribution against counts.
BACKOFF = 16.0
#: Weight of word counts against the model, and what each count loses.
WORDS, DISCOUNT = 0.12, 0.4


def is_held_out(doc_id):
    """Column: whether the row of this id is kept from learning; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _planes(numbers: np.ndarray) -> bytes:
    """Whole numbers from 0 on as bytes: how many bytes the largest takes, then the lowest byte of all numbers, the next of all, and so on."""
    k = max(1, -(-int(numbers.max(initial=0)).bit_length() // 8))
    return bytes([k]) + np.ascontiguousarray(numbers.view(np.uint8).reshape(len(numbers), numbers.itemsize)[:, :k].T).tobytes()


def _from_planes(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view(kind).ravel()


def _numbered_words(texts: list[pa.Array]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, number of each word of all texts, words of each text); see :mod:`millrace.llm.words` for what a word is."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays(texts)))
    flat, sizes = split.flatten(), pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False)
    some = pc.not_equal(flat, "")  # white space at an end leaves an empty string
    of_text = np.repeat(np.arange(len(sizes)), sizes)[some.to_numpy(zero_copy_only=False)]
    coded = flat.filter(some).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int32), np.bincount(of_text, minlength=len(sizes)).astype(np.int32)


def _bytes_of(words: pa.Array) -> tuple[bytes, np.ndarray]:
    """(the bytes of all words, the length of each) of an array that begins at its buffers' start."""
    words = pa.concat_arrays([words.cast(pa.binary())])
    offsets = np.frombuffer(words.buffers()[1], np.int32)[: len(words) + 1] if len(words) else np.zeros(1, np.int32)
    return (words.buffers()[2].to_pybytes()[: offsets[-1]] if len(words) else b""), np.diff(offsets)


def _word_hash(data: bytes, lengths: np.ndarray) -> np.ndarray:
    """A number below 2 ** 24 for each word, by its bytes."""
    if not len(lengths):
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths, dtype=np.int64)
    nth = np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)
    powers = np.cumprod(np.full(1 << 12, SPREAD, np.uint64))
    h = np.add.reduceat((np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)) * powers[nth & 4095], ends - lengths)
    h ^= h >> np.uint64(29)
    h *= np.uint64(SPREAD)
    return (h >> np.uint64(40)).astype(np.int64)


#: A chunk's columns besides its name and ids: words are put together, in the order of their hashes; others hold arrays of int32.
_CHUNK = ["held", "sizes", "words_at", "word", "length", "n", "n_pieces", "pieces"]


def _coder(model: bytes, id_type: str):
    ready = prepare(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, part, made = Pieces(ready), TaskContext.get().partitionId(), 0
        ids, held, texts, size = [], [], [], 0

        def chunk() -> pa.RecordBatch:
            word, at, sizes = _numbered_words(texts)
            order = np.argsort(_word_hash(*_bytes_of(word)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order))
            word, at, out = word.take(pa.array(order)), rank[at], np.concatenate(held)
            data, length = _bytes_of(word)
            counts = np.bincount(at[np.repeat(~out, sizes)], minlength=len(word)).astype(np.int32)
            flat, n_pieces = pieces.encode_words(word)
            one = pa.concat_arrays(ids)
            packed = [out.tobytes(), _planes(sizes), _planes(at), data, _planes(length), _planes(counts), _planes(n_pieces.astype(np.int32)), _planes(flat)]
            columns = [pa.array([part << 32 | made], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(one)], pa.int32()), one), *(pa.array([x], pa.binary()) for x in packed)]
            return pa.record_batch(columns, ["chunk", "ids", *_CHUNK])

        for b in batches:
            text = b.column("text").cast(pa.string())
            length = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            begin = 0
            for i in range(b.num_rows):
                size += int(length[i])
                if size >= CHUNK_BYTES or i + 1 == b.num_rows:
                    ids.append(b.column("id").slice(begin, i + 1 - begin))
                    held.append(np.asarray(b.column("held").slice(begin, i + 1 - begin).to_numpy(zero_copy_only=False), bool))
                    texts.append(text.slice(begin, i + 1 - begin))
                    begin = i + 1
                if size >= CHUNK_BYTES:
                    yield chunk()
                    ids, held, texts, size, made = [], [], [], 0, made + 1
        if held:
            yield chunk()

    return run, f"chunk long, ids array<{id_type}>, " + ", ".join(f"{c} binary" for c in _CHUNK)


class Chunk:
    """A row of the chunk table; the end is the word with the last number."""

    def __init__(self, row: dict, end_id: int):
        self.sizes = _from_planes(row["sizes"], np.int32)
        self.held = np.frombuffer(row["held"], bool)
        self.at = _from_planes(row["words_at"], np.int32)
        self.begin = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
        n = _from_planes(row["n_pieces"], np.int32).astype(np.int64)
        self.end = len(n)
        self.n_pieces = np.append(n, 1)
        self.first = np.cumsum(self.n_pieces) - self.n_pieces
        self.pieces = np.append(_from_planes(row["pieces"], np.int32), np.int32(end_id))

    def words_of(self, docs: Sequence[int]) -> np.ndarray:
        """Numbers of the documents' words, the end behind each document."""
        parts = []
        for i in docs:
            parts += [self.at[self.begin[i] : self.begin[i] + self.sizes[i]], [self.end]]
        return np.concatenate(parts) if parts else np.zeros(0, np.int32)

    def different(self, docs: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
        """(a document of each different text among ``docs``, for each of ``docs`` the place of its text's there)."""
        known: dict[bytes, int] = {}
        of = np.array([known.setdefault(self.at[self.begin[i] : self.begin[i] + self.sizes[i]].tobytes(), len(known)) for i in docs], np.int64)
        return np.asarray(docs)[np.unique(of, return_index=True)[1]], of

    def flat(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of these words, how many each has)."""
        n = self.n_pieces.take(numbers)
        before = np.cumsum(n) - n
        return self.pieces.take(np.repeat(self.first.take(numbers) - before, n) + np.arange(int(n.sum()))), n


_TEXT = ["held", "sizes", "words_at", "n_pieces", "pieces"]


def _chunks(batches: Iterator[pa.RecordBatch], end_id: int) -> Iterator[Chunk]:
    for b in batches:
        for i in range(b.num_rows):
            yield Chunk({c: b.column(c)[i].as_py() for c in _TEXT}, end_id)


# ---- model ------------------------------------------------------------------------------------------------------------------


class Layout:
    """Windows of documents that have so many ids each: where ids go as targets, and as inputs of the id after them."""

    def __init__(self, length: np.ndarray):
        front = WINDOW - STRIDE
        windows = -(-length // STRIDE)
        before, docs = np.cumsum(windows) - windows, np.arange(len(length))
        nth = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        at = before * STRIDE + front * docs  # in front of a text stands the end, 0
        self.n = int(windows.sum())
        self.targets = np.repeat(before * STRIDE, length) + nth
        self.inputs = np.repeat(at + front + 1, length) + nth  # a document's last id, the end, falls on a 0 or beyond it
        self.starts = np.repeat(at, windows) + STRIDE * (np.arange(self.n) - np.repeat(before, windows))

    def windows(self, number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(inputs (windows, WINDOW), target places (windows, STRIDE)) of the documents' ids."""
        row = np.zeros(int(self.starts[-1]) + 2 * WINDOW if self.n else 0, np.int64)
        row[self.inputs] = number
        target = np.zeros(self.n * STRIDE, np.int64)
        target[self.targets] = place
        return row.take(self.starts[:, None] + np.arange(WINDOW)), target.reshape(-1, STRIDE)


def stream(number: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of documents strung together, cut into windows (n, WINDOW) in which every id is a target: inputs, target places, which count."""
    n = -(-len(number) // WINDOW)
    inputs, target = np.zeros((2, n * WINDOW), np.int64)
    inputs[1 : len(number)] = number[:-1]
    target[: len(number)] = place
    return inputs.reshape(n, WINDOW), target.reshape(n, WINDOW), (np.arange(n * WINDOW) < len(number)).reshape(n, WINDOW)


def numbered(pieces: list, counts: np.ndarray, end_id: int) -> np.ndarray:
    """A number below ``GROUPS`` for each id: 0 the end, then the most frequent ids, then the shared ones."""
    own = GROUPS - 1 - SHARED
    out = np.zeros(len(counts), np.int64)
    for i, (p, *_) in enumerate(pieces):
        letter = p.lstrip(MARK)[:1]
        out[i] = 1 + own + (SHARED // 2) * p.startswith(MARK) + (ord(letter) if letter else 0) % (SHARED // 2)
    first = [i for i in np.lexsort((np.arange(len(counts)), -counts)).tolist() if i != end_id][:own]
    out[first] = 1 + np.arange(len(first))
    out[end_id] = 0
    return out


def places(after: np.ndarray) -> np.ndarray:
    """A place in the two-level softmax for each number, so that numbers that come after the same ones share an upper level: of the counts ``after``
    (number before, number) the leading directions, along which the numbers are halved again and again."""
    share = after / np.sqrt(np.outer(after.sum(1) + 1, after.sum(0) + 1))
    strength, axes = np.linalg.eigh(share.T @ share)
    x = axes[:, -16:] * np.sqrt(np.maximum(strength[-16:], 0))
    parts = [np.arange(GROUPS)]
    while len(parts) < SIDE:
        halves = []
        for p in parts:
            y = x[p] - x[p].mean(0)
            order = p[np.argsort(y @ np.linalg.svd(y, full_matrices=False)[2][0], kind="stable")]
            halves += [order[: len(order) // 2], order[len(order) // 2 :]]
        parts = halves
    out = np.empty(GROUPS, np.int64)
    out[np.concatenate(parts)] = np.arange(GROUPS)
    return out


def bigram(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities after a number of the upper level (GROUPS, SIDE) and, after a number and an upper one, of the lower (GROUPS * SIDE, SIDE),
    of counts (number before, place)."""
    n = after.reshape(GROUPS, SIDE, SIDE)
    upper = n.sum(2)
    first = (upper.sum(0) + 1) / (upper.sum() + SIDE)
    second = (n.sum(0) + 0.1) / (n.sum((0, 2))[:, None] + 0.1 * SIDE)
    a = (upper + BACKOFF * first) / (upper.sum(1, keepdims=True) + BACKOFF)
    b = (n + BACKOFF * second) / (upper[..., None] + BACKOFF)
    return np.log(a).astype(np.float32), np.log(b).astype(np.float32).reshape(GROUPS * SIDE, SIDE)


class Attention:
    """One layer: vectors of numbers and positions, masked attention with a residual, scores of both levels plus the bigram terms."""

    SHAPES = {"embed": (GROUPS, WIDTH), "place": (WINDOW, WIDTH), "query": (WIDTH, WIDTH), "key": (WIDTH, WIDTH), "value": (WIDTH, WIDTH), "first": (WIDTH, SIDE), "second": (SIDE, WIDTH, SIDE)}

    def __init__(self, first: np.ndarray, second: np.ndarray, flat: np.ndarray | None = None, kind=np.float32):
        """``first`` and ``second`` as :func:`bigram` gives them; the weights ``flat``, or a seeded beginning."""
        if flat is None:
            r = np.random.default_rng(1)
            flat = np.concatenate([r.standard_normal(math.prod(s)) * (0.02 if k in ("first", "second") else 0.25) for k, s in self.SHAPES.items()])
        self.flat, self.w, at = flat.astype(kind), {}, 0
        for k, s in self.SHAPES.items():
            self.w[k] = self.flat[at : at + math.prod(s)].reshape(s)
            at += math.prod(s)
        self.first, self.second = first.astype(kind, copy=False), second.astype(kind, copy=False)
        self.causal = np.tril(np.ones((WINDOW, WINDOW), kind))
        self.scale, self.one = kind(1 / math.sqrt(WIDTH)), np.ones((SIDE, 1), kind)

    def _hidden(self, inputs: np.ndarray, front: int) -> tuple:
        """Of all positions but the first ``front``."""
        w = self.w
        x = w["embed"].take(inputs, 0)
        x += w["place"]
        late = x[:, front:]
        q, k = late @ (w["query"] * self.scale), x @ w["key"]
        v = np.ones((len(x), WINDOW, WIDTH + 1), x.dtype)  # the last column sums the weights up
        v[..., :WIDTH] = x @ w["value"]
        a = np.clip(q, -REACH, REACH, out=q) @ np.clip(k, -REACH, REACH, out=k).transpose(0, 2, 1)
        np.exp(a, out=a)
        a *= self.causal[front:]
        both = a @ v
        total = both[..., WIDTH:]
        y = both[..., :WIDTH] / total
        return x, q, k, v, a, total, y, (late + y).reshape(-1, WIDTH)

    def _scores(self, h: np.ndarray, before: np.ndarray, place: np.ndarray) -> tuple:
        """Scores of the upper level, and of the lower one in the order of the targets' upper places."""
        up = place >> BITS
        s1 = h @ self.w["first"]
        s1 += self.first.take(before, 0)
        order = np.argsort(up.astype(np.int8), kind="stable")
        edges = np.append(0, np.cumsum(np.bincount(up, minlength=SIDE))).tolist()
        sorted_h, s2 = h.take(order, 0), self.second.take(((before << BITS) + up).take(order), 0)
        for i, (a, b) in enumerate(zip(edges, edges[1:])):
            if b > a:
                s2[a:b] += sorted_h[a:b] @ self.w["second"][i]
        return s1, s2, up, order, edges, sorted_h

    def _totals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(exponentials of the scores, their sums by row); rows where these leave the range are taken relative to their maximum, in place."""
        with np.errstate(over="ignore"):
            e = np.exp(scores)
            total = e @ self.one
        if not 0 < total.min(initial=1) <= total.max(initial=1) < np.inf:
            scores -= scores.max(1, keepdims=True)
            np.exp(scores, out=e)
            total = e @ self.one
        return e, total

    def log_likelihood(self, inputs: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of each target place's probability; targets (windows, n) stand at the last n positions."""
        front = WINDOW - target.shape[1]
        place, rows = target.ravel(), np.arange(target.size)
        s1, s2, up, order, *_ = self._scores(self._hidden(inputs, front)[-1], inputs[:, front:].ravel(), place)
        total1, total2 = self._totals(s1)[1], self._totals(s2)[1]
        out = s1.ravel().take((rows << BITS) + up) - np.log(total1)[:, 0]
        out[order] += s2.ravel().take((rows << BITS) + (place & SIDE - 1).take(order)) - np.log(total2)[:, 0]
        return out.reshape(target.shape)

    def gradient(self, inputs: np.ndarray, target: np.ndarray, counted: np.ndarray, whole: bool = True) -> np.ndarray:
        """Of the mean of the counted targets' negative log probability, by all weights or by those of the output, the last of all."""
        w, front = self.w, WINDOW - target.shape[1]
        x, q, k, v, a, total, y, h = self._hidden(inputs, front)
        place, rows = target.ravel(), np.arange(target.size)
        s1, s2, up, order, edges, sorted_h = self._scores(h, inputs[:, front:].ravel(), place)
        share = counted.reshape(-1).astype(self.flat.dtype)
        share /= max(1, counted.sum())
        p1, n1 = self._totals(s1)
        p1 *= share[:, None] / n1
        p1[rows, up] -= share
        p2, n2 = self._totals(s2)
        sorted_share = share.take(order)
        p2 *= sorted_share[:, None] / n2
        p2[rows, (place & SIDE - 1).take(order)] -= sorted_share
        d_second, d_sorted = np.zeros_like(w["second"]), np.empty_like(sorted_h)
        for i, (b, e) in enumerate(zip(edges, edges[1:])):
            if e > b:
                own = p2[b:e]
                np.matmul(sorted_h[b:e].T, own, out=d_second[i])
                if whole:
                    np.matmul(own, w["second"][i].T, out=d_sorted[b:e])
        if not whole:
            return np.concatenate([(h.T @ p1).ravel(), d_second.ravel()])
        back = np.empty_like(order)
        back[order] = rows
        dh = p1 @ w["first"].T
        dh += d_sorted.take(back, 0)
        d_first = h.T @ p1
        dh = dh.reshape(y.shape)
        part = np.empty((*y.shape[:2], WIDTH + 1), y.dtype)  # the last column goes with the ones of v
        np.divide(dh, total, out=part[..., :WIDTH])
        np.negative(np.einsum("bij,bij->bi", part[..., :WIDTH], y), out=part[..., WIDTH])
        dv = a.transpose(0, 2, 1) @ part[..., :WIDTH]
        ds = part @ v.transpose(0, 2, 1)
        ds *= a
        dq, dk = ds @ k, ds.transpose(0, 2, 1) @ q
        flat = lambda t: t.reshape(-1, WIDTH)
        dx = dk @ w["key"].T
        dx += dv @ w["value"].T
        dh += dq @ (w["query"].T * self.scale)
        dx[:, front:] += dh
        numbers = inputs.astype(np.int16).ravel()
        by = np.argsort(numbers, kind="stable")
        same = numbers.take(by)
        first = np.append(0, np.flatnonzero(same[1:] != same[:-1]) + 1)
        d_embed = np.zeros_like(w["embed"])
        d_embed[same[first]] = np.add.reduceat(flat(dx).take(by, 0), first, axis=0)
        all_x, late = flat(x), flat(x[:, front:])
        parts = {"embed": d_embed, "place": dx.sum(0), "query": late.T @ flat(dq) * self.scale, "key": all_x.T @ flat(dk), "value": all_x.T @ flat(dv), "first": d_first, "second": d_second}
        return np.concatenate([parts[n].ravel() for n in self.SHAPES])

    def train(self, parts: Iterable[tuple], windows: int, done: float = 0.0, share: float = 1.0, whole: bool = True) -> int:
        """Adam over parts of about so many windows in all, ``STEP`` at a time, or twice that for the output only; the rate falls from where ``done`` of the training is behind by ``share`` of it.
        Returns the number of targets."""
        own = self.flat if whole else self.flat[-(self.w["first"].size + self.w["second"].size) :]
        m, v, one = np.zeros_like(own), np.zeros_like(own), own.dtype.type
        size = STEP if whole else 2 * STEP
        steps, seen = max(1, windows // size), 0
        batches = (tuple(x[at : at + size] for x in part) for part in parts for at in range(0, len(part[0]), size))
        for step, (inputs, target, counted) in enumerate(batches, 1):
            g = self.gradient(inputs, target, counted, whole)
            seen += int(counted.sum())
            m *= one(0.9)
            m += one(0.1) * g
            v *= one(0.98)
            v += one(0.02) * np.square(g, out=g)
            rate = RATE * (1 - DECAY * (done + share * min(1.0, step / steps)))
            np.sqrt(v, out=g)
            g += one(1e-8 * math.sqrt(1 - 0.98**step))
            np.divide(m, g, out=g)
            g *= one(rate * math.sqrt(1 - 0.98**step) / (1 - 0.9**step))
            own -= g
        return seen


def _cells(total: np.ndarray, width: int) -> pa.RecordBatch:
    """The counts above zero of a long array, packed by ``width`` of them: (row, places inside, counts)."""
    some = np.flatnonzero(total)
    first = np.append(0, np.flatnonzero(np.diff(some // width)) + 1) if len(some) else np.zeros(0, int)
    parts = list(zip(first.tolist(), [*first[1:].tolist(), len(some)]))
    columns = [pa.array([int(some[a]) // width for a, _ in parts], pa.int32()), *(pa.array([_planes(x[a:b]) for a, b in parts], pa.binary()) for x in (some % width, total[some]))]
    return pa.record_batch(columns, ["row", "i", "n"])


def _summed(rows: DataFrame, width: int) -> np.ndarray:
    """The sum of all tables of :func:`_cells`, (GROUPS, width), on the driver; rows are added up on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, np.ndarray] = {}
        for b in batches:
            for row, i, n in zip(*(b.column(c).to_pylist() for c in ("row", "i", "n"))):
                own.setdefault(row, np.zeros(width, np.int64))[_from_planes(i, np.int64)] += _from_planes(n, np.int64)
        yield pa.record_batch([pa.array(list(own), pa.int32()), pa.array([x.tobytes() for x in own.values()], pa.binary())], ["row", "n"])

    out = np.zeros((GROUPS, width), np.int64)
    for r in rows.repartition("row").mapInArrow(run, "row int, n binary").collect():
        out[r["row"]] += np.frombuffer(r["n"], np.int64)
    return out


def train_model(coded: DataFrame, model: bytes, end_id: int) -> dict[str, np.ndarray]:
    """Arrays of the model: number and place of each id, its log probability within its number, the bigram terms and the weights of the layer."""
    pieces = parse(model).pieces
    n_ids = len(pieces)
    width = -(-n_ids // GROUPS)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_ids)
        for b in batches:
            for n, many, flat, held in zip(*(b.column(c).to_pylist() for c in ("n", "n_pieces", "pieces", "held"))):
                each = np.repeat(_from_planes(n, np.int32), _from_planes(many, np.int32))
                total += np.bincount(_from_planes(flat, np.int32), each, n_ids)
                total[end_id] += len(held) - np.frombuffer(held, bool).sum()
        yield _cells(total.astype(np.int64), width)

    unigram = _summed(coded.select("n", "n_pieces", "pieces", "held").mapInArrow(sums, "row int, i binary, n binary"), width).ravel()[:n_ids]
    number = numbered(pieces, unigram, end_id)
    texts = coded.select(*_TEXT)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GROUPS * GROUPS, np.int64)
        for c in _chunks(batches, end_id):
            own = number[c.pieces]
            learn = np.flatnonzero(~c.held)
            times = np.zeros(c.end + 1)
            for at in range(0, len(learn), 1024):  # where words meet: the last piece of one and the first of the next
                flat = np.append(c.end, c.words_of(learn[at : at + 1024]))
                times += np.bincount(flat[1:], minlength=c.end + 1)
                last, first = own[c.first + c.n_pieces - 1], own[c.first]
                total += np.bincount(last[flat[:-1]] * GROUPS + first[flat[1:]], minlength=len(total))
            inside = np.ones(len(own), bool)
            inside[c.first] = False
            then = np.flatnonzero(inside)
            total += np.bincount(own[then - 1] * GROUPS + own[then], np.repeat(times, c.n_pieces)[then], len(total)).astype(np.int64)
        yield _cells(total, GROUPS)

    after = _summed(texts.mapInArrow(pairs, "row int, i binary, n binary"), GROUPS)
    order = places(after.astype(float))
    moved = np.zeros((GROUPS, GROUPS))
    moved[:, order] = after
    first, second = bigram(moved)
    place, attention = order[number], Attention(first, second)
    shipped = coded.sparkSession.sparkContext.broadcast({"first": first, "second": second, "number": number, "place": place})

    def averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = 0, np.zeros(len(attention.flat))
        for b in batches:
            for n, w in zip(b.column("seen").to_pylist(), b.column("w").to_pylist()):
                seen, total = seen + n, total + n * np.frombuffer(w, np.float32)
        if seen:
            yield pa.record_batch([pa.array([seen], pa.int64()), pa.array([(total / seen).astype(np.float32).tobytes()], pa.binary())], ["seen", "w"])

    for turn in range(ROUNDS):
        begun = coded.sparkSession.sparkContext.broadcast(attention.flat)

        def trained(batches: Iterator[pa.RecordBatch], turn: int = turn, begun=begun) -> Iterator[pa.RecordBatch]:
            m, seen = shipped.value, 0
            own = Attention(m["first"], m["second"], begun.value)
            for c in _chunks(batches, end_id):
                learn = np.flatnonzero(~c.held)
                n_ids = np.add.reduceat(np.append(c.n_pieces.take(c.at), 0), c.begin) * (c.sizes > 0) + 1

                def parts(c: Chunk = c, learn: np.ndarray = learn) -> Iterator[tuple]:
                    for at in range(0, len(learn), TRAINED):
                        ids = c.flat(c.words_of(learn[at : at + TRAINED]))[0]
                        yield tuple(x[turn::ROUNDS] for x in stream(m["number"].take(ids), m["place"].take(ids)))

                seen += own.train(parts(), int(n_ids[learn].sum()) // (WINDOW * ROUNDS), turn / ROUNDS, 1 / ROUNDS, whole=turn + 1 < ROUNDS)
            if seen:
                yield pa.record_batch([pa.array([seen], pa.int64()), pa.array([own.flat.tobytes()], pa.binary())], ["seen", "w"])

        weights = texts.mapInArrow(trained, "seen long, w binary")
        while (n := weights.rdd.getNumPartitions()) > 64:  # sums of sums, so that no task takes in the weights of all
            weights = cut(weights.repartition(math.ceil(math.sqrt(n))).mapInArrow(averaged, "seen long, w binary"), "weights")
        parts = sorted(weights.collect(), key=lambda r: bytes(r["w"]))
        if parts:
            attention = Attention(first, second, sum(r["seen"] * np.frombuffer(r["w"], np.float32).astype(float) for r in parts) / sum(r["seen"] for r in parts))
    total = np.bincount(number, unigram + 0.5, GROUPS)
    return {"first": first, "second": second, "number": number, "place": place, "own": np.log((unigram + 0.5) / total[number]), "flat": attention.flat}


def _id_scores(c: Chunk, docs: Sequence[int], m: dict, attention: Attention) -> tuple[np.ndarray, np.ndarray]:
    """Of some documents of a chunk: the numbers of their words with the ends, and each word's natural log probability by the model."""
    numbers = c.words_of(docs)
    ids, n = c.flat(numbers)
    ends = np.cumsum(n)
    last = ends[numbers == c.end]
    layout = Layout(np.diff(last, prepend=0))
    inputs, target = layout.windows(m["number"].take(ids), m["place"].take(ids))
    got = np.concatenate([attention.log_likelihood(inputs[i : i + BATCH], target[i : i + BATCH]) for i in range(0, len(inputs), BATCH)])
    sums = np.append(0.0, np.cumsum(got.ravel().take(layout.targets).astype(float) + m["own"].take(ids)))
    return numbers, sums[ends] - sums[ends - n]


def _dealt_words(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A chunk's words in ``parts`` parts by hash, which lie one behind the other: (part, chunk, first word's number, words, lengths, n)."""
    for b in batches:
        for chunk, data, length, n in zip(*(b.column(c).to_pylist() for c in ("chunk", "word", "length", "n"))):
            length, n = _from_planes(length, np.int32), _from_planes(n, np.int32)
            part = _word_hash(data, length) * parts >> 24
            begin = np.append(0, np.cumsum(length, dtype=np.int64))
            edges = np.flatnonzero(np.diff(part, prepend=-1, append=parts))
            rows = [(int(part[i]), chunk, i, data[begin[i] : begin[j]], _planes(length[i:j]), _planes(n[i:j])) for i, j in zip(edges.tolist(), edges[1:].tolist())]
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], ["part", "chunk", "first", "word", "length", "n"])


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of :func:`_dealt_words` that hold all parts of their words to the sums: (chunk, first, c), and a row with the sum of all and the number of words that count."""
    rows = [r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("chunk", "first", "word", "length", "n")))]
    if not rows:
        return
    lengths = [_from_planes(r[3], np.int32) for r in rows]
    offsets = np.append(0, np.cumsum(np.concatenate(lengths), dtype=np.int64))
    words = pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(b"".join(r[2] for r in rows))])
    word = words.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    total = np.bincount(word, np.concatenate([_from_planes(r[4], np.int32) for r in rows])).astype(np.int64)  # exact below 2 ** 53
    ends = np.cumsum([len(x) for x in lengths])
    names = ["chunk", "first", "c", "n", "v"]
    for at in range(0, len(rows), 256):
        some = rows[at : at + 256]
        counts = [_planes(total[word[e - len(x) : e]]) for e, x in zip(ends[at : at + 256].tolist(), lengths[at : at + 256])]
        yield pa.record_batch([pa.array([r[0] for r in some], pa.int64()), pa.array([r[1] for r in some], pa.int32()), pa.array(counts, pa.binary()), pa.nulls(len(some), pa.int64()), pa.nulls(len(some), pa.int64())], names)
    yield pa.record_batch([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([int(total.sum())]), pa.array([int((total > 0).sum())])], names)


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 2) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``docs``.

    ``model`` is a SentencePiece model file's content, for the subword ids; ``end_id`` its id for the end of a text.  Null and empty texts hold the
    end only; ids may be of any type; a null id counts as the empty text in the hash, so its row is learned from.  Repeated rows are rows of their own.
    Without learning rows every count is zero.  Other columns are ignored.  Trainers take the chunks that a task reads, so ``score`` varies a little
    with the layout of the files; all else doesn't.
    """
    held = is_held_out(docs[id_col])
    src = docs.select(docs[id_col].alias("id"), held.alias("held"), docs[text_col].alias("text"))
    id_type = src.schema["id"].dataType.simpleString()
    run, schema = _coder(model, id_type)
    coded = cut(src.mapInArrow(run, schema), "coded")
    size = coded.agg(F.coalesce(F.sum(F.octet_length("n_pieces")), F.lit(0)).alias("n")).first()["n"]
    parts = max(1, -(-size // WORD_ROWS))
    dealt = coded.select("chunk", "word", "length", "n").mapInArrow(lambda x: _dealt_words(x, parts), "part int, chunk long, first int, word binary, length binary, n binary")
    # a word has one row in a chunk, so none has many of all rows
    known = cut(dealt.repartition(parts, "part").mapInArrow(_word_counts, "chunk long, first int, c binary, n long, v long"), "word-counts")
    total = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("v"), F.lit(0)).alias("v")).first()
    ends = src.where("not held").count()
    n, v = total["n"] + ends, total["v"] + (ends > 0)
    of_chunk = known.where("chunk is not null").select(F.col("chunk").alias("owner"), "first", "c")
    # a bounded set of arrays, whatever the corpus
    shipped = coded.sparkSession.sparkContext.broadcast(train_model(coded, model, end_id))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        m = shipped.value
        attention = Attention(m["first"], m["second"], m["flat"])
        row = {c: left.column(c)[0].as_py() for c in _TEXT}
        c, ids = Chunk(row, end_id), left.column("ids")[0].values
        many = np.zeros(c.end + 1, np.int64)
        for first, counts in zip(right.column("first").to_pylist(), right.column("c").to_pylist()):
            counts = _from_planes(counts, np.int64)
            many[first : first + len(counts)] = counts
        many[c.end] = ends
        value = np.log10(many + 1.0) - math.log10(n + v + 1)
        counted = WORDS * np.maximum(many - DISCOUNT, 0) / max(1, n)
        rest = math.log(1 - WORDS + WORDS * DISCOUNT * v / max(1, n))
        known = (many > 0).astype(np.int64)
        docs, alike = c.different(range(len(c.sizes)))  # equal documents of a chunk are scored once
        tokens = c.sizes[docs] + 1
        base, seen, mixed = [], [], []
        bound = np.cumsum(tokens, dtype=np.int64)
        at = 0
        while at < len(docs):  # about 50,000 words at once, or one document
            stop = max(at + 1, int(np.searchsorted(bound, bound[at] + 50_000)))
            numbers, own = _id_scores(c, docs[at:stop], m, attention)
            begin = np.append(0, np.cumsum(tokens[at : stop - 1], dtype=np.int64))
            base.append(np.add.reduceat(value.take(numbers), begin))
            seen.append(np.add.reduceat(known.take(numbers), begin))
            own += rest
            both = np.exp(own) + counted.take(numbers)
            small = both < 1e-290  # long words that were never counted
            both[small] = 1
            mixed.append(np.add.reduceat(np.where(small, own, np.log(both)), begin) / math.log(10))
            at = stop
        base, seen, mixed, tokens = (x[alike] for x in (*(np.concatenate(y) for y in (base, seen, mixed)), tokens))
        rows = len(tokens)
        return pa.table({"id": ids, "held_out": pa.array(c.held), "n_tokens": pa.array(tokens.astype(np.int64)), "n_known": seen, "train_tokens": pa.array([n] * rows, pa.int64()), "base_score": base, "score": mixed})

    out = coded.select("chunk", "ids", *_TEXT).groupBy("chunk").cogroup(of_chunk.groupBy("owner")).applyInArrow(scored, f"id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
