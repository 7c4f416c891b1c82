"""SentencePiece encoding and decoding on the tokenizers library.

The model file's protobuf is parsed here; from it the normaliser, the metaspace marker, the model (unigram scores, or for a
BPE model its merges, ordered by score) and byte fallback are rebuilt as a ``tokenizers.Tokenizer``.  Texts are cut in front of every run
of markers.  Where no piece runs on into a following marker (checked when the model is loaded) that changes no result of a BPE model, and equal
words are encoded once.  Unigram models are encoded text by text.  Batches are encoded by several threads.  ``verify`` compares ids and decoded text with the sentencepiece library; ``encode`` can
do so with a share of its own texts, and stops where they differ.
"""

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.words import utf8

MARK = "▁"
#: Kinds of pieces in the model file (fixed by its format).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words kept with their ids.
CACHED_WORDS = 200_000
#: Longer words are encoded each time.
CACHED_LENGTH = 64
#: Threads of the library in a task.
THREADS = 2


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(field, value) of a protobuf message: ints, 4 or 8 raw bytes, or bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        shift = value = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 2: None, 5: 4}[kind]
        n = varint() if n is None else n
        yield key >> 3, data[i : i + n]
        i += n


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    bpe: bool = False
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    escape_spaces: bool = True
    unk: int = 0
    merges: list[tuple[str, str]] = field(default_factory=list)


def parse(data: bytes) -> Model:
    m = Model()
    for f, v in _fields(data):
        if f == 1:
            piece = dict(_fields(v))
            score = struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
            m.pieces.append((piece[1].decode("utf-8"), score, piece.get(3, NORMAL)))
        elif f == 2:
            spec = dict(_fields(v))
            if spec.get(3, 1) not in (1, 2):
                raise ValueError("only unigram and BPE models are handled")
            m.bpe, m.byte_fallback, m.unk = spec.get(3, 1) == 2, bool(spec.get(35, 0)), spec.get(40, 0)
        elif f == 3:
            spec = dict(_fields(v))
            m.charsmap = spec.get(2, b"")
            m.dummy_prefix, m.trim_spaces, m.escape_spaces = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
    return m


def _merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """All ways to put two pieces together to a third; the piece with the higher score goes first."""
    usable = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    out = []
    for p, i in usable.items():
        for cut_at in range(1, len(p)):
            a, b = p[:cut_at], p[cut_at:]
            if a in usable and b in usable:
                out.append((-pieces[i][1], i, usable[a], usable[b], a, b))
    out.sort()
    return [(a, b) for *_, a, b in out]


def prepare(data: bytes) -> Model:
    """A model file's content, read once so that tasks needn't."""
    m = parse(data)
    m.merges = _merges(m.pieces) if m.bpe else []
    return m


class Pieces:
    """Encoder and decoder of one model: a file's bytes, or what :func:`prepare` made of them."""

    def __init__(self, data: bytes | Model):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

        self.model = m = prepare(data) if isinstance(data, bytes) else data
        if m.bpe:
            vocab = {p: i for i, (p, _, _) in enumerate(m.pieces)}
            inner = models.BPE(vocab=vocab, merges=m.merges, unk_token=m.pieces[m.unk][0], fuse_unk=True, byte_fallback=m.byte_fallback, cache_capacity=0)
        else:
            # pieces that no text may match have names that no text has
            hidden = [(p if kind in (NORMAL, USER, BYTE) else f"\U0010ffff{i}", s, kind) for i, (p, s, kind) in enumerate(m.pieces)]
            inner = models.Unigram([(p, s) for p, s, _ in hidden], unk_id=m.unk, byte_fallback=m.byte_fallback)
            self.literal = Tokenizer(models.Unigram([(f"\U0010ffff{i}" if kind == BYTE else p, s) for i, (p, s, kind) in enumerate(hidden)], unk_id=m.unk))
            self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(m.pieces) if kind == BYTE}
        self.tok, self.cutting = Tokenizer(inner), Tokenizer(inner)
        self.cutting.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
        self.marked = np.array([p.startswith(MARK) for p, _, _ in m.pieces])
        steps = []
        if m.charsmap:
            steps.append(normalizers.Precompiled(m.charsmap))
        if m.trim_spaces:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        self.first = normalizers.Sequence(steps) if steps else None
        self.escape = [(" ", MARK)] if m.escape_spaces else []
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p, _, kind in m.pieces if kind in (NORMAL, USER)) or not m.bpe or not m.escape_spaces
        self.word = re.compile(f"{MARK}+[^{MARK}]*|^[^{MARK}]+")
        self.tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.bytes_of = [self._bytes(p, kind) for p, _, kind in m.pieces]
        self.cache: dict[str, bytes] = {}

    def _bytes(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def normalise(self, text: str) -> str:
        if self.first is not None:
            text = self.first.normalize_str(text)
        if self.model.dummy_prefix and text:
            text = " " + text
        for a, b in self.escape:
            text = text.replace(a, b)
        return text

    def _backend(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32 bytes, by the library, in one multithreaded batch."""
        out = [np.array(e.ids, np.int32).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        for i, t in enumerate(texts):
            if not self.model.bpe and "<0x" in t:
                out[i] = self._spelled(t)
        return out

    def _spelled(self, text: str) -> bytes:
        """Ids of a text that may hold the name of a byte's piece, which stands for itself there."""
        ids: list[int] = []
        for i, (a, b) in zip(*((e := self.literal.encode(text, add_special_tokens=False)).ids, e.offsets)):
            ids += [self.byte_ids[c] for c in text[a:b].encode()] if i == self.model.unk and self.model.byte_fallback else [i]
        return np.array(ids, np.int32).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words that begin with their only marker: strung together, cut by the library in front of markers, and told apart
        again by the pieces that begin with one."""
        groups = ["".join(words[i : i + 256]) for i in range(0, len(words), 256)]
        ids = np.concatenate([np.array(e.ids, np.int32) for e in self.cutting.encode_batch_fast(groups, add_special_tokens=False)])
        begins = (np.flatnonzero(self.marked[ids]) * 4).tolist()
        flat = ids.tobytes()
        return [flat[a:b] for a, b in zip(begins, [*begins[1:], len(flat)])]

    def encode_packed(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as int32 bytes.  Words that are not yet known are encoded once for all texts."""
        ready = [self.normalise(t) for t in texts]
        if self.whole:
            return self._backend(ready)
        split = [self.word.findall(t) for t in ready]
        known = self.cache
        new = list(set(chain.from_iterable(split)).difference(known))
        plain = [w for w in new if w[0] == MARK and w[1:2] != MARK]
        other = [w for w in new if w[0] != MARK or w[1:2] == MARK]
        room = len(known) < CACHED_WORDS
        if plain:
            known.update(zip(plain, self._words(plain)))
        if other:
            known.update(zip(other, self._backend(other)))
        out = [b"".join(map(known.__getitem__, ws)) for ws in split]
        for w in new:
            if not room or len(w) > CACHED_LENGTH:
                del known[w]
        return out

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids (int32 bytes) of distinct words, each as it is encoded after a space."""
        marked = [MARK + w for w in words]
        known = self.cache
        plain = [w for w in marked if w not in known and MARK not in w[1:] and len(w) > 1]
        own: dict[str, bytes] = {}
        if plain and not self.whole:
            own = dict(zip(plain, self._words(plain)))
            room = max(0, CACHED_WORDS - len(known))
            known.update(islice(((w, i) for w, i in own.items() if len(w) <= CACHED_LENGTH), room))
        rest = [w for w in marked if w not in known and w not in own]
        own.update(zip(rest, self._backend(rest)))
        return [known.get(w) or own.get(w, b"") for w in marked]

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words (strings), each as it is encoded after a space, put together, and how many each has.  A word without any gets the unknown id."""
        odd = pc.match_substring(words, MARK).to_numpy(zero_copy_only=False)
        plain = words.filter(pa.array(~odd)) if odd.any() else words
        flat, n = np.zeros(0, np.int32), np.zeros(0, np.int64)
        if len(plain) and not self.whole:
            edges = np.append(np.arange(0, len(plain), 256), len(plain)).astype(np.int32)
            groups = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), plain), MARK)
            try:
                strung = [MARK + g for g in groups.to_pylist()]
            except UnicodeDecodeError:
                strung = []
            flat = np.concatenate([flat, *(np.array(e.ids, np.int32) for e in self.cutting.encode_batch_fast(strung, add_special_tokens=False))])
            begins = np.flatnonzero(self.marked[flat])
            n = np.diff(np.append(begins, len(flat)))
        if len(n) == len(words):
            return flat, n
        coded = self.word_ids([w.decode("utf-8", "replace") for w in words.cast(pa.binary()).to_pylist()])
        coded = [x or np.array([self.model.unk], np.int32).tobytes() for x in coded]
        return np.frombuffer(b"".join(coded), np.int32), np.array([len(x) // 4 for x in coded], np.int64)

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [np.frombuffer(x, np.int32).tolist() for x in self.encode_packed(texts)]

    def decode(self, ids: Sequence[Sequence[int]]) -> list[str]:
        """Texts of lists of ids; controls give nothing and the prefix space goes.  Bytes that form no UTF-8 become U+FFFD."""
        out, table = [], self.bytes_of.__getitem__
        for own in ids:
            text = b"".join(map(table, own)).decode("utf-8", "replace")
            out.append(text[1:] if self.model.dummy_prefix and text.startswith(" ") else text)
        return out


def verify(data: bytes, texts: Sequence[str], ours: "Pieces | None" = None, theirs=None) -> list[int]:
    """Numbers of the texts whose ids or decoded text differ from the sentencepiece library's; ``ours`` and ``theirs`` are encoders that are already loaded.
    A unigram model may give equal pieces in another order, whose scores have the same sum."""
    import sentencepiece

    ours, theirs = ours or Pieces(data), theirs or sentencepiece.SentencePieceProcessor(model_proto=data)
    a, b = ours.encode(texts), theirs.encode(list(texts), num_threads=1)
    return [i for i, (x, y, s, t) in enumerate(zip(a, b, ours.decode(a), theirs.decode(b))) if s != t or x != y and (ours.model.bpe or sorted(x) != sorted(y))]


def encode(docs: DataFrame, model: bytes, text_col: str = "text", *, threads: int = THREADS, verified: int = 0) -> DataFrame:
    """All rows and columns of ``docs`` and ``token_ids`` (array of int), ``n_tokens`` (long) and ``is_lossless``: whether decoding gives the text back.

    ``model`` is the model file's content; it travels with the tasks.  A batch's texts and new words are encoded by ``threads`` threads of the library.  Of every
    ``verified`` texts (0: of none) that a task encodes, one is encoded and decoded by the sentencepiece library as well; a difference is an error.  A null text has null ids, 0 tokens and counts as
    lossless, an empty one has no ids.  Texts are read whole; repeated rows are encoded each.  Columns of ``docs`` with these names are replaced.
    """
    new = ["token_ids", "n_tokens", "is_lossless"]
    base = docs.drop(*[c for c in docs.columns if c in new])
    names, place, ready = base.columns, base.columns.index(text_col), prepare(model)
    src = base.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        pieces, theirs, seen = Pieces(ready), None, 0
        if verified:
            import sentencepiece

            theirs = sentencepiece.SentencePieceProcessor(model_proto=model)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [None if t is None else t.decode("utf-8", "replace") for t in utf8(b, f"c{place}").to_pylist()]
                ids = pieces.encode_packed([t or "" for t in texts])
                if verified:
                    some = [t for i, t in enumerate(texts, seen) if t is not None and i % verified == 0]
                    seen += len(texts)
                    wrong = verify(model, some, pieces, theirs) if some else []
                    if wrong:
                        raise ValueError(f"not what the sentencepiece library gives: {some[wrong[0]][:200]!r}")
                same = [t is None or t == pieces.decode([np.frombuffer(x, np.int32).tolist()])[0] for t, x in zip(texts, ids)]
                lengths = np.array([len(x) // 4 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(ids), np.int32)
                offsets = pa.array(np.r_[0, np.cumsum(lengths)].astype(np.int32), mask=np.r_[[t is None for t in texts], False].astype(bool))
                yield pa.record_batch([*b.columns, pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(lengths), pa.array(same)], [*b.schema.names, *new])

    more = [T.StructField(name, kind) for name, kind in zip(new, (T.ArrayType(T.IntegerType()), T.LongType(), T.BooleanType()))]
    out = src.mapInArrow(run, T.StructType([*src.schema.fields, *more]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], *new)


def decode(encoded: DataFrame, model: bytes, ids_col: str = "token_ids") -> DataFrame:
    """All columns and ``decoded``: the text of the ids (null where they are null)."""
    names = [c for c in encoded.columns if c != "decoded"]
    place = names.index(ids_col)
    src, ready = encoded.select(*names).toDF(*[f"c{i}" for i in range(len(names))]), prepare(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(ready)
        for b in batches:
            lists = b.column(f"c{place}").to_pylist()
            texts = [None if x is None else pieces.decode([x])[0] for x in lists]
            yield pa.record_batch([*b.columns, pa.array(texts, pa.string())], [*b.schema.names, "decoded"])

    out = src.mapInArrow(run, T.StructType([*src.schema.fields, T.StructField("decoded", T.StringType())]))
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "decoded")
