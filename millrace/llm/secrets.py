"""Secret scans by a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must hold.  The texts of a
block are indexed: for every trigram that a query mentions, the postings (texts that hold it, case folded).  A rule's query
intersects and unites postings, and only the candidates are read with the regular expression.  Rules without a
mandatory trigram (hex runs) read every text.  The index covers whole texts; it is made block by block, so memory is bounded by a block or one text.
"""

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from re import _constants as sc
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.words import utf8

#: Bytes of text that are indexed together.
BLOCK_BYTES = 1 << 22
#: Alternatives of a piece beyond which its exact strings are given up.
EXACT = 32


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches; those whose ``group`` has fewer than ``least`` characters are dropped.

    Where a backtracking engine would begin anew at every character of a long run, ``anchored`` says the same with one beginning a run: its
    group ``found`` is what ``pattern`` matches."""

    kind: str
    pattern: str
    ignore_case: bool = False
    group: int = 0
    least: int = 0
    anchored: str | None = None
    found: int = 0

    @property
    def regex(self) -> re.Pattern:
        return re.compile(self.anchored or self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))


#: Fixed patterns, in the order in which spans with equal starts are listed.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", False, 0, 16),
    Rule("hex", r"[0-9a-f]+", False, 0, 32),
)
MORE_RULES = (
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
    # all beginnings in a run meet the same dot, and the first has the most before it
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", anchored=r"(?<![A-Za-z0-9_-])(?:(?!eyJ)[A-Za-z0-9_-])*+(eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,})", found=1),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", r"Bearer +[A-Za-z0-9._~+/-]{20,}"),
    # all letters of a run meet the same colon
    Rule("urlpass", r"[a-z][a-z0-9+.-]*://[^\x20\x09-\x0D/:@]+:[^\x20\x09-\x0D/@]+@", anchored=r"(?<![a-z0-9+.-])[0-9+.-]*+([a-z][a-z0-9+.-]*+://[^\x20\x09-\x0D/:@]++:[^\x20\x09-\x0D/@]++@)", found=1),
)

# A query is True (every text), ("tri", bytes), ("and", queries) or ("or", queries).


def _all(parts: list):
    parts = [p for p in dict.fromkeys(parts) if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _any(parts: list):
    parts = list(dict.fromkeys(parts))
    return True if True in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _held(strings: set[bytes]):
    """A text that holds one of these strings holds, for one of them, all its trigrams."""
    return _any([_all([("tri", s[i : i + 3]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _char(code: int) -> bytes:
    return chr(code).encode("utf-8").lower()


def _class(items: list) -> set[bytes] | None:
    out: set[bytes] = set()
    for op, arg in items:
        if op is sc.LITERAL:
            out.add(_char(arg))
        elif op is sc.RANGE and arg[1] - arg[0] < EXACT:
            out |= {_char(c) for c in range(arg[0], arg[1] + 1)}
        else:
            return None
    return out if len(out) <= EXACT else None


def _derive(nodes) -> tuple[set[bytes] | None, object]:
    """(the exact folded strings of the expression, or None; a query that holds for every match)."""
    exact: set[bytes] | None = {b""}
    queries: list = []

    def close() -> None:
        nonlocal exact
        if exact is not None and exact != {b""}:
            queries.append(_held(exact))
        exact = {b""}

    whole: set[bytes] | None = {b""}
    for op, arg in nodes:
        strings: set[bytes] | None = None
        query: object = True
        if op is sc.LITERAL:
            strings = {_char(arg)}
        elif op is sc.IN:
            strings = _class(arg)
        elif op is sc.SUBPATTERN:
            strings, query = _derive(arg[-1])
        elif op is sc.BRANCH:
            parts = [_derive(x) for x in arg[1]]
            query = _any([q for _, q in parts])
            if all(s is not None for s, _ in parts):
                strings = set().union(*(s for s, _ in parts))
        elif op in (sc.MAX_REPEAT, sc.MIN_REPEAT, sc.POSSESSIVE_REPEAT):
            low, high, inner = arg
            s, q = _derive(inner)
            query = q if low else True
            if s is not None and low == high and low <= 8:
                strings = {b""}
                for _ in range(low):
                    strings = {x + y for x in strings for y in s}
                    if len(strings) > EXACT:
                        strings = None
                        break
            elif s is not None and (low, high) == (0, 1):
                strings = s | {b""}
            elif s is not None and low:  # at least one: what stands before runs on into it, what follows starts anew
                if exact is not None and len(exact) * len(s) <= EXACT:
                    exact = {x + y for x in exact for y in s}
                close()
                whole = None
                queries.append(query)
                continue
        elif op is sc.AT:
            strings = {b""}
        if strings is not None and len(strings) > EXACT:
            strings = None
        if strings is None:
            close()
            whole = None
        elif exact is not None and len(exact) * len(strings) <= EXACT:
            exact = {x + y for x in exact for y in strings}
            whole = None if whole is None else {x + y for x in whole for y in strings}
        else:
            close()
            exact, whole = strings, None
        queries.append(query)
    last = exact if whole is None else whole
    queries.append(_held(last) if last and last != {b""} else True)
    return whole, _all(queries)


def trigram_query(rule: Rule):
    """The Boolean trigram query of the rule's pattern; True if it has no mandatory trigram."""
    return _derive(parser.parse(rule.pattern))[1]


def trigrams(query) -> set[bytes]:
    if query is True:
        return set()
    return {query[1]} if query[0] == "tri" else set().union(*(trigrams(q) for q in query[1]))


class Index:
    """Postings of a block of texts for the trigrams that queries mention."""

    def __init__(self, wanted: Sequence[bytes]):
        self.number = {t: i for i, t in enumerate(sorted(wanted))}
        self.table = np.full(1 << 24, -1, np.int16 if len(self.number) < 32768 else np.int32)
        for t, i in self.number.items():
            self.table[int.from_bytes(t, "big")] = i
        self.folded = np.arange(256, dtype=np.uint8)
        self.folded[65:91] += 32

    def postings(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean (trigrams, texts)."""
        out = np.zeros((len(self.number), len(texts)), bool)
        if not len(self.number):
            return out
        length = np.array([len(t) for t in texts])
        flat = self.folded[np.frombuffer(b"".join(texts), np.uint8)]
        ends = np.cumsum(length)
        for at in range(0, max(0, len(flat) - 2), BLOCK_BYTES):  # pieces overlap by two bytes
            f = flat[at : at + BLOCK_BYTES + 2].astype(np.int32)
            got = self.table[(f[:-2] << 16) | (f[1:-1] << 8) | f[2:]]
            where = np.flatnonzero(got >= 0)
            text = np.searchsorted(ends, where + at, "right")
            inside = where + at + 3 <= ends[text]
            out[got[where[inside]], text[inside]] = True
        return out

    def candidates(self, query, postings: np.ndarray) -> np.ndarray:
        if query is True:
            return np.ones(postings.shape[1], bool)
        if query[0] == "tri":
            return postings[self.number[query[1]]]
        parts = [self.candidates(q, postings) for q in query[1]]
        return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


def blocks(texts: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    begin, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]


class Scanner:
    def __init__(self, rules: Sequence[Rule]):
        self.rules = tuple(rules)
        self.queries = [trigram_query(r) for r in self.rules]
        self.wanted = sorted(set().union(*(trigrams(q) for q in self.queries)))

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """For each text (start, rule's number, end) in code points, sorted."""
        index, regexes = Index(self.wanted), [r.regex for r in self.rules]
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for begin, some in blocks(texts):
            postings, read = index.postings(some), {}
            for k, (rule, query, regex) in enumerate(zip(self.rules, self.queries, regexes)):
                for i in np.flatnonzero(index.candidates(query, postings)).tolist():
                    text = read.get(i)
                    if text is None:
                        text = read[i] = some[i].decode("utf-8", "surrogateescape")
                    for m in regex.finditer(text):
                        a, b = m.span(rule.group)
                        if b - a >= rule.least:
                            start, stop = m.span(rule.found)
                            out[begin + i].append((start, k, stop))
        for spans in out:
            spans.sort()
        return out


def listed(spans: list[tuple[int, int, int]], rules: Sequence[Rule]) -> str:
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """(id_col, kind, start, stop): every span found, in code points, end exclusive.  Rows without spans give none."""
    return summary(docs, id_col, text_col, rules=rules).selectExpr(f"`{id_col}`", "explode(found) AS s").select(id_col, "s.kind", "s.start", "s.stop")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, base: Sequence[Rule] = BASE_RULES, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """One row for each row of ``docs``: the id, found (array of kind, start, stop), n_<kind> of the base rules,
    base_sha256 of the base rules' spans and spans, the list of all.  Null and empty texts hold nothing;
    ids may be null or repeat; other columns are ignored."""
    rules, base = tuple(rules), tuple(base)
    scanner, n_base = Scanner(rules), len(base)
    if rules[:n_base] != base:
        raise ValueError("the base rules come first")
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = scanner.spans([t or b"" for t in utf8(b).to_pylist()])
            first = [[s for s in x if s[1] < n_base] for x in found]
            columns = [
                b.column("id"),
                pa.array([[{"kind": rules[k].kind, "start": a, "stop": e} for a, k, e in x] for x in found], pa.list_(item)),
                *(pa.array([sum(s[1] == k for s in x) for x in first], pa.int64()) for k in range(n_base)),
                pa.array([hashlib.sha256(listed(x, rules).encode()).hexdigest() for x in first], pa.string()),
                pa.array([listed(x, rules) for x in found], pa.string()),
            ]
            yield pa.record_batch(columns, ["id", "found", *(f"n_{r.kind}" for r in base), "base_sha256", "spans"])

    src = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    counts = "".join(f"n_{r.kind} long, " for r in base)
    schema = f"id {src.schema['id'].dataType.simpleString()}, found array<struct<kind:string,start:long,stop:long>>, {counts}base_sha256 string, spans string"
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def redact(docs: DataFrame, text_col: str = "text", *, count_col: str | None = None, rules: Sequence[Rule] = BASE_RULES + MORE_RULES) -> DataFrame:
    """All rows and columns of ``docs``, every secret in the text replaced by ``[kind]``; overlapping spans become one, under the
    kind that starts first.  Texts without secrets and null texts stay as they are.  ``count_col``, a column with the text's number
    of characters, is counted anew where the text changes."""
    rules = tuple(rules)
    scanner, place = Scanner(rules), docs.columns.index(text_col)
    counted = docs.columns.index(count_col) if count_col in docs.columns else None

    def cleaned(text: bytes, spans: list[tuple[int, int, int]]) -> str:
        whole, out, at = text.decode("utf-8", "surrogateescape"), [], 0
        for a, k, e in spans:
            if a >= at:
                out += [whole[at:a], f"[{rules[k].kind}]"]
            at = max(at, e)
        return "".join([*out, whole[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b, f"c{place}").to_pylist()
            new = [t if not s else cleaned(t, s).encode("utf-8", "surrogateescape") for t, s in zip(texts, scanner.spans([t or b"" for t in texts]))]
            columns = list(b.columns)
            columns[place] = pa.array(new, pa.binary()).cast(pa.string())
            if counted is not None:
                was = columns[counted]
                counts = [c if t == n else len(n.decode("utf-8", "surrogateescape")) for c, t, n in zip(was.to_pylist(), texts, new)]
                columns[counted] = pa.array(counts, was.type)
            yield pa.record_batch(columns, b.schema.names)

    src = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return src.mapInArrow(run, src.schema).toDF(*docs.columns)
