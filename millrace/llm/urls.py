"""URL filters by a bit-parallel wildcard automaton.

All glob rules are packed side by side into words of 64 bits.  One Shift-And step reads a byte of every URL of a batch
at once: a state moves on if the byte fits the next symbol of its pattern, and stays if a ``*`` stands there.  A few long URLs are read by the same
automaton with one long integer for all words.
Rules are globs over a canonical URL ``.host<sep>path``: A-Z lower-cased, unreserved characters that are percent-encoded decoded, and a separator (byte 255)
that occurs in no UTF-8 text.  Host rules compare the path as it is, so they have an automaton of their own.
"""

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SEPARATOR = b"\xff"
#: URLs are simulated in groups of about this many bytes (columns of equal position); groups of fewer are read one by one.
GROUP_BYTES, FEW = 1 << 22, 24


@dataclass(frozen=True)
class HostRule:
    """Fits ``host`` and its subdomains where the URL's path starts with ``path``; the longest fitting rule wins."""

    action: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the rule set that the query applies.
HOST_RULES = (
    HostRule("block", "net", "/"),
    HostRule("allow", "example.net", "/en/"),
    HostRule("block", "example.com", "/de/"),
    HostRule("allow", "org", "/fr/"),
)
#: Globs over the canonical host and path for what no host rule decides (``*`` any run of characters, ``?`` any one).
BLOCK_GLOBS = (
    "*casino*", "*free-bets*", "*cheap-pills*", "*ads-track*", "*viagra*", "*/wp-login*", "*porn*",
    "*/wp-admin/*", "*/xmlrpc.php*", "*/cgi-bin/*.cgi", "*/phpmyadmin/*", "*.exe", "*.apk", "*.scr",
    "*poker-*", "*slot-machine*", "*sports-bet*", "*lottery-win*", "*payday-loan*", "*replica-watch*", "*pharmacy-online*", "*weight-loss-pill*",
    "*keygen*", "*crack-serial*", "*warez*", "*torrent-download*", "*escort-*", "*xxx-video*", "*webcam-girls*",
    ".ads.*", ".adserver?.*", ".track?.*", ".click?.*", "*phishing*", "*malware*",
)

_ENCODED = re.compile(rb"%[0-9A-Fa-f]{2}")
_UNRESERVED = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")


class Automaton:
    """Shift-And masks of glob patterns over the bytes of UTF-8; a match covers the whole input."""

    def __init__(self, patterns: Sequence[bytes]):
        symbols: list[int] = []  # -1 the first byte of any character
        self.last, starts, loops = [], [], []
        for pattern in patterns:
            starts.append(len(symbols))
            symbols.append(-2)  # state before the first symbol: holds no byte
            loops.append(False)
            for c in pattern:
                if c == ord("*"):
                    loops[-1] = True
                else:
                    symbols.append(-1 if c == ord("?") else c)
                    loops.append(False)
            self.last.append(len(symbols) - 1)
        first = [c for c in range(256) if not 128 <= c < 192]
        self.moves, self.stays, self.start = [0] * 256, [0] * 256, sum(1 << i for i in starts)
        for i, (symbol, loop) in enumerate(zip(symbols, loops)):
            for c in first if symbol == -1 else [symbol] if symbol >= 0 else []:
                self.moves[c] |= 1 << i
            for c in range(256) if loop else range(128, 192) if symbol == -1 else []:  # the other bytes of a character
                self.stays[c] |= 1 << i
        self.words = max(1, -(-len(symbols) // 64))
        self.move, self.stay, self.begin = (np.array([self._split(x) for x in xs], np.uint64) for xs in (self.moves, self.stays, [self.start]))

    def _split(self, bits: int) -> list[int]:
        return [bits >> 64 * k & (1 << 64) - 1 for k in range(self.words)]

    def matches(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean (texts, patterns)."""
        out = np.zeros((len(texts), len(self.last)), bool)
        length = np.array([len(t) for t in texts], np.int64)
        order = np.argsort(length, kind="stable")
        at = 0
        while at < len(order):  # the longest run of the next URLs whose columns hold GROUP_BYTES at most
            width = np.maximum(length[order[at:]], 1)
            n = max(1, int(np.searchsorted(width * np.arange(1, len(width) + 1), GROUP_BYTES, "right")))
            some = order[at : at + n]
            out[some] = self._run([texts[i] for i in some]) if n >= FEW else [self._read(texts[i]) for i in some]
            at += n
        return out

    def _read(self, text: bytes) -> list[bool]:
        state, moves, stays = self.start, self.moves, self.stays
        for c in text:
            state = (state << 1) & moves[c] | state & stays[c]
        return [bool(state >> i & 1) for i in self.last]

    def _run(self, texts: list[bytes]) -> np.ndarray:
        """``texts`` sorted by length: those that have ended drop off the front."""
        length = np.array([len(t) for t in texts])
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum(length) - length
        state = np.repeat(self.begin, len(texts), 0)
        one, top = np.uint64(1), np.uint64(63)
        for j in range(int(length[-1]) if len(length) else 0):
            done = int(np.searchsorted(length, j, "right"))
            now = state[done:]
            shifted = now << one
            if self.words > 1:
                shifted[:, 1:] |= now[:, :-1] >> top
            byte = flat[begin[done:] + j]
            state[done:] = (shifted & self.move[byte]) | (now & self.stay[byte])
        last = np.array(self.last, int)
        return (state[:, last // 64] >> (last % 64).astype(np.uint64)) & one != 0


def canonical(host: bytes, path: bytes) -> bytes:
    def decoded(m: re.Match) -> bytes:
        c = int(m[0][1:], 16)
        return bytes([c]) if c in _UNRESERVED else m[0]

    own = lambda x: (_ENCODED.sub(decoded, x) if b"%" in x else x).lower()
    return b"." + own(host) + SEPARATOR + own(path)


def split_url(url: bytes | None) -> tuple[bytes, bytes]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, found, rest = (url or b"").partition(b"://")
    if not found:
        return b"", b""
    end = min((i for i in (rest.find(b"?"), rest.find(b"#")) if i >= 0), default=len(rest))
    host, slash, path = rest[:end].partition(b"/")
    return host.lower(), slash + path


@dataclass(frozen=True)
class Rules:
    """Host rules and block globs, compiled."""

    host_rules: tuple[HostRule, ...]
    hosts: Automaton
    globs: Automaton

    def judge(self, urls: Sequence[bytes | None]) -> list[tuple]:
        """(host, path, rule or None, verdict) of each URL."""
        parts = [split_url(u) for u in urls]
        hits = self.hosts.matches([b"." + h + SEPARATOR + p for h, p in parts])
        rank = sorted(range(len(self.host_rules)), key=lambda i: -len(self.host_rules[i].text))
        ranked = hits[:, rank]
        best = np.where(ranked.any(1), ranked.argmax(1), -1) if rank else np.full(len(parts), -1)
        caught = self.globs.matches([canonical(h, p) for h, p in parts]).any(1)
        out = []
        for (host, path), b, c in zip(parts, best.tolist(), caught.tolist()):
            rule = self.host_rules[rank[b]] if b >= 0 else None
            verdict = rule.action if rule else "block" if c else "allow"
            out.append((host, path, rule.text if rule else None, verdict))
        return out


def compile_rules(host_rules: Sequence[HostRule], block_globs: Sequence[str]) -> Rules:
    for r in host_rules:
        if set(r.text) & set("*?"):
            raise ValueError(f"host rules hold no wildcards: {r.text}")
    by_host = [b"*." + r.host.encode() + SEPARATOR + r.path.encode() + b"*" for r in host_rules]
    return Rules(tuple(host_rules), Automaton(by_host), Automaton([g.lower().encode() for g in block_globs]))


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", *, host_rules: Sequence[HostRule] = HOST_RULES, block_globs: Sequence[str] = BLOCK_GLOBS) -> DataFrame:
    """(id_col, host, path, rule, verdict) for every row; other columns are ignored, so only these two are read.

    A null URL or one without ``://`` has an empty host and path and is decided by the globs (so normally allowed).
    Repeated rows are judged each on its own; ids may be null; URLs are read whole, however long.
    """
    rules = compile_rules(host_rules, block_globs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls = b.column("url").cast(pa.binary()).to_pylist()
            rows = rules.judge(urls) if urls else []
            host, path, rule, verdict = zip(*rows) if rows else ((), (), (), ())
            yield pa.record_batch(
                [b.column("id"), pa.array(host, pa.binary()).cast(pa.string()), pa.array(path, pa.binary()).cast(pa.string()), pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                ["id", "host", "path", "rule", "verdict"],
            )

    src = pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"))
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("id", id_col)
