"""URL filters by a bit-parallel wildcard automaton (multiword Shift-And)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Symbols are the bytes 0-255 of the canonical URL, and one that stands between its host and its path.
BORDER = 256


@dataclass(frozen=True)
class Rule:
    """allow or block for one host with all its subdomains, and for paths with this prefix."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class GlobAutomaton:
    """All patterns at once over each URL.

    A pattern is a list of elements: a symbol, or (symbol set, True) for a star that repeats symbols of the set. Each
    symbol of each pattern is one bit; bit i is set when the pattern has matched up to its i-th symbol. Stars are
    self-loops on the bit before them. The bits of all patterns are packed into 64-bit words, one row of words per URL,
    and a step of the automaton handles the next byte of every URL of the block:

        state = ((state << 1) & has[symbol]) | (state & stays[symbol])

    A pattern has a bit in front, set at the start, that stands for "nothing read yet", so that it can begin with a star.
    """

    def __init__(self, patterns: list[list]):
        bits = sum(1 + sum(not isinstance(e, frozenset) for e in p) for p in patterns)
        self.words = max(1, -(-bits // 64))
        has, stays = np.zeros((257, bits), bool), np.zeros((257, bits), bool)
        start, accept, at = np.zeros(bits, bool), [], 0
        for p in patterns:
            start[at] = True
            for e in p:
                if isinstance(e, frozenset):
                    stays[list(e), at] = True
                else:
                    at += 1
                    has[e, at] = True
            accept.append(at)
            at += 1
        self.accept = np.array(accept, np.int64)
        self.has, self.stays, self.start = (self._pack(x) for x in (has, stays, start[None]))

    def _pack(self, x: np.ndarray) -> np.ndarray:
        full = np.zeros((len(x), self.words * 64), bool)
        full[:, : x.shape[1]] = x
        return np.packbits(full, axis=1, bitorder="little").view("<u8")

    def match(self, urls: list[tuple[bytes, bytes]]) -> np.ndarray:
        """A row per (host, path), a column per pattern."""
        out = np.zeros((len(urls), len(self.accept)), bool)
        if not urls or not len(self.accept):
            return out
        hosts = np.array([len(h) for h, _ in urls], np.int64)
        sizes = np.array([len(h) + 1 + len(p) for h, p in urls], np.int64)
        flat = np.frombuffer(b"".join(h + b"\0" + p for h, p in urls), np.uint8)
        order = np.argsort(-sizes, kind="stable")
        begin = (np.cumsum(sizes) - sizes)[order]
        hosts, sizes = hosts[order], sizes[order]
        state = np.repeat(self.start, len(urls), axis=0)
        live = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), side="right")
        for i, n in enumerate(live.tolist()):  # the URLs that have an i-th symbol come first
            symbol = flat[begin[:n] + i].astype(np.int64)
            symbol[hosts[:n] == i] = BORDER
            now = state[:n]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:n] = (moved & self.has[symbol]) | (now & self.stays[symbol])
        hit = (state[:, self.accept // 64] >> (self.accept % 64).astype(np.uint64)) & np.uint64(1)
        out[order] = hit.astype(bool)
        return out


_ANY_HOST = frozenset(range(256))
_ANY_PATH = frozenset(range(256))
_LABEL = frozenset(set(range(256)) - {ord(".")})


def compile_rule(rule: Rule) -> list[list]:
    """The host itself, or any subdomain of it; then the path and whatever follows it."""
    tail = [*rule.host.lower().encode(), BORDER, *rule.path.encode(), _ANY_PATH]
    return [tail, [_ANY_HOST, ord("."), *tail]]


def compile_glob(glob: str) -> list:
    """host-glob/path-glob; ** crosses dots in the host, * stays inside a label there and matches anything in the path.

    A glob without a slash holds for every path.
    """
    host, slash, path = glob.partition("/")
    out: list = []
    for k, part in enumerate(host.lower().split("**")):
        if k:
            out.append(_ANY_HOST)
        for i, piece in enumerate(part.split("*")):
            out += ([_LABEL] if i else []) + list(piece.encode())
    out.append(BORDER)
    if not slash:
        return [*out, _ANY_PATH]
    for i, piece in enumerate(("/" + path).split("*")):
        out += ([_ANY_PATH] if i else []) + list(piece.encode())
    return out


def canonical(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path without query and fragment; both empty for null or without "://"."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in (rest.find(c) for c in "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:end].encode(errors="surrogatepass").lower().decode(errors="surrogatepass"), rest[end:]
    end = min((i for i in (rest.find(c) for c in "?#") if i >= 0), default=len(rest))
    return host, rest[:end]


class UrlFilter:
    """Explicit rules first, the longest that fits wins (host and path taken together; of two as long, the earlier).

    Without a fitting rule the globs decide: a URL that any block glob matches is blocked, any other is allowed.
    """

    def __init__(self, rules: list[Rule], block_globs: list[str] = ()):
        self.rules = sorted(rules, key=lambda r: -len(r.name))
        self.automaton = GlobAutomaton([p for r in self.rules for p in compile_rule(r)] + [compile_glob(g) for g in block_globs])

    def judge(self, urls: list[str | None]) -> dict[str, list]:
        split = [canonical(u) for u in urls]
        hits = self.automaton.match([(h.encode(errors="surrogatepass"), p.encode(errors="surrogatepass")) for h, p in split])
        n = len(self.rules)
        fits = hits[:, : 2 * n].reshape(len(urls), n, 2).any(axis=2)
        globs = hits[:, 2 * n :].any(axis=1)
        first = np.where(fits.any(axis=1), fits.argmax(axis=1) if n else 0, -1).tolist()
        return {
            "host": [h for h, _ in split], "path": [p for _, p in split],
            "rule": [self.rules[k].name if k >= 0 else None for k in first],
            "verdict": [self.rules[k].verdict if k >= 0 else "block" if g else "allow" for k, g in zip(first, globs.tolist())],
        }


#: At most so many URLs, or so many bytes of them, are simulated together.
BLOCK_ROWS, BLOCK_BYTES = 8192, 4 << 20


def filter_urls(pages: DataFrame, rules: list[Rule], block_globs: list[str] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict for each row of pages; a narrow pass that reads two columns.

    Null or empty URLs and those without "://" have empty host and path, no rule, and the verdict of the globs. URLs of
    any length are read whole. Of rules of equal length the one given first wins. Repeated rows, and null ids, are judged
    each for itself. Empty tables give none. Other columns are not read and can't clash.
    """
    judge = UrlFilter(list(rules), list(block_globs))
    src = pages.select(pages[id_col].alias("_id"), pages[url_col].cast("string").alias("_url"))
    kind = src.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            urls, at = b.column(1).to_pylist(), 0
            while at < len(urls):
                end, size = at, 0
                while end < len(urls) and end - at < BLOCK_ROWS and (size := size + len(urls[end] or "")) <= BLOCK_BYTES or end == at:
                    end += 1
                got = judge.judge(urls[at:end])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), *(pa.array(got[k], pa.string()) for k in ("host", "path", "rule", "verdict"))], [id_col, "host", "path", "rule", "verdict"])
                at = end

    return src.mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")
