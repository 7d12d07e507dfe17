"""SentencePiece BPE by vectorised merge rounds: all words of a block as flat symbol arrays, merged together round by round."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.bpe import gather
from loomwright.llm.common import release

# Fixed values of the model files: the sign for a space; kinds of pieces; the kind of model that merges pairs; the text of the unknown piece.
SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE = 2
UNKNOWN_TEXT = " ⁇ "

#: No pair merges here.
NEVER = np.int32(2**31 - 1)
#: Symbols that are merged together; bytes of texts whose words are numbered together, and different words of such a block.
CHUNK, BLOCK_BYTES, BLOCK_WORDS = 1 << 19, 16 << 20, 300_000
#: Characters of a text that are split into words at a time.
SLICE = 1 << 20
#: A word that so often had to wait for a pair of its own goes through a queue instead of further rounds.
WAITS = 48


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def whole() -> int:
        nonlocal at
        x = shift = 0
        while True:
            c = raw[at]
            at, x, shift = at + 1, x | (c & 127) << shift, shift + 7
            if c < 128:
                return x

    while at < len(raw):
        key = whole()
        if key & 7 == 0:
            yield key >> 3, whole()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or whole()
        yield key >> 3, raw[at : at + n]
        at += n


class Pieces:
    """A BPE model file with byte fallback and without rewriting of characters.

    Symbols below size are ids of pieces; a character that is no piece is the symbol size + its code point. keys are
    sorted pairs of symbols (the first shifted by 32 bits) that merge, merged their pieces. ranks has the order of the
    pieces by falling score; pieces of one score share a rank. inner has the pairs of characters that stand side by side
    in some piece: no symbol ever spans another pair.
    """

    def __init__(self, path: str):
        with open(path, "rb") as f:
            parts = list(_fields(f.read()))
        found = [dict(_fields(v)) for k, v in parts if k == 1]
        trainer, normal = ({k: v for n, raw in parts if n == own for k, v in _fields(raw)} for own in (2, 3))
        self.prefix = bool(normal.get(3, 1))
        kinds = [x.get(3, NORMAL) for x in found]
        if trainer.get(3) != BPE or not trainer.get(35) or trainer.get(24) or normal.get(2) or normal.get(4, 1) or not normal.get(5, 1) or set(kinds) - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("only BPE models with byte fallback are read, that rewrite nothing but spaces and have no pieces of users")
        names, self.size = [x[1].decode() for x in found], len(found)
        scores = np.array([struct.unpack("<f", x[2])[0] if 2 in x else 0.0 for x in found])
        self.ranks = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        own = {s: i for i, (s, kind) in enumerate(zip(names, kinds)) if kind == NORMAL}
        self.bytes = np.zeros(256, np.int32)
        self.bytes[[int(s[3:5], 16) for s, kind in zip(names, kinds) if kind == BYTE]] = [i for i, kind in enumerate(kinds) if kind == BYTE]
        self.symbol = np.arange(self.size, self.size + 0x110000, dtype=np.int32)
        for s, i in own.items():
            if len(s) == 1:
                self.symbol[ord(s)] = i
        of = lambda s: own.get(s, int(self.symbol[ord(s)]) if len(s) == 1 else None)
        pairs = {a << 32 | b: i for s, i in own.items() for k in range(1, len(s)) if (a := of(s[:k])) is not None and (b := of(s[k:])) is not None}
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in sorted(pairs)], np.int32)
        self.inner = np.unique(np.array([ord(a) << 32 | ord(b) for s in own for a, b in zip(s, s[1:])], np.int64))
        self.word = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if not any(re.search(f"[^{SPACE}]{SPACE}", s) for s in own) else None
        self.text = [bytes([int(s[3:5], 16)]) if kind == BYTE else b"" if kind == CONTROL else UNKNOWN_TEXT.encode() if kind == UNKNOWN else s.replace(SPACE, " ").encode() for s, kind in zip(names, kinds)]

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols; NEVER where they don't merge."""
        key = a.astype(np.int64) << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        if not len(self.keys):
            return np.full(len(key), NEVER), np.zeros(len(key), np.int32)
        piece = self.merged[at]
        return np.where(self.keys[at] == key, self.ranks[piece], NEVER), piece

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, some at a time. No piece has a space sign behind another character, so that merges don't
        cross words; where a model has such a piece the whole text is one word."""
        if not text:
            return
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if self.word is None:
            yield [text]
            return
        edge, at = re.compile(f"[^{SPACE}]{SPACE}"), 0
        while at < len(text):
            found = edge.search(text, at + SLICE)
            end = found.start() + 1 if found else len(text)
            yield self.word.findall(text, at, end)
            at = end


def _queue(pieces: Pieces, symbols: list[int]) -> list[int]:
    """The symbols of one word merged one pair at a time, by rank and then from left to right."""
    n, known, ranks = len(symbols), {}, pieces.ranks

    def pair(a: int, b: int) -> int:
        if (key := a << 32 | b) not in known:
            at = int(np.searchsorted(pieces.keys, key))
            known[key] = int(pieces.merged[at]) if at < len(pieces.keys) and pieces.keys[at] == key else -1
        return known[key]

    symbols, after, before = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
    due = [pair(a, b) for a, b in zip(symbols, symbols[1:])] + [-1]
    heap = [(int(ranks[p]), i) for i, p in enumerate(due) if p >= 0]
    heapify(heap)
    while heap:
        rank, i = heappop(heap)
        if due[i] < 0 or ranks[due[i]] != rank:
            continue
        j = after[i]
        symbols[i], symbols[j], due[j] = due[i], -1, -1
        k = after[i] = after[j]
        due[i] = -1
        if k < n:
            before[k] = i
            due[i] = pair(symbols[i], symbols[k])
        if (p := before[i]) >= 0:
            due[p] = pair(symbols[p], symbols[i])
        for at in (p, i):
            if at >= 0 and due[at] >= 0:
                heappush(heap, (int(ranks[due[at]]), at))
    return [s for s in symbols if s >= 0]


def merge_rounds(pieces: Pieces, points: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of so many code points each, one after another, to symbols in order, with the place where each begins.

    All words lie in flat arrays. A round finds the least rank of the pairs of each word and merges all its pairs of that
    rank, from left to right; merged symbols are compacted away, pairs are looked up anew only beside them, and words
    without a pair leave. Should a merge make a pair of no higher rank, later merges of that word wait for the next round,
    as that pair comes first where words are merged one pair at a time. Words are cut where no piece has both
    characters side by side.
    """
    n = len(points)
    begin = np.zeros(n, bool)
    begin[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    if n > 1:
        side = points[:-1].astype(np.int64) << 32 | points[1:]
        at = np.minimum(np.searchsorted(pieces.inner, side), max(len(pieces.inner) - 1, 0))
        begin[1:] |= pieces.inner[at] != side if len(pieces.inner) else True
    done = pieces.symbol[points]
    place = np.zeros(n, bool)
    symbol, where = done.copy(), np.arange(n, dtype=np.int32)
    starts = np.flatnonzero(begin)
    rank, piece = np.full(n, NEVER), np.zeros(n, np.int32)
    inside = np.flatnonzero(~begin[1:]) if n > 1 else np.zeros(0, np.int64)
    rank[inside], piece[inside] = pieces.pair(symbol[inside], symbol[inside + 1])
    waited = np.zeros(len(starts), np.int32)
    while len(symbol):
        lengths = np.diff(starts, append=len(symbol))
        least = np.minimum.reduceat(rank, starts)
        leave = least == NEVER
        for k in np.flatnonzero(waited > WAITS):
            own = slice(starts[k], starts[k] + lengths[k])
            got = _queue(pieces, symbol[own].tolist())
            symbol[own.start : own.start + len(got)] = got
            # Places within the word only have to rise.
            symbol[own.start + len(got) : own.stop] = -1
            leave[k] = True
        if leave.any():
            out = np.repeat(leave, lengths)
            out_where, out_symbol = where[out], symbol[out]
            real = out_symbol >= 0
            done[out_where[real]], place[out_where[real]] = out_symbol[real], True
            stay = ~out
            symbol, where, rank, piece = symbol[stay], where[stay], rank[stay], piece[stay]
            lengths, least, waited = lengths[~leave], least[~leave], waited[~leave]
            starts = np.cumsum(lengths) - lengths
            if not len(symbol):
                break
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        hit = np.flatnonzero(rank == least[word])
        # Of pairs that overlap every second one merges, from the left.
        run = np.flatnonzero(np.diff(hit, prepend=-2) != 1)
        hit = hit[(np.arange(len(hit)) - np.repeat(run, np.diff(run, append=len(hit)))) % 2 == 0]
        new, of = piece[hit], word[hit]
        several = np.bincount(of, minlength=len(lengths)) > 1
        if several.any():
            k = np.flatnonzero(several[of])
            i, own, low = hit[k], of[k], np.full(len(k), NEVER)
            right, left = i + 2 < starts[own] + lengths[own], i > starts[own]
            low[right] = pieces.pair(new[k][right], symbol[i[right] + 2])[0]
            follows = np.concatenate([[False], hit[1:] == hit[:-1] + 2])[k]
            beside = np.where(follows, new[np.maximum(k - 1, 0)], symbol[np.maximum(i - 1, 0)])
            low[left] = np.minimum(low[left], pieces.pair(beside[left], new[k][left])[0])
            early = np.zeros(len(hit), bool)
            early[k] = low <= least[own]
            if early.any():
                first = np.full(len(lengths), len(hit))
                np.minimum.at(first, of[early], np.flatnonzero(early))
                late = np.arange(len(hit)) > first[of]
                waited[np.unique(of[late])] += 1
                hit, new, of = hit[~late], new[~late], of[~late]
        symbol[hit] = new
        stay = np.ones(len(symbol), bool)
        stay[hit + 1] = False
        at = hit - np.arange(len(hit))
        symbol, where, rank, piece = symbol[stay], where[stay], rank[stay], piece[stay]
        lengths = lengths - np.bincount(of, minlength=len(lengths))
        starts = np.cumsum(lengths) - lengths
        ends = starts + lengths - 1
        touched = np.unique(np.concatenate([at, (at - 1)[at > starts[of]]]))
        owner = np.searchsorted(starts, touched, side="right") - 1
        last = touched == ends[owner]
        rank[touched[last]] = NEVER
        touched = touched[~last]
        rank[touched], piece[touched] = pieces.pair(symbol[touched], symbol[touched + 1])
    places = np.flatnonzero(place)
    return done[places], places


def encode_words(pieces: Pieces, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words one after another, and how many each word has."""
    flat, counts, at = [], [], 0
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths)
    while at < len(words):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
        points = np.frombuffer("".join(words[at:end]).encode("utf-32-le", "surrogatepass"), "<u4")
        symbols, places = merge_rounds(pieces, points, lengths[at:end])
        point = np.maximum(symbols - pieces.size, 0)
        size = np.where(symbols < pieces.size, 1, 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF))
        begins = np.cumsum(size) - size
        ids = np.zeros(int(size.sum()), np.int32)
        ids[begins[symbols < pieces.size]] = symbols[symbols < pieces.size]
        for c in np.unique(symbols[symbols >= pieces.size]).tolist():
            own = pieces.bytes[list(chr(c - pieces.size).encode("utf-8", "surrogatepass"))]
            ids[begins[symbols == c][:, None] + np.arange(len(own))] = own
        owner = np.searchsorted(np.cumsum(lengths[at:end]), places, side="right")
        flat.append(ids)
        counts.append(np.bincount(owner, weights=size, minlength=end - at).astype(np.int64))
        at = end
    return (np.concatenate(flat), np.concatenate(counts)) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))


class Table:
    """Byte strings by number, to be put together for many numbers at a time."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), np.int64, len(strings))
        self.begins, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(strings), np.uint8)

    def parts(self, ids: np.ndarray) -> Iterator[bytes]:
        for at in range(0, len(ids), 1 << 20):
            own = ids[at : at + (1 << 20)]
            yield gather(self.flat, self.begins[own], self.sizes[own]).tobytes()


def decoded(pieces: Pieces, table: Table, ids: np.ndarray) -> bytes:
    """The text of ids that a text was encoded to, without the space put before it."""
    back = b"".join(table.parts(ids))
    return back[1:] if pieces.prefix and back[:1] == b" " else back


def _figures(path: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path)
        texts, numerals = Table(pieces.text), Table([b"%d," % i for i in range(pieces.size)])
        numbers: dict[str, int] = {}
        held: list[tuple[pa.Array, list[np.ndarray]]] = []
        kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}

        def close() -> Iterator[pa.RecordBatch]:
            flat, sizes = encode_words(pieces, list(numbers))
            begins = np.cumsum(sizes) - sizes
            for rows, words in held:
                out: dict[str, list] = {k: [] for k in names[1:]}
                for own in words:
                    ids = gather(flat, begins[own], sizes[own])
                    digest, rest = hashlib.sha256(), len(ids)
                    for part in numerals.parts(ids):
                        rest -= 1 << 20
                        digest.update(part if rest > 0 else part[:-1])
                    back = decoded(pieces, texts, ids)
                    figures = {"n_tokens": len(ids), "ids_sha256": digest.hexdigest(), "decoded_sha256": hashlib.sha256(back).hexdigest()}
                    figures |= {"ids": ids} if "ids" in out else {}
                    figures |= {"decoded": back.decode("utf-8", "replace")} if "decoded" in out else {}
                    for k, v in figures.items():
                        out[k].append(v)
                yield pa.RecordBatch.from_arrays([rows, *(pa.array(v, kinds.get(k, pa.string())) for k, v in out.items())], names)
            held.clear()
            numbers.clear()

        size = 0
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part, words = b.slice(at, 64), []
                for text in part.column(1).to_pylist():
                    own = [np.fromiter((numbers.setdefault(w, len(numbers)) for w in some), np.uint32, len(some)) for some in pieces.words(text or "")]
                    words.append(np.concatenate(own) if own else np.zeros(0, np.uint32))
                held.append((part.column(0), words))
                size += part.nbytes
                if size >= BLOCK_BYTES or len(numbers) >= BLOCK_WORDS:
                    yield from close()
                    size = 0
        yield from close()
        release()

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """id, the columns to keep, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded text.

    path: the model file, there on every worker. Every text is encoded whole, as the sentencepiece library encodes it with
    that model, without begin and end, and decoded again; null counts as empty and has no ids. Rows that repeat an id, and
    null ids, are rows of their own. Empty tables give none. A long text, or a long word, has to fit a worker's
    memory some dozen times. Other columns are not read; a kept column may not bear the name of a figure.

    Nothing is dealt out: a task numbers the different words of a block of texts and merges these together in rounds.
    """
    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {}) | ({"decoded": "string"} if with_text else {})
    if clash := {id_col, *keep} & {*kinds}:
        raise ValueError(f"columns {sorted(clash)} bear names of figures; rename them first")
    src = docs.select(F.struct(docs[id_col].alias(id_col), *(docs[c] for c in keep)).alias("_row"), docs[text_col].cast("string").alias("_text"))
    out = src.mapInArrow(_figures(path, ["_row", *kinds]), f"`_row` {src.schema['_row'].dataType.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))
    return out.select("_row.*", *kinds)
