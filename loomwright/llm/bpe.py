"""Byte-level BPE by corpus-level merge replay: merges are applied to the different words of the corpus together, by rank."""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomwright.llm.common import release, shared_dir, written
from loomwright.llm.hash_arrays import forget, load, save, top_bucket


class Ranks:
    """A vocabulary file of lines "base64 rank"."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.take({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def take(self, of: dict[bytes, int]) -> None:
        """pairs: the rank of each two tokens that are one together, under the first shifted by 32 bits, and the second."""
        self.of, self.byte = of, [of.get(bytes([b])) for b in range(256)]
        self.token = {r: t for t, r in of.items()}
        self.pairs = {of[t[:i]] << 32 | of[t[i:]]: r for t, r in of.items() for i in range(1, len(t)) if t[:i] in of and t[i:] in of}


def replay(words: list[bytes], ranks: Ranks) -> list[list[int]]:
    """The ids of each word. A word that is a token itself is that token.

    The words lie one after another as a linked list of tokens. An inverted index has, for each rank, the positions of
    the pairs that merge to it. The lowest rank is taken off a heap and its merge applied at all its positions, from
    left to right; only the pairs with the touched neighbours are looked up anew. Should a merge make a pair of no higher
    rank, the rest of that word waits until the new pair had its turn, as it would if each word were encoded alone.
    """
    tokens: list[int] = []
    owner: list[int] = []
    after: list[int] = []
    before: list[int] = []
    due: list[int] = []
    starts: list[int] = []
    rank_of, byte, get = ranks.of.get, ranks.byte.__getitem__, ranks.pairs.get
    index: dict[int, list[int]] = {}
    for w, word in enumerate(words):
        begin = len(tokens)
        starts.append(begin if word else -1)
        whole = rank_of(word)
        if whole is not None:
            ids = [whole]
        else:
            ids = list(map(byte, word))
        n = len(ids)
        tokens += ids
        owner += [w] * n
        before += range(begin - 1, begin + n - 1)
        after += range(begin + 1, begin + n + 1)
        if n:
            before[begin] = after[-1] = -1
            # The rank of each pair, -1 for none.
            own = [get(a << 32 | b, -1) for a, b in zip(ids, ids[1:])]
            for i, r in enumerate(own, begin):
                if r >= 0:
                    if r in index:
                        index[r].append(i)
                    else:
                        index[r] = [i]
            due += own
            due.append(-1)
    heap = list(index)
    heapify(heap)
    while heap:
        r = heappop(heap)
        at = index.pop(r)
        at.sort()
        waits = -1
        for i in at:
            if due[i] != r:
                continue
            if owner[i] == waits:
                if r in index:
                    index[r].append(i)
                else:
                    index[r] = [i]
                    heappush(heap, r)
                continue
            j = after[i]
            tokens[i] = r
            due[j] = -1
            k = after[i] = after[j]
            low = False
            if k >= 0:
                before[k] = i
                s = due[i] = get(r << 32 | tokens[k], -1)
                if s >= 0:
                    low = s <= r
                    if s in index:
                        index[s].append(i)
                    else:
                        index[s] = [i]
                        heappush(heap, s)
            else:
                due[i] = -1
            p = before[i]
            if p >= 0:
                s = due[p] = get(tokens[p] << 32 | r, -1)
                if s >= 0:
                    low = low or s <= r
                    if s in index:
                        index[s].append(p)
                    else:
                        index[s] = [p]
                        heappush(heap, s)
            if low:
                waits = owner[i]
    out = []
    for i in starts:
        ids = []
        while i >= 0:
            ids.append(tokens[i])
            i = after[i]
        out.append(ids)
    return out


#: A block of texts has its own numbering of words, until it has so many characters or different words.
BLOCK_CHARS, BLOCK_WORDS = 64 << 20, 800_000
#: Words of a block that go into one row; words of all blocks that meet in one bucket, under one inverted index.
CHUNK, BUCKET = 65536, 250_000


class _Numbers(dict):
    """Words in the order of first sight."""

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        return at


def _packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers as compressed byte planes; none is no byte."""
    return zstandard.ZstdCompressor(level=1).compress(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()) if len(numbers) else b""


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint32)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob, max_output_size=4 * n), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _compressed(at: np.ndarray, sizes: np.ndarray, flat: bytes) -> bytes:
    """Numbers, as many sizes, and the bytes of things of these sizes."""
    body = zstandard.ZstdCompressor(level=1).compress(b"".join(x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for x in (np.diff(at, prepend=0), sizes)) + flat)
    return len(at).to_bytes(8, "little") + (8 * len(at) + len(flat)).to_bytes(8, "little") + body


def _expanded(blob: bytes) -> tuple[np.ndarray, np.ndarray, bytes]:
    n, size = (int.from_bytes(blob[i : i + 8], "little") for i in (0, 8))
    raw = zstandard.ZstdDecompressor().decompress(blob[16:], max_output_size=size)
    steps, sizes = (np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 4 * n * k).reshape(4, n).T).view("<u4").ravel() for k in (0, 1))
    return np.cumsum(steps.astype(np.int64)), sizes.astype(np.int64), raw[8 * n :]


def _planes(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _split(pattern: str, row: pa.DataType):
    """Rows of two kinds: each text as numbers of the words of its block; and the words of a block, a chunk a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, numbers, chars = regex.compile(pattern).findall, _Numbers(), 0
        block = TaskContext.get().partitionId() << 32
        names = ["_row", "block", "n", "blob", "words"]

        def close() -> Iterator[pa.RecordBatch]:
            words = list(numbers)
            for at in range(0, len(words), CHUNK):
                part = [w.encode() for w in words[at : at + CHUNK]]
                blob = _compressed(np.arange(at, at + len(part)), np.fromiter(map(len, part), np.int64, len(part)), b"".join(part))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, row), pa.array([block]), pa.nulls(1, pa.int64()), pa.array([blob], pa.binary()), pa.array([len(part)])], names)
            numbers.clear()

        for b in batches:
            at, sizes = 0, np.asarray(pc.fill_null(pc.binary_length(b.column(1)), 0)).tolist()
            while at < b.num_rows:
                end, size, counts, blobs = at, 0, [], []
                while end < b.num_rows and end - at < 256 and (end == at or size + sizes[end] <= 4 << 20):
                    size, end = size + sizes[end], end + 1
                for text in b.column(1).slice(at, end - at).to_pylist():
                    found = find(text) if text else []
                    counts.append(len(found))
                    blobs.append(_packed(np.fromiter(map(numbers.__getitem__, found), np.uint32, len(found))))
                n = end - at
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), pa.array([block] * n, pa.int64()), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary()), pa.nulls(n, pa.int64())], names)
                chars, at = chars + size, end
                if chars >= BLOCK_CHARS or len(numbers) >= BLOCK_WORDS:
                    yield from close()
                    block, chars = block + 1, 0
        yield from close()
        release()

    return run


def _deal(buckets: int):
    """The words of each block, by bucket of their hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, sizes, flat = _expanded(blob)
                ends = np.cumsum(sizes).tolist()
                words = [flat[i:j] for i, j in zip([0, *ends], ends)]
                to = top_bucket(np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)), buckets)
                order = np.argsort(to, kind="stable")
                edges = np.flatnonzero(np.diff(to[order], prepend=-1, append=-1))
                out = []
                for i, j in zip(edges[:-1], edges[1:]):
                    own = order[i:j]
                    part = [words[k] for k in own.tolist()]
                    out.append(_compressed(at[own], sizes[own], b"".join(part)))
                yield pa.RecordBatch.from_arrays([pa.array(to[order][edges[:-1]], pa.int32()), pa.array([block] * len(out), pa.int64()), pa.array(out, pa.binary())], ["bucket", "block", "blob"])

    return run


def _replayed(path: str):
    """A bucket's different words are replayed once each, under one index; every block gets the ids of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, held = _Numbers(), []
        for b in batches:
            for block, blob in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                at, sizes, flat = _expanded(blob)
                ends = np.cumsum(sizes).tolist()
                held.append((block, at, np.fromiter((numbers[flat[i:j]] for i, j in zip([0, *ends], ends)), np.int64, len(at))))
        if not held:
            return
        parts = [array("I", x) for x in replay(list(numbers), Ranks(path))]
        numbers.clear()
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        flat, begins = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(sizes) - sizes
        for block, at, own in held:
            ids = gather(flat, begins[own], sizes[own])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([_compressed(at, sizes[own], _planes(ids))], pa.binary())], ["block", "blob"])
        release()

    return run


def _save_blocks(folder: str):
    """Rows come sorted by block: a file for each with its words' numbers of ids, and the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []

        def close() -> pa.RecordBatch:
            at, sizes = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
            flat = np.concatenate([_from_planes(p[2]) for p in parts])
            order, begins = np.argsort(at), np.cumsum(sizes) - sizes
            whole = _compressed(at[order], sizes[order], _planes(gather(flat, begins[order], sizes[order])))
            save(f"{folder}/{block}", np.frombuffer(whole, np.uint8))
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], ["block"])

        for b in batches:
            for own, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if block is not None and own != block:
                    yield close()
                    parts = []
                block = own
                parts.append(_expanded(blob))
        if parts:
            yield close()
        release()

    return run


def gather(values: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """values[begins[k] : begins[k] + sizes[k]] of all k one after another."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.arange(ends[-1]) + np.repeat(begins - ends + sizes, sizes)]


class Decoder:
    """Bytes of ids, token by token."""

    def __init__(self, ranks: Ranks):
        table = [ranks.token.get(i, b"") for i in range(max(ranks.token) + 1)]
        self.sizes = np.fromiter(map(len, table), np.int64, len(table))
        self.begins, self.flat = np.cumsum(self.sizes) - self.sizes, np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """Some ids at a time, whatever their number."""
        parts = (ids[at : at + (1 << 20)] for at in range(0, len(ids), 1 << 20))
        return b"".join(gather(self.flat, self.begins[p], self.sizes[p]).tobytes() for p in parts)


def _join(path: str, folder: str, names: list[str]):
    """Ids of each text from those of its block's words; then digests of them, and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, block, sizes, begins, flat = Decoder(Ranks(path)), None, None, None, None
        for b in batches:
            at, many = 0, b.column(2).to_numpy().tolist()
            while at < b.num_rows:
                end, size = at, 0
                while end < b.num_rows and end - at < 256 and (end == at or size + many[end] <= 1 << 20):
                    size, end = size + many[end], end + 1
                out: dict[str, list] = {k: [] for k in names[1:]}
                for own, n, blob in zip(*(b.column(k).slice(at, end - at).to_pylist() for k in (1, 2, 3))):
                    if n and own != block:
                        block, (whole,) = own, load(f"{folder}/{own}", ["u1"])
                        _, sizes, flat = _expanded(whole.tobytes())
                        begins, flat = np.cumsum(sizes) - sizes, _from_planes(flat)
                        forget(folder)
                    numbers = _unpacked(blob, n)
                    ids = gather(flat, begins[numbers], sizes[numbers]) if n else np.zeros(0, "<u4")
                    back = decoder.decode(ids)
                    figures = {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(back).hexdigest()}
                    figures |= {"ids": ids.astype("<i4")} if "ids" in out else {}
                    figures |= {"decoded": back.decode()} if "decoded" in out else {}
                    for k, v in figures.items():
                        out[k].append(v)
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, end - at), *(pa.array(v, kinds.get(k, pa.string())) for k, v in out.items())], names)
                at = end
        release()

    return run


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """id, the columns to keep, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids and the decoded text.

    path: the rank file, there on every worker; pattern splits a text into words that are encoded separately. Every text
    is encoded whole, without special tokens, and decoded again; null counts as empty and has no ids. Rows that repeat an
    id, and null ids, are rows of their own; equal words have equal ids wherever they are. Empty tables give none. A long
    text, or a long word, has to fit a worker's memory, a word some hundred times. Other columns are not read.

    Texts are read and split once: each becomes numbers of the words of its block, in a table of about half the size of
    the texts. The words of all blocks meet in buckets by their hash, as many as their number asks for; there the merges
    are replayed, each word of the corpus once, and the ids go back to the blocks. They become a file for each block,
    which is all that the tasks that put the block's texts together read.
    """
    spark, folder = docs.sparkSession, shared_dir(docs.sparkSession)
    row = F.struct(docs[id_col].alias(id_col), *(docs[c] for c in keep))
    src = docs.select(row.alias("_row"), docs[text_col].cast("string").alias("_text"))
    kind = src.schema["_row"].dataType
    split = src.mapInArrow(_split(pattern, to_arrow_type(kind)), f"`_row` {kind.simpleString()}, block bigint, n bigint, blob binary, words bigint")
    parts = written(split, folder, "split")
    words = parts.where("words is not null").select("block", "blob", "words")
    buckets = 1 + (words.agg(F.sum("words")).first()[0] or 0) // BUCKET
    dealt = words.select("block", "blob").mapInArrow(_deal(buckets), "bucket int, block bigint, blob binary").repartitionById(buckets, "bucket")
    ids = dealt.mapInArrow(_replayed(path), "block bigint, blob binary")
    files = shared_dir(spark)
    ids.repartition("block").sortWithinPartitions("block").mapInArrow(_save_blocks(files), "block bigint").write.parquet(f"{folder}/blocks")
    kinds = {"n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"} | ({"ids": "array<int>"} if with_ids else {}) | ({"decoded": "string"} if with_text else {})
    texts = parts.where("n is not null").select("_row", "block", "n", "blob")
    out = texts.mapInArrow(_join(path, files, ["_row", *kinds]), f"`_row` {kind.simpleString()}, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))
    return out.select("_row.*", *kinds)
