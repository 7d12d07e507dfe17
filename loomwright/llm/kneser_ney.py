"""LM scoring: an interpolated modified Kneser-Ney model of word pairs, counted in Spark, kept as sorted hash arrays.

The model, of order 2: with c the counts of pairs and N1+(. w) the number of different words before w,

    P(w | v) = max(c(v w) - D(c(v w)), 0) / c(v .) + (D1 N1(v .) + D2 N2(v .) + D3 N3+(v .)) / c(v .) * P(w)
    P(w)     = max(N1+(. w) - d(N1+(. w)), 0) / N1+(. .) + (d1 M1 + d2 M2 + d3 M3+) / N1+(. .) / (V + 1)

where N1, N2, N3+ are the numbers of followers of v seen once, twice and more often, M the same over N1+(. w), and the
discounts D (d) come from the numbers of pairs (words) with counts 1 to 4. After a word that training has not as a
context, P(w | v) is P(w). V counts the different training tokens, one more stands for all unknown ones.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import shared_dir
from loomwright.llm.hash_arrays import add_up, load, mix, pack, positions, save, top_bucket, unpack

#: No word is empty: the empty one stands for the end of a text. Its begin has the first number that no word has.
END = b""


@dataclass(frozen=True)
class Training:
    """Texts train whose crc32 of the id as text, modulo folds, is not 0. chunk: tokens that a task counts before it sends."""

    folds: int = 10
    chunk: int = 3_000_000
    #: A context with more than 1/often of all tokens has its pairs dealt out one by one; at most so many contexts have.
    often: int = 2048
    #: A bucket of pairs for about so many bytes of text.
    bucket_bytes: int = 64 << 20


def words(text: str | None) -> list[bytes]:
    return text.encode(errors="surrogatepass").lower().split() if text else []


def _hash(word: bytes) -> int:
    return xxhash.xxh64_intdigest(word, 42)


def held_out(ident, folds: int) -> bool:
    return zlib.crc32(("" if ident is None else str(ident)).encode(errors="surrogatepass")) % folds == 0


def _texts(batches: Iterator[pa.RecordBatch], columns: tuple[int, ...] = (0, 1)) -> Iterator[tuple]:
    for b in batches:
        for at in range(0, b.num_rows, 256):
            yield from zip(*(b.column(k).slice(at, 256).to_pylist() for k in columns))


def _send(keys: np.ndarray, counts: np.ndarray, bucket: np.ndarray) -> Iterator[pa.RecordBatch]:
    """keys in order; a row for each bucket."""
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if len(order) else []
    for i, j in zip(edges[:-1], edges[1:]):
        own = order[i:j]
        yield pa.RecordBatch.from_arrays([pa.array([int(bucket[own[0]])], pa.int32()), pa.array([pack(keys[own], counts[own])], pa.binary())], ["bucket", "blob"])


_BLOBS = "bucket int, blob binary"


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    """Bucket k to partition k."""
    return rows.repartitionById(buckets, "bucket")


def _merged(batches: Iterator[pa.RecordBatch], each: int = 8) -> tuple[int, np.ndarray, np.ndarray] | None:
    """All that a bucket got, added up a few blobs at a time; None if it got nothing."""
    bucket, total, held = None, None, []

    def fold() -> tuple[np.ndarray, np.ndarray]:
        got = held + ([total] if total is not None else [])
        return add_up(np.concatenate([k for k, _ in got]), np.concatenate([c for _, c in got]))

    for b in batches:
        for k, blob in zip(b.column(0).to_pylist(), b.column(1)):
            bucket = k
            held.append(unpack(blob.as_buffer().to_pybytes()))
            if len(held) >= each and sum(len(k) for k, _ in held) > (len(total[0]) if total is not None else 0):
                total, held = fold(), []
    if bucket is None:
        return None
    return (bucket, *(fold() if held else total))


def _count_words(how: Training, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = Counter(), 0

        def out() -> Iterator[pa.RecordBatch]:
            keys = np.fromiter(map(_hash, counts), np.uint64, len(counts))
            keys, many = add_up(keys, np.fromiter(counts.values(), np.int64, len(counts)))
            yield from _send(keys, many, top_bucket(keys, buckets))

        for ident, text in _texts(batches):
            if not held_out(ident, how.folds):
                w = words(text)
                counts.update(w)
                counts[END] += 1
                n += len(w) + 1
                if n >= how.chunk or len(counts) > 500_000:
                    yield from out()
                    counts, n = Counter(), 0
        yield from out()

    return run


def _save_words(folder: str, often: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if got := _merged(batches):
            bucket, keys, counts = got
            save(f"{folder}/words-{bucket:05d}", keys, counts)
            top = np.flatnonzero(counts > counts.sum() / often)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(keys)], pa.int64()), pa.array([int(counts.sum())], pa.int64()), pa.array([top], pa.list_(pa.int64())), pa.array([counts[top]], pa.list_(pa.int64()))], ["bucket", "n", "total", "at", "count"])

    return run


def _parts(order: np.ndarray, bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The buckets that occur, each with its part of the order: as many steps as there are, however many buckets exist."""
    edges = np.flatnonzero(np.diff(bucket, prepend=bucket[:1] - 1, append=bucket[-1:] + 1)) if len(bucket) else []
    for i, j in zip(edges[:-1], edges[1:]):
        yield int(bucket[i]), order[i:j]


@dataclass(frozen=True)
class Vocabulary:
    """Numbers of words: the place in the files of hashes, one file after another."""

    folder: str
    sizes: tuple[int, ...]
    total: int
    often: tuple[int, ...]

    @property
    def size(self) -> int:
        return sum(self.sizes)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number and the count of each word; -1 and 0 for unknown ones."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        begin, order = np.cumsum([0, *self.sizes]), np.argsort(hashes)
        bucket = top_bucket(hashes[order], len(self.sizes))
        for b, own in _parts(order, bucket):
            if self.sizes[b]:
                keys, many = load(f"{self.folder}/words-{b:05d}", ["<u8", "<i8"])
                at = positions(keys, hashes[own])
                ids[own] = np.where(at >= 0, at + begin[b], -1)
                counts[own] = np.where(at >= 0, many[at], 0)
        return ids, counts


class _Numbers(dict):
    """Words of the texts so far, in the order of first sight, with their numbers and counts in the vocabulary."""

    KEPT = 600_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.ids, self.counts, self.new = vocabulary, np.zeros(0, np.int64), np.zeros(0, np.int64), []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        at = self[word] = len(self)
        return at

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Of all texts one after another, the end after each: numbers and counts."""
        if len(self) > self.KEPT:
            self.clear()
            self.ids = self.counts = np.zeros(0, np.int64)
        flat = [w for t in texts for w in (*t, END)]
        at = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        if self.new:
            ids, counts = self.vocabulary.find(np.fromiter(map(_hash, self.new), np.uint64, len(self.new)))
            self.ids, self.counts, self.new = np.concatenate([self.ids, ids]), np.concatenate([self.counts, counts]), []
        return self.ids[at], self.counts[at]


def _blocks(rows: Iterator[tuple], tokens: int = 300_000) -> Iterator[tuple[list, list[list[bytes]]]]:
    """Ids and words of texts, some texts at a time."""
    idents, texts, n = [], [], 0
    for ident, text, *more in rows:
        w = words(text)
        idents.append((ident, *more) if more else ident)
        texts.append(w)
        n += len(w) + 1
        if n >= tokens:
            yield idents, texts
            idents, texts, n = [], [], 0
    if idents:
        yield idents, texts


def _contexts(ids: np.ndarray, sizes: np.ndarray, begin: int) -> np.ndarray:
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    out[np.cumsum(sizes) - sizes] = begin
    return out


def _pair_bucket(keys: np.ndarray, often: np.ndarray, buckets: int) -> np.ndarray:
    """Pairs of a context go together, but for contexts that are very frequent, whose pairs go apart."""
    context = keys >> np.uint64(32)
    return top_bucket(mix(np.where(positions(often, context) >= 0, keys, context)), buckets)


def _count_pairs(how: Training, vocabulary: Vocabulary, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, often = _Numbers(vocabulary), np.array(vocabulary.often, np.uint64)
        held: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            yield from _send(keys, counts, _pair_bucket(keys, often, buckets))

        training = (r for r in _texts(batches) if not held_out(r[0], how.folds))
        for _, texts in _blocks(training):
            ids, _ = numbers.read(texts)
            context = _contexts(ids, np.array([len(t) + 1 for t in texts]), vocabulary.size)
            held.append(context.astype(np.uint64) << np.uint64(32) | ids.astype(np.uint64))
            if sum(map(len, held)) >= how.chunk:
                yield from out()
                held = []
        if held:
            yield from out()

    return run


def _number_bucket(keys: np.ndarray, numbers: int, buckets: int) -> np.ndarray:
    return (keys.astype(np.int64) // -(-numbers // buckets)).astype(np.int64)


def _save_pairs(folder: str, numbers: int, buckets: int):
    """Keeps the pairs of a bucket, and sends what they say of contexts (tag 0-3: c, N1, N2, N3+) and words (tag 4: N1+(. w)).

    The last row, of bucket -1, has the numbers of pairs with counts 1 to 4, and of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not (got := _merged(batches)):
            return
        bucket, keys, counts = got
        many = np.flatnonzero(counts >= 255)
        save(f"{folder}/pairs-{bucket:05d}", keys, np.minimum(counts, 255).astype(np.uint8), many, counts[many])
        context, word = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
        one = np.ones(len(keys), np.int64)
        facts = add_up(context, counts, *((counts == 1).astype(np.int64), (counts == 2).astype(np.int64), (counts > 2).astype(np.int64)))
        words_, before = add_up(word, one)
        every = [(facts[0], f, tag) for tag, f in enumerate(facts[1:])] + [(words_, before, 4)]
        for k, c, tag in every:
            there = np.flatnonzero(c)
            for part in _send(k[there], c[there], _number_bucket(k[there], numbers, buckets)):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tag], pa.int32()), part.column(1)], ["bucket", "tag", "blob"])
        sums = np.array([*((counts == k).sum() for k in (1, 2, 3, 4)), len(counts)], np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([bucket], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["bucket", "tag", "blob"])

    return run


def _save_facts(folder: str, numbers: int, buckets: int):
    """For each number of the bucket: c(v .), N1, N2, N3+ and N1+(. w). Gives the numbers of words with 1 to 4, 3+, and the sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width, table, bucket = -(-numbers // buckets), None, None
        for b in batches:
            for k, tag, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                if table is None:
                    bucket, table = k, np.zeros((5, width), np.int64)
                keys, counts = unpack(blob.as_buffer().to_pybytes())
                table[tag][keys.astype(np.int64) - bucket * width] += counts
        if table is None:
            return
        save(f"{folder}/facts-{bucket:05d}", *table)
        before = table[4]
        yield pa.RecordBatch.from_arrays([pa.array([[*((int((before == k).sum())) for k in (1, 2, 3, 4)), int((before > 2).sum()), int(before.sum())]], pa.list_(pa.int64()))], ["sums"])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of things counted 1 to 4 times; where they are too few to tell, 0.5, 1 and 1.5."""
    if not (n1 and n2 and n3 and n4):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in enumerate(d, 1))


@dataclass(frozen=True)
class Model:
    vocabulary: Vocabulary
    buckets: int
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    words_seen: tuple[int, int, int]  # M1, M2, M3+
    before_all: int  # N1+(. .)

    def facts(self, ids: np.ndarray) -> np.ndarray:
        """The five facts of each number; zeros for -1."""
        out = np.zeros((5, len(ids)), np.int64)
        width = -(-(self.vocabulary.size + 1) // self.buckets)
        order = np.argsort(ids, kind="stable")
        for b, own in _parts(order, ids[order] // width):
            if b < 0:  # unknown
                continue
            try:
                columns = load(f"{self.vocabulary.folder}/facts-{b:05d}", ["<i8"] * 5)
            except FileNotFoundError:  # no training text has a number of this range
                continue
            for k, c in enumerate(columns):
                out[k, own] = c[ids[own] - b * width]
        return out

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        """Counts of different pairs of known numbers."""
        out = np.zeros(len(keys), np.int64)
        bucket = _pair_bucket(keys, np.array(self.vocabulary.often, np.uint64), self.buckets)
        order = np.argsort(bucket, kind="stable")
        for b, own in _parts(order, bucket[order]):
            try:
                known, small, at, large = load(f"{self.vocabulary.folder}/pairs-{b:05d}", ["<u8", "u1", "<i8", "<i8"])
            except FileNotFoundError:
                continue
            place = positions(known, keys[own])
            got = np.where(place >= 0, small[place], 0).astype(np.int64)
            full = np.flatnonzero(got == 255)
            got[full] = large[np.searchsorted(at, place[full])]
            out[own] = got
        return out

    def log10(self, context: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Of each token after its context; -1 stands for unknown words."""
        pair_d, word_d = np.array([0, *self.pair_discounts]), np.array([0, *self.word_discounts])
        total = max(self.before_all, 1)
        different, back = np.unique(ids, return_inverse=True)
        before = self.facts(different)[4]
        rest = (float(word_d[1:] @ np.array(self.words_seen)) / total if self.before_all else 1.0) / (self.vocabulary.size + 1)
        single = (np.maximum(before - word_d[np.minimum(before, 3)], 0) / total + rest)[back]
        different, back = np.unique(context, return_inverse=True)
        c, n1, n2, n3, _ = self.facts(different)
        left = np.where(c > 0, (pair_d[1] * n1 + pair_d[2] * n2 + pair_d[3] * n3) / np.maximum(c, 1), 1.0)[back]
        c = c[back]
        out = left * single
        both = np.flatnonzero((context >= 0) & (ids >= 0) & (c > 0))
        keys, back = np.unique(context[both].astype(np.uint64) << np.uint64(32) | ids[both].astype(np.uint64), return_inverse=True)
        seen = self.pairs(keys)[back]
        out[both] += np.maximum(seen - pair_d[np.minimum(seen, 3)], 0) / c[both]
        return np.log10(out)


def train(docs: DataFrame, how: Training, folder: str, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts words, then pairs of word numbers, of all training texts; the model's files go to folder.

    Each pass counts chunks of tokens in the tasks and deals the counts out by bucket as compressed sorted arrays. The
    driver sees a few numbers of each bucket.
    """
    # So many that the tokens of one, at six bytes each or so, are worked on in a task's memory.
    size = docs.agg(F.sum(F.octet_length(docs[text_col].cast("string")))).first()[0] or 0
    buckets = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // how.bucket_bytes)
    src = docs.select(docs[id_col].cast("string").alias("_id"), docs[text_col].cast("string").alias("_text"))
    stats = _dealt(src.mapInArrow(_count_words(how, buckets), _BLOBS), buckets).mapInArrow(_save_words(folder, how.often), "bucket int, n bigint, total bigint, at array<bigint>, count array<bigint>").collect()
    sizes = [0] * buckets
    for r in stats:
        sizes[r.bucket] = r.n
    total, begin = sum(r.total for r in stats), np.cumsum([0, *sizes])
    often = sorted([int(begin[r.bucket]) + i for r in stats for i, c in zip(r.at, r["count"]) if c > total / how.often] + [sum(sizes)])
    vocabulary = Vocabulary(folder, tuple(sizes), total, tuple(often))
    if vocabulary.size >= 1 << 31:
        raise ValueError("numbers of words take 31 bits; this corpus has more different words")
    numbers = vocabulary.size + 1
    counted = _dealt(src.mapInArrow(_count_pairs(how, vocabulary, buckets), _BLOBS), buckets)
    facts = counted.mapInArrow(_save_pairs(folder, numbers, buckets), "bucket int, tag int, blob binary").write
    facts.parquet(f"{folder}/sent")
    sent = docs.sparkSession.read.schema("bucket int, tag int, blob binary").parquet(f"{folder}/sent")
    pair_sums = sum((np.frombuffer(bytes(r.blob), "<u8").astype(np.int64) for r in sent.where("bucket < 0").select("blob").collect()), np.zeros(5, np.int64)).tolist()
    rows = _dealt(sent.where("bucket >= 0"), buckets).mapInArrow(_save_facts(folder, numbers, buckets), "sums array<bigint>").collect()
    m1, m2, m3, m4, more, before = np.sum([r.sums for r in rows], axis=0).tolist() if rows else [0] * 6
    return Model(vocabulary, buckets, discounts(*pair_sums[:4]), discounts(m1, m2, m3, m4), (m1, m2, more), before)


def score(docs: DataFrame, model: Model, how: Training, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    src = docs.select(docs[id_col].cast("string").alias("_key"), docs[text_col].cast("string").alias("_text"), docs[id_col].alias("_id"))
    kind = src.schema["_id"].dataType
    n, v = model.vocabulary.total, model.vocabulary.size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = _Numbers(model.vocabulary)
        for idents, texts in _blocks(_texts(batches, (0, 1, 2))):
            ids, counts = numbers.read(texts)
            sizes = np.array([len(t) + 1 for t in texts])
            begin = np.cumsum(sizes) - sizes
            base = np.add.reduceat(np.log10((counts + 0.1) / (n + 0.1 * (v + 1))), begin)
            own = np.add.reduceat(model.log10(_contexts(ids, sizes, v), ids), begin)
            known = np.add.reduceat((counts > 0).astype(np.int64), begin)
            cols = [idents_type([i for _, i in idents]), pa.array([held_out(k, how.folds) for k, _ in idents], pa.bool_()), pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(len(texts), n), pa.int64()), pa.array(base), pa.array(own)]
            yield pa.RecordBatch.from_arrays(cols, ["_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(kind)
    idents_type = lambda idents: pa.array(idents, arrow)
    out = src.mapInArrow(run, f"`_id` {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
    return out.withColumnRenamed("_id", id_col)


def perplexity_scores(docs: DataFrame, how: Training = Training(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    score is the log10 probability of the text with its end; perplexity is 10 ** (-score / n_tokens). Null and empty
    texts have the end as their only token. Ids of any type go by their text as Spark casts it; a null id counts as empty
    text for the fold. Every row is counted and scored, repeated rows each for itself. Texts of any length are counted and
    scored whole. Without any training text, each token has the probability of an unknown one. Empty tables give none.
    """
    model = train(docs, how, shared_dir(docs.sparkSession), id_col, text_col)
    return score(docs, model, how, id_col, text_col)
