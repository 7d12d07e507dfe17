"""SimHash near-dedup with bit-sliced comparison."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.llm.common import drop_dir, release, shared_dir, whole_ids, written
from loomwright.llm.components import Forest, components
from loomwright.llm.hash_arrays import forget, load, mix, save

ONES = np.uint64(0xFFFFFFFFFFFFFFFF)
#: 64-bit words of the long fingerprint.
WORDS = 16
_STEPS = np.arange(WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class SimHash:
    """shingle words make a shingle; fingerprints link at radius or fewer of 64 differing bits.

    Fingerprints are cut into blocks; radius differing bits leave at least blocks - radius of them equal, so that all
    links are found among fingerprints that share that many blocks: a bucket for each choice of blocks. With more blocks
    keys are longer, and buckets smaller, at the price of more of them: blocks is the least number, and grows with the
    number of fingerprints (sized), so that a bucket keeps some members whatever that is. A bucket of more than split
    fingerprints is compared in parts, each with each.

    With tables, texts are compared as sets of shingles instead, by a fingerprint of 64 * WORDS bits. Sets with a Jaccard
    similarity J are at most arccos(2 J / (1 + J)) apart, whatever was cut, added or replaced, so that at 0.8 a bit
    differs with probability 0.15. A bucket for each of tables pieces of key_bits bits: 64 pieces of 16 bits have an equal
    one with probability 0.992 at 0.8, 0.9994 at 0.85. Within a bucket, candidates differ in at most radius of the first 64
    bits (10 expected at 0.8, 2.9 the deviation) and at most check_differing of the first 128 (19, deviation 4). They
    link if the sets themselves, of 64-bit hashes, have a similarity of at least similarity.
    """

    shingle: int = 4
    radius: int = 4
    blocks: int = 6
    split: int = 50_000
    tables: int = 0
    key_bits: int = 16
    check_differing: int = 36
    similarity: float = 0.8

    def __post_init__(self) -> None:
        assert 0 <= self.radius < 32 and (self.tables or self.radius < self.blocks)
        assert self.tables * self.key_bits <= 64 * WORDS and 64 % self.key_bits == 0

    def sized(self, n: int) -> SimHash:
        """With as many blocks as n different fingerprints need for keys of about as many bits as n has."""
        blocks = self.blocks
        while not self.tables and blocks < 16 and 64 * (blocks - self.radius) // blocks < n.bit_length() - 2:
            blocks += 1
        return replace(self, blocks=blocks)

    @property
    def columns(self) -> list[str]:
        """The words of the fingerprint."""
        return ["print", *(f"c{k}" for k in range(1, WORDS))] if self.tables else ["print"]

    @property
    def payload(self) -> list[str]:
        """The columns that go into the buckets."""
        return [*self.columns[:2], "spot"] if self.tables else self.columns

    def keys(self) -> list[list[tuple[str, int, int]]]:
        """For each bucket of a fingerprint, the (word, shift, width) that make its key."""
        if self.tables:
            each = 64 // self.key_bits
            return [[(self.columns[t // each], t % each * self.key_bits, self.key_bits)] for t in range(self.tables)]
        cuts = [64 * i // self.blocks for i in range(self.blocks + 1)]
        spans = [("print", cuts[i], cuts[i + 1] - cuts[i]) for i in range(self.blocks)]
        return [list(c) for c in combinations(spans, self.blocks - self.radius)]


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    whole = len(bits) // 255 * 255
    return bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + bits[whole:].sum(axis=0, dtype=np.uint8)


def _hashes(words: list[bytes], shingle: int) -> Iterator[np.ndarray]:
    """XXH64 of the shingles, repeats included, a block at a time; fewer words than a shingle are one shingle."""
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        yield np.array([digest(joined, 42)], np.uint64)
        return
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(words) - shingle + 1], ends[shingle - 1 :]
    for at in range(0, len(starts), 65280):
        part = slice(at, at + 65280)
        yield np.array([digest(joined[i:j], 42) for i, j in zip(starts[part].tolist(), ends[part].tolist())], np.uint64)


def _print(total: np.ndarray, n: int) -> int:
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def _words(text: str | None) -> list[bytes]:
    return text.encode(errors="surrogatepass").lower().split() if text else []


def fingerprint(text: str | None, shingle: int) -> int:
    """Words are split at ASCII white space, A-Z lower-cased; fewer words than a shingle are one shingle, none give 0."""
    if not (words := _words(text)):
        return 0
    n, total = 0, np.zeros(64, np.int64)
    for hashes in _hashes(words, shingle):
        n, total = n + len(hashes), total + _bits(hashes)
    return _print(total, n)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different shingles of a text as sorted 64-bit hashes."""
    words = _words(text)
    return np.unique(np.concatenate(list(_hashes(words, shingle)))) if words else np.empty(0, np.uint64)


def long_fingerprint(own: np.ndarray) -> np.ndarray:
    """WORDS words of SimHash bits of a set of hashes; each hash is spread over all of them. No hashes give 0."""
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(own), 255):
        spread = mix(own[at : at + 255, None] + _STEPS)
        total += np.unpackbits(spread.astype("<u8").view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * total > len(own), bitorder="little").view("<u8")


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of 64-bit values, stored vertically: row b has bit b of all values, 64 values in a word."""
    bits = np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    full = np.zeros((64, -(-len(values) // 64) * 64), np.uint8)
    full[:, : len(values)] = bits.T
    return np.packbits(full, axis=1, bitorder="little").view("<u8")


def near(differing: np.ndarray, radius: int) -> np.ndarray:
    """Words whose bits say which lanes have at most radius bits set in the planes of differing.

    Bitwise counters of weight 1, 2 and 4 (and 8 and 16 for a radius of 8 or more) are kept for all lanes; carry-save adders take four planes at a time. After
    every eight planes, blocks of 64 lanes that all exceed the radius are left out of the rest.
    """
    width = differing.shape[1]
    where, over = np.arange(width), np.zeros(width, np.uint64)
    one, two, four, eight, sixteen = np.zeros((5, width), np.uint64)
    for k in range(0, 64, 4):
        a, b, c, d = differing[k : k + 4] if len(where) == width else differing[k : k + 4, where]
        x = one ^ a
        carry1, x = (one & a) | (x & b), x ^ b
        y = x ^ c
        carry2, one = (x & c) | (y & d), y ^ d
        x = two ^ carry1
        carry4, two = (two & carry1) | (x & carry2), x ^ carry2
        carry8, four = four & carry4, four ^ carry4
        if radius < 8:
            over |= carry8
        else:
            carry16, eight = eight & carry8, eight ^ carry8
            over |= sixteen & carry16
            sixteen = sixteen ^ carry16
        if k % 8 == 4:
            more, even = over.copy(), np.full(len(where), ONES)
            for bit, counter in ((16, sixteen), (8, eight), (4, four), (2, two), (1, one))[0 if radius >= 8 else 2 :]:
                if radius & bit:
                    even &= counter
                else:
                    more |= even & counter
                    even &= ~counter
            if (alive := more != ONES).sum() < 0.75 * len(where):
                where, over, one, two, four, eight, sixteen, more = (v[alive] for v in (where, over, one, two, four, eight, sixteen, more))
                if not len(where):
                    return np.zeros(width, np.uint64)
    out = np.zeros(width, np.uint64)
    out[where] = ~more
    return out


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


#: Buckets up to this size are compared all together, position by position; larger ones each by itself.
SMALL = 48


#: Hashes after which a file of shingle sets is full; bits of a spot for the place in a file and for the number of a file.
FULL, PLACE, FILE = 1 << 20, 22, 20


class Sets:
    """Shingle sets in files of the shared folder, each behind its size. A spot says partition, file and place."""

    def __init__(self, folder: str, partition: int = 0) -> None:
        self.folder, self.partition, self.file, self.size = folder, partition, 0, 0
        self.parts: list[np.ndarray] = []

    def add(self, own: np.ndarray) -> int:
        if self.size >= FULL:
            self.flush()
        spot = (self.partition << FILE | self.file) << PLACE | self.size
        self.parts += [np.array([len(own)], np.uint64), own]
        self.size += len(own) + 1
        return spot

    def flush(self) -> None:
        if self.parts:
            save(f"{self.folder}/{self.partition << FILE | self.file}", np.concatenate(self.parts))
            self.file, self.size, self.parts = self.file + 1, 0, []

    def get(self, spot: int) -> np.ndarray:
        (flat,), at = load(f"{self.folder}/{spot >> PLACE}", ["<u8"]), spot & (1 << PLACE) - 1
        return flat[at + 1 : at + 1 + int(flat[at])]

    def similar(self, x: int, y: int, least: float) -> bool:
        a, b = self.get(x), self.get(y)
        if min(len(a), len(b)) < least * max(len(a), len(b)):
            return False
        common = len(np.intersect1d(a, b, assume_unique=True))
        return common >= least * (len(a) + len(b) - common)


def _candidates(rows: np.ndarray, i, j, how: SimHash) -> np.ndarray:
    """Which of the pairs, near by their prints, are near by the first 128 bits as well."""
    if not how.tables:
        return np.ones(np.broadcast_shapes(np.shape(i), np.shape(j)), bool)
    return np.bitwise_count(rows[:2, i] ^ rows[:2, j]).sum(axis=0, dtype=np.int64) <= how.check_differing


def _join(x: int, y: int, spots: tuple[int, int] | None, how: SimHash, forest: Forest, sets: Sets | None) -> bool:
    """Whether the nodes are in one component: already, or now since they are similar."""
    if sets is not None and forest.root(x) != forest.root(y) and not sets.similar(*spots, how.similarity):
        return False
    forest.join(x, y)
    return True


def link_buckets(buckets: np.ndarray, rows: np.ndarray, nodes: np.ndarray, how: SimHash, forest: Forest, sets: Sets | None = None) -> None:
    """Joins the nodes that are near in any bucket; buckets are runs of equal values. rows: the payload."""
    prints = rows[0]
    edge = np.flatnonzero(np.concatenate([[True], buckets[1:] != buckets[:-1], [True]]))
    sizes = np.diff(edge)
    rest = np.repeat(sizes, sizes) - (np.arange(len(buckets)) - np.repeat(edge[:-1], sizes))  # members from here on
    small = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, SMALL):
        left = np.flatnonzero(small & (rest > step))
        if not len(left):
            break
        for at in range(0, len(left), 1 << 18):
            i = left[at : at + (1 << 18)]
            hit = i[lanes(near(planes(prints[i] ^ prints[i + step]), how.radius), len(i))]
            hit = hit[_candidates(rows, hit, hit + step, how)]
            for x, y, *spots in zip(nodes[hit].tolist(), nodes[hit + step].tolist(), rows[-1, hit].tolist(), rows[-1, hit + step].tolist()):
                _join(x, y, spots, how, forest, sets)
    for k in np.flatnonzero(sizes > SMALL).tolist():
        part = slice(edge[k], edge[k + 1])
        link_large(rows[:, part], nodes[part], how, forest, sets)


def link_large(rows: np.ndarray, nodes: np.ndarray, how: SimHash, forest: Forest, sets: Sets | None = None) -> None:
    """One bucket: each member is a probe once, against the members that no probe has reached yet.

    A member that is reached belongs to its probe's component, and need not be found again. The first member of the
    bit planes that isn't reached starts the next component.
    """
    prints = rows[0]
    todo = np.arange(len(prints))
    vertical, open_ = planes(prints), np.ones(len(prints), bool)
    while len(todo):
        front = [int(np.flatnonzero(open_)[0])]
        open_[front[0]] = False
        while front and open_.any():
            i = front.pop()
            flip = np.where((prints[todo[i]] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), ONES, np.uint64(0))
            hit = lanes(near(vertical ^ flip[:, None], how.radius), len(todo))
            hit = hit[open_[hit]]
            hit = hit[_candidates(rows, todo[hit], todo[[i]], how)]
            x, own = int(nodes[todo[i]]), int(rows[-1, todo[i]])
            there = zip(nodes[todo[hit]].tolist(), rows[-1, todo[hit]].tolist())
            hit = hit[np.array([_join(x, y, (own, spot), how, forest, sets) for y, spot in there], bool)]
            open_[hit] = False
            front += hit.tolist()
        if open_.sum() * 2 < len(todo):
            todo = todo[open_]
            if len(todo):
                vertical, open_ = planes(prints[todo]), np.ones(len(todo), bool)


def fingerprints(docs: DataFrame, how: SimHash, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """_id and the words of the fingerprint (bits as signed numbers) for each row of docs; with tables also the spot of its
    shingle set in the files of folder."""
    src = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    shingle, names = how.shingle, [*how.columns, *(["spot"] if how.tables else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = Sets(folder, TaskContext.get().partitionId()) if how.tables else None

        def row(text: str | None) -> list[int]:
            if sets is None:
                return [fingerprint(text, shingle)]
            own = shingle_set(text, shingle)
            return [*long_fingerprint(own).tolist(), sets.add(own)]

        for b in batches:
            for at in range(0, b.num_rows, 512):
                texts = b.column(1).slice(at, 512).to_pylist()
                got = np.array([row(t) for t in texts], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 512), *(pa.array(c) for c in got.T)], ["_id", *names])
        if sets is not None:
            sets.flush()
        release()

    return src.mapInArrow(run, f"`_id` {src.schema['_id'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in names))


def _links(how: SimHash, folder: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, kept, sets = Forest(), None, Sets(folder) if how.tables else None

        def out() -> Iterator[pa.RecordBatch]:
            a, b = forest.links()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            now = np.stack([c.to_numpy() for c in batch.columns[:3]]), np.stack([c.to_numpy() for c in batch.columns[3:]])
            kept = now if kept is None else tuple(np.concatenate([x, y], axis=1) for x, y in zip(kept, now))
            changes = np.flatnonzero((kept[0][:, 1:] != kept[0][:, :-1]).any(axis=0)) + 1
            if len(changes):  # the last bucket may go on in the next batch
                _group(kept[0][:, : changes[-1]], kept[1][:, : changes[-1]], how, forest, sets)
                kept = kept[0][:, changes[-1] :], kept[1][:, changes[-1] :]
            if len(forest.up) > 500_000:
                yield from out()
        if kept is not None and kept[0].shape[1]:
            _group(*kept, how, forest, sets)
        yield from out()
        if sets is not None:
            forget(folder)

    return run


def _group(keys: np.ndarray, rows: np.ndarray, how: SimHash, forest: Forest, sets: Sets | None) -> None:
    runs = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(axis=0))])
    link_buckets(runs, rows[:-1].view(np.uint64), rows[-1], how, forest, sets)


def near_links(prints: DataFrame, how: SimHash, folder: str, sets: str | None = None) -> DataFrame:
    """a, b: links that connect just what is connected. prints has distinct fingerprints, each with a node (and the spot of
    its shingle set in the folder sets)."""
    choices = []
    for t, spans in enumerate(how.keys()):
        key = F.lit(0).cast("bigint")
        for word, shift, width in spans:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(word, shift).bitwiseAND((1 << width) - 1))
        choices.append(F.struct(F.lit(t).alias("choice"), key.alias("key")))
    own = [*how.payload, "node"]
    rows = prints.select(F.explode(F.array(*choices)).alias("k"), *own).select(F.col("k.choice").cast("bigint").alias("choice"), "k.key", *own)
    large = written(rows.groupBy("choice", "key").count().where(F.col("count") > how.split).select("choice", "key", F.ceil(F.col("count") / how.split).alias("parts")), folder, "large")
    cold = rows.join(large, ["choice", "key"], "left")
    part = F.pmod(F.xxhash64("print"), "parts")
    with_all = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1), lambda j: F.struct(F.least(part, j).alias("p"), F.greatest(part, j).alias("q")))
    alone = F.array(F.struct(F.lit(0).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("q")))
    dealt = cold.withColumn("pq", F.explode(F.when(F.col("parts").isNull(), alone).otherwise(with_all)))
    dealt = dealt.select(F.col("choice").bitwiseOR(F.shiftleft(F.col("pq.p"), 8)).alias("choice"), "key", F.col("pq.q").alias("q"), *own)
    return dealt.repartition("choice", "key", "q").sortWithinPartitions("choice", "key", "q").mapInArrow(_links(how, sets), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, how: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id: the smallest id that links lead to, for each row of docs.

    Null and empty texts have the fingerprint zero and link like any other. A row with a null id has its fingerprint and
    a null component, and links nothing. Rows that repeat an id are rows of their own. Ids are whole numbers; other types
    raise. Texts of any length are read whole, some words at a time. Empty tables give none. Other columns are not read.

    Texts are read once, for fingerprints in a table. Equal fingerprints become one node before anything is compared,
    its number the smallest id. Buckets are dealt out by key; each task gives a spanning forest of its links, so that
    what leaves a group grows with its members and not with their pairs. With tables, the shingle sets are written once
    to files that all tasks read candidates from, and are deleted when the links are known.
    """
    spark = docs.sparkSession
    whole_ids(docs, id_col)
    folder, sets = shared_dir(spark), shared_dir(spark) if how.tables else None
    kind = docs.select(docs[id_col].alias("c")).schema["c"].dataType
    prints = written(fingerprints(docs, how, id_col, text_col, sets), folder, "prints")
    nodes = written(prints.where("_id is not null").groupBy(*how.columns).agg(F.min(F.col("_id").cast("bigint")).alias("node"), *([F.min("spot").alias("spot")] if how.tables else [])), folder, "nodes")
    parts = components(near_links(nodes, how.sized(nodes.count()), folder, sets), folder)
    if sets:
        drop_dir(spark, sets)
    named = written(nodes.join(parts, "node", "left").select(*how.columns, F.coalesce("component", "node").alias("component_id")), folder, "named")
    out = prints.join(named, how.columns, "left").select(F.col("_id").alias(id_col), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), F.when(F.col("_id").isNotNull(), F.col("component_id")).cast(kind).alias("component_id"))
    return out


def keep_one(docs: DataFrame, how: SimHash = SimHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay: of each component the document with the smallest id; rows with a null id all stay.

    Of rows that repeat an id, the one whose text sorts first stays. Columns stay as they are.
    """
    found = near_duplicates(docs, how, id_col, text_col)
    first = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_kept")).distinct()
    rows = docs.where(docs[id_col].isNotNull()).join(written(first, shared_dir(docs.sparkSession), "kept"), docs[id_col] == F.col("_kept"), "left_semi")
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(text_col)))
    return rows.withColumn("_rank", rank).where("_rank = 1").drop("_rank").unionByName(docs.where(docs[id_col].isNull()))
