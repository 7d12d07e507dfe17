"""Benchmark decontamination: a prefix-filtered join of item windows with documents."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import release

# A-Z become a-z; every other ASCII character that is no letter or digit separates words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Windows:
    """Windows of size consecutive words; an item of fewer words is one window.

    Items are broadcast part by part; a part has at most part_bytes of text (or one item).
    """

    size: int = 10
    part_bytes: int = 4 << 20


def words(text: str | None) -> list[bytes]:
    return text.encode(errors="surrogatepass").translate(_FOLD).split() if text else []


def item_windows(items: list[tuple[str | None, str | None]], size: int) -> dict[tuple[bytes, ...], set[str | None]]:
    """Each different window, with the items that have it."""
    out: dict[tuple[bytes, ...], set[str | None]] = {}
    for name, text in items:
        w = words(text)
        for i in range(max(1, len(w) - size + 1) if w else 0):
            out.setdefault(tuple(w[i : i + size]), set()).add(name)
    return out


def prefix_index(windows: dict[tuple[bytes, ...], set], counts: dict[bytes, int]) -> dict[bytes, list[tuple]]:
    """By its rarest word, each window with that word's place in it.

    A window is contained in a document only if all its words are, so that the prefix that a containment join needs of
    a window, its words ordered by rarity, is the first one. Ties go to the word that sorts first.
    """
    out: dict[bytes, list[tuple]] = {}
    for w, names in windows.items():
        rare = min(set(w), key=lambda x: (counts.get(x, 0), x))
        out.setdefault(rare, []).append((w.index(rare), list(w), names))
    return out


def find(doc: list[bytes], index: dict[bytes, list[tuple]], hit: bytearray, names: set) -> None:
    """Marks the words of doc that lie in a window, and adds the names of the windows' items.

    A word of a prefix proposes a place for each of its windows; the place has to lie inside the document, and the words
    there have to be the window's.
    """
    n = len(doc)
    for i in [i for i, w in enumerate(doc) if w in index]:
        for offset, window, items in index[doc[i]]:
            begin, end = i - offset, i - offset + len(window)
            if begin >= 0 and end <= n and doc[begin:end] == window:
                hit[begin:end] = b"\1" * len(window)
                names |= items


def _count(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts = vocabulary.value, Counter()
        for b in batches:
            for at in range(0, b.num_rows, 512):
                for text in b.column(0).slice(at, 512).to_pylist():
                    counts.update(filter(known.__contains__, words(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    return run


def _search(index, last: bool):
    """Adds what one part of the benchmark marks; the last part gives the figures."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = index.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                marks, names = [], []
                for text, hit, known in zip(*(part.column(k).to_pylist() for k in (1, 2, 3))):
                    doc = words(text)
                    mark, got = bytearray(hit) if hit is not None else bytearray(len(doc)), set(known or ())
                    find(doc, found, mark, got)
                    marks.append(bytes(mark))
                    names.append(sorted(x for x in got if x is not None))
                cols = [pa.array(marks, pa.binary()), pa.array(names, pa.list_(pa.string()))]
                if last:
                    cols += [pa.array([len(x) for x in marks], pa.int64()), pa.array([x.count(1) for x in marks], pa.int64()), pa.array([len(x) for x in names], pa.int64())]
                    cols.append(pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *cols], ["_row", "_text", *_STATE, *(_FIGURES if last else ())])
        release()

    return run


_STATE = {"hit": "binary", "items": "array<string>"}
_FIGURES = {"n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string"}


def search(docs: DataFrame, benchmark: DataFrame, how: Windows = Windows(), id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, the columns to keep, n_words, n_hit, n_items, items_sha256, contaminated, items, hit for each row of docs.

    hit has a byte for each word, 1 inside an occurrence of a window; items are the ids of items with an occurring
    window, as strings in order. Null and empty texts have no words; an item without words has no window. A null item id
    marks words but is no item; items that share an id count once. Rows that repeat an id, and null ids, are judged each
    for itself, texts of any length whole. Empty tables give none.

    The benchmark's size is looked at first: it is broadcast in as many parts as its bytes need, and documents pass
    through the parts one after another without a shuffle. How rare each of its words is, all documents say.
    """
    spark = docs.sparkSession
    items = benchmark.select(benchmark[item_col].cast("string").alias("name"), benchmark[text_col].cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    parts = -(-size // how.part_bytes) or 1
    row = F.struct(docs[id_col].alias(id_col), *(docs[c] for c in keep if c != text_col))
    state = docs.select(row.alias("_row"), docs[text_col].cast("string").alias("_text"))
    kind = state.schema["_row"].dataType.simpleString()
    texts = state.select("_text")
    state = state.withColumns({c: F.lit(None).cast(t) for c, t in _STATE.items()})
    for part in range(parts):
        own = items if parts == 1 else items.where(F.pmod(F.xxhash64("name", "text"), F.lit(parts)) == part)
        windows = item_windows([tuple(r) for r in own.collect()], how.size)
        known = spark.sparkContext.broadcast(frozenset(x for w in windows for x in w))
        counts = texts.mapInArrow(_count(known), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        index = prefix_index(windows, {bytes(r.word): r.n for r in counts.collect()})
        kinds = _STATE | (_FIGURES if part == parts - 1 else {})
        run = _search(spark.sparkContext.broadcast(index), part == parts - 1)
        state = state.mapInArrow(run, f"`_row` {kind}, `_text` string, " + ", ".join(f"{c} {t}" for c, t in kinds.items()))
    kept = [F.col("_text").alias(c) if c == text_col else F.col(f"_row.`{c}`").alias(c) for c in keep]
    return state.select(F.col(f"_row.`{id_col}`").alias(id_col), *kept, "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"), "items", "hit")
