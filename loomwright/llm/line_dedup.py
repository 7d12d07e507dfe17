"""Line dedup in DataFrame operations only: hashes of lines are dealt out, never the lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from loomwright.llm.common import ASCII_SPACE, ascii_lower, shared_dir, written

#: A null doc_id is a document of its own that comes before all others.
NO_ID = -(1 << 63)
#: A line's documents are dealt out in so many groups, so that a line of any frequency spreads over ranges.
SALTS = 256


@dataclass(frozen=True)
class LineRule:
    """Lines whose key has at least min_chars code points and is in at least min_docs documents stay in one document."""

    min_chars: int = 20
    min_docs: int = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _row_key(text: Column) -> Column:
    """With the doc_id it tells rows of one doc_id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _doc(docs: DataFrame, id_col: str) -> Column:
    """The document's id as it orders: whole numbers as numbers, anything else as text (null: the empty text)."""
    if isinstance(docs.schema[id_col].dataType, IntegralType):
        return F.coalesce(docs[id_col].cast("bigint"), F.lit(NO_ID))
    return F.coalesce(docs[id_col].cast("string"), F.lit(""))


def ordered_lines(lines: DataFrame) -> DataFrame:
    """h1, h2, salt, n, last for each line and group of its documents: how many documents it has there, and the last.

    One range-partitioned pass in the order of hash, group, document (last first) and position: the first occurrence of a
    line in a group says its last document, and the number of changes of document, up to the group's end, how many there
    are. Spark spills a group that is too long for memory.
    """
    order = [F.col("h1"), F.col("h2"), F.col("salt"), F.col("doc").desc(), F.col("pos")]
    ranges = lines.select("h1", "h2", "salt", "doc", "pos").repartitionByRange("h1", "h2", "salt").sortWithinPartitions(*order)
    stream = Window.partitionBy("h1", "h2", "salt").orderBy(F.col("doc").desc(), F.col("pos"))
    so_far = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = ranges.select("h1", "h2", "salt", "doc", "pos", F.lag("doc").over(stream).alias("before"), F.lead("pos").over(stream).isNull().alias("end"), F.first("doc").over(so_far).alias("last"))
    rows = rows.withColumn("n", F.count(F.when(F.col("before").isNull() | (F.col("before") != F.col("doc")), 1)).over(so_far))
    return rows.where("end").select("h1", "h2", "salt", "n", "last")


def keep_bitmaps(docs: DataFrame, rule: LineRule = LineRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, row_key, n_dropped, keep: the keep bitmap of each row of docs that loses lines, compressed.

    keep is an array of (word, bits): bit b of word w says whether line 64 w + b stays; words that are all ones are left
    out, and so are rows that keep all lines. A line's key is the line stripped of ASCII white space, A-Z lower-cased. Of
    a key in enough documents (distinct ids), only the largest id's lines stay, all of them.

    The plan: line hashes (128 bits), document and position go to a table once. ordered_lines streams through their
    ranges; its partial results meet by hash, at most SALTS a line. The keys to drop are joined with the lines again by
    hash and group, so that no task gets more of a frequent line than one group of its documents.
    """
    exploded = docs.select(_doc(docs, id_col).alias("doc"), _row_key(docs[text_col]).alias("row_key"), F.posexplode(_lines(docs[text_col])).alias("pos", "line"))
    key = F.btrim("line", F.lit(ASCII_SPACE))
    keyed = exploded.select("doc", "row_key", "pos", key.alias("key")).where(F.length("key") >= rule.min_chars).select("doc", "row_key", "pos", ascii_lower(F.col("key")).alias("key"))
    salt = F.pmod(F.xxhash64(F.lit(2), "doc"), F.lit(SALTS)).cast("smallint")
    folder = shared_dir(docs.sparkSession)
    lines = written(keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), salt.alias("salt"), "doc", "row_key", "pos"), folder, "lines")
    groups = written(ordered_lines(lines), folder, "groups")
    often = groups.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last")).where(F.col("n") >= rule.min_docs).select("h1", "h2", "last")
    keys = written(groups.select("h1", "h2", "salt").join(often, ["h1", "h2"]), folder, "keys")
    lost = lines.join(keys, ["h1", "h2", "salt"]).where(F.col("doc") != F.col("last"))
    # Rows of one id with one text have the same positions to drop: bit_or counts them once.
    words = lost.groupBy("doc", "row_key", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("pos").bitwiseAND(63))).alias("drop"))
    keep = F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("drop").alias("bits"))))
    return words.groupBy("doc", "row_key").agg(F.sum(F.bit_count("drop")).cast("bigint").alias("n_dropped"), keep.alias("keep"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the columns kept_text, n_lines and n_dropped; one row for each row of docs."""
    names = ("kept_text", "n_lines", "n_dropped", "_keep", "_doc", "_row_key")
    docs = docs.drop(*(n for n in docs.columns if n in names))
    # Every line of a word that isn't there stays. element_at on a map is one look-up a line.
    found = bitmaps.select(F.col("doc").alias("_doc"), F.col("row_key").alias("_row_key"), F.col("n_dropped"), F.map_from_entries("keep").alias("_keep")).hint("shuffle_hash")
    both = docs.withColumns({"_doc": _doc(docs, id_col), "_row_key": _row_key(docs[text_col])}).join(found, ["_doc", "_row_key"], "left")
    lines = _lines(F.col(text_col))
    word = lambda i: F.coalesce(F.try_element_at("_keep", F.shiftright(i, 6)), F.lit(-1).cast("bigint"))
    kept = F.array_join(F.filter(lines, lambda _, i: F.getbit(word(i), i.bitwiseAND(63)) == 1), "\n")
    out = {"kept_text": F.when(F.col("_keep").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept), "n_lines": F.size(lines).cast("bigint"), "n_dropped": F.coalesce("n_dropped", F.lit(0)).cast("bigint")}
    return both.withColumns(out).drop("_keep", "_doc", "_row_key")


def dedup_lines(docs: DataFrame, rule: LineRule = LineRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs with kept_text, n_lines (before) and n_dropped. Null and empty texts are one empty line.

    Ids are whole numbers or texts (in the order of texts; a null one counts as the empty text); other types go by their
    text. Texts of any length are split whole. Rows that repeat an id are one document when documents are counted, and
    each keeps or loses its own lines. Empty tables give none. Columns of the result's names are replaced, others stay.
    """
    return apply_bitmaps(docs, keep_bitmaps(docs, rule, id_col, text_col), id_col, text_col)
