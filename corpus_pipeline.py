"""From raw documents to token ids: five stages, each one operator over all that its predecessor kept.

Every stage takes nulls in any column, empty and very long texts, repeated rows and ids, extra columns (which don't go on)
and empty tables. A null or empty text is text of no word: the classifier judges it by its shape and metadata, one of all
such texts stays in near-dedup, it has no passage, and no token. Rows with a null id are never copies of others. Of rows
that repeat an id, near-dedup keeps the one whose text sorts first; other stages judge each row for itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import bpe, decontaminate, line_dedup, quality, simhash
from loomwright.llm.common import shared_dir, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies: by the sets of shingles of five words, at a similarity of about 0.8.
NEAR = simhash.SimHash(shingle=5, radius=20, tables=64)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are bad or toxic go."""
    return quality.classify(docs, table(spark, sf_dir, "labels")).where(~F.col("rejected")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay in their last document only; n_chars is counted anew."""
    out = line_dedup.dedup_lines(docs.select(*COLUMNS))
    return out.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("bigint").alias("n_chars"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of copies and near copies the document with the smallest id stays."""
    return simhash.keep_one(docs.select(*COLUMNS), NEAR)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    found = decontaminate.search(docs, table(spark, sf_dir, "benchmark"), decontaminate.Windows(size=10), keep=COLUMNS[1:])
    return found.where(~F.col("contaminated")).select(*COLUMNS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of the ids and of what they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_decode(docs, path, public_tokenizers.PATTERN, keep=("lang", "source", "n_chars"), with_ids=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("SimHash near-dedup", simhash_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", bpe_stage),
]

#: A trained classifier is no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, folder, f"stage{k}")
    return docs
