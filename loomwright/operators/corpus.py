"""A corpus that is merged into batch by batch: a text that is there already is told by its key, and old texts stay unread."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwright.functions import expr
from loomwright.schema import ROW_ID

#: Bits of a Bloom filter for each key, and how many of them a key sets: one key in a hundred seems to be there and isn't.
BITS, HASHES = 10, 7


def text_key(text: Column) -> Column:
    """128 bits of the SHA-256 of a text."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _places(keys: pa.Array, bits: int) -> np.ndarray:
    """The bits that each key sets, a row a key."""
    halves = np.frombuffer(b"".join(keys.to_pylist()), ">u8").reshape(-1, 2)
    return (halves[:, :1] + np.arange(HASHES, dtype=np.uint64) * (halves[:, 1:] | np.uint64(1))) % np.uint64(bits)


def _filter(table: pa.Table) -> pa.Table:
    """The Bloom filter of the keys of one bucket."""
    bits = 8 * math.ceil(max(table.num_rows, 1) * BITS / 8)
    marks = np.zeros(bits, bool)
    marks[_places(table.column("key").combine_chunks(), bits).ravel()] = True
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "filter": pa.array([np.packbits(marks).tobytes()], pa.binary())})


def _maybe(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The keys of one bucket that some batch's filter has."""
    seen = np.zeros(keys.num_rows, bool)
    own = keys.column("key").combine_chunks()
    for raw in filters.column("filter").to_pylist() if keys.num_rows else ():
        marks = np.unpackbits(np.frombuffer(raw, np.uint8)).astype(bool)
        seen |= marks[_places(own, len(marks))].all(axis=1)
    return keys.select(["key"]).filter(pa.array(seen))


@dataclass(frozen=True)
class Corpus:
    """texts (the rows), keys and filters in a folder that driver and executors share, each with a folder for each batch.

    buckets: of keys, by their first bytes, for the filters; so many that a bucket's keys of one batch, and the filters of
    all batches (ten bits a key), fit in a task.
    """

    spark: SparkSession
    folder: str
    buckets: int = 256

    def _read(self, kind: str, schema: str, before: int) -> DataFrame:
        """The batches before this one."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], f"{schema}, batch int")
        return self.spark.read.schema(f"{schema}, batch int").parquet(f"{self.folder}/{kind}").where(F.col("batch") < before)

    def known(self, keys: DataFrame, batch: int) -> DataFrame:
        """Of the keys those that earlier batches have. Bloom filters tell most that they lack; only the rest meets the keys."""
        bucket = F.pmod(F.conv(F.hex(F.substring("key", 1, 4)), 16, 10).cast("bigint"), F.lit(self.buckets)).cast("int")
        filters = self._read("filters", "bucket int, filter binary", batch)
        maybe = keys.select(bucket.alias("bucket"), "key").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_maybe, "key binary")
        return maybe.join(self._read("keys", "bucket int, key binary", batch), "key", "left_semi")

    def add(self, df: DataFrame, batch: int, text: str = "text") -> DataFrame:
        """The rows that are new, which now belong to the corpus: of rows with one text the one with the smallest row
        number, if no earlier batch has it. Null texts and those of white space only stay out. A batch that is added
        again replaces itself; batches are added in the order of their numbers."""
        rows = df.where(F.col(text).isNotNull() & ~expr.is_blank(F.col(text))).withColumn("_key", text_key(F.col(text)))
        first = F.row_number().over(Window.partitionBy("_key").orderBy(ROW_ID))
        once = rows.withColumn("_rank", first).where("_rank = 1").drop("_rank")
        once.write.mode("overwrite").parquet(stage := f"{self.folder}/stage/batch={batch}")
        once = self.spark.read.schema(once.schema).parquet(stage)
        known = self.known(once.select(F.col("_key").alias("key")), batch)
        fresh = once.join(known, F.col("_key") == F.col("key"), "left_anti")
        fresh.write.mode("overwrite").parquet(texts := f"{self.folder}/texts/batch={batch}")
        fresh = self.spark.read.schema(once.schema).parquet(texts)
        bucket = F.pmod(F.conv(F.hex(F.substring("_key", 1, 4)), 16, 10).cast("bigint"), F.lit(self.buckets)).cast("int")
        fresh.select(bucket.alias("bucket"), F.col("_key").alias("key")).write.mode("overwrite").parquet(own := f"{self.folder}/keys/batch={batch}")
        keys = self.spark.read.schema("bucket int, key binary").parquet(own)
        keys.groupBy("bucket").applyInArrow(_filter, "bucket int, filter binary").write.mode("overwrite").parquet(f"{self.folder}/filters/batch={batch}")
        return fresh.drop("_key")

    def rows(self) -> DataFrame:
        """All rows of the corpus."""
        return self.spark.read.option("mergeSchema", True).parquet(f"{self.folder}/texts").drop("_key", "batch")
