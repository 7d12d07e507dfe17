"""Review as a stream: corrections arrive as files, the last one of each row counts, and labels are merged batch by batch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from loomwright.operators.annotate import merge_review
from loomwright.schema import REVIEW, ROW_ID

NUMBERED = T.StructType([T.StructField(ROW_ID, T.LongType()), *REVIEW.fields])
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read(spark: SparkSession, folder: str, schema: T.StructType = REVIEW) -> DataFrame:
    """A streaming frame of review rows from the CSV files that appear in a folder. _order tells which of two corrections is
    the later one: by the time of the file, its name, and the place in it."""
    rows = spark.readStream.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(folder)
    time = F.lpad(F.unix_micros(F.col("_metadata.file_modification_time")).cast("string"), 20, "0")
    marked = rows.withColumn("_order", F.concat_ws("|", time, F.col("_metadata.file_path")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()  # a file is read by one task, from its beginning
        for b in batches:
            own = []
            for file in b.column(b.num_columns - 1).to_pylist():
                own.append(f"{file}|{seen[file]:010}")
                seen[file] += 1
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own, pa.string())], b.schema.names)

    return marked.mapInArrow(place, marked.schema)


class LastCorrection(StatefulProcessor):
    """Holds the last correction of each row, and tells when it changes."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("last", "label string, at string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        best = max(((r["_order"], r["corrected_label"]) for r in rows), key=lambda x: x[0])
        before = self.last.get() if self.last.exists() else None
        if before is not None and best[0] <= before[1]:
            return
        self.last.update((best[1], best[0]))
        if before is None or before[0] != best[1]:
            yield Row(**{ROW_ID: key[0], "corrected_label": best[1], "_order": best[0]})

    def close(self) -> None:
        pass


def changes(stream: DataFrame) -> DataFrame:
    """_row_id, corrected_label, _order: a row whenever the correction that counts for a row becomes another one. Blank ones
    are corrections too: they take an earlier one back. Rows without a number are left out."""
    own = stream.where(F.col(ROW_ID).isNotNull()).select(ROW_ID, F.coalesce("corrected_label", F.lit("")).alias("corrected_label"), "_order")
    return own.groupBy(ROW_ID).transformWithState(LastCorrection(), f"{ROW_ID} bigint, corrected_label string, _order string", "Update", "None")


def follow(stream: DataFrame, target: str, checkpoint: str):
    """Writes the changes of each batch below target by its number; a batch that is tried again replaces what it wrote. What
    earlier batches brought is in the state store, so that a batch costs its own rows only."""
    spark = stream.sparkSession
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKS)
    try:
        write = lambda rows, n: rows.write.mode("overwrite").parquet(f"{target}/batch={n}")
        return changes(stream).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


def corrected(labelled: DataFrame, target: str) -> DataFrame:
    """All labelled rows (with numbers) with final_label: the corrections that count by now merged in."""
    given = labelled.sparkSession.read.schema(f"{ROW_ID} bigint, corrected_label string, _order string, batch bigint").parquet(target)
    last = given.groupBy(ROW_ID).agg(F.max_by("corrected_label", F.struct("batch", "_order")).alias("corrected_label"))
    return merge_review(labelled, labelled.where("needs_review").join(last, ROW_ID, "left"))


def merge_into(stream: DataFrame, labelled: DataFrame, target: str, checkpoint: str):
    """Each batch of corrections, joined with the labelled rows it names by text, is written below target by its number:
    a batch that is tried again replaces what it wrote. Of a text that a batch has several times the correction that
    sorts last counts; one that an earlier batch corrected already is left out."""
    spark = labelled.sparkSession

    def earlier(number: int) -> DataFrame | None:
        try:
            return spark.read.parquet(target).where(F.col("batch") < number).select("text")
        except AnalysisException:  # nothing is written yet
            return None

    def write(batch: DataFrame, number: int) -> None:
        given = batch.groupBy("text").agg(F.max("corrected_label").alias("corrected_label"))
        if number and (before := earlier(number)) is not None:
            given = given.join(before, "text", "left_anti")
        seen = labelled.where("needs_review").join(given, "text")
        merge_review(labelled.where(F.lit(False)), seen).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def distinct_records(stream: DataFrame, time: str = "collected_time", delay: str = "1 hour") -> DataFrame:
    """Continuous ingest: a text once within the delay; the state kept is bounded by the watermark."""
    return stream.withColumn(time, F.to_timestamp("collected_at")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["text"])
