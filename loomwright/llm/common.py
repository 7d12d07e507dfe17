"""What the operators share: the shared work folder, written tables, ASCII lower case."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

# The white space of the word and line contracts, [\x20\x09-\x0D], and A-Z with a-z.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

_FALLBACK: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; removed when the JVM ends.

    Only where the session names no such folder and driver and tasks are one process (tests) a temporary one is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not base:
        base = _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="loomwright-"))
    path = f"{base.rstrip('/')}/loomwright-{uuid.uuid4().hex}"
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop)
    fs.deleteOnExit(hadoop)
    return path


def drop_dir(spark: SparkSession, path: str) -> None:
    """Deletes a folder of shared_dir that is no longer needed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes df once as Parquet in the shared folder and reads it back: cuts the lineage, outlives executors."""
    path = f"{folder}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_ids(df: DataFrame, column: str) -> None:
    """Raises where ids are no whole numbers: components are named by their smallest id, as a 64-bit number."""
    if not isinstance(df.schema[column].dataType, IntegralType):
        raise TypeError(f"{column} has to be a whole number, not {df.schema[column].dataType.simpleString()}; number the rows first")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. lower() is the quick way for texts that are ASCII throughout."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """For the queries. They hand rows to Python in small batches, whatever the length of texts: a setting of the session
    that changes no result."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def release() -> None:
    """Gives back to the system what a finished task has freed; Python workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
