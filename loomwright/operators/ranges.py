"""Rows dealt out by ranges of an order, and held fast: what is computed from the ranges twice sees the same ranges."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NullType


_FALLBACK: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; it goes when the JVM ends.

    Only where the session names no folder, and driver and tasks are one process (tests), a temporary one is taken.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if not base:
        base = _FALLBACK.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="loomwright-"))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/held-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    return path.toString()


def held(df: DataFrame) -> DataFrame:
    """df written once as Parquet in a shared folder, and read back: what is read twice is the same both times.

    Bounds of ranges are sampled anew by each run of a plan; two uses of one plan may not agree about them otherwise.
    Columns that have no type stay null.
    """
    own = [f.name for f in df.schema if not isinstance(f.dataType, NullType)]
    some, path = df.select(*(F.col(f"`{c}`") for c in own)), f"{shared_folder(df.sparkSession)}/rows"
    some.write.parquet(path)
    back = df.sparkSession.read.schema(some.schema).parquet(path)
    return back.select(*(F.col(f"`{c}`") if c in own else F.lit(None).alias(c) for c in df.columns))


def dealt_out(df: DataFrame, key: str) -> DataFrame:
    """df as it is, or dealt out by a key if it has fewer partitions than there are cores: a file of one row group, or a few
    of them, is read by as few tasks, and what is done with the rows afterwards needn't be."""
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(F.col(key)) if few else df


def by_range(df: DataFrame, *order: str) -> DataFrame:
    """df in sorted ranges, with _part (the range) and _at (the place in it, from 0)."""
    ranged = df.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order)
    return held(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))


def ranked(df: DataFrame, name: str, order: list[str], group: str | None = None) -> DataFrame:
    """df with the rank of each row (from 0) in the order, within its group if there is one (null is a group).

    A group of any size spreads over ranges. What meets in one place has a row for each range and group in it, and is
    broadcast: ranges follow the group first, so that there are no more of them than ranges and groups together.
    """
    keys = ["_part", *([group] if group else [])]
    ranged = by_range(df, *([group] if group else []), *order)
    ends = ranged.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy(*keys[1:]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begin = ends.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_begin"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return ranged.join(F.broadcast(begin), same).withColumn(name, F.col("_begin") + F.col("_at")).select(*df.columns, name)


def mode(df: DataFrame, column: str):
    """The smallest of the most frequent values; null if there is none. Values are counted apart, never in one place."""
    counts = df.where(F.col(f"`{column}`").isNotNull()).groupBy(F.col(f"`{column}`").alias("v")).agg(F.count("*").alias("n"))
    row = counts.orderBy(F.desc("n"), "v").limit(1).collect()
    return row[0]["v"] if row else None


def below(df: DataFrame, key: Column, tie: str, n: int) -> Column:
    """The condition that holds for the n rows of df with the smallest keys (md5 texts; equal keys by tie).

    Keys are counted by their beginnings, four digits a round, until few share the one with the last row; so the rows are
    found by a filter, however many they are. Rows that are equal in key and tie go together.
    """
    keys = df.select(key.alias("k"), F.col(tie).alias("t"))
    start, left, few = "", n, 10_000
    if n <= 0:
        return F.lit(False)
    while True:
        own = keys.where(F.col("k").startswith(start)) if start else keys
        counts = own.groupBy(F.substring("k", len(start) + 1, 4).alias("d")).agg(F.count("*").alias("n")).collect()
        total = sum(r.n for r in counts)
        if total <= left and not start:
            return F.lit(True)
        for r in sorted(counts, key=lambda r: r.d):
            if r.n >= left:
                break
            left -= r.n
        start += r.d
        if r.n <= few or len(start) >= 32:
            last = keys.where(F.col("k").startswith(start)).orderBy("k", "t").limit(left).agg(F.max(F.struct("k", "t")).alias("m")).first().m
            return (key < last.k) | ((key == last.k) & (F.col(tie) <= F.lit(last.t)))
