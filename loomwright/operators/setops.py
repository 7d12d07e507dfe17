"""Unions, keep-first deduplication, differences, alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import expr
from loomwright.operators.ranges import by_range, ranked
from loomwright.schema import RECORD, ROW_ID


def union_all(frames: list[DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """By name; columns that a frame lacks are null. No frame: no row of the record layout."""
    if not frames:
        return (spark or SparkSession.active()).createDataFrame([], RECORD)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def keep_first(df: DataFrame, *keys: str, order: str = ROW_ID) -> DataFrame:
    """Of the rows with equal keys (nulls are equal) the one that comes first."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def digest(df: DataFrame) -> Column:
    """256 bits that tell rows apart by all columns but the row number; nulls are equal, NaN too, and 0 and -0."""
    own = [f for f in df.schema if f.name != ROW_ID]
    plain = lambda f: F.col(f"`{f.name}`") + F.lit(0).cast(f.dataType) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f"`{f.name}`")
    text = lambda f: plain(f).cast("string") if isinstance(f.dataType, (T.AtomicType, T.NullType)) else F.to_json(F.struct(plain(f).alias("v")))
    each = [F.coalesce(F.concat(F.octet_length(text(f)).cast("string"), F.lit(":"), text(f)), F.lit("-")) for f in own]
    return F.unhex(F.sha2(F.concat(*each) if each else F.lit(""), 256)).alias("_digest")


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Rows that are equal in all columns but the row number, once; the smallest row number stays."""
    own = [c for c in df.columns if c != ROW_ID]
    return df.groupBy(*own).agg(F.min(ROW_ID).alias(ROW_ID)).select(df.columns) if ROW_ID in df.columns else df.dropDuplicates()


def merge(frames: list[DataFrame], spark: SparkSession | None = None) -> DataFrame:
    """Union, first row of each text, then rows without text go: null texts and those of white space only.

    First is the earlier frame, then the smaller row number. Rows without numbers go by a hash of the row, so that the
    choice doesn't depend on where rows lie.
    """
    df = union_all([f.withColumn("_frame", F.lit(i)) for i, f in enumerate(frames)], spark)
    if not frames:
        return df
    if ROW_ID not in df.columns:
        df = ranked(df.withColumns({"_hash": F.xxhash64(*df.columns), "_place": F.monotonically_increasing_id()}), ROW_ID, ["_frame", "_hash", "_place"]).drop("_hash", "_place")
    rank = F.row_number().over(Window.partitionBy("text").orderBy("_frame", ROW_ID))
    df = df.withColumn("_rank", rank).where("_rank = 1").drop("_rank", "_frame")
    return df.where(F.col("text").isNotNull() & ~expr.is_blank(F.col("text")))


def minus(df: DataFrame, taken: DataFrame, key: str = ROW_ID) -> DataFrame:
    """The rows whose key isn't taken; duplicates stay."""
    return df.join(taken.select(key), key, "left_anti")


def only(df: DataFrame, taken: DataFrame, key: str = ROW_ID) -> DataFrame:
    return df.join(taken.select(key), key, "left_semi")


def reindex(df: DataFrame, order: str = ROW_ID) -> DataFrame:
    """Row numbers from 0 without gaps, in the order of the old ones.

    Only the counts of sorted ranges meet in one place: each range begins where those before it end.
    """
    return ranked(df, "_rank", [order]).withColumn(order, F.col("_rank")).select(df.columns)


def align(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two modalities by a shared key, without losing rows of either side."""
    return left.join(right, key, "full_outer")


def align_as_of(left: DataFrame, right: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """Each left row with the latest non-null columns of right at or before its time, key by key.

    Rows are dealt out by ranges of (key, time), so that a key with very many rows spreads over ranges; what comes in from
    the ranges before is a row for each range, of the key that it begins with.
    """
    own = [c for c in left.columns if c not in columns]
    both = left.select(*own, *(F.lit(None).alias(c) for c in columns), F.lit(1).alias("_side")).unionByName(right.select(key, time, *columns, F.lit(0).alias("_side")), allowMissingColumns=True)
    ranged = by_range(both, key, time, "_side")
    k = F.col(key)
    last = ranged.groupBy("_part", key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in columns), F.max("_at").alias("_end"), F.min("_at").alias("_begin"))
    ends = ranged.groupBy(F.col("_part").alias("_p")).agg(F.max("_at").alias("_last"), F.min("_at").alias("_first"))
    # Of each range the first and the last key; all others begin and end inside it.
    edge = last.join(F.broadcast(ends), (F.col("_part") == F.col("_p")) & ((F.col("_end") == F.col("_last")) | (F.col("_begin") == F.col("_first"))))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(F.col("_part").alias("_p"), k.alias("_k"), *(F.last(c, True).over(before).alias(f"_c{i}") for i, c in enumerate(columns)))
    back = Window.partitionBy("_part", key).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.select(*own, "_side", "_part", *(F.last(c, ignorenulls=True).over(back).alias(c) for c in columns)).where("_side = 1")
    out = inside.join(F.broadcast(carry), (F.col("_part") == F.col("_p")) & k.eqNullSafe(F.col("_k")), "left")
    return out.select(*own, *(F.coalesce(c, f"_c{i}").alias(c) for i, c in enumerate(columns)))


def align_nearest(left: DataFrame, right: DataFrame, key: str, time: str, id_col: str, columns: list[str], tolerance: float | None = None) -> DataFrame:
    """Two modalities by key and time, without losing rows of either side: the columns of left; id_col and the columns of
    the right row nearest to it, before or after, at most tolerance away (seconds, for times that are numbers those); gap,
    the right row's time less the left one's. Then the right rows that no left row has taken, with their key and time.

    Of two equally far the earlier one counts, of right rows of one time the last by id_col where they come before (or at
    the same time), the first where they come after. A right row may be taken by several left rows. Rows without key or
    time meet none, and stay. id_col names right rows one by one.

    Both sides lie in ranges of (key, time); the last right row so far and the first one to come are carried on within
    each range, and between ranges for the keys at their ends, so that a key of any number of rows spreads.
    """
    own, kind = left.columns, left.schema[time].dataType
    at = (lambda c: F.unix_micros(c.cast("timestamp")) / 1e6) if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) else (lambda c: c.cast("double"))
    row = F.struct(F.col(time).alias("t"), F.col(id_col).alias("id"), *(F.col(c).alias(f"c{i}") for i, c in enumerate(columns)))
    there = F.col(key).isNotNull() & F.col(time).isNotNull()
    sides = right.where(there).select(key, time, row.alias("_r"), F.lit(0).alias("_side"), F.col(id_col).alias("_o"))
    both = left.where(there).withColumn("_side", F.lit(1)).unionByName(sides, allowMissingColumns=True)
    ranged = by_range(both, key, time, "_side", "_o")
    has, k = F.col("_r").isNotNull(), F.col(key)
    ends = ranged.groupBy("_part", key).agg(F.max_by("_r", F.when(has, F.col("_at"))).alias("_last"), F.min_by("_r", F.when(has, F.col("_at"))).alias("_first"), F.min("_at").alias("_begin"), F.max("_at").alias("_end"))
    whole = ranged.groupBy(F.col("_part").alias("_p")).agg(F.min("_at").alias("_b"), F.max("_at").alias("_e"))
    edge = ends.join(F.broadcast(whole), (F.col("_part") == F.col("_p")) & ((F.col("_begin") == F.col("_b")) | (F.col("_end") == F.col("_e"))))
    seen = lambda *by: Window.partitionBy(key).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(F.col("_part").alias("_p"), k.alias("_k"), F.last("_last", True).over(seen("_part")).alias("_in"), F.last("_first", True).over(seen(F.desc("_part"))).alias("_out"))
    upto = lambda *by: Window.partitionBy("_part", key).orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    near = ranged.withColumns({"_before": F.last("_r", True).over(upto("_at")), "_after": F.last("_r", True).over(upto(F.desc("_at")))}).where("_side = 1").drop("_r", "_o", "_at")
    near = near.join(F.broadcast(carry), (F.col("_part") == F.col("_p")) & (k == F.col("_k")), "left")
    near = near.select(*own, F.coalesce("_before", "_in").alias("_before"), F.coalesce("_after", "_out").alias("_after"))
    gap = lambda c: at(F.col(f"{c}.t")) - at(F.col(time))
    ok = lambda c: F.col(c).isNotNull() & (F.abs(gap(c)) <= F.lit(tolerance) if tolerance is not None else F.lit(True))
    later = ok("_after") & (~ok("_before") | (gap("_after") < -gap("_before")))
    near = near.withColumn("_r", F.when(later, F.col("_after")).when(ok("_before"), F.col("_before"))).withColumn("gap", gap("_r"))
    matched = near.select(*own, F.col("_r.id").alias(id_col), *(F.col(f"_r.c{i}").alias(c) for i, c in enumerate(columns)), "gap")
    lone = left.where(~there).select(*own)
    left_over = right.join(matched.select(id_col).where(F.col(id_col).isNotNull()), id_col, "left_anti").select(key, time, id_col, *columns)
    return matched.unionByName(lone, allowMissingColumns=True).unionByName(left_over, allowMissingColumns=True)
