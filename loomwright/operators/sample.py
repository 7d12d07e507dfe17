"""Exact samples and splits by sampling keys, top rows by score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import expr
from loomwright.operators.ranges import below, ranked
from loomwright.schema import ROW_ID


#: Up to so many rows each task keeps its best and one task the best of them; more are found by a cut-off key.
FEW = 10_000


def chosen(df: DataFrame, n: int, seed: int | str = 42) -> Column:
    """The condition for the n rows with the smallest keys."""
    return below(df, expr.rank_key(F.col(ROW_ID), seed), ROW_ID, n)


def take(df: DataFrame, n: int, seed: int | str = 42) -> DataFrame:
    """n rows without replacement: those with the smallest keys; no global sort."""
    if n > FEW:
        return df.where(chosen(df, n, seed))
    return df.orderBy(expr.rank_key(F.col(ROW_ID), seed), ROW_ID).limit(n)


def top(df: DataFrame, score: Column, n: int) -> DataFrame:
    return df.withColumn("score", score).orderBy(F.desc("score"), ROW_ID).limit(n)


def folds(df: DataFrame, label: str, k: int = 5, seed: int | str = 42) -> DataFrame:
    """fold: k of equal size in each class (null is one), by key. Numbers and classes are ranked without the rows and then
    meet them again; rows of one number and class are in one fold."""
    ids = df.select(F.col(label).alias("_class"), F.col(ROW_ID).alias("_id"), expr.rank_key(F.col(ROW_ID), seed).alias("_key")).distinct()
    own = ranked(ids, "_rank", ["_key", "_id"], "_class").select("_class", "_id", F.pmod("_rank", F.lit(k)).cast("int").alias("fold"))
    return df.join(own, F.col(label).eqNullSafe(F.col("_class")) & (F.col(ROW_ID) == F.col("_id"))).drop("_class", "_id")


def first_and_rest(df: DataFrame, n: int, seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    """n rows by key, and all others: two filters by one cut-off key."""
    own = chosen(df, n, seed)
    return df.where(own), df.where(~own)


def test_size(n: int, share: float = 0.2, least: int = 50) -> int:
    """Raises where the rows don't leave any to train on."""
    size = max(int(share * n), least)
    if size >= n:
        raise ValueError(f"{n} rows are too few: the test set takes {size}")
    return size


def train_test(df: DataFrame, share: float = 0.2, least: int = 50, seed: int | str = 42) -> tuple[DataFrame, DataFrame]:
    test, train = first_and_rest(df, test_size(df.count(), share, least), seed)
    return train, test


def seed_size(n: int, most: int = 50) -> int:
    return min(most, n // 3)


def inject_faults(df: DataFrame, null_text: float = 0.05, null_label: float = 0.03, repeat: float = 0.04, drop_class: tuple[str, float] = ("positive", 0.45), longer: tuple[int, int] = (10, 15), seed: int = 42) -> DataFrame:
    """Faults whose numbers are known: nulls, repeated rows, a class cut down, long texts. Rows are picked by key."""
    n = df.count()
    out = df.withColumn("text", F.when(chosen(df, longer[0], f"{seed}long"), F.repeat("text", longer[1])).otherwise(F.col("text")))
    out = out.withColumn("text", F.when(~chosen(df, int(n * null_text), f"{seed}text"), F.col("text")))
    out = out.withColumn("label", F.when(~chosen(df, int(n * null_label), f"{seed}label"), F.col("label")))
    name, share = drop_class
    some = out.where(F.col("label") == name)
    out = out.where(~(F.coalesce(F.col("label") == name, F.lit(False)) & chosen(some, int(some.count() * share), f"{seed}class")))
    return out.unionByName(out.where(chosen(out, int(n * repeat), f"{seed}again")))
