"""Accuracy, F1 and the report by class, all from one confusion table; what active learning gained."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.annotate import confusion


def by_class(pairs: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support for each class of truth or prediction; 0 where nothing is there."""
    sums = pairs.select("truth", "predicted", "n").withColumn("p", F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("t"), F.lit(0).cast("bigint").alias("q"), F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit")), F.struct(F.col("predicted").alias("label"), F.lit(0).cast("bigint").alias("t"), F.col("n").alias("q"), F.lit(0).cast("bigint").alias("hit")))))
    sums = sums.select("p.*").groupBy("label").agg(F.sum("t").alias("t"), F.sum("q").alias("q"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.when(b != 0, a / F.nullif(b, F.lit(0))).otherwise(F.lit(0.0))
    return sums.select("label", ratio(F.col("hit"), F.col("q")).alias("precision"), ratio(F.col("hit"), F.col("t")).alias("recall"), ratio(2 * F.col("hit"), F.col("t") + F.col("q")).alias("f1"), F.col("t").alias("support"))


def scores(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """accuracy, f1_macro, f1_weighted, n."""
    pairs = confusion(df, truth, predicted)
    whole = pairs.agg(F.bround(F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)) / F.nullif(F.sum("n"), F.lit(0)), 4).alias("accuracy"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n"))
    f1 = by_class(pairs).agg(F.bround(F.avg("f1"), 4).alias("f1_macro"), F.bround(F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0)), 4).alias("f1_weighted"))
    return whole.crossJoin(F.broadcast(f1)).select("accuracy", "f1_macro", "f1_weighted", "n")


def report(df: DataFrame, truth: str = "label", predicted: str = "prediction") -> DataFrame:
    """A row for each class, then the plain and the weighted mean."""
    own = by_class(confusion(df, truth, predicted))
    w = lambda c: F.sum(F.col(c) * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))
    rows = own.unionByName(own.agg(F.lit("macro avg").alias("label"), *(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support")))
    rows = rows.unionByName(own.agg(F.lit("weighted avg").alias("label"), *(w(c).alias(c) for c in ("precision", "recall", "f1")), F.sum("support").alias("support")))
    return rows.select("label", *(F.bround(c, 4).alias(c) for c in ("precision", "recall", "f1")), "support")


def learning_summary(history: DataFrame) -> DataFrame:
    """First and last accuracy and F1 of each strategy, and the gains."""
    ends = history.groupBy("strategy").agg(*(f(c, "iteration").alias(f"{name}_{c}") for name, f in (("seed", F.min_by), ("final", F.max_by)) for c in ("accuracy", "f1")), F.max("n_labeled").alias("n_labeled_final"))
    return ends.select("strategy", "seed_accuracy", "seed_f1", "final_accuracy", "final_f1", F.bround(F.col("final_accuracy") - F.col("seed_accuracy"), 4).alias("accuracy_gain"), F.bround(F.col("final_f1") - F.col("seed_f1"), 4).alias("f1_gain"), "n_labeled_final")


def savings(history: DataFrame, measure: str = "accuracy", strategy: str = "entropy", base: str = "random") -> DataFrame:
    """target (what the base strategy ends with), n_base, n_first and iteration (where the strategy first gets there), saved, saved_pct."""
    goal = history.where(F.col("strategy") == base).agg(F.max_by(measure, "iteration").alias("target"), F.max_by("n_labeled", "iteration").alias("n_base"))
    there = history.where(F.col("strategy") == strategy).crossJoin(F.broadcast(goal)).where(F.col(measure) >= F.col("target"))
    first = there.agg(F.min_by("n_labeled", "iteration").alias("n_first"), F.min("iteration").alias("iteration"))
    saved = F.col("n_base") - F.col("n_first")
    return goal.crossJoin(F.broadcast(first)).select("target", "n_base", "n_first", "iteration", saved.alias("saved"), F.bround(saved / F.nullif("n_base", F.lit(0)) * 100, 1).alias("saved_pct"))
