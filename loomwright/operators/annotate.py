"""Labels with confidence, their quality, and the rows a person should look at."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import expr
from loomwright.schema import ROW_ID, find_label, find_text, first_column

#: A scorer gets texts and class names and gives a probability of each class for each text.
Scorer = Callable[[list[str], list[str]], list[list[float]]]
THRESHOLD = 0.7


def with_confidence(df: DataFrame, probabilities: Column, classes: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """predicted_label, confidence (four digits), needs_review (below the threshold, after rounding)."""
    names = F.array(*map(F.lit, classes))
    one = expr.bound(probabilities, lambda p: F.struct(expr.argmax(p, names).alias("name"), F.bround(F.array_max(p), 4).alias("top")))
    out = df.withColumn("_label", one)
    return out.withColumns({"predicted_label": F.col("_label.name"), "confidence": F.col("_label.top"), "needs_review": F.col("_label.top") < threshold}).drop("_label")


def keyword_probabilities(text: Column) -> Column:
    """negative, positive: by how many known words of either kind a text has, with a bonus for the winner."""

    def two(n: Column) -> Column:
        pos, neg = n["pos"], n["neg"]
        return (pos + F.lit(1.0) + (pos >= neg).cast("double") * 0.5) / (pos + neg + 2.5 - (pos < neg).cast("double") * 0.5)

    return expr.bound(expr.bound(expr.keywords(F.coalesce(text, F.lit(""))), two), lambda p: F.array(F.lit(1.0) - p, p))


def label_by_keywords(df: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The annotator that needs no model: it stays inside generated code."""
    return with_confidence(df, keyword_probabilities(F.col(text)), ["negative", "positive"], threshold)


def label_by_scorer(df: DataFrame, load: Callable[[], Scorer], classes: list[str], text: str = "text", batch: int = 32, threshold: float = THRESHOLD) -> DataFrame:
    """Zero-shot labelling by a model: loaded once a task, fed batch texts at a time."""
    at, schema = df.columns.index(text), df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = load()
        for b in batches:
            for begin in range(0, b.num_rows, batch):
                part = b.slice(begin, batch)
                p = score([t or "" for t in part.column(at).to_pylist()], classes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([[float(x) for x in row] for row in p], pa.list_(pa.float64()))], [*part.schema.names, "_p"])

    from pyspark.sql import types as T

    scored = df.mapInArrow(run, T.StructType([*schema.fields, T.StructField("_p", T.ArrayType(T.DoubleType()))]))
    return with_confidence(scored, F.col("_p"), classes, threshold).drop("_p")


#: A column with more different values than this isn't one of classes.
MOST_CLASSES = 10_000


def classes_of(df: DataFrame, label: str = "label") -> DataFrame:
    """class: the different values of a column, without null."""
    return df.select(F.col(label).alias("class")).where(F.col("class").isNotNull()).distinct()


def default_classes(df: DataFrame, label: str | None = "label") -> list[str]:
    """The known classes in order; positive and negative where none is. Raises where there are more than MOST_CLASSES."""
    found = [r[0] for r in classes_of(df, label).orderBy("class").limit(MOST_CLASSES + 1).collect()] if label and label in df.columns else []
    if len(found) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} values: these are no classes")
    return [str(c) for c in found] or ["positive", "negative"]


def confusion(df: DataFrame, truth: str = "label", predicted: str = "predicted_label") -> DataFrame:
    """truth, predicted, n over rows that have both."""
    both = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    return both.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def agreement(pairs: DataFrame) -> DataFrame:
    """kappa, agreement, n of a confusion table; null where there is nothing to compare or chance alone agrees fully.

    The table has a row for each pair of classes, and is all that is looked at."""
    total = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("same"))
    t, p = pairs.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("a")), pairs.groupBy(F.col("predicted").alias("c")).agg(F.sum("n").alias("b"))
    chance = t.join(p, "c").agg(F.coalesce(F.sum(F.col("a").cast("double") * F.col("b")), F.lit(0.0)).alias("ab"))
    po, pe = F.col("same") / F.nullif("n", F.lit(0)), F.col("ab") / (F.nullif("n", F.lit(0)).cast("double") * F.col("n"))
    kappa = F.try_divide(po - pe, 1 - pe)
    return total.crossJoin(F.broadcast(chance)).select(F.bround(kappa, 4).alias("kappa"), F.bround(po, 4).alias("agreement"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def confidence_stats(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    c = F.col("confidence")
    low = F.count(F.when(c < threshold, 1))
    return df.agg(
        F.bround(F.avg(c), 4).alias("confidence_mean"), F.bround(F.stddev_samp(c), 4).alias("confidence_std"), F.bround(F.min(c), 4).alias("confidence_min"), F.bround(F.max(c), 4).alias("confidence_max"),
        low.alias("low_confidence_count"), expr.percent(low, F.count("*"), 2).alias("low_confidence_pct"),
    )


def check_quality(df: DataFrame, threshold: float = THRESHOLD) -> dict:
    """label_dist, confidence figures, kappa and agreement (always there, null without ground truth)."""
    predicted = "predicted_label" if "predicted_label" in df.columns else find_label(df)
    if predicted is None:
        raise ValueError("no label column")
    out: dict = {"label_dist": {r[0]: r["count"] for r in df.where(F.col(predicted).isNotNull()).groupBy(predicted).count().orderBy(F.desc("count"), predicted).collect()}}
    if "confidence" in df.columns:
        out |= confidence_stats(df, threshold).first().asDict()
    truth = "label" if "label" in df.columns and predicted == "predicted_label" else "ground_truth" if "ground_truth" in df.columns else None
    row = agreement(confusion(df, truth, predicted)).first() if truth else None
    return out | {"kappa": row and row["kappa"], "agreement": row and row["agreement"]}


def flag(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows for review, the least certain first."""
    low = F.col("needs_review") if "needs_review" in df.columns else F.col("confidence") < threshold
    return df.where(low).orderBy("confidence", *([ROW_ID] if ROW_ID in df.columns else []))


def review_queue(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows for review as they are, with an empty column for the correction."""
    low = F.col("needs_review") if "needs_review" in df.columns else F.col("confidence") < threshold
    return df.where(low).withColumn("corrected_label", F.lit(""))


def auto_correct(queue: DataFrame) -> DataFrame:
    """Stands in for the reviewer: the correction is the known label, and the prediction where no label is known."""
    known = F.coalesce("label", "predicted_label") if "label" in queue.columns else F.col("predicted_label")
    return queue.withColumn("corrected_label", known)


def corrections(queue: DataFrame, n: int = 10) -> DataFrame:
    """The first n rows whose correction differs from the prediction, with the beginning of their text."""
    changed = queue.where(F.coalesce(F.col("corrected_label") != F.col("predicted_label"), F.lit(True)))
    return changed.orderBy(ROW_ID).limit(n).select(ROW_ID, expr.preview(F.col("text"), 100).alias("text"), F.col("predicted_label").alias("auto_label"), F.col("corrected_label").alias("corrected_to"), "confidence")


def merge_review(df: DataFrame, corrected: DataFrame) -> DataFrame:
    """All rows with final_label: the prediction of confident rows, the correction of reviewed ones.

    A correction that is null, empty or white space means that the prediction stands.
    """
    sure = df.where(~F.col("needs_review")).withColumn("final_label", F.col("predicted_label"))
    given = F.nullif(expr.strip(F.coalesce(F.col("corrected_label"), F.lit(""))), F.lit(""))
    seen = corrected.withColumn("final_label", F.coalesce(given, F.col("predicted_label")))
    return sure.unionByName(seen, allowMissingColumns=True)


def tasks(df: DataFrame, model: str = "facebook/bart-large-mnli") -> DataFrame:
    """A column task: annotation tasks as JSON; predictions only where there is a label; score 1 without confidence."""
    text = find_text(df)
    if text is None:
        raise ValueError("no text column")
    label = find_label(df, ("predicted_label", "label", "target"))
    data = [F.col(text).cast("string").alias("text"), *([F.col("source").cast("string").alias("source")] if "source" in df.columns else []), *([F.col("confidence").cast("double").alias("confidence")] if "confidence" in df.columns else [])]
    parts = [F.struct(*data).alias("data")]
    if label:
        score = F.col("confidence").cast("double") if "confidence" in df.columns else F.lit(1.0)
        result = F.struct(F.lit("label").alias("from_name"), F.lit("text").alias("to_name"), F.lit("choices").alias("type"), F.struct(F.array(F.col(label).cast("string")).alias("choices")).alias("value"))
        parts.append(F.when(F.col(label).isNotNull(), F.array(F.struct(F.lit(model).alias("model_version"), F.array(result).alias("result"), score.alias("score")))).alias("predictions"))
    keep = [ROW_ID] if ROW_ID in df.columns else []
    return df.select(*keep, F.to_json(F.struct(*parts)).alias("task"))


def examples(df: DataFrame, label: str | None = None, n: int = 3, seed: int = 42, chars: int = 200) -> DataFrame:
    """Up to n rows of each class, those with the smallest sampling keys: label, rank, text."""
    from pyspark.sql import Window

    label = label or first_column(df, "predicted_label", "label", "target", "class", "category")
    rank = F.row_number().over(Window.partitionBy(label).orderBy(expr.rank_key(F.col(ROW_ID), seed), ROW_ID))
    return df.where(F.col(label).isNotNull()).withColumn("rank", rank).where(F.col("rank") <= n).select(F.col(label).alias("label"), "rank", expr.preview(F.col("text"), chars).alias("text"))
