"""Drift: shares of classes in windows of event time, held against a baseline; the same rows from a batch and from a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Added to every count, so that a class that one side lacks has a share.
SMOOTH = 0.5


def baseline(df: DataFrame, label: str) -> DataFrame:
    """class, share: of the rows that have a class, smoothed."""
    counts = df.where(F.col(label).isNotNull()).groupBy(F.col(label).cast("string").alias("class")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum(F.col("n") + SMOOTH).alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("class", ((F.col("n") + SMOOTH) / F.col("total")).alias("share"))  # one row


def _window(time: Column, size: str, slide: str | None) -> Column:
    return F.window(time, size, slide) if slide else F.window(time, size)


def counts(df: DataFrame, time: str, label: str, classes: list[str], size: str, slide: str | None = None, delay: str | None = None) -> DataFrame:
    """start, end, n, counts (of each of the classes) in tumbling windows, or sliding ones if slide is given. On a stream
    delay is how late a row may come; windows come out when the watermark has passed them, and what is kept is a row a window.

    Rows without time or class, or of another class, don't count.
    """
    own = df.where(F.col(label).cast("string").isin(classes))
    own = own.withWatermark(time, delay) if delay else own
    each = [F.count(F.when(F.col(label).cast("string") == c, 1)).alias(f"c{i}") for i, c in enumerate(classes)]
    out = own.groupBy(_window(F.col(time), size, slide).alias("_w")).agg(F.count("*").alias("n"), *each)
    return out.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", F.array(*(F.col(f"c{i}") for i in range(len(classes)))).alias("counts"))


def stability(windows: DataFrame, shares: dict[str, float], limit: float = 0.2) -> DataFrame:
    """start, end, n, psi (population stability index against the shares of a baseline), drifted (psi above the limit)."""
    k = len(shares)
    base = F.array(*(F.lit(float(s)) for s in shares.values()))
    now = F.transform("counts", lambda c: (c + F.lit(SMOOTH)) / (F.col("n") + F.lit(SMOOTH * k)))
    psi = F.aggregate(F.zip_with(now, base, lambda a, b: (a - b) * F.ln(a / b)), F.lit(0.0), lambda s, x: s + x)
    return windows.withColumn("psi", F.round(psi, 9)).select("start", "end", "n", "psi", (F.col("psi") > limit).alias("drifted"))


def monitor(df: DataFrame, against: DataFrame, time: str, label: str, size: str, slide: str | None = None, delay: str | None = None, limit: float = 0.2) -> DataFrame:
    """The windows of df (a frame or a stream) with their distance from the frame `against`, whose classes (a row each
    comes to the driver) are those that count."""
    shares = {r["class"]: r["share"] for r in baseline(against, label).orderBy("class").collect()}
    if not shares:
        raise ValueError(f"the baseline has no row with {label}")
    return stability(counts(df, time, label, list(shares), size, slide, delay), shares, limit)
