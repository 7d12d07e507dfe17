"""What the exploration notebook draws, as frames: cross tables, summaries, histograms, words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import expr
from loomwright.operators import quantiles as order
from loomwright.operators.quantiles import quantiles


def crosstab(df: DataFrame, rows: str, columns: str, names: list[str]) -> DataFrame:
    """A column for each of names, counts of their rows; 0 where there are none."""
    out = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull()).groupBy(rows).pivot(columns, names).count()
    return out.fillna(0, subset=names)


def crosstab_margins(df: DataFrame, rows: str, columns: str) -> DataFrame:
    """rows, columns, n with totals under the name All; one pass over the data."""
    both = df.where(F.col(rows).isNotNull() & F.col(columns).isNotNull()).cube(rows, columns).agg(F.count("*").alias("n"), F.grouping(rows).alias("_a"), F.grouping(columns).alias("_b"))
    return both.select(F.when(F.col("_a") == 1, "All").otherwise(F.col(rows)).alias(rows), F.when(F.col("_b") == 1, "All").otherwise(F.col(columns)).alias(columns), "n")


def by_source(df: DataFrame) -> DataFrame:
    """records, positive, negative, mean length and word count, share of positive, for each source."""
    is_ = lambda name: F.count(F.when(F.col("label") == name, 1))
    out = df.groupBy("source").agg(F.count("text").alias("records"), is_("positive").alias("positive"), is_("negative").alias("negative"), F.bround(F.avg(F.length("text")), 1).alias("avg_text_len"), F.bround(F.avg(expr.word_count(F.col("text"))), 1).alias("avg_word_count"))
    return out.withColumn("balance_pct", expr.percent(F.col("positive"), F.col("records"), 1))


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max of numeric columns, exact; a row each. NaN is no value."""
    found = quantiles(df, {c: F.col(c) for c in columns}, (0.25, 0.5, 0.75))
    x = {c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in columns}
    aggs = [a for i, c in enumerate(columns) for a in (F.count(x[c]).alias(f"n{i}"), F.avg(x[c]).alias(f"a{i}"), F.stddev_samp(x[c]).alias(f"s{i}"), F.min(x[c]).alias(f"l{i}"), F.max(x[c]).alias(f"h{i}"))]
    facts = [F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("count"), F.bround(f"a{i}", 4).alias("mean"), F.bround(f"s{i}", 4).alias("std"), F.bround(f"l{i}", 4).alias("min"), *(F.bround(F.lit(q).cast("double"), 4).alias(name) for q, name in zip(found[c], ("q25", "q50", "q75"))), F.bround(f"h{i}", 4).alias("max")) for i, c in enumerate(columns)]
    return df.agg(*aggs).select(F.inline(F.array(*facts)))


def describe_text(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, unique, top (the smallest of the most frequent values), freq of string columns; a row each."""
    stacked = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns))).alias("p")).select("p.*")
    counts = stacked.groupBy("column", "v").agg(F.count("*").alias("n"))
    there = F.col("v").isNotNull()
    # Of the most frequent values the smallest: the least of (minus count, value).
    best = F.min(F.when(there, F.struct((-F.col("n")).alias("n"), "v")))
    out = counts.groupBy("column").agg(F.coalesce(F.sum(F.when(there, F.col("n"))), F.lit(0)).alias("count"), F.count("v").alias("unique"), best.alias("best"))
    return out.select("column", "count", "unique", F.col("best.v").alias("top"), (-F.col("best.n")).alias("freq"))


def histogram(df: DataFrame, value, bins: int) -> DataFrame:
    """bin (from 0), lower, n: equal widths between the smallest and the largest value; the last bin is closed."""
    x = df.select(value.cast("double").alias("x")).where("x is not null and not isnan(x)")
    ends = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("x") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))).otherwise(F.lit(0))
    return x.crossJoin(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.first(F.col("lo")).alias("_lo"), F.first(width).alias("_w")).select("bin", F.bround(F.col("_lo") + F.col("bin") * F.col("_w"), 4).alias("lower"), "n")


def quantiles_by(df: DataFrame, column, key: str, shares: tuple[float, ...]) -> DataFrame:
    """key, n, q: exact quantiles of a column in each group; null is a group, one without values isn't."""
    return order.group_quantiles(df, {"x": column}, shares, (key,)).select(key, "n", "q")


def boxes(df: DataFrame, column, key: str, reach: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """The boxes with whiskers of each group, and the points beyond them: see quantiles.boxes."""
    return order.boxes(df, column, key, reach)


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    return df.select(F.explode(expr.words(F.col(text))).alias("word")).where(expr.is_content(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


def top_words(df: DataFrame, n: int = 20, text: str = "text") -> DataFrame:
    return word_counts(df, text).orderBy(F.desc("n"), "word").limit(n)


def class_words(df: DataFrame, label: str = "label", text: str = "text") -> DataFrame:
    """label, word, n: how often each word is in the texts of a class, which is all that a word cloud draws. Texts of a class
    are never put together."""
    words = df.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), F.explode(expr.words(F.col(text))).alias("word"))
    return words.where(expr.is_content(F.col("word"))).groupBy("label", "word").agg(F.count("*").alias("n"))


def columns(df: DataFrame) -> DataFrame:
    """column, type, nulls, unique."""
    row = df.agg(*(a for i, c in enumerate(df.columns) for a in (F.count(F.when(F.col(f"`{c}`").isNull(), 1)).alias(f"n{i}"), F.count_distinct(F.col(f"`{c}`")).alias(f"u{i}"))))
    return row.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n{i}").alias("nulls"), F.col(f"u{i}").alias("unique")) for i, (c, t) in enumerate(df.dtypes)))))
