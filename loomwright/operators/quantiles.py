"""Exact order statistics of any number of groups: a sketch brackets them, one exact pass settles them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwright.operators.ranges import held

#: Ranks of the sketch are off by this share of the rows at most; brackets are three times as wide.
ERROR = 1e-4
#: Bins of equal width that the values in a bracket are dealt out to.
BINS = 256


def measured(df: DataFrame, columns: dict[str, Column], keys: tuple[str, ...] = ()) -> DataFrame:
    """keys, column, x: the values of all columns as rows; nulls and NaN are none. Written once, so that whatever made df
    runs once; texts are left behind."""
    wide = df.select(*keys, *(c.cast("double").alias(name) for name, c in columns.items()))
    rows = wide.unpivot([F.col(k) for k in keys], [F.col(f"`{c}`") for c in columns], "column", "x")
    return held(rows.where(F.col("x").isNotNull() & ~F.isnan("x")))


def _settle(rows: DataFrame, marks: DataFrame, shares: tuple[float, ...], keys: list[str]) -> DataFrame:
    """keys, n, least, most, q, sure from rows (keys, x) and marks (keys, n, least, most, lo, hi: an end for each share).

    Shares ascend. Values in a bracket are counted one by one, and those between brackets together. Zones and bins are in
    the order of values, so that running totals over the bins of a group (some hundred rows), and over the values in each
    bin, give the ranks of each value.
    """
    facts = ["n", "least", "most", "lo", "hi"]
    marks = marks.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), *facts)
    marks = F.broadcast(marks) if keys == ["column"] else marks
    at, x = range(len(shares)), F.col("x")
    same = lambda left: _all(F.col(k).eqNullSafe(F.col(f"{left}{i}")) for i, k in enumerate(keys))
    zone = F.lit(0)
    for j in at:
        zone = zone + (x > F.col("hi")[j]).cast("int")
    # Brackets ascend as shares do, so that a value behind z of them can only be in the next one.
    each = rows.join(marks, same("_k")).select(*keys, "lo", "hi", "x", zone.alias("zone")).select(*keys, "x", "zone", F.get("lo", "zone").alias("b"), F.get("hi", "zone").alias("e"))
    # Halves before the difference, so that it can't be infinite; the bins of infinite brackets are -1, 0 and BINS.
    part = F.floor((x / 2 - F.col("b") / 2) / F.nullif(F.col("e") / 2 - F.col("b") / 2, F.lit(0.0)) * BINS)
    finite = (F.col("b") > float("-inf")) & (F.col("e") < float("inf"))
    bin_ = F.when(finite, F.coalesce(part, F.lit(0))).when(x == float("-inf"), F.lit(-1)).when(x == float("inf"), F.lit(BINS)).otherwise(F.lit(0))
    inside = x >= F.col("b")
    counts = each.groupBy(*keys, "zone", F.when(inside, bin_).cast("int").alias("bin"), F.when(inside, x).alias("x")).agg(F.count("*").alias("c"))
    totals = counts.groupBy(*keys, "zone", "bin").agg(F.sum("c").alias("s"))
    before = Window.partitionBy(*keys).orderBy("zone", "bin").rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.join(marks, same("_k")).select(*(F.col(k).alias(f"_c{i}") for i, k in enumerate(keys)), *facts[:3], F.col("zone").alias("_zone"), F.col("bin").alias("_bin"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("carry"))
    upto = Window.partitionBy(*keys, "zone", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    running = counts.withColumn("_run", F.sum("c").over(upto)).join(carry, same("_c") & (F.col("zone") == F.col("_zone")) & F.col("bin").eqNullSafe(F.col("_bin")))
    last = F.col("carry") + F.col("_run")
    has = lambda rank: (last - F.col("c") <= rank) & (rank < last)
    place = [F.lit(float(p)) * (F.col("n") - 1) for p in shares]
    ends = [F.max(F.when(has(f(r)), x)).alias(f"{name}{j}") for j, r in enumerate(place) for name, f in (("a", F.floor), ("b", F.ceil))]
    got = running.groupBy(*keys, *facts[:3]).agg(*ends)
    # Equal neighbours aren't subtracted: infinities would give no number.
    value = lambda j, r: F.when((F.col(f"a{j}") == F.col(f"b{j}")) | (r == F.floor(r)), F.col(f"a{j}")).otherwise(F.col(f"a{j}") + (r - F.floor(r)) * (F.col(f"b{j}") - F.col(f"a{j}")))
    sure = _all(F.col(f"{name}{j}").isNotNull() for j in at for name in "ab")
    return got.select(*keys, *facts[:3], F.array(*(value(j, r) for j, r in enumerate(place))).alias("q"), sure.alias("sure"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _marks(rows: DataFrame, shares: tuple[float, ...], keys: list[str], error: float) -> DataFrame:
    accuracy = max(1, math.ceil(1 / error))
    wide = 3 / accuracy
    points = [min(max(p + s * wide, 0.0), 1.0) for p in shares for s in (-1, 1)]
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", points, accuracy).alias("_q"))
    lo = F.array(*(F.col("least") if p - wide <= 0 else F.col("_q")[2 * j] for j, p in enumerate(shares)))
    hi = F.array(*(F.col("most") if p + wide >= 1 else F.col("_q")[2 * j + 1] for j, p in enumerate(shares)))
    return found.select(*keys, "n", "least", "most", lo.alias("lo"), hi.alias("hi"))


def _local(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def settle(rows: DataFrame, shares: tuple[float, ...], keys: tuple[str, ...], error: float = ERROR, marks: DataFrame | None = None) -> DataFrame:
    """keys, n, least, most, q: the exact quantiles of x at the shares in each group of rows, interpolated between neighbours.

    rows is passed over twice: a mergeable sketch brackets each quantile (unless marks with keys, n, least, most, lo, hi
    for ascending shares are given), and then values within brackets are counted, about 6 of 10,000 for each share. No group is ever held in one place.
    Should a bracket miss its rank, its group is settled without brackets. -inf and inf are values like others; null may be a key.
    """
    keys, rising = list(keys), tuple(sorted(set(shares)))
    # Figures of columns alone are a row for each column, and may go by the driver.
    keep = _local if keys == ["column"] else held
    out = keep(_settle(rows, keep(_marks(rows, rising, keys, error) if marks is None else marks), rising, keys))
    if out.where(~F.col("sure")).count():
        missed = out.where(~F.col("sure"))
        every = [F.array(*[F.col(c)] * len(rising)).alias(n) for c, n in (("least", "lo"), ("most", "hi"))]
        out = out.where("sure").unionByName(keep(_settle(rows, missed.select(*keys, "n", "least", "most", *every), rising, keys)))
    return out.select(*keys, "n", "least", "most", F.array(*(F.col("q")[rising.index(p)] for p in shares)).alias("q"))


def group_quantiles(df: DataFrame, columns: dict[str, Column], shares: tuple[float, ...], keys: tuple[str, ...] = (), error: float = ERROR) -> DataFrame:
    """keys, column, n, q for each group (null is one) and each of the columns that has values in it."""
    return settle(measured(df, columns, keys), shares, (*keys, "column"), error)


def quantiles(df: DataFrame, columns: dict[str, Column], shares: tuple[float, ...]) -> dict[str, list[float | None]]:
    """The exact quantiles of each column at the shares; nulls and NaN don't count. A row for each column comes back."""
    found = {r["column"]: list(r["q"]) for r in group_quantiles(df, columns, shares).collect()} if columns else {}
    return {c: found.get(c, [None] * len(shares)) for c in columns}


def boxes(df: DataFrame, column: Column, key: str, reach: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """What box plots by group draw, for groups that aren't null and have values: first key, n, q1, median, q3, lower and
    upper (the ends of the whiskers: the outermost values within `reach` times the box of its edges, but never inside
    the box), n_outliers; then key, x: the values beyond the whiskers' reach, each as often as it occurs."""
    rows = measured(df.where(F.col(key).isNotNull()), {"x": column}, (key,))
    q = settle(rows, (0.25, 0.5, 0.75), (key, "column")).select(key, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    far = F.lit(reach) * (F.col("q3") - F.col("q1"))
    both = rows.select(key, "x").join(q, key)
    low, high = F.col("x") < F.col("q1") - far, F.col("x") > F.col("q3") + far
    near = ~low & ~high
    ends = both.groupBy(key, "n", "q1", "median", "q3").agg(F.min(F.when(near, F.col("x"))).alias("lower"), F.max(F.when(near, F.col("x"))).alias("upper"), F.count(F.when(~near, 1)).alias("n_outliers"))
    return ends.withColumns({"lower": F.least("lower", "q1"), "upper": F.greatest("upper", "q3")}), both.where(low | high).select(key, "x")
