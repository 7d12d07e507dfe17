"""Data quality: missing values, duplicates, outliers, class balance. A pass over the data for each kind, never one a column."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import expr
from loomwright.operators import quantiles as order
from loomwright.operators.ranges import held
from loomwright.operators.setops import digest
from loomwright.schema import BALANCE_NAMES, ROW_ID, find_label, numbers, strings, values


@dataclass(frozen=True)
class Detector:
    """method: iqr, anything else is the z-score. approx: quantiles with a bounded error instead of exact ones."""

    method: str = "iqr"
    iqr_k: float = 1.5
    zscore: float = 3.0
    imbalance: float = 0.7
    approx: bool = False


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def missing(df: DataFrame) -> DataFrame:
    """column, count, percent of columns with missing values. For strings, white space only counts as missing as well."""
    kinds = {f.name: f.dataType for f in df.schema}
    gone = {c: expr.is_missing(_c(c), kinds[c]) | (expr.is_blank(_c(c)) if c in strings(df) else F.lit(False)) for c in values(df)}
    row = df.agg(F.count("*").alias("_n"), *(F.count(F.when(F.coalesce(x, F.lit(True)), 1)).alias(f"_m{i}") for i, x in enumerate(gone.values())))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _c(f"_m{i}").alias("count")) for i, c in enumerate(gone))))
    out = row.select("_n", pairs.alias("p")).select(F.col("p.column").alias("column"), F.col("p.count").alias("count"), expr.percent(F.col("p.count"), F.col("_n"), 2).alias("percent"))
    return out.where("count > 0")


def duplicates(df: DataFrame, how_many: bool = False) -> DataFrame:
    """count and percent of rows that repeat an earlier one in all columns; nulls are equal; with how_many also rows.

    Rows meet by a digest of their columns, so that texts stay where they are.
    """
    kept = df.groupBy(digest(df)).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("kept"))
    return kept.select((F.col("rows") - F.col("kept")).alias("count"), expr.percent(F.col("rows") - F.col("kept"), F.col("rows"), 2).alias("percent"), *(["rows"] if how_many else []))


def measures(df: DataFrame) -> dict[str, Column]:
    """What outliers may be looked for in: numeric columns, and lengths of string columns (see limits)."""
    return {c: _c(c).cast("double") for c in numbers(df)} | {f"{c}_length": F.length(_c(c)).cast("double") for c in strings(df)}


def limits(df: DataFrame, how: Detector = Detector()) -> list[Row]:
    """column, lower, upper, outside (how many values are beyond), n of each measure with at least three different values;
    of string columns only those with a median length above 10. A row for each column comes back.

    The values are written once, without the texts; sketch, exact quartiles and counts are taken from them.
    """
    columns = measures(df)
    if not columns:
        return []
    rows = order.measured(df, columns)
    if how.method == "iqr" and how.approx:
        q = rows.groupBy("column").agg(F.count("*").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"), F.percentile_approx("x", [0.25, 0.5, 0.75], 10000).alias("q"))
    else:
        q = order.settle(rows, (0.25, 0.5, 0.75), ("column",))
    if how.method != "iqr":
        q = q.join(rows.groupBy("column").agg(F.avg("x").alias("_m"), F.stddev_samp("x").alias("_s")), "column")
    known = {r["column"]: r for r in beyond(rows, q, how, [f"{c}_length" for c in strings(df)])}
    return [known[c] for c in columns if c in known]


def beyond(rows: DataFrame, q: DataFrame, how: Detector, texts: list[str]) -> list[Row]:
    """column, lower, upper, outside, n from values (column, x) and their figures (column, n, least, most, q, and for
    z-scores _m and _s). texts: the columns of lengths."""
    if how.method == "iqr":
        far = how.iqr_k * (F.col("q")[2] - F.col("q")[0])
        lo, hi = F.col("q")[0] - far, F.col("q")[2] + far
    else:
        lo, hi = F.col("_m") - how.zscore * F.col("_s"), F.col("_m") + how.zscore * F.col("_s")
    q = q.where(~F.col("column").isin(texts) | (F.col("q")[1] > 10)) if texts else q
    # A bound that is no number, as between infinities, bounds nothing.
    lo, hi = (F.when(~F.isnan(b), b) for b in (lo, hi))
    both = rows.join(F.broadcast(q.select("column", "n", "least", "most", lo.alias("lower"), hi.alias("upper"))), "column")
    x, facts = F.col("x"), ["column", "n", "lower", "upper"]
    out = F.count(F.when((x < F.col("lower")) | (x > F.col("upper")), 1))
    found = both.groupBy(*facts).agg(out.alias("outside"), F.count(F.when((x > F.col("least")) & (x < F.col("most")), 1)).alias("_between"))
    return found.where("_between > 0").collect()


def bounds(df: DataFrame, how: Detector = Detector()) -> dict[str, tuple[float, float]]:
    """lower and upper bound of each measure that has any."""
    return {r["column"]: (r["lower"], r["upper"]) for r in limits(df, how) if r["lower"] is not None and r["upper"] is not None}


def outliers(df: DataFrame, how: Detector = Detector()) -> DataFrame:
    """column, method, count, percent (of values there), lower_bound, upper_bound of measures with outliers."""
    return outlier_rows(df.sparkSession, limits(df, how), how)


def outlier_rows(spark: SparkSession, found: list[Row], how: Detector) -> DataFrame:
    rows = [(r["column"], how.method, r["outside"], r["n"], r["lower"], r["upper"]) for r in found if r["outside"]]
    out = spark.createDataFrame(rows, "column string, method string, count bigint, n bigint, lower double, upper double")
    return out.select("column", "method", "count", expr.percent(F.col("count"), F.col("n"), 2).alias("percent"), F.bround("lower", 4).alias("lower_bound"), F.bround("upper", 4).alias("upper_bound"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """value and count, without nulls; the most frequent first, equal counts by value."""
    return df.where(_c(column).isNotNull()).groupBy(_c(column).alias("value")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "value")


def imbalance(df: DataFrame, how: Detector = Detector(), column: str | None = None) -> DataFrame:
    """column, n_classes, imbalance_ratio (smallest over largest class), is_imbalanced. The flag goes by the exact ratio."""
    column = balance_column(df, column)
    if column is None:
        return df.sparkSession.createDataFrame([], "column string, n_classes bigint, imbalance_ratio double, is_imbalanced boolean")
    counts = value_counts(df, column).agg(F.count("*").alias("n"), F.min("count").alias("lo"), F.max("count").alias("hi"))
    return balance(counts, F.lit(column), how)


def balance_column(df: DataFrame, column: str | None = None) -> str | None:
    return column or find_label(df, BALANCE_NAMES) or next(iter(strings(df)), None)


def balance(counts: DataFrame, column: Column, how: Detector) -> DataFrame:
    """From n, lo, hi: how many classes there are, and the rows of the smallest and of the largest."""
    ratio = F.coalesce(F.try_divide("lo", "hi"), F.lit(1.0))
    return counts.select(column.alias("column"), F.col("n").alias("n_classes"), F.bround(ratio, 4).alias("imbalance_ratio"), (ratio < how.imbalance).alias("is_imbalanced"))


def detect(df: DataFrame, how: Detector = Detector()) -> dict:
    """The whole report as a dictionary; what it holds is bounded by the number of columns and classes."""
    column = find_label(df, BALANCE_NAMES) or next(iter(strings(df)), None)
    dup, balance = duplicates(df, how_many=True).first(), imbalance(df, how).first()
    return {
        "shape": {"rows": dup["rows"], "columns": len(values(df))},
        "missing": {r["column"]: {"count": r["count"], "percent": r["percent"]} for r in missing(df).collect()},
        "duplicates": {"count": dup["count"], "percent": dup["percent"]},
        "outliers": [r.asDict() for r in outliers(df, how).collect()],
        "imbalance": {"column": column, "distribution": {r["value"]: r["count"] for r in value_counts(df, column).collect()}, "imbalance_ratio": balance["imbalance_ratio"], "is_imbalanced": balance["is_imbalanced"]} if column else {},
    }


def metrics(df: DataFrame, how: Detector = Detector(), label: str | None = None) -> DataFrame:
    """metric, value: the figures of a report as rows, a few for each column. They are computed here and now, so that a frame
    may be let go of afterwards: texts are passed over once for what is counted (rows meet by their digest), and once for
    what is measured."""
    kinds, texts = {f.name: f.dataType for f in df.schema}, strings(df)
    gone = {c: F.coalesce(expr.is_missing(_c(c), kinds[c]) | (expr.is_blank(_c(c)) if c in texts else F.lit(False)), F.lit(True)) for c in values(df)}
    name = balance_column(df, label)
    flags = [F.count(F.when(x, 1)).alias(f"m{i}") for i, x in enumerate(gone.values())]
    seen = held(df.groupBy(digest(df), (_c(name).cast("string") if name else F.lit(None).cast("string")).alias("_class")).agg(F.count("*").alias("n"), *flags))
    sums = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count_distinct("_digest").alias("kept"), *(F.coalesce(F.sum(f"m{i}"), F.lit(0)).alias(f"m{i}") for i in range(len(gone)))).first()
    missed = {c: sums[f"m{i}"] for i, c in enumerate(gone) if sums[f"m{i}"]}
    odd = limits(df, how)
    rows = [("rows", sums["rows"]), ("columns", len(gone)), ("missing_values_total", sum(missed.values())), *((f"missing_{c}", n) for c, n in missed.items())]
    rows += [("duplicates", sums["rows"] - sums["kept"]), ("outliers_total", sum(r["outside"] for r in odd))]
    if name:
        counts = seen.where(F.col("_class").isNotNull()).groupBy("_class").agg(F.sum("n").alias("count")).agg(F.count("*").alias("n"), F.min("count").alias("lo"), F.max("count").alias("hi"))
        rows.append(("imbalance_ratio", balance(counts, F.lit(name), how).first()["imbalance_ratio"]))
    return df.sparkSession.createDataFrame([(k, float(v)) for k, v in rows], "metric string, value double")


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """metric, before, after, delta, delta_pct of two frames of metrics. A column without missing values counts 0."""
    b, a = (x.select("metric", F.col("value").alias(n)) for x, n in ((before, "before"), (after, "after")))
    both = b.join(a, "metric", "full_outer")
    zero = lambda c: F.when(F.col("metric").startswith("missing_"), F.coalesce(c, F.lit(0.0))).otherwise(F.col(c))
    both = both.select("metric", zero("before").alias("before"), zero("after").alias("after")).where((F.col("metric") != "imbalance_ratio") | F.col("before").isNotNull())
    delta = F.col("after") - F.col("before")
    change = F.when(F.col("before") != 0, F.bround(delta / F.nullif("before", F.lit(0.0)) * 100, 1)).otherwise(F.lit(0.0))
    return both.select("metric", "before", "after", F.bround(delta, 4).alias("delta"), change.alias("delta_pct"))


def side_by_side(df: DataFrame, strategies: dict[str, dict[str, str]], shown: tuple[str, ...] | None = None) -> DataFrame:
    """metric, before, and after_<name> for each strategy: the comparisons joined by metric, those shown if some are named."""
    from loomwright.operators.clean import fix

    base, out = metrics(df), None
    for name, strategy in strategies.items():
        fixed = fix(df, strategy).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            figures = metrics(fixed)
        finally:
            fixed.unpersist()
        one = compare(base, figures).select("metric", "before", F.col("after").alias(f"after_{name}"))
        out = one if out is None else out.join(one.drop("before"), "metric", "full_outer")
    return out.where(F.col("metric").isin(*shown)) if shown else out


__all__ = ["Detector", "ROW_ID", "bounds", "compare", "detect", "duplicates", "imbalance", "measures", "metrics", "missing", "outliers", "side_by_side", "value_counts"]
