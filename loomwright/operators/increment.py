"""A profile that grows: each batch leaves states behind that merge, and a profile of all batches reads no text again."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import expr
from loomwright.operators import profile
from loomwright.operators import quantiles as order
from loomwright.operators.setops import digest
from loomwright.schema import strings, values

#: Entries of a quantile sketch (its ranks are off by less than ERROR of the values).
SKETCH, ERROR = 4096, 0.004
SHARES = (0.25, 0.5, 0.75)


def _c(name: str):
    return F.col(f"`{name}`")


@dataclass(frozen=True)
class Store:
    """A folder that driver and executors share, with a folder for each kind of state, and in it one for each batch.

    gone: column, rows, missing. numbers: column, x (what is measured; texts are left behind). moments: column, is_text, n,
    mean, m2, least, most, sketch. digests: _digest, n. classes: value, n. A batch that is added again replaces itself.
    """

    spark: SparkSession
    folder: str

    def read(self, kind: str) -> DataFrame:
        return self.spark.read.option("basePath", f"{self.folder}/{kind}").parquet(f"{self.folder}/{kind}")

    def add(self, df: DataFrame, batch: int, label: str | None = None) -> None:
        """Two passes over the batch: what is measured is written once, and what rows have in common is counted."""
        put = lambda kind, rows: rows.write.mode("overwrite").parquet(f"{self.folder}/{kind}/batch={batch}")
        columns, kinds, texts = profile.measures(df), {f.name: f.dataType for f in df.schema}, strings(df)
        wide = df.select(*(c.alias(n) for n, c in columns.items())) if columns else df.select(F.lit(None).cast("double").alias("_none"))
        rows = wide.unpivot([], [_c(c) for c in wide.columns], "column", "x").where(F.col("x").isNotNull() & ~F.isnan("x"))
        put("numbers", rows)
        numbers = self.spark.read.schema("column string, x double").parquet(f"{self.folder}/numbers/batch={batch}")
        is_text = F.col("column").isin([f"{c}_length" for c in texts]) if texts else F.lit(False)
        put("moments", numbers.groupBy("column").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.coalesce(F.var_pop("x") * F.count("*"), F.lit(0.0)).alias("m2"), F.min("x").alias("least"), F.max("x").alias("most"), F.kll_sketch_agg_double("x", F.lit(SKETCH)).alias("sketch")).withColumn("is_text", is_text))
        gone = {c: F.coalesce(expr.is_missing(_c(c), kinds[c]) | (expr.is_blank(_c(c)) if c in texts else F.lit(False)), F.lit(True)) for c in values(df)}
        flags = [F.count(F.when(x, 1)).alias(f"m{i}") for i, x in enumerate(gone.values())]
        name = profile.balance_column(df, label)
        seen = df.groupBy(digest(df), (_c(name).cast("string") if name else F.lit(None).cast("string")).alias("_value")).agg(F.count("*").alias("n"), *flags).persist()
        try:
            put("digests", seen.groupBy("_digest").agg(F.sum("n").alias("n")))
            put("classes", seen.where(F.col("_value").isNotNull()).groupBy(F.col("_value").alias("value")).agg(F.sum("n").alias("n")).withColumn("column", F.lit(name).cast("string")))
            sums = seen.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), *(F.coalesce(F.sum(f"m{i}"), F.lit(0)).alias(f"m{i}") for i in range(len(gone))))
            put("gone", sums.select("rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(gone)))).alias("p")).select("p.column", "rows", "p.missing"))
        finally:
            seen.unpersist()

    def missing(self) -> DataFrame:
        """As profile.missing of all rows; a column that a batch lacks is missing in all of its rows."""
        gone = self.read("gone")
        total = gone.groupBy("batch").agg(F.max("rows").alias("rows")).agg(F.sum("rows").alias("total"))
        own = gone.groupBy("column").agg(F.sum("rows").alias("rows"), F.sum("missing").alias("missing")).crossJoin(F.broadcast(total))
        count = F.col("missing") + F.col("total") - F.col("rows")
        return own.select("column", count.alias("count"), expr.percent(count, F.col("total"), 2).alias("percent")).where("count > 0")

    def duplicates(self) -> DataFrame:
        """As profile.duplicates of all rows, if all batches have the same columns."""
        one = self.read("digests").groupBy("_digest").agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("kept"))
        return one.select((F.col("rows") - F.col("kept")).alias("count"), expr.percent(F.col("rows") - F.col("kept"), F.col("rows"), 2).alias("percent"))

    def moments(self) -> DataFrame:
        """column, is_text, n, mean, std, least, most, sketch of all values."""
        own = self.read("moments").groupBy("column", "is_text")
        n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
        # Squares around the common mean: those around each batch's, and those of the batches' means around it.
        both = own.agg(n.alias("n"), mean.alias("mean"), F.sum("m2").alias("within"), F.collect_list(F.struct("n", "mean")).alias("parts"), F.min("least").alias("least"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch").alias("sketch"))
        between = F.aggregate("parts", F.lit(0.0), lambda s, p: s + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
        var = (F.col("within") + between) / F.nullif(F.col("n") - 1, F.lit(0))
        return both.select("column", "is_text", "n", "mean", F.sqrt(var).alias("std"), "least", "most", "sketch")

    def quantiles(self, shares: tuple[float, ...] = SHARES) -> DataFrame:
        """column, n, least, most, q: exact. The merged sketch brackets them, one pass over the numbers settles them."""
        rising = tuple(sorted(set(shares)))
        get = lambda p, end: F.when(F.lit(not 0 < p < 1), F.col(end)).otherwise(F.kll_sketch_get_quantile_double("sketch", F.lit(min(max(p, 0.0), 1.0))))
        lo, hi = (F.array(*(get(p + s * ERROR, end) for p in rising)) for s, end in ((-1, "least"), (1, "most")))
        marks = self.moments().select("column", "n", "least", "most", lo.alias("lo"), hi.alias("hi"))
        return order.settle(self.read("numbers"), shares, ("column",), marks=marks)

    def outliers(self, how: profile.Detector = profile.Detector()) -> DataFrame:
        """As profile.outliers of all rows."""
        moments, numbers = self.moments(), self.read("numbers")
        texts = [r["column"] for r in moments.where("is_text").select("column").distinct().collect()]
        spread = moments.select("column", F.col("mean").alias("_m"), F.col("std").alias("_s"))
        return profile.outlier_rows(self.spark, profile.beyond(numbers, self.quantiles().join(spread, "column"), how, texts), how)

    def imbalance(self, how: profile.Detector = profile.Detector()) -> DataFrame:
        """As profile.imbalance of all rows: the column is the one that the batches were added with."""
        counts = self.read("classes").groupBy("column", "value").agg(F.sum("n").alias("count"))
        return profile.balance(counts.groupBy("column").agg(F.count("*").alias("n"), F.min("count").alias("lo"), F.max("count").alias("hi")), F.col("column"), how)

    def describe(self) -> DataFrame:
        """count, mean, std, min, quartiles, max of the numeric columns, as explore.describe of all rows."""
        found = self.moments().where(~F.col("is_text")).select("column", "mean", "std").join(self.quantiles(), "column")
        r = lambda c: F.bround(c, 4)
        return found.select("column", F.col("n").alias("count"), r("mean").alias("mean"), r("std").alias("std"), r("least").alias("min"), *(r(F.col("q")[k]).alias(f"q{round(100 * p)}") for k, p in enumerate(SHARES)), r("most").alias("max"))

