"""Repairs: duplicates, then missing values, then outliers, then class balance. Unknown strategies do nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwright.functions import expr
from loomwright.operators import profile
from loomwright.operators.quantiles import quantiles
from loomwright.operators.ranges import by_range, mode, ranked
from loomwright.operators.setops import drop_duplicates
from loomwright.schema import BALANCE_NAMES, ROW_ID, find_label, numbers, strings, values

DEFAULT = {"missing": "drop", "duplicates": "drop", "outliers": "clip_iqr"}
SEED = 42


def _c(name: str):
    return F.col(f"`{name}`")


def drop_missing(df: DataFrame, blank: bool = False) -> DataFrame:
    """Rows with a null or NaN go; white space stays unless blank."""
    out = df.dropna("any", subset=values(df))
    for c in strings(df) if blank else ():
        out = out.where(~expr.is_blank(_c(c)))
    return out


def fill_median(df: DataFrame) -> DataFrame:
    """Numbers by the median (they become doubles), strings by the smallest of their most frequent values, else ""."""
    nums, texts = numbers(df), strings(df)
    if not nums and not texts:
        return df
    medians = quantiles(df, {c: _c(c) for c in nums}, (0.5,)) if nums else {}
    new = {c: F.coalesce(F.nanvl(_c(c).cast("double"), F.lit(None).cast("double")), F.lit(medians[c][0]).cast("double")) for c in nums}
    for c in texts:
        top = mode(df, c)
        new[c] = F.coalesce(_c(c), F.lit("" if top is None else top))
    return df.withColumns(new)


def fill_mode(df: DataFrame) -> DataFrame:
    """Each column by the smallest of its most frequent values."""
    kinds, top = dict(df.dtypes), {c: mode(df, c) for c in values(df)}
    return df.withColumns({c: F.coalesce(_c(c), F.lit(v).cast(kinds[c])) for c, v in top.items() if v is not None})


def fill_neighbours(df: DataFrame, order: str = ROW_ID) -> DataFrame:
    """Each column by the last value before it, else by the first after it, in the order of row numbers.

    Ranges of row numbers are filled each for itself, forwards and then backwards, in time proportional to their rows;
    what comes in from other ranges is the last and first value of each range, a row for each, and these are what a
    single task sees.
    """
    own = [c for c in df.columns if c != order]
    ranged = by_range(df, order).drop("_at")
    ends = ranged.groupBy("_part").agg(*(x for i, c in enumerate(own) for x in (F.max_by(_c(c), F.when(_c(c).isNotNull(), F.col(order))).alias(f"l{i}"), F.min_by(_c(c), F.when(_c(c).isNotNull(), F.col(order))).alias(f"f{i}"))))
    # The first value after a row is the last one before it when rows are read backwards: frames that only grow.
    seen = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    back, ahead = seen(Window.orderBy("_part")), seen(Window.orderBy(F.desc("_part")))
    carry = ends.select("_part", *(x for i in range(len(own)) for x in (F.last(f"l{i}", True).over(back).alias(f"l{i}"), F.last(f"f{i}", True).over(ahead).alias(f"f{i}"))))
    upto = lambda *by: Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)
    down, up = upto(order), upto(F.desc(order))
    filled = ranged.select("_part", order, *(x for i, c in enumerate(own) for x in (F.last(_c(c), True).over(down).alias(f"d{i}"), F.last(_c(c), True).over(up).alias(f"u{i}"))))
    out = filled.join(F.broadcast(carry), "_part")
    return out.select(order, *(F.coalesce(f"d{i}", f"l{i}", f"u{i}", f"f{i}").alias(c) for i, c in enumerate(own))).select(df.columns)


def fill_constant(df: DataFrame, number: int = 0, text: str = "UNKNOWN") -> DataFrame:
    nums, texts = numbers(df), strings(df)
    out = df.fillna(number, subset=nums) if nums else df
    return out.fillna(text, subset=texts) if texts else out


def clip_outliers(df: DataFrame, method: str) -> DataFrame:
    """Numbers go to the nearer bound; texts longer than the upper one, cut off to a whole number, keep their beginning."""
    new = {}
    for name, (lo, hi) in profile.bounds(df, profile.Detector(method=method)).items():
        if name in numbers(df):
            new[name] = expr.clip(_c(name).cast("double"), F.lit(float(lo)), F.lit(float(hi)))
        elif hi < 2**31:
            c = name.removesuffix("_length")
            new[c] = F.when(F.length(_c(c)) > int(hi), F.substring(_c(c), 1, int(hi))).otherwise(_c(c))
    return df.withColumns(new) if new else df


def drop_outliers(df: DataFrame, method: str) -> DataFrame:
    """Rows go that are out of the bounds in any measure; all bounds come from the frame as it was."""
    columns, bad = profile.measures(df), F.lit(False)
    for name, (lo, hi) in profile.bounds(df, profile.Detector(method=method)).items():
        bad = bad | F.coalesce((columns[name] < lo) | (~F.isnan(columns[name]) & (columns[name] > hi)), F.lit(False))
    return df.where(~bad)


def _counts(df: DataFrame, label: str) -> DataFrame:
    return df.where(_c(label).isNotNull()).groupBy(_c(label).alias("_class")).agg(F.count("*").alias("_n"))


def _in_class(df: DataFrame, label: str, seed: int) -> DataFrame:
    """Rows with a class, with their rank by sampling key in it."""
    keyed = df.where(_c(label).isNotNull()).withColumn("_key", expr.rank_key(F.col(ROW_ID), seed))
    return ranked(keyed, "_rank", ["_key", ROW_ID], label).drop("_key")


def undersample(df: DataFrame, label: str, seed: int = SEED) -> DataFrame:
    """As many rows of each class as the smallest has, those with the smallest keys; rows without a class go.

    Keys are ranked without the rows; the last one that stays of each class then tells by a filter which rows do, so that
    texts aren't dealt out. Rows of one number and class go together.
    """
    few = _counts(df, label).agg(F.min("_n")).first()[0] or 0
    known = df.where(_c(label).isNotNull()).withColumn("_key", expr.rank_key(F.col(ROW_ID), seed))
    ranks = ranked(known.select(_c(label).alias("_class"), "_key", ROW_ID), "_rank", ["_key", ROW_ID], "_class")
    last = ranks.where(F.col("_rank") == few - 1).select("_class", F.col("_key").alias("_last"), F.col(ROW_ID).alias("_id"))
    stay = (F.col("_key") < F.col("_last")) | ((F.col("_key") == F.col("_last")) & (F.col(ROW_ID) <= F.col("_id")))
    return known.join(last, _c(label) == F.col("_class")).where(stay).select(df.columns)


def oversample(df: DataFrame, label: str, seed: int = SEED) -> DataFrame:
    """Classes smaller than the largest are drawn anew, with replacement, to its size; the largest stays as it is.

    Draw k of a class is its row of rank hash(k) modulo its size. Draws are rows of their own before they meet the
    ranks, so that no task holds a class.
    """
    counts = _counts(df, label)
    counts = counts.join(F.broadcast(counts.agg(F.max("_n").alias("_most"))))
    rows = _in_class(df, label, seed)
    blocks = counts.where("_n < _most").select("_class", "_n", "_most", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_most") - 1) / 65536))).alias("_block"))
    draws = blocks.select("_class", "_n", F.explode(F.sequence(F.col("_block") * 65536, F.least(F.col("_block") * 65536 + 65535, F.col("_most") - 1))).alias("_draw"))
    pick = F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("_class").cast("string"), F.lit(":"), F.col("_draw").cast("string"), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("bigint"), F.col("_n"))
    drawn = draws.select("_class", pick.alias("_pick")).join(rows, (F.col("_class") == _c(label)) & (F.col("_pick") == F.col("_rank"))).select(df.columns)
    stay = rows.join(F.broadcast(counts.where("_n = _most").select("_class")), F.col("_class") == _c(label), "left_semi").select(df.columns)
    return stay.unionByName(drawn)


def fix(df: DataFrame, strategy: dict[str, str] | None = None, label: str | None = None) -> DataFrame:
    """All repairs in their fixed order. Rows need a row number only for filling by neighbours and for balancing."""
    strategy = DEFAULT if strategy is None else strategy
    if strategy.get("duplicates") == "drop":
        df = drop_duplicates(df)
    fill = {"drop": drop_missing, "median": fill_median, "mode": fill_mode, "ffill": fill_neighbours, "constant": fill_constant}.get(strategy.get("missing", ""))
    df = fill(df) if fill else df
    repair = {"clip_iqr": (clip_outliers, "iqr"), "clip_zscore": (clip_outliers, "zscore"), "drop_iqr": (drop_outliers, "iqr"), "drop_zscore": (drop_outliers, "zscore")}.get(strategy.get("outliers", ""))
    df = repair[0](df, repair[1]) if repair else df
    balance = {"oversample": oversample, "undersample": undersample}.get(strategy.get("imbalance", ""))
    label = label or find_label(df, BALANCE_NAMES)
    return balance(df, label) if balance and label else df
