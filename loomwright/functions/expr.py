"""Scalar functions as Column expressions: all of them run inside Spark's generated code."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Words that speak for a positive and for a negative text, words that say nothing, quotes around citations.
POSITIVE = "love good great happy beautiful wonderful best hope joy amazing excellent positive bright kind success inspire inspiring dream smile friend heart laugh light peace warm brave true truth wisdom freedom power life lovely pleasure delight cheerful gentle".split()
NEGATIVE = "hate bad worst sad ugly terrible fear angry pain dark evil death fail wrong hurt war cry alone suffer hell misery enemy stupid lie despair broken lost weak nothing never regret trouble foolish danger cruel".split()
STOP_WORDS = "the a an and or but in on at to for of with by from is it this that are was be as has have had not no do does did will would can could should may might shall its i you he she we they me him her us them my your his our their what which who whom if than so just about up out all been being there here when where how more most very too also into over s t".split()
QUOTES = "“”\"'"


def words(text: Column) -> Column:
    """Runs of a-z after lower-casing."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use mentions it, wherever the optimizer moves it to."""
    return F.element_at(F.transform(F.array(value), use), 1)


def keywords(text: Column) -> Column:
    """pos, neg: how many different positive and negative words occur."""
    count = lambda own, known: F.size(F.array_intersect(own, F.array(*map(F.lit, known))))
    return bound(words(text), lambda own: F.struct(count(own, POSITIVE).alias("pos"), count(own, NEGATIVE).alias("neg")))


def sentiment(text: Column) -> Column:
    """positive if at least as many different positive as negative words occur; null for null."""
    return F.when(text.isNotNull(), bound(keywords(text), lambda n: F.when(n["pos"] >= n["neg"], "positive").otherwise("negative")))


def strip(text: Column) -> Column:
    """Unicode white space off both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_quotes(text: Column) -> Column:
    return F.btrim(strip(text), F.lit(QUOTES))


def is_blank(text: Column) -> Column:
    """Nothing but Unicode white space; known at the first other character."""
    return ~F.rlike(text, F.lit(r"(?U)\S"))


def is_missing(column: Column, kind: T.DataType) -> Column:
    """Null; for floating point NaN as well."""
    return column.isNull() | F.isnan(column) if isinstance(kind, (T.FloatType, T.DoubleType)) else column.isNull()


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def preview(text: Column, chars: int) -> Column:
    return F.substring(text, 1, chars)


def escape_pipes(text: Column) -> Column:
    return F.replace(text, F.lit("|"), F.lit("\\|"))


def is_content(word: Column, min_chars: int = 3) -> Column:
    """Of words taken apart: neither short nor a stop word."""
    return (F.length(word) >= min_chars) & ~word.isin(STOP_WORDS)


def lookup(column: Column, mapping: Mapping, fallback: Column | None = None) -> Column:
    """The mapping of a value as text, or the value itself as text."""
    raw = column.cast("string") if fallback is None else fallback
    if not mapping:
        return raw
    return F.coalesce(F.create_map(*(F.lit(str(x)) for pair in mapping.items() for x in pair))[column.cast("string")], raw)


def clip(column: Column, lo: Column, hi: Column) -> Column:
    """Between the bounds; missing values stay."""
    return F.when(column.isNull() | F.isnan(column), column).otherwise(F.greatest(lo, F.least(hi, column)))


def half_even(column: Column, digits: int) -> Column:
    return F.bround(column, digits)


def entropy(p: Column) -> Column:
    return -F.aggregate(p, F.lit(0.0), lambda s, x: s + x * F.ln(x + F.lit(1e-12)))


def margin(p: Column) -> Column:
    """Minus the lead of the most probable class over the next one."""
    best = F.sort_array(p, asc=False)
    return F.when(F.size(p) > 1, -(best[0] - best[1])).otherwise(-best[0])


def argmax(p: Column, names: Column) -> Column:
    return F.element_at(names, F.array_position(p, F.array_max(p)).cast("int"))


def percent(part: Column, whole: Column, digits: int) -> Column:
    """0 of nothing."""
    return F.when(whole != 0, F.bround(part / F.nullif(whole, F.lit(0)) * 100, digits)).otherwise(F.lit(0.0))


def iso_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'")


def rank_key(row_id: Column, seed: int | str) -> Column:
    """Order for sampling: the md5 of the row's number and a seed, the same in any engine."""
    return F.md5(F.concat(row_id.cast("string"), F.lit(f":{seed}")))


def json_field(document: Column, path: str, default: str | None = None) -> Column:
    found = F.get_json_object(document, f"$.{path}")
    return found if default is None else F.coalesce(found, F.lit(default))
