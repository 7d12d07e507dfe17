"""Record layouts, and how text and label columns are found by name and type."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows have a number of their own; Spark keeps no order, and "first" means the smallest.
ROW_ID = "_row_id"
RECORD = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "label", "source", "collected_at")])
LABELLED = T.StructType([*RECORD.fields, T.StructField("predicted_label", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("needs_review", T.BooleanType())])
REVIEW = T.StructType([*LABELLED.fields, T.StructField("corrected_label", T.StringType())])
HISTORY = T.StructType([T.StructField("iteration", T.IntegerType()), T.StructField("n_labeled", T.IntegerType()), T.StructField("accuracy", T.DoubleType()), T.StructField("f1", T.DoubleType()), T.StructField("strategy", T.StringType())])

# Names by which columns are found, in order of preference.
TEXT_NAMES = ("text", "sentence", "review", "comment", "content", "body", "message")
LABEL_NAMES = ("label", "target", "class", "category", "sentiment")
BALANCE_NAMES = ("label", "target", "class", "category")
TEXT_HINTS = ("text", "comment_text", "sentence", "content", "review", "question", "title", "body", "message", "tweet", "document")
LABEL_HINTS = ("label", "labels", "target", "class", "sentiment", "category", "toxic", "rating", "score", "intent")


def strings(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != ROW_ID]


def numbers(df: DataFrame) -> list[str]:
    """Numeric columns; booleans are none."""
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name != ROW_ID]


def values(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def find_text(df: DataFrame, by_length: bool = True) -> str | None:
    """The first known name; else, if asked, the first string column whose median length is above 20."""
    for name in TEXT_NAMES:
        if name in df.columns:
            return name
    own = strings(df) if by_length else []
    if not own:
        return None
    lengths = df.agg(*(F.median(F.length(F.col(f"`{c}`"))).alias(f"m{i}") for i, c in enumerate(own))).first()
    return next((c for c, m in zip(own, lengths) if m is not None and m > 20), None)


def find_label(df: DataFrame, names: tuple[str, ...] = LABEL_NAMES) -> str | None:
    return next((n for n in names if n in df.columns), None)


def first_column(df: DataFrame, *names: str) -> str:
    """The first of the names that df has."""
    found = find_label(df, names)
    if found is None:
        raise ValueError(f"none of {', '.join(names)} among the columns {', '.join(df.columns)}")
    return found


@dataclass(frozen=True)
class Match:
    text: str
    label: str


def match_schema(schema: T.StructType, class_columns: tuple[str, ...] = ()) -> Match | None:
    """A text and a label column for a data set nobody described.

    Text: the first hint that is part of a string column's name, else the first string column. Label: the first column
    known to hold classes, else the first hint that is part of a numeric column's name; strings are never labels.
    """
    texts = [f.name for f in schema if isinstance(f.dataType, T.StringType)]
    figures = [f.name for f in schema if isinstance(f.dataType, (T.IntegralType, T.FractionalType)) and not isinstance(f.dataType, T.DecimalType)]
    hinted = lambda hints, names: next((n for h in hints for n in names if h in n.lower()), None)
    text = hinted(TEXT_HINTS, texts) or next(iter(texts), None)
    label = next((c for c in class_columns if c in schema.names), None) or hinted(LABEL_HINTS, figures)
    return Match(text, label) if text and label else None
