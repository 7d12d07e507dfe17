"""A scorer that ships: each class is the mean of the unit vectors of rows known to be of it; rows go to the nearest class."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.operators import annotate, sample
from loomwright.operators.features import FittedTfIdf
from loomwright.schema import ROW_ID


def _unit(column: pa.Array, size: int) -> np.ndarray:
    """Vectors of length one; zeros for null, zero, odd-sized and non-finite ones."""
    out = np.zeros((len(column), size))
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == size)
    if len(at) and size:
        out[at] = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    good = np.isfinite(norm[:, 0]) & (norm[:, 0] > 0)
    return np.where(good[:, None], out / np.where(good[:, None], norm, 1.0), 0.0)


def sums(known: DataFrame, vector: str, keys: tuple[str, ...]) -> dict[tuple, np.ndarray]:
    """The sum of the unit vectors of each group, added up in the tasks: a row for each group and dimension meets the driver."""
    size = known.agg(F.max(F.size(vector)).alias("s")).first()["s"] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for b in batches:
            x, groups = _unit(b.column(len(keys)), size), list(zip(*(b.column(k).to_pylist() for k in range(len(keys)))))
            at: dict[tuple, list[int]] = {}
            for i, g in enumerate(groups):
                at.setdefault(g, []).append(i)
            for g, own in at.items():
                held[g] = held.get(g, 0) + x[own].sum(axis=0)
        for g, s in held.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.string()) for v in g), pa.array([s], pa.list_(pa.float64()))], [*names, "s"])

    names = [f"k{i}" for i in range(len(keys))]
    own = known.select(*(F.col(k).cast("string").alias(n) for k, n in zip(keys, names)), F.col(vector).cast("array<double>").alias("v"))
    rows = own.mapInArrow(run, "".join(f"{n} string, " for n in names) + "s array<double>").select(*names, F.posexplode("s").alias("i", "x")).groupBy(*names, "i").agg(F.sum("x").alias("x")).collect()
    found: dict[tuple, np.ndarray] = {}
    for r in rows:
        found.setdefault(tuple(r[n] for n in names), np.zeros(size))[r.i] = r.x
    return found


def _means(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {c: v / n if (n := np.linalg.norm(v)) > 0 else v for c, v in sorted(found.items())}


def prototypes(known: DataFrame, vector: str = "embedding", label: str = "label") -> dict[str, np.ndarray]:
    """The unit mean of each class."""
    return _means({c: v for (c,), v in sums(known.where(F.col(label).isNotNull()), vector, (label,)).items()})


def out_of_fold(df: DataFrame, vector: str = "embedding", label: str = "label", k: int = 5, **how) -> DataFrame:
    """Labelled rows with fold, and what label_by_prototype says of them by the prototypes of the other folds. One pass
    gives the sums of all folds; those of the others are the sum of all less the own."""
    known = sample.folds(df.where(F.col(label).isNotNull()), label, k)
    found = sums(known, vector, ("fold", label))
    out = None
    for f in range(k):
        others: dict[str, np.ndarray] = {}
        for (g, c), v in found.items():
            if int(g) != f:
                others[c] = others.get(c, 0) + v
        part = label_by_prototype(known.where(F.col("fold") == f), _means(others), vector, **how)
        out = part if out is None else out.unionByName(part)
    return out


def label_by_prototype(df: DataFrame, classes: dict[str, np.ndarray], vector: str = "embedding", sharpness: float = 10.0, threshold: float = annotate.THRESHOLD) -> DataFrame:
    """df with predicted_label, similarity (cosine to the nearest class, the first of equally near ones), confidence
    (softmax of the similarities times sharpness, four digits) and needs_review. Vectors that are null, zero, of another size
    or not finite are of no class, with confidence 0. The prototypes, a vector a class, go to the tasks."""
    names = list(classes)
    m = np.array([classes[c] for c in names]) if names else np.zeros((0, 0))
    at = df.columns.index(vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _unit(b.column(at).cast(pa.list_(pa.float64())), m.shape[1])
            z, there = x @ m.T, x.any(axis=1)
            best = np.where(there, z.argmax(axis=1), -1) if len(names) else np.full(b.num_rows, -1)
            top = z.max(axis=1, initial=-1.0)
            p = np.exp(sharpness * (z - top[:, None])).sum(axis=1) if len(names) else np.ones(b.num_rows)
            said = pa.array([names[k] if k >= 0 else None for k in best.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, said, pa.array(top, mask=best < 0), pa.array(np.where(best >= 0, 1 / p, 0.0))], [*b.schema.names, "predicted_label", "similarity", "_top"])

    kind = T.StructType([*df.schema.fields, *(T.StructField(n, t) for n, t in (("predicted_label", T.StringType()), ("similarity", T.DoubleType()), ("_top", T.DoubleType())))])
    out = df.mapInArrow(run, kind).withColumn("confidence", F.bround("_top", 4))
    return out.withColumn("needs_review", F.col("confidence") < threshold).drop("_top")


def text_scorer(features: FittedTfIdf, known: DataFrame, label: str = "label", threshold: float = annotate.THRESHOLD):
    """Labels texts by the prototypes of known rows (text, label), in the space of fitted features: a function of a frame
    with row numbers, which gives _row_id, predicted_label, similarity, confidence, needs_review."""
    from pyspark.ml.functions import vector_to_array

    vectors = lambda df, *keep: features.transform(df.select("text", *keep)).select(*keep, vector_to_array("features").alias("v"))
    classes = prototypes(vectors(known, label), "v", label)
    return lambda df: label_by_prototype(vectors(df, ROW_ID), classes, "v", threshold=threshold).drop("v")
