"""Whitening of embeddings: components of the covariance by Spark MLlib's SVD of the centred rows."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import release, shared_dir, written

#: Entries become whole numbers: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Singular values below this share of the largest are none.
LEAST = 1e-9
_ENTRY = 2.0**62


def _whole(column: pa.Array, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length (or the one length) without a null or non-finite entry, and their whole numbers."""
    offsets = column.offsets.to_numpy()
    lengths, flat = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    there = column.is_valid().to_numpy(zero_copy_only=False)
    for n in [size] if size is not None else np.unique(lengths[there]).tolist():
        at = np.flatnonzero(there & (lengths == n))
        c = flat[offsets[at][:, None] + np.arange(n)]
        finite = np.isfinite(c).all(axis=1)
        with np.errstate(over="ignore"):
            yield at[finite], np.clip(np.floor(SCALE * c[finite]), -_ENTRY, _ENTRY).astype(np.int64) + SHIFT


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact sums of each dimension, in two halves of 32 bits, for each length of vectors in the partition."""
    held: dict[int, list] = {}
    for b in batches:
        for at, x in _whole(b.column(0)):
            if len(at) and x.shape[1]:
                low, high = int(x.min()), int(x.max())
                own = held.setdefault(x.shape[1], [0, np.zeros(x.shape[1], np.int64), np.zeros(x.shape[1], np.int64), low, high])
                own[0] += len(at)
                own[1] += (x >> 32).sum(axis=0)
                own[2] += (x & 0xFFFFFFFF).sum(axis=0)
                own[3:] = [min(own[3], low), max(own[4], high)]
    kinds = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64()]
    rows = [(k, *v) for k, v in held.items()]
    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)] if rows else [pa.array([], t) for t in kinds], ["size", "n", "high", "low", "least", "most"])


@dataclass
class Whitening:
    """n vectors of the fit, exact sums of their dimensions; components in columns, falling eigenvalues of the covariance
    (divisor n). bound: no deviation is above it."""

    n: int
    sums: list[int]
    bound: int
    components: np.ndarray
    values: np.ndarray

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exact: 64-bit numbers where all squares add up within them, else Python's."""
        if self.bound < 2**62:
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.numerators(x) / self.n).astype(np.float64)


def _centred(fit: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, x in _whole(b.column(0), len(fit.sums)):
                z = fit.centred(x)
                offsets = pa.array(np.arange(0, z.size + 1, z.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, pa.array(z.ravel()))], ["z"])
        release()

    return run


def fit_whitening(vectors: DataFrame, count: int = 8, vector_col: str = "embedding") -> Whitening | None:
    """The first components of all vectors without a null or non-finite entry; None if there is none.

    Dimensions are those of most vectors (of equally many, the larger number); vectors of another length, empty ones too, have no
    place in a covariance and count as invalid. Entries beyond 2^52 count as 2^52. The covariance of the centred rows is
    added up by MLlib in a tree over the partitions, d * d / 2 numbers each; the driver decomposes that one matrix, whose
    size goes by the dimensions and not by the rows. Components without variance (at 1e-9 of the largest deviation) are left out.
    """
    folder = shared_dir(vectors.sparkSession)
    src = vectors.select(vectors[vector_col].cast("array<double>").alias("v"))
    parts = written(src.mapInArrow(_partial, "size int, n bigint, high array<bigint>, low array<bigint>, least bigint, most bigint"), folder, "sums")
    best = parts.groupBy("size").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most")).orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return None
    each = parts.where(F.col("size") == best["size"]).select(F.posexplode(F.arrays_zip("high", "low")).alias("at", "s"))
    exact = "decimal(38,0)"
    rows = each.groupBy("at").agg(F.sum(F.col("s.high").cast(exact)).alias("high"), F.sum(F.col("s.low").cast(exact)).alias("low")).orderBy("at").collect()
    n, sums = best["n"], [(int(r.high) << 32) + int(r.low) for r in rows]
    bound = sum(max(abs(n * best["least"] - s), abs(n * best["most"] - s)) ** 2 for s in sums)
    fit = Whitening(n, sums, bound, np.zeros((len(sums), 0)), np.zeros(0))
    centred = src.mapInArrow(_centred(fit), "z array<double>").select(array_to_vector("z").alias("z"))
    # All singular values: their solver works to double precision, the one for some of them to a tolerance.
    svd = RowMatrix(MLUtils.convertVectorColumnsFromML(centred, "z"), n, len(sums)).computeSVD(len(sums), False, LEAST)
    s = svd.s.toArray()
    some = np.flatnonzero((s > 0) & (s > LEAST * s.max(initial=0)))[:count]
    return Whitening(n, sums, bound, svd.V.toArray()[:, some], s[some] ** 2 / n)


def _whitened(fit: Whitening, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        onto = fit.components / np.sqrt(fit.values)
        for b in batches:
            for at, x in _whole(b.column(1), len(fit.sums)):
                y = fit.numerators(x)
                deviation = (y * y).sum(axis=1)
                if kind != pa.int64():
                    deviation = [Decimal(int(v)) if v < 10**38 else None for v in deviation]
                w = (y / fit.n).astype(np.float64) @ onto
                offsets = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(deviation, kind), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))], ["_id", "deviation", "w"])
        release()

    return run


def whiten(vectors: DataFrame, count: int = 8, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, component (from 1), n, deviation, whitened, explained and identity_error: for each valid vector a row a component.

    deviation is the exact sum over dimensions of (n * x - S)^2, as bigint where every value is sure to fit, else as
    decimal(38,0), null beyond 38 digits. explained is the component's share of the total variance, which is the sum of
    all deviations over n^3. identity_error is the largest entry, without sign, of the covariance of the whitened vectors
    less the identity. Null and non-finite entries, null, empty and odd-sized vectors: see fit_whitening. Rows that repeat
    an id or a vector, and null ids, are rows of their own. No valid vector, or none that differs from another, gives no
    row. Other columns are not read.
    """
    spark, folder = vectors.sparkSession, shared_dir(vectors.sparkSession)
    fit = fit_whitening(vectors, count, vector_col)
    k = len(fit.values) if fit else 0
    own = vectors.select(vectors[id_col].alias("_id"), vectors[vector_col].cast("array<double>").alias("v"))
    kind = own.schema["_id"].dataType.simpleString()
    long = not k or fit.bound < 2**62
    exact = "bigint" if long else "decimal(38,0)"
    if not k:
        return spark.createDataFrame([], f"`{id_col}` {kind}, component int, n bigint, deviation {exact}, whitened double, explained double, identity_error double")
    rows = written(own.mapInArrow(_whitened(fit, pa.int64() if long else pa.decimal128(38, 0)), f"_id {kind}, deviation {exact}, w array<double>"), folder, "whitened")
    w = [F.col("w")[i] for i in range(k)]
    first = rows.agg(F.try_sum(F.col("deviation").cast("decimal(38,0)")).alias("exact"), F.sum(F.col("deviation").cast("double")).alias("near"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(w))).first()
    total = int(first["exact"]) if first["exact"] is not None else first["near"]
    centred = [c - F.lit(first[f"m{i}"]) for i, c in enumerate(w)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    products = rows.agg(*(F.sum(centred[i] * centred[j]) for i, j in pairs)).first()
    error = max(abs(p / fit.n - (i == j)) for p, (i, j) in zip(products, pairs))
    share = [float(e) * fit.n**3 / total if math.isfinite(total) else 0.0 for e in fit.values]
    out = rows.select("_id", "deviation", F.posexplode("w").alias("at", "whitened"))
    return out.select(F.col("_id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(fit.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.array(*map(F.lit, share))[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"))
