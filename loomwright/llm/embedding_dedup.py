"""Embedding near-dedup: spherical k-means cells, blocked cosine products inside them, one representative per group."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import shared_dir, whole_ids, written
from loomwright.llm.components import Forest, components


@dataclass(frozen=True)
class Cells:
    """Pairs link at a cosine of threshold or more.

    Cells: one for about per_cell different vectors, at most max_cells, fitted on the sample_bytes of vectors (as
    doubles) with the smallest hashes. A vector lives in the cell of its nearest centroid and visits all cells whose
    centroid is nearly as near: by up to margin in cosine. Pairs are found when one visits the other's cell; of pairs
    whose cosines with a centroid differ by more than margin some are missed (recall is measured in the tests); with a
    margin of 2 every vector visits all cells, and none is missed. Beyond per_cell * max_cells vectors cells grow.
    A cell of more than split members is compared in parts, each with each.
    """

    threshold: float = 0.9
    margin: float = 0.12
    per_cell: int = 512
    max_cells: int = 2048
    sample_bytes: int = 32 << 20
    rounds: int = 8
    split: int = 4096


def unit(rows: list[list[float | None] | None]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one length as doubles of length one, and which of them are vectors: not null, finite, not zero."""
    size = max((len(r) for r in rows if r is not None), default=0)
    x = np.array([[np.nan if v is None else v for v in r] if r is not None else [np.nan] * size for r in rows], np.float64).reshape(len(rows), size)
    with np.errstate(all="ignore"):
        top = np.abs(x).max(axis=1, initial=0)
        ok = np.isfinite(x).all(axis=1) & (top > 0)
        x = x / np.where(ok, top, 1)[:, None]
        x /= np.sqrt((x * x).sum(axis=1))[:, None]
    return x, ok


def spherical_kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Centroids of length one. Starts from vectors evenly spaced in the given order; empty cells keep their centroid."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        home = np.concatenate([(x[i : i + 4096] @ centres.T).argmax(axis=1) for i in range(0, len(x), 4096)])
        order = np.argsort(home, kind="stable")
        begin = np.flatnonzero(np.diff(home[order], prepend=-1))
        sums = np.add.reduceat(x[order], begin, axis=0)
        norm = np.sqrt((sums * sums).sum(axis=1))
        good = norm > 1e-12
        centres[home[order][begin][good]] = sums[good] / norm[good, None]
    return centres


def _vectors(column: pa.ListArray) -> np.ndarray:
    """Valid vectors of one length, as doubles of length one."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _assign(centres: np.ndarray, how: Cells):
    """A row for each cell that a vector lives in or visits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sizes = part.column(2).value_lengths().to_numpy(zero_copy_only=False)
                for size in np.unique(sizes):
                    own = part.filter(pa.array(sizes == size))
                    x = _vectors(own.column(2))
                    near = x @ centres.T if size == centres.shape[1] else np.zeros((len(x), 1))
                    reach = near >= near.max(axis=1)[:, None] - how.margin
                    row, cell = np.nonzero(reach)
                    visits = np.split(cell.astype(np.int32), np.cumsum(reach.sum(axis=1))[:-1])
                    cols = [pa.array(np.full(len(row), size, np.int32)), pa.array(cell.astype(np.int32)), pa.array(near.argmax(axis=1)[row].astype(np.int32)), pa.array([visits[r] for r in row], pa.list_(pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols + [own.column(k).take(pa.array(row)) for k in (0, 1, 2)], ["dim", "cell", "home", "visits", "node", "many", "v"])

    return run


def _solve(group: pa.Table, threshold: float, counts: dict[int, int], forest: Forest) -> None:
    """One (cell, p, q): those of part p that live in the cell, with part q of all that live in it or visit it."""
    cell, p, q = (group[k][0].as_py() for k in ("cell", "p", "q"))
    home, part, node, many = (group[k].to_numpy() for k in ("home", "part", "node", "many"))
    here, others = np.flatnonzero((home == cell) & (part == p)), np.flatnonzero(part == q)
    if not len(here) or not len(others):
        return
    x = _vectors(group["v"].combine_chunks())
    visits = [frozenset(v) for v in group["visits"].take(pa.array(here)).to_pylist()]
    to, label, own = node[here], np.arange(len(here)), np.zeros(len(here), np.int64)
    for i in range(0, len(others), 1024):
        who = others[i : i + 1024]
        found = (x[who] @ x[here].T >= threshold) & (node[who][:, None] != to[None])
        for h in np.unique(home[who]):
            if h < cell:  # the visitor's cell counts the pairs with those that visit it
                found[np.ix_(home[who] == h, [h in v for v in visits])] = False
        got = found @ many[here]
        for r in np.flatnonzero(got).tolist():
            k = int(node[who[r]])
            counts[k] = counts.get(k, 0) + int(got[r])
            roots = np.unique(label[found[r]])
            for c in roots.tolist():
                forest.join(k, int(to[c]))
            if len(roots) > 1:
                label[np.isin(label, roots)] = roots[0]
        # Two that live here meet in (p, q) and in (q, p), or twice in (p, p); a visitor comes once and counts for both.
        visitor = home[who] != cell
        own += many[who][visitor] @ found[visitor]
    for k, n in zip(to.tolist(), own.tolist()):
        if n:
            counts[k] = counts.get(k, 0) + n


_KEYS = ["dim", "cell", "p", "q"]


def _compare(threshold: float):
    """Rows (node, null, links) that add up, and rows (node, node, 0) for what is connected."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, int] = {}
        forest, held, key = Forest(), [], None

        def out() -> Iterator[pa.RecordBatch]:
            a, b = forest.links()
            yield pa.RecordBatch.from_arrays([pa.array([*counts, *a], pa.int64()), pa.array([None] * len(counts) + b, pa.int64()), pa.array([*counts.values(), *[0] * len(a)], pa.int64())], ["a", "b", "n"])
            counts.clear()

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(k).to_numpy() for k in range(4)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), b.num_rows]
            for i, j in zip(cuts, cuts[1:]):
                now = tuple(keys[:, i].tolist())
                if held and key != now:
                    _solve(pa.Table.from_batches(held), threshold, counts, forest)
                    held = []
                key = now
                held.append(b.slice(i, j - i))
            if len(counts) + len(forest.up) > 300_000:
                yield from out()
        if held:
            _solve(pa.Table.from_batches(held), threshold, counts, forest)
        yield from out()

    return run


def near_vectors(vectors: DataFrame, how: Cells = Cells(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n_links, component_id, kept for each row of vectors.

    n_links: other rows linked directly. component_id: the smallest id that links lead to. kept: the row has that id.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and so do vectors of
    different lengths. Rows with a null id link with nothing and have a null component. Equal vectors are one node that
    counts many times, so that copies are never compared with one another; rows that repeat an id count each for itself.
    Ids are whole numbers; other types raise. Empty tables give none. Other columns are not read.
    """
    whole_ids(vectors, id_col)
    folder = shared_dir(vectors.sparkSession)
    single = vectors.select(vectors[vector_col].alias("v")).schema["v"].dataType.simpleString() == "array<float>"
    src = vectors.select(vectors[id_col].alias("_id"), vectors[vector_col].cast("array<float>" if single else "array<double>").alias("v"))
    ok = F.coalesce(F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))) & F.exists("v", lambda e: e != 0), F.lit(False)) & F.col("_id").isNotNull()
    rows = src.select("_id", F.when(ok, F.col("v")).alias("v")).withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit(1), "v")})
    different = rows.where("v is not null").groupBy("v", "h1", "h2").agg(F.min(F.col("_id").cast("bigint")).alias("node"), F.count("*").alias("many"))
    nodes = written(different.select("node", "many", "v", "h1", "h2"), folder, "nodes")
    first = nodes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    centres = np.zeros((1, 1))
    if first:
        size, n = first
        k = int(min(max(1, n // how.per_cell), how.max_cells))
        sample = nodes.where(F.size("v") == size).orderBy("h1", "h2").limit(max(1, min(40 * k, how.sample_bytes // (8 * size)))).select("v")
        x, _ = unit([r.v for r in sample.toLocalIterator()])
        centres = spherical_kmeans(x, min(k, len(x)), how.rounds)
    placed = written(nodes.select("node", "many", "v").mapInArrow(_assign(centres, how), f"dim int, cell int, home int, visits array<int>, node bigint, many bigint, v {src.schema['v'].dataType.simpleString()}"), folder, "placed")
    big = written(placed.groupBy("dim", "cell").count().select("dim", "cell", F.ceil(F.col("count") / how.split).alias("parts")).where("parts > 1"), folder, "big")
    both = placed.join(big, ["dim", "cell"], "left").withColumn("parts", F.coalesce("parts", F.lit(1).cast("bigint")))
    both = both.withColumn("part", F.pmod(F.xxhash64("node"), "parts"))
    every = F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)
    as_other = F.transform(every, lambda j: F.struct(j.alias("p"), F.col("part").alias("q")))
    as_home = F.when(F.col("home") == F.col("cell"), F.transform(every, lambda j: F.struct(F.col("part").alias("p"), j.alias("q")))).otherwise(F.array().cast("array<struct<p:bigint,q:bigint>>"))
    dealt = both.withColumn("pq", F.explode(F.array_distinct(F.concat(as_other, as_home))))
    dealt = dealt.select("dim", "cell", F.col("pq.p").alias("p"), F.col("pq.q").alias("q"), "home", "part", "node", "many", "visits", "v")
    found = written(dealt.repartition(*_KEYS).sortWithinPartitions(*_KEYS).mapInArrow(_compare(how.threshold), "a bigint, b bigint, n bigint"), folder, "found")
    counts = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = components(found.where("b is not null").select("a", "b"), folder)
    named = nodes.select("h1", "h2", "node", "many").join(counts, "node", "left").join(parts, "node", "left")
    # Rows without a vector have keys of their own, so that they don't meet in one place.
    named = written(named.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("many") - 1).cast("bigint").alias("n_links"), F.coalesce("component", "node").alias("component_id")), folder, "named")
    keyed = rows.select("_id", F.when(F.col("v").isNotNull(), F.col("h1")).otherwise(F.xxhash64("_id")).alias("h1"), F.when(F.col("v").isNotNull(), F.col("h2")).alias("h2"))
    out = keyed.join(named, ["h1", "h2"], "left").withColumn("component_id", F.coalesce("component_id", F.col("_id").cast("bigint")))
    return out.select(F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), F.col("component_id").cast("bigint"), F.coalesce(F.col("_id").cast("bigint") == F.col("component_id"), F.lit(False)).alias("kept"))
