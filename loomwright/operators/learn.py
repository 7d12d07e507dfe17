"""Classifiers on text features, active learning, the annotator that needs labels only, the final model."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions import expr
from loomwright.operators import annotate, sample
from loomwright.operators.features import FittedTfIdf, Sparse, TfIdf, small_batches
from loomwright.operators.ranges import held
from loomwright.operators.setops import minus, only
from loomwright.schema import HISTORY, ROW_ID

#: A group of at most so many rows is fitted in one task; of more, Spark's solver finds the same minimum in many jobs.
ROWS_PER_TASK = 20_000
STRATEGIES = ("entropy", "margin", "random")


def minimum(x, y: np.ndarray, classes: int, ridge: float, steps: int = 100) -> np.ndarray:
    """Weights of multinomial logistic regression, a row a class, the intercept last: the minimum of the mean loss plus
    ridge / 2 times the squared weights, without the intercepts. Newton's steps, each solved by conjugate gradients, so
    that x (an array or a sparse matrix) is only multiplied with vectors."""
    n, d = x.shape
    hold, target, back = np.append(np.full(d, ridge), 1e-9)[:, None], np.eye(classes)[y], x.T
    times = lambda w: x.dot(w[:-1]) + w[-1]
    gather = lambda r: np.vstack([back.dot(r), r.sum(axis=0)]) / n

    def state(w: np.ndarray) -> tuple[float, np.ndarray]:
        z = times(w)
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        total = e.sum(axis=1, keepdims=True)
        return float((np.log(total[:, 0]) - z[np.arange(n), y]).mean() + (hold * w * w).sum() / 2), e / total

    w = np.zeros((d + 1, classes))
    loss, p = state(w)
    for _ in range(steps):
        g = gather(p - target) + hold * w
        size = np.sqrt((g * g).sum())
        if size < 1e-9:
            break
        step, rest = np.zeros_like(w), -g
        way, left = rest.copy(), float((g * g).sum())
        for _ in range(min(2 * w.size, 500)):
            r = p * times(way)
            curved = gather(r - p * r.sum(axis=1, keepdims=True)) + (hold + 1e-12) * way
            much = left / float((way * curved).sum())
            step, rest = step + much * way, rest - much * curved
            now = float((rest * rest).sum())
            if np.sqrt(now) < min(0.1, np.sqrt(size)) * size * 1e-2:
                break
            way, left = rest + now / left * way, now
        part = 1.0
        while part > 1e-8 and (then := state(w + part * step))[0] > loss + 1e-4 * part * float((g * step).sum()):
            part /= 2
        if part <= 1e-8:
            break
        w, (loss, p) = w + part * step, then
    return w.T


def _matrix(column: pa.Array):
    """An array, or a sparse matrix, from vectors as Spark stores them."""
    values, indices = (column.field(column.type.get_field_index(c)) for c in ("values", "indices"))
    flat = values.flatten().to_numpy(zero_copy_only=False)
    if indices.null_count == len(indices):
        return flat.reshape(len(column), -1)
    width = column.field(column.type.get_field_index("size")).to_numpy(zero_copy_only=False).max(initial=0)
    ends = np.cumsum(indices.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
    return Sparse(np.concatenate([[0], ends]), indices.flatten().to_numpy(zero_copy_only=False), flat, int(width))


def _fit_one(c: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        names = sorted(set(table.column("y").to_pylist()))
        y = np.array([names.index(v) for v in table.column("y").to_pylist()])
        w = minimum(_matrix(table.column("x").chunk(0)), y, max(len(names), 2), 1.0 / (c * len(y)))
        return pa.table({"g": table.column("g").slice(0, 1), "names": pa.array([names], pa.list_(pa.string())), "w": pa.array([w.ravel()], pa.list_(pa.float64()))})

    return run


def _fit_many(rows: DataFrame, c: float, n: int) -> tuple[list[str], np.ndarray]:
    """The same minimum by Spark's solver. Columns that don't vary have no weight, as it can't do with them."""
    names = StringIndexer(inputCol="y", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    indexed = names.transform(rows).select("features", "_y").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        variances = indexed.select(Summarizer.variance(F.col("features"))).first()[0].toArray()
        some, k = np.flatnonzero(variances > 1e-12), max(len(names.labels), 2)
        w = np.zeros((k, len(variances) + 1))
        if len(some) and len(names.labels) > 1:
            sliced = VectorSlicer(inputCol="features", outputCol="_some", indices=some.tolist()).transform(indexed)
            solver = LogisticRegression(featuresCol="_some", labelCol="_y", family="multinomial", standardization=False, regParam=1.0 / (c * n), elasticNetParam=0.0, maxIter=3000, tol=1e-12)
            model = solver.fit(sliced)
            w[:, some], w[:, -1] = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        return list(names.labels), w
    finally:
        indexed.unpersist()


def fit_groups(rows: DataFrame, group: str, label: str, c: float, counts: dict[str, int] | None = None) -> dict[str, tuple[list[str], np.ndarray]]:
    """For each group (as text) the names of its classes and the weights of its classifier, a row a class, intercept last.

    One job fits all groups of at most ROWS_PER_TASK rows, a task each; for larger ones Spark's solver runs side by side.
    Rows without a label are left out. counts: the numbers of rows of the groups, where they are known.
    """
    known = rows.where(F.col(label).isNotNull()).select(F.col(group).cast("string").alias("g"), F.col(label).cast("string").alias("y"), "features")
    if counts is None:
        counts = {r.g: r["count"] for r in known.groupBy("g").count().collect()}
    large = [g for g, n in counts.items() if n > ROWS_PER_TASK]
    out: dict[str, tuple[list[str], np.ndarray]] = {}
    if len(large) < len(counts):
        few = known.where(~F.col("g").isin(large)) if large else known
        for r in few.select("g", "y", F.unwrap_udt("features").alias("x")).groupBy("g").applyInArrow(_fit_one(c), "g string, names array<string>, w array<double>").collect():
            out[r.g] = (r.names, np.array(r.w).reshape(max(len(r.names), 2), -1))
    if large:
        with ThreadPoolExecutor(min(len(large), 8)) as pool:
            fits = [pool.submit(inheritable_thread_target(known.sparkSession)(_fit_many), known.where(F.col("g") == g), c, counts[g]) for g in large]
            out |= {g: f.result() for g, f in zip(large, fits)}
    return out


def forest():
    """200 trees as deep as Spark lets them be."""
    return RandomForestClassifier(featuresCol="features", labelCol="_y", numTrees=200, maxDepth=30, seed=42)


@dataclass
class Classifier:
    """A fitted model with the names of its classes."""

    model: object
    classes: list[str]

    @classmethod
    def of(cls, names: list[str], w: np.ndarray) -> Classifier:
        """Of weights, a row a class, the intercept last."""
        from pyspark.ml.common import _py2java
        from pyspark.ml.linalg import Matrices, Vectors

        context, (k, d) = SparkSession.active().sparkContext, w.shape
        weights, begin = Matrices.dense(k, d - 1, w[:, :-1].ravel(order="F").tolist()), Vectors.dense(w[:, -1].tolist())
        model = context._jvm.org.apache.spark.ml.classification.LogisticRegressionModel(f"minimum_{id(w):x}", _py2java(context, weights), _py2java(context, begin), k, True)
        return cls(LogisticRegressionModel(model).setFeaturesCol("features"), names if len(names) > 1 else [*names, "-"])

    @classmethod
    def fit(cls, df: DataFrame, label: str = "label", kind: str = "logreg", c: float = 1000.0) -> Classifier:
        """logreg: the mean loss plus half the squared weights over c n, whatever the number of rows; rf: a random forest."""
        known = df.where(F.col(label).isNotNull())
        if kind == "logreg":
            found = fit_groups(known.withColumn("_g", F.lit("")), "_g", label, c)
            if not found:
                raise ValueError("no labelled row to fit a classifier on")
            return cls.of(*found[""])
        if kind != "rf":
            raise ValueError(f"unknown model {kind}; there are logreg and rf")
        names = StringIndexer(inputCol=label, outputCol="_y", stringOrderType="alphabetAsc").fit(known)
        return cls(forest().fit(names.transform(known)), list(names.labels))

    def probabilities(self, df: DataFrame) -> DataFrame:
        """df with _p: a probability for each of the classes."""
        out = self.model.setPredictionCol("_prediction").setProbabilityCol("_probability").setRawPredictionCol("_rawp").transform(df)
        return out.withColumn("_p", vector_to_array("_probability")).drop("_prediction", "_probability", "_rawp")

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        return self.probabilities(df).withColumn(column, expr.argmax(F.col("_p"), F.array(*map(F.lit, self.classes)))).drop("_p")


def uncertainty(p, strategy: str):
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}; there are {', '.join(STRATEGIES)}")
    return expr.entropy(p) if strategy == "entropy" else expr.margin(p)


@dataclass
class ActiveLearner:
    kind: str = "logreg"
    max_features: int = 5000
    components: int = 50
    features: FittedTfIdf | None = None
    classifier: Classifier | None = field(default=None)

    def vocabulary(self) -> TfIdf:
        return TfIdf(self.max_features, 2, 2, self.components)

    def build_vocabulary(self, texts: DataFrame, text: str = "text") -> None:
        """Features are fitted once, on all texts there are."""
        self.features = self.vocabulary().fit(texts, text)

    def featurize(self, df: DataFrame, text: str = "text") -> DataFrame:
        return df if "features" in df.columns else self.features.transform(df, text)

    def fit(self, labelled: DataFrame, label: str = "label") -> ActiveLearner:
        if self.features is None and "features" not in labelled.columns:
            self.build_vocabulary(labelled)
        self.classifier = Classifier.fit(self.featurize(labelled), label, self.kind)
        return self

    def query(self, pool: DataFrame, strategy: str, batch: int, seed: int | str = 42) -> DataFrame:
        """The row numbers of the batch most uncertain rows; by key for random, and as long as nothing is fitted."""
        if self.classifier is None or strategy == "random":
            return sample.take(pool, batch, seed).select(ROW_ID)
        scored = self.classifier.probabilities(self.featurize(pool))
        return sample.top(scored, uncertainty(F.col("_p"), strategy), batch).select(ROW_ID)

    def evaluate(self, test: DataFrame, label: str = "label") -> dict:
        """From the confusion table, which has a row for each pair of classes."""
        return _figures(annotate.confusion(self.classifier.predict(self.featurize(test)), label, "prediction").collect())

    def run_cycle(self, labelled: DataFrame, pool: DataFrame, test: DataFrame, strategy: str = "entropy", iterations: int = 5, batch: int = 20, label: str = "label") -> list[dict]:
        """From the seed, batch rows a round move from the pool to the labelled ones; ends early when the pool is empty."""
        return compare_strategies(labelled, pool, test, (strategy,), iterations, batch, label, self.kind, self)[strategy]


def _figures(pairs: list) -> dict:
    """accuracy and macro f1 from rows truth, predicted, n."""
    n, same = sum(r.n for r in pairs), sum(r.n for r in pairs if r.truth == r.predicted)
    f1 = []
    for c in {x for r in pairs for x in (r.truth, r.predicted)}:
        both = sum(r.n * ((r.truth == c) + (r.predicted == c)) for r in pairs)
        f1.append(2 * sum(r.n for r in pairs if r.truth == r.predicted == c) / both if both else 0.0)
    return {"accuracy": round(same / n, 4) if n else None, "f1": round(sum(f1) / len(f1), 4) if f1 else None}


_PAIRS, _NAMED = "pairs array<struct<truth:string,predicted:string,n:bigint>>", pa.list_(pa.struct([("truth", pa.string()), ("predicted", pa.string()), ("n", pa.int64())]))
_ROUND = f"strategy string, ids array<bigint>, {_PAIRS}"
_SHARE = f"strategy string, numbers array<double>, keys array<string>, ids array<bigint>, {_PAIRS}"


def _score(models: dict, taken: dict[str, list[int]], batch: int):
    """Each task's share of a round: for each strategy the pairs of truth and prediction of its test rows, and the best of
    its pool, at most batch rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: dict[str, Counter] = {s: Counter() for s in taken}
        best: dict[str, list[tuple]] = {s: [] for s in taken}
        gone = {s: np.array(sorted(ids), np.int64) for s, ids in taken.items()}
        for b in batches:
            if not b.num_rows:
                continue
            ids, test, truth, key = (b.column(b.schema.get_field_index(c)) for c in (ROW_ID, "_test", "_truth", "_key"))
            ids, test, truth = ids.to_numpy(zero_copy_only=False), test.to_numpy(zero_copy_only=False), np.array(truth.to_pylist(), object)
            x = _matrix(b.column(b.schema.get_field_index("x")))
            for s, (names, w) in models.items():
                z = x.dot(w[:, :-1].T) + w[:, -1]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                said = np.array([*names, "-"][: p.shape[1]], object)[p.argmax(axis=1)]
                pairs[s].update((t, q) for t, q in zip(truth[test], said[test]) if t is not None)
                at = np.flatnonzero(~test & ~np.isin(ids, gone[s]))
                if s == "random":
                    own = [(k, i) for k, i in zip(key.take(pa.array(at)).to_pylist(), ids[at].tolist())]
                else:
                    p = np.sort(p[at], axis=1)
                    value = (p * np.log(p + 1e-12)).sum(axis=1) if s == "entropy" else p[:, -1] - p[:, -2]
                    own = list(zip(value.tolist(), ids[at].tolist()))
                best[s] = nsmallest(batch, best[s] + own)
        rows = [{"strategy": s, "numbers": [float(v[0]) for v in best[s]] if s != "random" else [], "keys": [v[0] for v in best[s]] if s == "random" else [], "ids": [v[1] for v in best[s]], "pairs": [{"truth": t, "predicted": q, "n": n} for (t, q), n in pairs[s].items()]} for s in taken]
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("strategy", pa.string()), ("numbers", pa.list_(pa.float64())), ("keys", pa.list_(pa.string())), ("ids", pa.list_(pa.int64())), ("pairs", _NAMED)]))

    return run


def _best(batch: int):
    """The tasks' shares of one strategy as one."""

    def run(table: pa.Table) -> pa.Table:
        own, pairs = [], Counter()
        for r in table.to_pylist():
            own += list(zip(r["keys"] or r["numbers"], r["ids"]))
            for p in r["pairs"]:
                pairs[p["truth"], p["predicted"]] += p["n"]
        row = {"strategy": table.column("strategy")[0].as_py(), "ids": [i for _, i in nsmallest(batch, own)], "pairs": [{"truth": t, "predicted": q, "n": n} for (t, q), n in sorted(pairs.items())]}
        return pa.Table.from_pylist([row], pa.schema([("strategy", pa.string()), ("ids", pa.list_(pa.int64())), ("pairs", _NAMED)]))

    return run


def _rounds(rows: DataFrame, strategies: tuple[str, ...], iterations: int, batch: int, label: str, begun: int) -> dict[str, list[dict]]:
    """All strategies side by side over held rows with features and _part: a job fits them, another one scores the test
    rows and the pool for all of them. The driver knows which rows have been chosen, batch numbers a round."""
    spark, live = small_batches(rows.sparkSession), list(strategies)
    chosen: dict[str, list[int]] = {s: [] for s in strategies}
    history: dict[str, list[dict]] = {s: [] for s in strategies}
    for k in range(iterations + 1):
        names = spark.createDataFrame([(s, i) for s in live for i in chosen[s]], f"_s string, {ROW_ID} bigint")
        first = rows.where("_part = 0").withColumn("_s", F.explode(F.array(*map(F.lit, live))))
        more = rows.where("_part = 1").join(F.broadcast(names), ROW_ID) if any(chosen[s] for s in live) else None
        both = first.unionByName(more) if more is not None else first
        models = fit_groups(both, "_s", label, 1000.0, {s: begun + len(chosen[s]) for s in live})
        scored = rows.where("_part > 0").select(ROW_ID, (F.col("_part") == 2).alias("_test"), F.col(label).cast("string").alias("_truth"), expr.rank_key(F.col(ROW_ID), f"42:{k + 1}").alias("_key"), F.unwrap_udt("features").alias("x"))
        shares = scored.mapInArrow(_score({s: models[s] for s in live}, {s: chosen[s] for s in live}, batch), _SHARE)
        got = {r.strategy: r for r in shares.groupBy("strategy").applyInArrow(_best(batch), _ROUND).collect()}
        for s in [*live]:
            pairs, ids = (got[s].pairs, got[s].ids) if s in got else ([], [])
            history[s].append({"iteration": k, "n_labeled": begun + len(chosen[s]), **_figures(pairs), "strategy": s})
            chosen[s] += ids
            if not ids:
                live.remove(s)
        if not live:
            break
    return history


def _cycle(rows: DataFrame, kind: str, strategy: str, iterations: int, batch: int, label: str, begun: int) -> list[dict]:
    """One strategy round by round, for models that only Spark fits."""
    learner, history, chosen, spark = ActiveLearner(kind), [], [], rows.sparkSession
    labelled, pool, test = (rows.where(F.col("_part") == k) for k in range(3))
    for k in range(iterations + 1):
        ids = spark.createDataFrame([(i,) for i in chosen], f"{ROW_ID} bigint")
        if k:
            new = [r[0] for r in learner.query(minus(pool, F.broadcast(ids)), strategy, batch, f"42:{k}").collect()]
            if not new:
                break
            chosen += new
            ids = spark.createDataFrame([(i,) for i in chosen], f"{ROW_ID} bigint")
        learner.fit(labelled.unionByName(only(pool, F.broadcast(ids))), label)
        history.append({"iteration": k, "n_labeled": begun + len(chosen), **learner.evaluate(test, label), "strategy": strategy})
    return history


def compare_strategies(labelled: DataFrame, pool: DataFrame, test: DataFrame, strategies: tuple[str, ...] = ("entropy", "random"), iterations: int = 5, batch: int = 20, label: str = "label", kind: str = "logreg", learner: ActiveLearner | None = None) -> dict[str, list[dict]]:
    """A fresh model for each strategy on one set of features: those of the rows, or of the learner if it has a vocabulary,
    or else of the texts of all three frames. Features are computed once, and rounds of logistic regression run for all
    strategies together; what each round takes from the rows is bounded by batch and the classes."""
    if unknown := [s for s in strategies if s not in STRATEGIES]:
        raise ValueError(f"unknown strategy {unknown[0]}; there are {', '.join(STRATEGIES)}")
    learner = learner or ActiveLearner(kind)
    own = "features" if "features" in labelled.columns else "text"
    rows = None
    for k, f in enumerate((labelled, pool, test)):
        f = f.select(ROW_ID, label, own).withColumn("_part", F.lit(k))
        rows = f if rows is None else rows.unionByName(f)
    if own == "text" and learner.features is None:
        learner.features, rows = learner.vocabulary().fit_rows(rows, keep=(ROW_ID, label, "_part"))
    elif own == "text":
        rows = learner.features.transform(rows).drop("text")
    rows = held(rows)
    begun = rows.where(F.col("_part") == 0).where(F.col(label).isNotNull()).count()
    if not begun:
        raise ValueError("no labelled row to begin with")
    if kind != "logreg":
        return {s: _cycle(rows, kind, s, iterations, batch, label, begun) for s in strategies}
    return _rounds(rows, strategies, iterations, batch, label, begun)


def history_frame(spark, results: dict[str, list[dict]]) -> DataFrame:
    rows = [(h["iteration"], h["n_labeled"], h["accuracy"], h["f1"], h["strategy"]) for hs in results.values() for h in hs]
    return spark.createDataFrame(rows, HISTORY)


def label_out_of_fold(df: DataFrame, label: str = "label", threshold: float = annotate.THRESHOLD, k: int = 5) -> DataFrame:
    """The annotator for when no model is at hand: each fold is labelled by a model of the others; the text statistics
    are those of all rows. Rows without a label are left out. Features are written once and all folds are fitted on them;
    texts stay where they are when they are labelled."""
    known = sample.folds(df.where(F.col(label).isNotNull()), label, k)
    found = TfIdf(5000, 1, 1, None, sublinear=False).fit(known)
    rows = held(found.transform(known.select("text", label, "fold")).drop("text"))
    others = F.explode(F.filter(F.sequence(F.lit(0), F.lit(k - 1)), lambda g: g != F.col("fold")))
    models = {int(g): m for g, m in fit_groups(rows.withColumn("_g", others), "_g", label, 1.0).items()}

    def label_batch(b: pa.RecordBatch, x: Sparse) -> list[pa.Array]:
        fold = b.column(b.schema.get_field_index("fold")).to_numpy(zero_copy_only=False)
        said, top = np.full(b.num_rows, None, object), np.full(b.num_rows, np.nan)
        for g, (names, w) in models.items():
            at = np.flatnonzero(fold == g)
            z = (x.dot(w[:, :-1].T) + w[:, -1])[at]
            p = np.exp(z - z.max(axis=1, keepdims=True, initial=-np.inf))
            p /= p.sum(axis=1, keepdims=True)
            said[at], top[at] = np.array([*names, "-"][: p.shape[1]], object)[p.argmax(axis=1)], p.max(axis=1, initial=0)
        return [pa.array(said.tolist(), pa.string()), pa.array(top, from_pandas=True)]

    out = found.applied(known, label_batch, [T.StructField("predicted_label", T.StringType()), T.StructField("_top", T.DoubleType())]).drop("fold")
    out = out.withColumn("confidence", F.bround("_top", 4))
    return out.withColumn("needs_review", F.col("confidence") < threshold).drop("_top")


@dataclass
class FinalModel:
    features: FittedTfIdf
    classifier: Classifier

    def predict(self, df: DataFrame) -> DataFrame:
        return self.classifier.predict(self.features.transform(df)).drop("features")

    def save(self, path: str) -> None:
        """All that predicting takes: vocabulary, weights of words, projection, classifier, names of classes."""
        spark = SparkSession.active()
        self.features.save(f"{path}/features")
        self.classifier.model.write().overwrite().save(f"{path}/classifier")
        kind = type(self.classifier.model).__name__
        spark.createDataFrame([(kind, self.classifier.classes)], "kind string, classes array<string>").coalesce(1).write.mode("overwrite").json(f"{path}/classes")

    @classmethod
    def load(cls, path: str) -> FinalModel:
        import pyspark.ml.classification as found

        row = SparkSession.active().read.schema("kind string, classes array<string>").json(f"{path}/classes").first()
        return cls(FittedTfIdf.load(f"{path}/features"), Classifier(getattr(found, row.kind).load(f"{path}/classifier"), list(row.classes)))


def train_final(train: DataFrame, test: DataFrame, label: str = "label") -> tuple[FinalModel, DataFrame]:
    """Features of 10000 words and pairs, 100 components, logistic regression; and the predictions for test."""
    features, ready = TfIdf(10000, 2, 2, 100).fit_rows(train, keep=(label,))
    model = FinalModel(features, Classifier.fit(held(ready), label, "logreg", 10.0))
    return model, model.predict(test)
