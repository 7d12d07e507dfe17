"""Operators on small frames: nulls, NaN, white space, ties, one class, empty frames; and properties of the repairs."""

import hashlib
import json
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwright import schema
from loomwright.functions import expr
from loomwright.operators import annotate, clean, evaluate, explore, features, learn, profile, sample, setops

REC = "_row_id bigint, text string, label string"


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("text, expected", [("", "positive"), ("LOVE hate", "positive"), ("hate hate love bad", "negative"), ("bad bad bad good", "positive"), (None, None), ("dark, cruel; EVIL friend", "negative")])
def test_sentiment(spark, text, expected):
    assert one(spark, expr.sentiment, text) == expected


def test_scalars(spark):
    assert one(spark, expr.strip, "   x y\t\n") == "x y"
    assert [one(spark, expr.is_blank, t) for t in ("", "  ", "\t", "a")] == [True, True, True, False]
    assert one(spark, expr.strip_quotes, " “it's”") == "it's"
    assert one(spark, expr.slug, "Toxic  Comments: 2!") == "toxic_comments_2"
    assert one(spark, expr.word_count, "a b　 c") == 3
    assert one(spark, lambda c: expr.half_even(c, 0), 2.5, "double") == 2.0
    assert one(spark, lambda c: expr.lookup(c, {0: "neg"}), 0, "int") == "neg" and one(spark, lambda c: expr.lookup(c, {0: "neg"}), 7, "int") == "7"
    p = [0.2, 0.5, 0.3]
    assert math.isclose(one(spark, expr.entropy, p, "array<double>"), -sum(x * math.log(x + 1e-12) for x in p))
    assert math.isclose(one(spark, expr.margin, p, "array<double>"), -0.2) and one(spark, expr.margin, [1.0], "array<double>") == -1.0
    assert one(spark, lambda c: expr.clip(c, F.lit(0.0), F.lit(1.0)), None, "double") is None
    assert one(spark, lambda c: F.filter(expr.words(c), lambda w: expr.is_content(w)), "The cat is on a mat, OK") == ["cat", "mat"]


def test_merge_order(spark):
    a = spark.createDataFrame([(5, "x", "a"), (1, "x", "b"), (2, None, "c"), (3, "  ", "d")], REC)
    b = spark.createDataFrame([(0, "x", "late"), (9, "y", None)], REC)
    got = {r.text: r.label for r in setops.merge([a, b]).collect()}
    assert got == {"x": "b", "y": None}
    assert setops.merge([], spark).columns == schema.RECORD.names


def test_dedup_reindex_minus(spark):
    df = spark.createDataFrame([(7, "a", None), (3, "a", None), (9, "b", "x"), (4, "a", "x")], REC)
    assert sorted(r._row_id for r in setops.drop_duplicates(df).collect()) == [3, 4, 9]
    assert {r._row_id: r.text for r in setops.reindex(df).collect()} == {0: "a", 1: "a", 2: "a", 3: "b"}
    assert setops.minus(df, df.where("_row_id = 3")).count() == 3
    assert setops.reindex(df.limit(0)).count() == 0


def test_profile_trichotomy(spark):
    df = spark.createDataFrame([("", float("nan"), None), (" \t", 1.0, "a"), (None, None, "a"), ("x", 2.0, "b")], "t string, v double, label string")
    got = {r["column"]: (r["count"], r["percent"]) for r in profile.missing(df).collect()}
    assert got == {"t": (3, 75.0), "v": (2, 50.0), "label": (1, 25.0)}
    assert profile.missing(df.limit(0)).count() == 0 and profile.duplicates(df.limit(0)).first()["percent"] == 0
    same = spark.createDataFrame([(None, 1), (None, 1), ("a", 1)], "t string, v int")
    assert profile.duplicates(same).first().asDict() == {"count": 1, "percent": 33.33}


def test_bounds(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (3.0, 6), (10.0, 6)], "a double, b int")
    found = profile.bounds(df)
    assert set(found) == {"a"}  # b has two different values only
    assert found["a"] == (1.75 - 1.5 * 3.0, 4.75 + 1.5 * 3.0)
    z = profile.bounds(df, profile.Detector(method="zscore"))["a"]
    assert math.isclose(z[1], 4.0 + 3 * math.sqrt(50 / 3))


def test_imbalance(spark):
    df = spark.createDataFrame([("a",)] * 7 + [("b",)] * 10 + [(None,)], "label string")
    assert profile.imbalance(df).first().asDict() == {"column": "label", "n_classes": 2, "imbalance_ratio": 0.7, "is_imbalanced": False}
    assert profile.imbalance(df.limit(0)).first()["imbalance_ratio"] == 1.0


def rows(spark, n=200):
    data = [(i, f"text number {i} " + "w " * (i % 37), "positive" if i % 3 else "negative") for i in range(n)]
    return spark.createDataFrame(data, REC)


def test_faults_are_found(spark):
    df = rows(spark)
    bad = sample.inject_faults(df, drop_class=("positive", 0.0))
    by = {r["column"]: r["count"] for r in profile.missing(bad.dropDuplicates(["_row_id"])).collect()}
    assert by == {"text": 10, "label": 6} and bad.count() == 208
    fixed = clean.fix(bad, clean.DEFAULT)
    assert profile.missing(fixed).count() == 0 and profile.duplicates(fixed).first()["count"] == 0
    assert sorted(r._row_id for r in clean.fix(fixed, {"duplicates": "drop", "missing": "drop"}).collect()) == sorted(r._row_id for r in fixed.collect())


def test_fill(spark):
    df = spark.createDataFrame([(0, None, None), (1, "b", 1.0), (2, "a", None), (3, "b", 4.0), (4, "a", float("nan")), (5, None, None)], "_row_id bigint, label string, v double")
    get = lambda d, c: [r[c] for r in d.orderBy("_row_id").collect()]
    assert get(clean.fix(df, {"missing": "median"}), "v") == [2.5, 1.0, 2.5, 4.0, 2.5, 2.5]
    assert get(clean.fix(df, {"missing": "mode"}), "label") == ["a", "b", "a", "b", "a", "a"]
    assert get(clean.fix(df, {"missing": "ffill"}), "label") == ["b", "b", "a", "b", "a", "a"]
    assert get(clean.fix(df, {"missing": "constant"}), "label")[0] == "UNKNOWN"
    assert clean.fix(df, {"missing": "what"}).count() == 6


def test_outlier_repairs(spark):
    df = spark.createDataFrame([(i, "é🙂" * 10, float(i % 5)) for i in range(20)] + [(98, "🙂" * 500, 1.0), (99, None, 1e6)], "_row_id bigint, text string, v double")
    clipped = {r._row_id: r for r in clean.fix(df, {"outliers": "clip_iqr"}).collect()}
    assert clipped[99].v < 100 and clipped[99].text is None and clipped[3].v == 3.0
    assert {r._row_id for r in clean.fix(df, {"outliers": "drop_iqr"}).collect()} == {*range(20), 98}


def test_balance(spark):
    df = rows(spark)
    counts = lambda d: {r["label"]: r["count"] for r in d.groupBy("label").count().collect()}
    assert counts(clean.fix(df, {"imbalance": "oversample"})) == {"positive": 133, "negative": 133}
    assert counts(clean.fix(df, {"imbalance": "undersample"})) == {"positive": 67, "negative": 67}
    over = clean.fix(df, {"imbalance": "oversample"})
    assert over.where("label = 'positive'").dropDuplicates(["_row_id"]).count() == 133  # the largest class stays as it is
    assert {r._row_id % 3 for r in over.where("label = 'negative'").collect()} == {0}


def test_compare_takes_absent_columns_as_zero(spark):
    frame = lambda *r: spark.createDataFrame(list(r), "metric string, value double")
    got = {r.metric: r.asDict() for r in profile.compare(frame(("rows", 4.0), ("missing_a", 2.0), ("z", 0.0)), frame(("rows", 3.0), ("missing_b", 1.0), ("z", 5.0))).collect()}
    assert got["rows"]["delta_pct"] == -25.0 and got["missing_a"]["after"] == 0.0 and got["missing_b"]["before"] == 0.0 and got["z"]["delta_pct"] == 0.0


def test_finders(spark):
    assert schema.find_text(spark.createDataFrame([("x" * 30, "y")], "blob string, id string")) == "blob"
    assert schema.find_text(spark.createDataFrame([("x", "y")], "a string, b string")) is None
    s = spark.createDataFrame([], "id bigint, my_text_en string, score double, Label_int int").schema
    assert schema.match_schema(s) == schema.Match("my_text_en", "Label_int")
    assert schema.match_schema(spark.createDataFrame([], "text string, label string").schema) is None
    assert schema.match_schema(s, ("id",)).label == "id"


def test_review_by_numbers(spark):
    """130 rows, 66 of them corrected: neg/neg 22, neg/pos 22, pos/neg 44, pos/pos 42."""
    cells = [("negative", "negative", 22), ("negative", "positive", 22), ("positive", "negative", 44), ("positive", "positive", 42)]
    data = [(t, p) for t, p, n in cells for _ in range(n)]
    df = spark.createDataFrame([(i, f"t{i}", t, p, 0.6, True) for i, (t, p) in enumerate(data)], REC + ", predicted_label string, confidence double, needs_review boolean")
    q = annotate.check_quality(df)
    po, pe = 64 / 130, (44 * 66 + 86 * 64) / 130**2
    assert q["agreement"] == round(po, 4) and q["kappa"] == round((po - pe) / (1 - pe), 4) and q["low_confidence_count"] == 130
    corrected = annotate.auto_correct(annotate.review_queue(df))
    assert corrected.where("corrected_label <> predicted_label").count() == 66 and annotate.corrections(corrected).count() == 10
    blank = corrected.withColumn("corrected_label", F.when(F.col("_row_id") == 0, "").when(F.col("_row_id") == 1, " ").when(F.col("_row_id") == 2, None).otherwise(F.col("corrected_label")))
    final = {r._row_id: r for r in annotate.merge_review(df, blank).collect()}
    assert all(final[i].final_label == data[i][1] for i in range(3)) and final[129].final_label == "positive"  # blank corrections: the prediction stands


def test_quality_without_truth(spark):
    df = spark.createDataFrame([("a", 0.5)], "predicted_label string, confidence double")
    assert annotate.check_quality(df)["kappa"] is None
    same = spark.createDataFrame([("a", "a")] * 3, "label string, predicted_label string")
    assert annotate.check_quality(same) == {"label_dist": {"a": 3}, "kappa": None, "agreement": 1.0}


def test_tasks(spark):
    df = spark.createDataFrame([(1, "naïve", "pos", 0.9), (2, "b", None, 0.4)], "_row_id bigint, text string, predicted_label string, confidence double")
    got = {r._row_id: json.loads(r.task) for r in annotate.tasks(df).collect()}
    assert got[1]["predictions"][0]["result"][0]["value"]["choices"] == ["pos"] and got[1]["predictions"][0]["score"] == 0.9
    assert "predictions" not in got[2] and got[2]["data"] == {"text": "b", "confidence": 0.4}


def test_scorer(spark):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(["good", None, "x"])], REC)
    load = lambda: lambda texts, classes: [[0.9, 0.1] if t == "good" else [0.31239, 0.68761] for t in texts]
    got = {r._row_id: r for r in annotate.label_by_scorer(df, load, ["p", "n"], batch=2).collect()}
    assert (got[0].predicted_label, got[0].needs_review) == ("p", False) and (got[1].predicted_label, got[1].confidence, got[1].needs_review) == ("n", 0.6876, True)


def test_metrics_use_all_classes(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("c", "a")], "label string, prediction string")
    got = {r.label: r for r in evaluate.report(df).collect()}
    assert got["b"].recall == 0.0 and got["c"].precision == 0.0 and got["a"].f1 == 0.5 and got["macro avg"].f1 == round(0.5 / 3, 4)
    s = evaluate.scores(df).first()
    assert (s.accuracy, s.f1_macro, s.f1_weighted, s.n) == (0.3333, 0.1667, 0.3333, 3)
    assert evaluate.scores(df.limit(0)).first().n == 0


def test_sampling(spark):
    df = rows(spark, 100)
    train, test = sample.train_test(df)
    assert test.count() == 50 and train.join(test, "_row_id").count() == 0 and train.count() == 50
    with pytest.raises(ValueError):
        sample.test_size(40)
    assert sample.test_size(1100) == 220 and sample.seed_size(90) == 30
    f = sample.folds(df, "label").groupBy("label", "fold").count().collect()
    assert max(r["count"] for r in f if r.label == "negative") - min(r["count"] for r in f if r.label == "negative") <= 1


def test_folds_and_undersampling_of_repeated_rows(spark):
    data = [(i, f"t{i}", "ab"[i % 3 == 0]) for i in range(90)] + [(5, "t5", "a"), (6, "t6", "b"), (200, "n", None)]
    df = spark.createDataFrame(data, REC).repartition(4)
    got = sample.folds(df, "label", 3).collect()
    assert len(got) == len(data) and len({(r._row_id, r.fold) for r in got}) == 91 and {r.fold for r in got if r.label is None} == {0}
    keys = {l: sorted((hashlib.md5(f"{i}:42".encode()).hexdigest(), i) for i, _, x in data if x == l) for l in "ab"}
    few = min(map(len, keys.values()))
    want = sorted(i for l in "ab" for k in keys[l] if k <= keys[l][few - 1] for i in [k[1]])
    assert sorted(r._row_id for r in clean.undersample(df, "label").collect()) == want
    assert clean.undersample(df.where("label is null"), "label").count() == 0


def test_weights_match_definition(spark):
    df = spark.createDataFrame([(0, "cat cat dog"), (1, "cat bird"), (2, None)], "_row_id bigint, text string")
    got = {(r._row_id, r.word): r.weight for r in features.weights(df, min_df=1).collect()}
    idf = lambda d: 1 + math.log(4 / (1 + d))
    a, b = (1 + math.log(2)) * idf(2), idf(1)
    assert math.isclose(got[0, "cat"], a / math.hypot(a, b)) and len(got) == 4


def learning_rows(spark):
    good, bad = "great lovely warm bright kind".split(), "awful cruel dark sad broken".split()
    data = [(i, " ".join((good if i % 2 else bad)[(i + k) % 5] for k in range(3)) + f" item {i % 7}", "positive" if i % 2 else "negative") for i in range(120)]
    return spark.createDataFrame(data, REC)


def test_active_learning(spark):
    df = learning_rows(spark)
    test, rest = sample.first_and_rest(df, 40, "t")
    seed, pool = sample.first_and_rest(rest, 20, "s")
    results = learn.compare_strategies(seed, pool, test, ("entropy", "margin", "random"), iterations=4, batch=20)
    for name, history in results.items():
        assert [h["n_labeled"] for h in history] == [20, 40, 60, 80] and [h["iteration"] for h in history] == [0, 1, 2, 3]  # the pool is empty then
        assert all(h["strategy"] == name and 0 <= h["accuracy"] <= 1 for h in history) and history[-1]["accuracy"] >= 0.9
    with pytest.raises(ValueError):
        learn.uncertainty(F.col("p"), "guess")


def test_out_of_fold_and_final(spark):
    df = learning_rows(spark)
    out = learn.label_out_of_fold(df, k=3)
    assert out.count() == 120 and out.where("predicted_label = label").count() >= 110 and out.where("confidence not between 0.5 and 1").count() == 0
    train, test = sample.train_test(df)
    assert evaluate.scores(learn.train_final(train, test)[1]).first().accuracy >= 0.9


def test_explore(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (2.0,), (5.0,), (None,)], "x double")
    assert {r.bin: r.n for r in explore.histogram(df, F.col("x"), 4).collect()} == {0: 2, 1: 1, 3: 1}
    assert explore.histogram(df.where("x = 1"), F.col("x"), 4).first().n == 2
    words = spark.createDataFrame([("the Cat cat",), ("dog",), (None,)], "text string")
    assert [(r.word, r.n) for r in explore.top_words(words, 2).collect()] == [("cat", 2), ("dog", 1)]


def test_exact_quantiles_and_modes(spark):
    import random

    from loomwright.operators import quantiles, ranges

    r = random.Random(0)
    data = [(r.lognormvariate(0, 3), float(r.randint(0, 3)), None if i % 3 else -r.random(), float("nan") if i % 2 else 7.0, "ab"[i % 2], i) for i in range(3001)]
    df = spark.createDataFrame(data, "a double, b double, c double, d double, s string, _row_id bigint").repartition(7)
    got = quantiles.quantiles(df, {c: F.col(c) for c in "abcd"}, (0.0, 0.25, 0.5, 0.9, 1.0))
    for k, c in enumerate("abcd"):
        own = np.array([x[k] for x in data if x[k] is not None and x[k] == x[k]])
        assert np.allclose(got[c], np.quantile(own, (0.0, 0.25, 0.5, 0.9, 1.0)), rtol=1e-12), c
    assert quantiles.quantiles(df.limit(0), {"a": F.col("a")}, (0.5,)) == {"a": [None]} and quantiles.quantiles(df, {}, (0.5,)) == {}
    assert ranges.mode(df, "s") == "a" and ranges.mode(df.limit(0), "s") is None
    keys = sorted((hashlib.md5(f"{i}:42".encode()).hexdigest(), i) for i in range(3001))
    for n in (0, 1, 17, 1500, 3000, 3001, 5000):
        assert {x._row_id for x in df.where(sample.chosen(df, n)).collect()} == {i for _, i in keys[:n]}


@pytest.mark.parametrize("error", [1e-4, 0.2, 0.0])
def test_quantiles_of_groups(spark, error, monkeypatch):
    """Infinities, ties, one value, a hot group, null as a group; with a coarse sketch, and with one whose brackets miss."""
    import random

    from loomwright.operators import quantiles

    r = random.Random(8)
    inf, shares = math.inf, (0.9, 0.0, 0.25, 0.5, 1.0)
    draw = {"hot": lambda: r.lognormvariate(0, 4), "tied": lambda: float(r.randint(0, 2)), "one": lambda: 7.5, "inf": lambda: r.choice([inf, -inf, 1.0, 2.0, math.nan]), "only": lambda: inf, "none": lambda: r.choice([None, math.nan]), None: lambda: -r.random()}
    data = [(k, draw[k]()) for k in r.choices([*draw], [20, 3, 1, 3, 1, 1, 3], k=4000)]
    df = spark.createDataFrame(data, "k string, x double").repartition(5)
    if not error:
        error = 1e-4
        real = quantiles._marks
        monkeypatch.setattr(quantiles, "_marks", lambda *a: real(*a).withColumns({"lo": F.transform("lo", lambda v: v + F.lit(0.3)), "hi": F.transform("hi", lambda v: v + F.lit(0.3))}))
    got = {x.k: (x.n, x.least, x.most, list(x.q)) for x in quantiles.settle(quantiles.measured(df, {"x": F.col("x")}, ("k",)), shares, ("k", "column"), error).collect()}
    assert set(got) == {*draw} - {"none"}
    for k in got:
        own = np.sort([x for q, x in data if q == k and x == x])
        want = []
        for p in shares:
            at = p * (len(own) - 1)
            a, b = own[math.floor(at)], own[math.ceil(at)]
            want.append(a if a == b else a + (at - math.floor(at)) * (b - a))
        assert got[k][0] == len(own) and got[k][1:3] == (own.min(), own.max())
        assert all(a == b or math.isclose(a, b, rel_tol=1e-12) or (a != a and b != b) for a, b in zip(got[k][3], want)), (k, got[k], want)


def test_infinities_bound_nothing(spark):
    inf = math.inf
    df = spark.createDataFrame([(i, x, 7.0, inf) for i, x in enumerate([1.0, 2.0, 3.0, 4.0, 100.0, inf, -inf, math.nan, None])], "_row_id bigint, a double, b double, c double")
    got = {x["column"]: x for x in profile.outliers(df).collect()}
    assert set(got) == {"a"} and (got["a"]["count"], got["a"].lower_bound, got["a"].upper_bound) == (2, -74.25, 127.75)
    odd = spark.createDataFrame([(inf,), (-inf,), (inf,), (1.0,)], "x double")
    assert profile.outliers(odd).count() == 0 and clean.fix(odd, {"outliers": "clip_iqr"}).collect() == odd.collect() and clean.fix(odd, {"missing": "median"}).count() == 4
    assert explore.describe(odd, ["x"]).first().q50 == inf


def test_boxes(spark):
    import random

    r = random.Random(3)
    data = [(k, r.choice([r.gauss(0, 1), r.gauss(0, 9), None])) for k in r.choices(["a", "b", None], [8, 2, 1], k=900)] + [("c", 5.0)]
    box, points = explore.boxes(spark.createDataFrame(data, "k string, x double"), F.col("x"), "k")
    far = sorted((p.k, p.x) for p in points.collect())
    for b in box.collect():
        own = np.array([x for k, x in data if k == b.k and x is not None])
        q1, q2, q3 = np.quantile(own, (0.25, 0.5, 0.75))
        out = (own < q1 - 1.5 * (q3 - q1)) | (own > q3 + 1.5 * (q3 - q1))
        assert np.allclose((b.n, b.q1, b.median, b.q3, b.lower, b.upper, b.n_outliers), (len(own), q1, q2, q3, min(own[~out].min(), q1), max(own[~out].max(), q3), out.sum()))
        assert np.allclose([x for k, x in far if k == b.k], np.sort(own[out]))
    assert box.count() == 3 and len(far) > 10


def test_fill_is_linear_and_labels_are_computed_once(spark):
    df = spark.range(100).select(F.col("id").alias("_row_id"), F.when(F.col("id") % 7 == 3, F.col("id")).alias("x"))
    text = clean.fill_neighbours(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in text.lower()
    queue = annotate.review_queue(annotate.label_by_keywords(rows(spark, 10)))
    assert queue.select("_row_id", "predicted_label", "confidence")._jdf.queryExecution().optimizedPlan().toString().lower().count("regexp_extract_all") <= 2


def test_minimum_of_the_loss():
    rng = np.random.default_rng(0)
    for k, ridge in ((2, 0.05), (3, 0.05), (2, 1e-5)):
        x, y = np.where(rng.random((80, 5)) < 0.6, rng.normal(size=(80, 5)), 0), rng.integers(0, k, 80)
        w = learn.minimum(x, y, k, ridge)
        z = np.hstack([x, np.ones((80, 1))])
        p = np.exp(z @ w.T)
        p /= p.sum(axis=1, keepdims=True)
        g = (p - np.eye(k)[y]).T @ z / 80 + np.append(np.full(5, ridge), 0) * w
        assert np.abs(g).max() < 1e-7
        rows = [np.flatnonzero(r) for r in x]
        own = features.Sparse(np.cumsum([0, *map(len, rows)]), np.concatenate(rows), x[x != 0], 5)
        assert np.allclose(learn.minimum(own, y, k, ridge), w, atol=1e-6)


def test_one_objective_at_any_number_of_rows(spark, monkeypatch):
    """On either side of the bound the model is the same: there in a task, here by Spark's solver; and so for several groups."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2001, 6)) * [1, 1, 0.5, 0.1, 2, 0]
    y = ["yes" if v else "no" for v in (x @ [1, -2, 1, 3, 0, 0] + rng.normal(size=2001) > 0.3)]
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(i, l, "ab"[i % 2], Vectors.dense(v)) for i, (l, v) in enumerate(zip(y, x.tolist()))], ["_row_id", "label", "g", "features"]).cache()
    monkeypatch.setattr(learn, "ROWS_PER_TASK", 2000)
    for c in (1.0, 1000.0):
        below, above = (learn.Classifier.fit(rows.where(f"_row_id < {n}"), c=c).model for n in (2000, 2001))
        monkeypatch.setattr(learn, "ROWS_PER_TASK", 1999)
        again = learn.Classifier.fit(rows.where("_row_id < 2000"), c=c).model
        monkeypatch.setattr(learn, "ROWS_PER_TASK", 2000)
        assert np.allclose(again.coefficientMatrix.toArray(), below.coefficientMatrix.toArray(), atol=2e-4)
        assert np.allclose(again.interceptVector.toArray(), below.interceptVector.toArray(), atol=2e-4)
        assert np.allclose(above.coefficientMatrix.toArray(), below.coefficientMatrix.toArray(), atol=0.02)
    one = learn.fit_groups(rows, "g", "label", 1.0)
    monkeypatch.setattr(learn, "ROWS_PER_TASK", 1000)  # group a has 1001 rows, group b 1000
    two = learn.fit_groups(rows, "g", "label", 1.0)
    assert set(one) == set(two) == {"a", "b"} and all(one[g][0] == two[g][0] == ["no", "yes"] and np.allclose(one[g][1], two[g][1], atol=2e-4) for g in one)
    rows.unpersist()


def test_rounds_take_the_most_uncertain(spark):
    """Against a history kept by hand, with the fit of the library and everything else in numpy."""
    df = learning_rows(spark)
    test, rest = sample.first_and_rest(df, 40, "t")
    seed, pool = sample.first_and_rest(rest, 20, "s")
    fitted = features.TfIdf(5000, 2, 2, 50).fit(df)
    frames = [[(r._row_id, r.label, r.features.toArray()) for r in fitted.transform(f).collect()] for f in (seed, pool, test)]
    learner = learn.ActiveLearner(features=fitted)
    for strategy in ("entropy", "margin"):
        got = learner.run_cycle(seed, pool, test, strategy, iterations=2, batch=7)
        known, left, check = list(frames[0]), list(frames[1]), frames[2]
        for h in got:
            w = learn.minimum(np.array([v for _, _, v in known]), np.array([int(l == "positive") for _, l, _ in known]), 2, 1 / (1000 * len(known)))
            probs = lambda rows: [np.exp(z - np.log(np.exp(z).sum())) for z in (w[:, :-1] @ v + w[:, -1] for _, _, v in rows)]
            hit = sum((p.argmax() == 1) == (l == "positive") for p, (_, l, _) in zip(probs(check), check))
            assert h["n_labeled"] == len(known) and abs(h["accuracy"] - hit / 40) < 1e-4
            value = {"entropy": lambda p: (p * np.log(p + 1e-12)).sum(), "margin": lambda p: abs(p[0] - p[1])}[strategy]
            order = sorted(zip((value(p) for p in probs(left)), (i for i, _, _ in left)))
            taken = {i for _, i in order[:7]}
            known, left = known + [r for r in left if r[0] in taken], [r for r in left if r[0] not in taken]


def test_saved_model_predicts_the_same(spark, tmp_path):
    df = learning_rows(spark)
    model, predicted = learn.train_final(*sample.train_test(df))
    model.save(f"{tmp_path}/m")
    again = learn.FinalModel.load(f"{tmp_path}/m").predict(df)
    assert {(r._row_id, r.prediction) for r in again.collect()} == {(r._row_id, r.prediction) for r in model.predict(df).collect()}


def test_random_forest(spark):
    df = learning_rows(spark)
    own = features.TfIdf(200, 1, 1, 10).fit(df).transform(df)
    model = learn.Classifier.fit(own, kind="rf")
    assert model.predict(own).where("prediction = label").count() >= 115


def test_side_by_side(spark):
    df = spark.createDataFrame([(0, "a", None), (1, "a", None), (2, "b", "x")], "_row_id bigint, text string, label string")
    got = {r.metric: r for r in profile.side_by_side(df, {"drop": {"missing": "drop"}, "fill": {"missing": "constant"}}, ("rows", "duplicates")).collect()}
    assert (got["rows"].before, got["rows"].after_drop, got["rows"].after_fill) == (3, 1, 3) and got["duplicates"].after_fill == 1 and len(got) == 2


def test_class_words_and_clock(spark):
    df = spark.createDataFrame([("the cat cat", "a"), ("dog", "b"), ("dog", None)], "text string, label string")
    assert {(r.label, r.word, r.n) for r in explore.class_words(df).collect()} == {("a", "cat", 2), ("b", "dog", 1)}
    assert spark.range(1).select(expr.iso_now().alias("t")).first().t.endswith("+00:00")


def sparse_frame(spark, x, parts):
    return spark.createDataFrame([(np.flatnonzero(r).tolist(), r[r != 0].tolist()) for r in x], "_i array<int>, _x array<double>").repartition(parts)


def test_right_vectors_are_those_of_the_matrix(spark):
    rng = np.random.default_rng(3)
    x = np.where(rng.random((60, 40)) < 0.2, rng.normal(size=(60, 40)), 0)
    x[7] = 0
    at = [np.flatnonzero(r) for r in x]
    own = features.Sparse(np.concatenate([[0], np.cumsum([len(a) for a in at])]), np.concatenate(at), x[x != 0], 40)
    assert np.allclose(own.dot(np.eye(40)), x) and np.allclose(own.T.dot(np.eye(60)), x.T)
    v, s = features.right_vectors(sparse_frame(spark, x, 4), 40, 5)
    assert np.allclose(np.abs((v * np.linalg.svd(x)[2][:5]).sum(axis=1)), 1, atol=1e-9) and np.allclose(s, np.linalg.svd(x)[1][:5], rtol=1e-9)
    v, s = features.right_vectors(sparse_frame(spark, x[:3], 2), 40, 5)  # of rank three
    assert np.allclose(s, [*np.linalg.svd(x[:3])[1], 0, 0], atol=1e-9) and not v[3:].any()
    assert not features.right_vectors(sparse_frame(spark, x, 2).limit(0), 40, 5)[0].any()


def test_right_vectors_of_many_rows(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = np.where(rng.random((50_000, 120)) < 0.08, rng.random((50_000, 120)) * np.geomspace(3, 0.2, 120), 0)
    monkeypatch.setattr(features, "BLOCK", 500)  # many blocks
    s = features.right_vectors(sparse_frame(spark, x, 6), 120, 10)[1]
    assert np.allclose(s, np.linalg.svd(x, compute_uv=False)[:10], rtol=1e-6)


def test_nearest_on_both_sides(spark):
    """Most rows have one key and spread over ranges; no row of either side is lost; ties, tolerance, null keys and times."""
    import random

    r = random.Random(2)
    key = lambda: None if r.random() < 0.03 else "hot" if r.random() < 0.8 else f"k{r.randint(0, 9)}"
    moment = lambda most: None if r.random() < 0.03 else r.randint(0, most)
    left, right = [(key(), moment(2000), i) for i in range(700)], [(key(), moment(2000), 1000 + i, r.random()) for i in range(250)]
    a, b = spark.createDataFrame(left, "k string, t bigint, i bigint").repartition(5), spark.createDataFrame(right, "k string, t bigint, j bigint, v double")
    for tolerance in (None, 4, 0):
        got = setops.align_nearest(a, b, "k", "t", "j", ["v"], tolerance).collect()
        want, taken = {}, set()
        for k, t, i in left:
            near = [(abs(s - t), s > t, j if s > t else -j, s - t, j, v) for q, s, j, v in right if k is not None and q == k and t is not None and s is not None and (tolerance is None or abs(s - t) <= tolerance)]
            want[i] = min(near)[3:] if near else (None, None, None)
            taken.add(want[i][1])
        assert {x.i: (x.gap, x.j, x.v) for x in got if x.i is not None} == want and sum(x.i is not None for x in got) == len(left)
        assert sorted((x.j, x.k, x.t) for x in got if x.i is None) == sorted((j, k, t) for k, t, j, _ in right if j not in taken)


def test_as_of_over_ranges(spark):
    """A key with most rows spreads over ranges; values come in from the ranges before."""
    import random

    r = random.Random(1)
    left = [(0 if r.random() < 0.8 else r.randint(1, 9), r.randint(0, 3000), i) for i in range(800)]
    right = [(0 if r.random() < 0.8 else r.randint(1, 9), r.randint(0, 3000), r.random() if r.random() < 0.7 else None) for _ in range(300)]
    a, b = spark.createDataFrame(left, "k bigint, t bigint, i bigint"), spark.createDataFrame(right, "k bigint, t bigint, v double").groupBy("k", "t").agg(F.max("v").alias("v"))
    got = {x.i: x.v for x in setops.align_as_of(a, b, "k", "t", ["v"]).collect()}
    known = {}
    for k, t, v in right:
        if v is not None:
            known[k, t] = max(v, known.get((k, t), v))
    for k, t, i in left:
        before = [(s, v) for (q, s), v in known.items() if q == k and s <= t]
        assert got[i] == (max(before)[1] if before else None)


@pytest.mark.parametrize("texts, many, ngrams", [("zipf", 20, 2), ("zipf", 20, 3), ("ties", 5, 2), ("few", 500, 2), ("none", 5, 2)])
def test_vocabularies_are_those_of_all_words_and_pairs(spark, monkeypatch, texts, many, ngrams):
    """Pairs are counted of words only that are frequent enough; where too many words are as frequent, of all."""
    draw, seen = random.Random(7), []
    words = ["the", "é", *(f"w{k}" for k in range(60))]
    made = {"zipf": [" ".join(draw.choices(words, [1 / (k + 1) for k in range(len(words))], k=draw.randrange(30))) for _ in range(80)], "ties": [" ".join(f"x{k:02}" for k in range(40))] * 3, "few": ["Big cat, big CAT. sat", "cat sat big cat", None, "²x ²x x_1 the cat"], "none": ["", None]}[texts]
    df = spark.createDataFrame(list(enumerate(made)), "_row_id bigint, text string").repartition(3)
    was = features._pair_counts
    monkeypatch.setattr(features, "_pair_counts", lambda n: (seen.append(n), was(n))[1])
    monkeypatch.setattr(features, "GATHERED", 8)
    found, rows = features.TfIdf(many, ngrams, 2, None, stop_words=("the",)).fit_counts(df, keep=("_row_id",))
    terms = []
    for t in made:
        own = [w for w in re.findall(r"[\w²]{2,}", (t or "").lower()) if w != "the"]
        terms.append(Counter(" ".join(own[i : i + k]) for k in range(1, ngrams + 1) for i in range(len(own) - k + 1)))
    n, d = sum(terms, Counter()), Counter(t for c in terms for t in c)
    want = sorted((t for t in n if d[t] >= 2), key=lambda t: (-n[t], t))[:many]
    assert found.vocabulary == want and (seen == [] or len(seen) == 1 and (seen[0] < 4 * many)) and bool(seen) == (ngrams == 2 and texts != "ties")
    counts = lambda frame: {r._row_id: {found.vocabulary[i]: c for i, c in zip(r._i, r._c)} for r in frame.collect()}
    assert counts(rows) == counts(found.counted(df)) == {i: {t: c for t, c in own.items() if t in want} for i, own in enumerate(terms)}
    top = {}
    for r in found.strongest(rows, 2).collect():
        top.setdefault(r._row_id, []).append((r.term, r.weight))
    every = {}
    for r in found.terms(df).collect():
        every.setdefault(r._row_id, []).append((r.term, round(r.weight, 6)))
    assert {i: sorted(v) for i, v in top.items()} == {i: sorted(sorted(v, key=lambda x: (-x[1], x[0]))[:2]) for i, v in every.items()}


@pytest.mark.parametrize("name", ["tfidf_pairs_topk", "tfidf_topk"])
def test_top_terms_are_found_where_the_row_is(spark, name):
    """Neither the terms of rows nor texts are dealt out for the best three."""
    from loomwright.plans import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_memory_of_features_is_bounded_by_pieces_not_by_rows(spark):
    """Products spread columns over some entries at a time; rows with texts go to Python in small batches."""
    import tracemalloc

    own = features.Sparse(np.arange(0, 2_000_001, 100), np.tile(np.arange(100, dtype=np.int32), 20_000), np.ones(2_000_000), 100)
    m = np.arange(800.0).reshape(100, 8)
    tracemalloc.start()
    z = own.dot(m)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.allclose(z, m.sum(axis=0)) and most < 40e6
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df = spark.range(5000, numPartitions=1).selectExpr("id AS _row_id", "concat('word', id % 7) AS text")
    features.TfIdf(5, 1, 1, None).fit(df)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    assert max(r.n for r in df.mapInArrow(sizes, "n bigint").collect()) <= 1024


@pytest.mark.parametrize("job", ["folds", "final"])
def test_learners_take_rows_in_small_batches(spark, job):
    """Tasks with many rows hand 1,024 of them at most to Python at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df = spark.range(3000, numPartitions=1).selectExpr("id AS _row_id", "concat('word', id % 7, ' thing', id % 2) AS text", "IF(id % 2 = 0, 'a', 'b') AS label")
    out = learn.label_out_of_fold(df) if job == "folds" else learn.train_final(df.where("_row_id < 2000"), df.where("_row_id >= 2000"))[1]

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    assert out.count() == (3000 if job == "folds" else 1000) and max(r.n for r in df.mapInArrow(sizes, "n bigint").collect()) <= 1024


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_folds_take_one_python_worker_a_task(spark, monkeypatch):
    """Features of the folds are written once and read by all models; words are counted, weighed and labelled in one step."""
    seen, was = [], learn.fit_groups
    monkeypatch.setattr(learn, "fit_groups", lambda rows, *a, **k: (seen.append(optimized(rows)), was(rows, *a, **k))[1])
    df = spark.range(300, numPartitions=2).selectExpr("id AS _row_id", "IF(id % 50 = 0, null, concat('word', id % 7, ' thing', id % 2)) AS text", "IF(id % 2 = 0, 'a', 'b') AS label")
    out = learn.label_out_of_fold(df)
    assert "MapInArrow" not in seen[0] and optimized(out).count("MapInArrow") == 1
    got = out.collect()
    assert len(got) == 300 and out.columns == ["_row_id", "text", "label", "predicted_label", "confidence", "needs_review"] and all(r.predicted_label == r.label for r in got if r.text)

@pytest.mark.parametrize("components, sublinear", [(None, True), (None, False), (3, True)])
def test_features_in_one_step_are_those_of_counts(spark, components, sublinear):
    df = spark.range(200, numPartitions=3).selectExpr("id AS _row_id", "IF(id % 9 = 0, null, concat(repeat(concat('word', id % 7, ' '), int(id % 3) + 1), 'thing', id % 2)) AS text")
    found = features.TfIdf(50, 2, 2, components, sublinear).fit(df)
    one, two = ({r._row_id: r.features.toArray() for r in f.collect()} for f in (found.transform(df), found.finished(found.counted(df))))
    assert optimized(found.transform(df)).count("MapInArrow") == 1
    assert len(one) == 200 and all(np.allclose(one[i], two[i], rtol=1e-12, atol=1e-12) for i in two) and not one[0].any() and one[1].any()


def test_partial_sums_go_to_python_in_small_pieces(spark, monkeypatch):
    """1,024 rows of partial sums, however many tasks made them, are 32 MB at most."""
    x = np.where(np.random.default_rng(5).random((300, 4000)) < 0.02, 1.0, 0.0)
    q, df, seen = np.random.default_rng(6).normal(size=(4000, 110)), sparse_frame(spark, x, 4), []
    was = type(df).toArrow
    monkeypatch.setattr(type(df), "toArrow", lambda f: (seen.append(was(f)), seen[-1])[1])
    assert np.allclose(features.gram_product(df, q), x.T @ (x @ q))
    assert max(len(z.values) for z in seen[0].column("z")) * 8 * 1024 <= 32 << 20
