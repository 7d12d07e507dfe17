"""What grows batch by batch: profiles, a stored corpus, corrections, drift; and the scorer by prototypes."""

import math
import random
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomwright.operators import corpus, explore, features, learn, profile, prototypes, quantiles, setops
from loomwright.operators.increment import Store
from loomwright.streaming import corrections, drift

ROWS = "_row_id bigint, text string, label string, v double, w int"


def same(a, b):
    key = lambda rows: sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows)
    return key(a.select(sorted(a.columns)).collect()) == key(b.select(sorted(b.columns)).collect())


def data(n, seed):
    r = random.Random(seed)
    out = [(i, r.choice([None, "", " ", "some words that are long " * r.randint(1, 9)]), r.choice(["a", "a", "a", "b", None]), r.choice([None, math.nan, r.gauss(0, 1), r.lognormvariate(2, 2), 5.0]), r.randint(0, 9)) for i in range(n)]
    return out + [(n + i, *x[1:]) for i, x in enumerate(out[:20])]


def test_profile_of_batches_is_that_of_the_whole(spark, tmp_path):
    parts = [spark.createDataFrame(data(n, s), ROWS) for s, n in enumerate((300, 1, 500, 40))]
    whole = setops.union_all(parts)
    store = Store(spark, str(tmp_path))
    for k, p in enumerate(parts):
        store.add(p, k, "label")
        if k == 2:
            store.add(p, k, "label")  # tried again
    assert same(store.missing(), profile.missing(whole))
    assert same(store.duplicates(), profile.duplicates(whole)) and store.duplicates().first()["count"] > 60
    for how in (profile.Detector(), profile.Detector(method="zscore", zscore=1.5)):
        assert same(store.outliers(how), profile.outliers(whole, how)) and store.outliers(how).count() > 0
    assert same(store.imbalance(), profile.imbalance(whole, column="label"))
    assert same(store.describe(), explore.describe(whole, ["v", "w"]))


def test_sketches_that_miss_are_made_good(spark, tmp_path, monkeypatch):
    from loomwright.operators import increment

    monkeypatch.setattr(increment, "SKETCH", 8)  # ranks are far off
    store, r = Store(spark, str(tmp_path)), random.Random(1)
    frames = [spark.createDataFrame([(r.lognormvariate(0, 3),) for _ in range(2000)], "x double") for _ in range(2)]
    for k, f in enumerate(frames):
        store.add(f, k)
    got = {x["column"]: list(x.q) for x in store.quantiles((0.5, 0.1, 0.99)).collect()}
    want = quantiles.quantiles(setops.union_all(frames), {"x": F.col("x")}, (0.5, 0.1, 0.99))
    assert np.allclose(got["x"], want["x"], rtol=1e-12)


def test_a_batch_without_rows_or_numbers(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.add(spark.createDataFrame([], "a string"), 0)
    store.add(spark.createDataFrame([("x",), (None,), ("x",)], "a string"), 1)
    assert store.missing().first().asDict() == {"column": "a", "count": 1, "percent": 33.33} and store.duplicates().first()["count"] == 1
    assert store.outliers().count() == 0


def corpus_rows(seed, n=200):
    r = random.Random(seed)
    return [(i, r.choice([None, "", " \t", f"text {r.randint(0, 150)}", f"Text {r.randint(0, 9)} é"]), f"s{seed}") for i in range(n)]


@pytest.mark.parametrize("buckets", [1, 16])
def test_merging_in_batches_is_merging_at_once(spark, tmp_path, buckets):
    frames = [spark.createDataFrame(corpus_rows(s), "_row_id bigint, text string, source string") for s in range(3)]
    own = corpus.Corpus(spark, str(tmp_path), buckets)
    new = [own.add(f, k) for k, f in enumerate(frames)]
    assert same(own.rows(), setops.merge(frames)) and sum(x.count() for x in new) == own.rows().count()
    before = sorted(new[2].collect())
    assert sorted(own.add(frames[2], 2).collect()) == before and same(own.rows(), setops.merge(frames))
    assert own.add(frames[0], 3).count() == 0 and own.add(frames[0].limit(0), 4).count() == 0
    plan = own.known(frames[1].select(corpus.text_key(F.col("text")).alias("key")).where("key is not null"), 9)._jdf.queryExecution().toString()
    assert "/keys" in plan and "/texts" not in plan


def test_filters_only_ever_say_maybe(spark, tmp_path, monkeypatch):
    """With filters that say yes to nearly every key, the keys themselves decide."""
    monkeypatch.setattr(corpus, "BITS", 1)
    frames = [spark.createDataFrame(corpus_rows(s), "_row_id bigint, text string, source string") for s in range(3)]
    own = corpus.Corpus(spark, str(tmp_path), 4)
    for k, f in enumerate(frames):
        own.add(f, k)
    assert same(own.rows(), setops.merge(frames))


def csv(path, rows):
    Path(path).write_text("_row_id,text,label,source,collected_at,predicted_label,confidence,needs_review,corrected_label\n" + "".join(f"{i},t{i},,,,p,0.5,true,{c}\n" for i, c in rows))


def test_last_correction_of_each_row_counts(spark, tmp_path):
    folder, target, kept = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/cp"
    folder.mkdir()
    run = lambda: corrections.follow(corrections.read(spark, str(folder), corrections.NUMBERED), target, kept).awaitTermination(120)
    batch = lambda: [sorted((r._row_id, r.corrected_label) for r in spark.read.parquet(str(p)).collect()) for p in sorted(Path(target).glob("batch=*"), key=lambda p: int(p.name[6:]))]
    csv(folder / "a.csv", [(0, "x"), (1, "y"), (0, "z")])
    run()
    csv(folder / "b.csv", [(1, "y"), (2, "w")])
    run()
    csv(folder / "c.csv", [(0, ""), (3, " ")])
    run()
    got = [b for b in batch() if b]
    assert got == [[(0, "z"), (1, "y")], [(2, "w")], [(0, ""), (3, " ")]]  # the repeated y of row 1 changes nothing
    labelled = spark.createDataFrame([(i, f"t{i}", "p", 0.5, i < 5) for i in range(6)], "_row_id bigint, text string, predicted_label string, confidence double, needs_review boolean")
    final = {r._row_id: r.final_label for r in corrections.corrected(labelled, target).collect()}
    assert final == {0: "p", 1: "y", 2: "w", 3: "p", 4: "p", 5: "p"}
    run()
    assert [b for b in batch() if b] == got  # nothing new


def drifting(seed=4):
    r, begin = random.Random(seed), datetime(2024, 3, 1)
    classes = lambda day: r.choices(["a", "b", "c", None, "new"], [5, 3, 2 if day < 5 else 0, 1, day])[0]
    return [(begin + timedelta(days=d, seconds=r.randint(0, 86399)), classes(d)) for d in range(9) for _ in range(60)] + [(None, "a")]


@pytest.mark.parametrize("slide", [None, "6 hours"])
def test_drift_of_a_stream_is_that_of_the_batch(spark, tmp_path, slide):
    rows = sorted(drifting(), key=lambda x: x[0] or datetime.min)
    base = spark.createDataFrame([x for x in rows if x[0] and x[0] < datetime(2024, 3, 4)], "t timestamp, c string")
    batch = drift.monitor(spark.createDataFrame(rows, "t timestamp, c string"), base, "t", "c", "1 day", slide)
    for k in range(3):
        part = spark.createDataFrame(rows[k * 200 : (k + 1) * 200], "t timestamp, c string")
        part.coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    (Path(tmp_path) / "flat").mkdir()
    for k in range(3):
        for p in Path(tmp_path, "in", str(k)).glob("*.parquet"):
            p.rename(Path(tmp_path, "flat", f"{k}.parquet"))
    stream = spark.readStream.schema("t timestamp, c string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/flat")
    query = drift.monitor(stream, base, "t", "c", "1 day", slide, delay="2 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {tuple(r) for r in batch.where(F.col("start").isNotNull()).collect()}
    got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got <= want and len(got) >= len(want) - (2 if slide is None else 5)  # the last windows are open still
    first = batch.orderBy("start").first()
    assert max(r.psi for r in batch.collect()) > 2 * first.psi


def test_stability_by_hand(spark):
    df = spark.createDataFrame([(datetime(2024, 1, 1, 3), "a")] * 3 + [(datetime(2024, 1, 1, 4), "b")], "t timestamp, c string")
    base = spark.createDataFrame([("a",), ("b",), ("b",), (None,)], "c string")
    (got,) = drift.monitor(df, base, "t", "c", "1 day").collect()
    p, q = (3.5 / 5, 1.5 / 5), (1.5 / 4, 2.5 / 4)
    assert got.n == 4 and math.isclose(got.psi, sum((a - b) * math.log(a / b) for a, b in zip(p, q)), abs_tol=1e-8) and got.drifted
    with pytest.raises(ValueError):
        drift.monitor(df, base.limit(0), "t", "c", "1 day")


def test_prototypes(spark):
    rows = [(1, [1.0, 0.0], "x"), (2, [0.9, 0.1], "x"), (3, [0.0, 2.0], "y"), (4, None, "y"), (5, [0.0, 0.0], "y"), (6, [1.0], "y"), (7, [math.nan, 1.0], "y"), (8, [1.0, 0.2], None), (9, [], "x")]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>, label string").repartition(3)
    found = prototypes.prototypes(df)
    u = np.array([1.0, 0.0]) + np.array([0.9, 0.1]) / math.hypot(0.9, 0.1)
    assert list(found) == ["x", "y"] and np.allclose(found["x"], u / np.linalg.norm(u)) and np.allclose(found["y"], [0, 1])
    got = {r.id: r for r in prototypes.label_by_prototype(df, found).collect()}
    assert {i: r.predicted_label for i, r in got.items()} == {1: "x", 2: "x", 3: "y", 4: None, 5: None, 6: None, 7: None, 8: "x", 9: None}
    assert got[3].similarity == 1.0 and not got[3].needs_review and got[4].confidence == 0.0 and got[4].needs_review
    assert prototypes.prototypes(df.limit(0)) == {} and prototypes.label_by_prototype(df, {}).where("predicted_label is not null").count() == 0


def test_texts_by_prototypes(spark):
    good, bad = "great lovely warm bright kind".split(), "awful cruel dark sad broken".split()
    rows = [(i, " ".join((good if i % 2 else bad)[(i + k) % 5] for k in range(3)), "positive" if i % 2 else "negative") for i in range(60)]
    df = spark.createDataFrame([*rows, (100, None, None), (101, "unknown", None)], "_row_id bigint, text string, label string")
    label = prototypes.text_scorer(features.TfIdf(100, 1, 1, None).fit(df), df.where("_row_id < 30"))
    got = {r._row_id: r for r in label(df).collect()}
    assert all(got[i].predicted_label == l for i, _, l in rows) and got[100].predicted_label is None and len(got) == 62


def test_learning_needs_labels(spark):
    df = spark.createDataFrame([(1, "a", None)], "_row_id bigint, text string, label string")
    with pytest.raises(ValueError, match="no labelled row"):
        learn.compare_strategies(df, df, df)
