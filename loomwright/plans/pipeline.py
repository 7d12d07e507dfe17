"""The whole way from sources to a trained classifier and its reports."""

from __future__ import annotations

import logging
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import annotate, clean, evaluate, learn, profile, sample
from loomwright.operators.ranges import ranked
from loomwright.plans import reports
from loomwright.schema import ROW_ID
from loomwright.sources.collect import PLACE, Collector, read_corrections, write_file

log = logging.getLogger(__name__)


@dataclass
class Settings:
    task: str = "sentiment_analysis"
    threshold: float = annotate.THRESHOLD
    max_samples: int = 1000
    auto: bool = True
    out: str = "."
    iterations: int = 5
    batch: int = 20
    #: The review queue and the annotation tasks as one file each, for a person's tool; else every task writes its own.
    one_file: bool = False

    def path(self, name: str) -> str:
        return f"{self.out}/{name}"


def numbered(df: DataFrame) -> DataFrame:
    """With a row number of its own for every row: rows of files have one in source order (read_numbered); others are
    numbered in the order of a hash of the row, which doesn't depend on where rows lie, and equal rows one after another."""
    if ROW_ID in df.columns:
        return df
    keyed = df.withColumns({"_hash": F.xxhash64(*df.columns), "_place": F.monotonically_increasing_id()})
    return ranked(keyed, ROW_ID, ["_hash", "_place"]).drop("_hash", "_place")


def label(df: DataFrame, classes: list[str], threshold: float, scorer=None) -> tuple[DataFrame, str]:
    """By the scorer if there is one and it works on the first row; else out of fold from the labels there are; else by keywords."""
    if scorer is not None:
        try:
            out = annotate.label_by_scorer(df, scorer, classes, threshold=threshold)
            out.limit(1).collect()
            return out, "zero-shot"
        except Exception as problem:  # noqa: BLE001  whatever a model does, labels are still wanted
            log.warning("the scorer is left out: %s", problem)
    if "label" in df.columns and df.where(F.col("label").isNotNull()).select("label").distinct().count() > 1:
        return learn.label_out_of_fold(df, threshold=threshold), "TF-IDF out of fold"
    return annotate.label_by_keywords(df, threshold=threshold), "keywords"


def review(df: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame]:
    """All rows with final_label, and the reviewed ones. Without a corrected file, or if asked for, review is simulated."""
    queue = annotate.review_queue(df, s.threshold)
    write_file(queue, s.path("review_queue.csv"), "csv", single=s.one_file)
    given = None if s.auto else read_corrections(df.sparkSession, s.path("review_queue_corrected.csv"))
    if given is None:
        corrected = annotate.auto_correct(queue)
    else:
        # By row number where the person's file kept it, else by text; of several corrections the last in the file counts.
        key = ROW_ID if ROW_ID in given.columns and ROW_ID in queue.columns else "text"
        last = given.groupBy(key).agg(F.max_by("corrected_label", PLACE).alias("corrected_label"))
        corrected = queue.drop("corrected_label").join(last, key, "left")
    return annotate.merge_review(df, corrected), corrected


def run(spark: SparkSession, settings: Settings = Settings(), df: DataFrame | None = None, collector: Collector | None = None, scorer=None) -> dict[str, Any]:
    """Collect (or take df), clean, label, review, active learning, training, reports; gives the figures of each stage."""
    s, m = settings, {}
    raw = numbered(df if df is not None else (collector or Collector(spark)).with_max_samples(s.max_samples).run(s.task)).cache()
    m["raw_size"] = raw.count()
    cleaned = clean.fix(raw, clean.DEFAULT).cache()
    m["clean_size"] = cleaned.count()
    comparison = [r.asDict() for r in profile.compare(profile.metrics(raw), profile.metrics(cleaned)).orderBy("metric").collect()]
    reports.quality_report(profile.detect(raw), comparison, clean.DEFAULT, s.path("reports/quality_report.md"))
    labelled, m["annotation_method"] = label(cleaned, annotate.default_classes(cleaned), s.threshold, scorer)
    labelled = labelled.cache()
    quality = annotate.check_quality(labelled, s.threshold)
    m |= {k: quality.get(k) for k in ("kappa", "agreement", "confidence_mean")} | {"labeled_size": labelled.count(), "flagged_count": quality.get("low_confidence_count")}
    reports.annotation_spec(labelled, s.path("annotation_spec.md"), s.task)
    reports.annotation_report(quality, m["labeled_size"], s.threshold, s.path("reports/annotation_report.md"), m["annotation_method"])
    reports.export_tasks(labelled, s.path("labelstudio_import.json"), array=s.one_file)
    final, corrected = review(labelled, s)
    final = final.cache()
    changed = corrected.where(F.coalesce(F.col("corrected_label") != F.col("predicted_label"), F.lit(True)))
    m |= {"hitl_total": corrected.count(), "hitl_corrections": changed.count(), "hitl_examples": [r.asDict() for r in annotate.corrections(corrected).collect()]}
    reports.data_card(final, s.path("data/labeled/DATA_CARD.md"))
    write_file(final, s.path("data/labeled/final_dataset.csv"), "csv")
    known = final.withColumn("label", F.col("final_label")).select(ROW_ID, "text", "label").where("label is not null")
    train, test = sample.train_test(known)
    seed, pool = sample.first_and_rest(train, sample.seed_size(train.count()))
    m["al_results"] = learn.compare_strategies(seed, pool, test, iterations=s.iterations, batch=s.batch)
    reports.learning_report(m["al_results"], s.path("reports/al_report.md"))
    reports.learning_curve(m["al_results"], s.path("reports/learning_curve.svg"))
    model, predicted = learn.train_final(train, test)
    model.save(s.path("models/final"))
    m |= evaluate.scores(predicted).first().asDict() | {"train_size": train.count(), "test_size": test.count()}
    m["classification_report"] = reports.markdown([r.asDict() for r in evaluate.report(predicted).collect()])
    reports.final_report(m, s.path("reports/final_report.md"))
    for f in (raw, cleaned, labelled, final):
        f.unpersist()
    return m
