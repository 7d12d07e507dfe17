"""Collection: data sets from files, the catalogue of tasks, search for data sets by topic, and the run over all sources."""

from __future__ import annotations

import logging
import os
import re
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import expr
from loomwright.operators import sample, setops
from loomwright.operators.ranges import held, ranked
from loomwright.schema import RECORD, REVIEW, ROW_ID, match_schema
from loomwright.sources import html, json_api

log = logging.getLogger(__name__)

# The tasks that come with the library.
QUOTES = {"type": "scrape", "url": "https://quotes.toscrape.com", "selector": "div.quote span.text"}
CATALOG = {
    "schema": {"columns": RECORD.names},
    "tasks": {
        "sentiment_analysis": {
            "description": "Binary sentiment of texts (positive / negative)", "modality": "text", "output": {"path": "data/raw/sentiment_dataset.csv", "format": "csv"},
            "sources": [{"type": "hf_dataset", "name": "rotten_tomatoes", "split": "train", "text_field": "text", "label_field": "label", "label_map": {0: "negative", 1: "positive"}, "max_samples": 3000}, QUOTES | {"max_pages": 10, "auto_label": True}],
        },
        "topic_classification": {
            "description": "News by topic (World / Sports / Business / Sci-Tech)", "modality": "text", "output": {"path": "data/raw/topic_dataset.csv", "format": "csv"},
            "sources": [{"type": "hf_dataset", "name": "fancyzhx/ag_news", "split": "train", "text_field": "text", "label_field": "label", "label_map": {0: "World", 1: "Sports", 2: "Business", 3: "Sci-Tech"}, "max_samples": 4000}, QUOTES | {"max_pages": 5, "auto_label": False}],
        },
        "emotion_detection": {
            "description": "Emotion of texts (sadness / joy / love / anger / fear / surprise)", "modality": "text", "output": {"path": "data/raw/emotion_dataset.csv", "format": "csv"},
            "sources": [{"type": "hf_dataset", "name": "dair-ai/emotion", "split": "train", "text_field": "text", "label_field": "label", "label_map": {0: "sadness", 1: "joy", 2: "love", 3: "anger", 4: "fear", 5: "surprise"}, "max_samples": 3000}, QUOTES | {"max_pages": 5, "auto_label": False}],
        },
    },
}


def read_file(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """By the ending: csv (quoted fields may hold line breaks), json (lines), parquet; other paths are Parquet."""
    if path.endswith(".csv"):
        reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
        return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    if path.endswith((".json", ".jsonl")):
        return (spark.read.schema(schema) if schema else spark.read).json(path)
    return spark.read.parquet(path)


#: The place of a row in its files.
PLACE = "_place"


def placed(df: DataFrame) -> DataFrame:
    """df, just read from files, with the place of each row: file, begin of the part of the file, row in that part."""
    return df.select("*", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row")).alias(PLACE))


def read_numbered(spark: SparkSession, path: str) -> DataFrame:
    """read_file with row numbers from 0 in source order, for fills and for "first"; those that the file has stay."""
    df = read_file(spark, path)
    return df if ROW_ID in df.columns else ranked(placed(df), ROW_ID, [PLACE]).drop(PLACE)


def write_file(df: DataFrame, path: str, kind: str, single: bool = False) -> bool:
    """csv or parquet; any other format writes nothing."""
    if kind not in ("csv", "parquet"):
        return False
    df = df.drop(ROW_ID).coalesce(1) if single else df.drop(ROW_ID)
    writer = df.write.mode("overwrite")
    writer.option("header", True).option("escape", '"').csv(path) if kind == "csv" else writer.parquet(path)
    return True


def load_dataset(spark: SparkSession, name: str, source: str = "hf", split: str = "train", text_field: str = "text", label_field: str = "label", label_map: dict | None = None, max_samples: int | None = None, root: str | None = None, seed: int = 42, collected_at: str | None = None) -> DataFrame:
    """A data set below root (by default the folder HF_HOME names): files name/split.*, or a table of that name.

    With max_samples, the rows with the smallest sampling keys. Labels become text: by label_map, else as they are.
    """
    if source != "hf":
        raise ValueError(f"source {source!r} is not supported; there is hf")
    df = open_dataset(spark, name, split, root)
    df = df.select(F.col(text_field).cast("string").alias("text"), F.col(label_field).alias("label")) if label_field in df.columns else df.select(F.col(text_field).cast("string").alias("text"), F.lit(None).cast("string").alias("label"))
    if max_samples is not None:
        df = df.withColumn(ROW_ID, F.xxhash64("text", F.col("label").cast("string")))
        df = sample.take(df, max_samples, seed).drop(ROW_ID)
    return df.select("text", expr.lookup(F.col("label"), label_map or {}).alias("label"), F.lit(f"hf_{name}").alias("source"), F.lit(collected_at or datetime.now(timezone.utc).isoformat()).alias("collected_at")).select(*RECORD.names)


def open_dataset(spark: SparkSession, name: str, split: str, root: str | None = None) -> DataFrame:
    root = root or os.environ.get("HF_HOME")
    table = re.sub(r"[^A-Za-z0-9]+", "_", name)
    if spark.catalog.tableExists(table):
        return spark.table(table)
    if root is None:
        raise FileNotFoundError(f"no table {table}, and no folder of data sets is named")
    for ending in (".parquet", ".csv", ".json", ".jsonl"):
        try:
            return read_file(spark, f"{root}/{name}/{split}{ending}")
        except Exception as problem:  # noqa: BLE001  Spark has no narrower class for a path that isn't there
            if "PATH_NOT_FOUND" not in str(problem):
                raise
    raise FileNotFoundError(f"no file {root}/{name}/{split}.*")


def topic_queries(topic: str) -> list[str]:
    """The whole topic, its first three and two words if it has more than two, its first if it has more than one."""
    words = topic.split()
    out = [topic]
    if len(words) > 2:
        out += [" ".join(words[:3]), " ".join(words[:2])]
    return out + ([words[0]] if len(words) > 1 else [])


def discover(spark: SparkSession, topic: str, max_samples: int = 3000, max_candidates: int = 15) -> tuple[list[dict], dict]:
    """Source descriptors and output for a topic, from the tables of the catalogue whose names hold all words of a query."""
    tables = sorted(t.name for t in spark.catalog.listTables())
    found: list[str] = []
    for query in topic_queries(topic):
        words = [w for w in re.split(r"[^a-z0-9]+", query.lower()) if w]
        found = [t for t in tables if all(w in t.lower() for w in words)][:max_candidates]
        if found:
            break
    if not found:
        raise RuntimeError(f"no data set for {topic!r}")
    for name in found:
        if match := match_schema(spark.table(name).schema):
            slug = re.sub(r"[^a-z0-9]+", "_", topic.lower()).strip("_")
            return [{"type": "hf_dataset", "name": name, "split": "train", "text_field": match.text, "label_field": match.label, "label_map": None, "max_samples": max_samples}, QUOTES | {"max_pages": 5, "auto_label": True}], {"path": f"data/raw/{slug}_dataset.csv", "format": "csv"}
    raise RuntimeError(f"none of {', '.join(found[:5])} has a text and a label column")


@dataclass
class Collector:
    """config: a dictionary, or the path of a YAML file. root: where data sets lie."""

    spark: SparkSession
    config: dict | str = field(default_factory=lambda: CATALOG)
    root: str | None = None

    def __post_init__(self) -> None:
        if isinstance(self.config, str):
            import yaml

            with open(self.config, encoding="utf-8") as f:
                self.config = yaml.safe_load(f) or {}
        self.columns = self.config.get("schema", {}).get("columns", RECORD.names)

    def available_tasks(self) -> dict[str, str]:
        return {name: t.get("description", "") for name, t in self.config.get("tasks", {}).items()}

    def resolve(self, task: str) -> dict:
        tasks = self.config.get("tasks", {})
        if task not in tasks:
            raise KeyError(f"no task {task!r}; there are {', '.join(tasks) or 'none'}")
        return tasks[task]

    def with_max_samples(self, n: int) -> Collector:
        """The same, with n rows at most of each source that has a limit."""
        limit = lambda ss: [s | {"max_samples": n} if "max_samples" in s else s for s in ss]
        config = dict(self.config)
        if "sources" in config:
            config["sources"] = limit(config["sources"])
        config["tasks"] = {k: t | {"sources": limit(t.get("sources", []))} for k, t in config.get("tasks", {}).items()}
        return Collector(self.spark, config, self.root)

    def build(self, source: dict) -> DataFrame | None:
        """The frame of a source; None for a type that isn't known."""
        own = {k: v for k, v in source.items() if k != "type"}
        kind = source.get("type")
        if kind == "hf_dataset":
            return load_dataset(self.spark, root=self.root, **own)
        if kind == "scrape":
            return html.scrape(self.spark, **own)
        if kind == "api":
            return json_api.fetch(self.spark, **own)
        if kind == "file":
            return read_file(self.spark, own["path"])
        return None

    def run(self, task: str | None = None, topic: str | None = None, sources: list[dict] | None = None) -> DataFrame:
        """Records of all sources that can be read, merged. Sources given win over those of a task or topic.

        A source that fails is left out. Each is asked once: its records are staged, and what joins the others is the
        staged ones, in the order of sources.
        """
        output = self.config.get("output")
        if topic is not None and sources is None:
            sources, output = discover(self.spark, topic)
        elif task is not None:
            own = self.resolve(task)
            sources, output = sources if sources is not None else own.get("sources", []), own.get("output", output)
        sources = sources if sources is not None else self.config.get("sources", [])
        frames = []
        for i, source in enumerate(sources):
            try:
                frame = self.build(source)
                if frame is None:
                    log.warning("source %d has the unknown type %s", i, source.get("type"))
                    continue
                # Numbered as they came; the checkpoint is the one time that the source is read.
                frames.append(held(project(frame, self.columns).withColumn(ROW_ID, F.monotonically_increasing_id())))
            except Exception as problem:  # noqa: BLE001  whatever it is, the other sources go on
                log.warning("source %d (%s) is left out: %s", i, source.get("type"), problem)
        df = setops.merge(frames, self.spark).drop(ROW_ID)
        if output and output.get("path"):
            write_file(df, output["path"], output.get("format", "csv"))
        return df


def project(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns; those that aren't there are null."""
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def read_corrections(spark: SparkSession, path: str) -> DataFrame | None:
    """The review queue as a person left it; None if there is no such file."""
    try:
        return placed(read_file(spark, path, REVIEW))
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise
