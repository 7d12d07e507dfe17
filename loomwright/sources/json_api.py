"""JSON endpoints: a data source for a GET, and the same unwrapping over documents that are a column."""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from loomwright.functions import expr
from loomwright.schema import RECORD
from loomwright.sources import web


def items(document, results_key: str | None) -> list:
    """The records of an answer: under its key if that is given, else the answer; what is no list is one record."""
    if results_key and isinstance(document, dict):
        document = document.get(results_key, document)
    return document if isinstance(document, list) else [document]


def plain(value) -> str | None:
    """JSON values as text: strings as they are, null as null, others as JSON."""
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _asked(o, more: dict | None = None):
    """The JSON of the endpoint; None where there is no answer, or no JSON."""
    url, query = o["endpoint"], json.loads(o.get("params", "{}")) | (more or {})
    if query:
        url += ("&" if "?" in url else "?") + urllib.parse.urlencode(query)
    got = web.get(url, o)
    try:
        return json.loads(got[0]) if got else None
    except ValueError:
        return None


def _rows(document, o) -> Iterator[tuple]:
    for item in items(document, o.get("results_key")) if document is not None else ():
        if isinstance(item, dict):
            yield (plain(item.get(o.get("text_field", "text"))) or "", plain(item.get(o.get("label_field", "label"))))


class _ApiReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def read(self, partition) -> Iterator[tuple]:
        return _rows(_asked(self.options), self.options)


class _Range(InputPartition):
    def __init__(self, begin: int, n: int):
        super().__init__((begin, n))


class _ApiStream(DataSourceStreamReader):
    """Offsets are numbers of records: the answer says how many there are, and is asked for the new ones, page_size a task."""

    def __init__(self, options):
        self.options = options

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        o = self.options
        document = _asked(o, {o.get("offset_param", "offset"): 0, o.get("limit_param", "limit"): 1})
        total = document.get(o.get("total_key", "total")) if isinstance(document, dict) else None
        self.last = max(getattr(self, "last", 0), int(total or 0))
        return {"at": self.last}

    def partitions(self, start: dict, end: dict):
        n = int(self.options.get("page_size", "100"))
        return [_Range(k, min(n, end["at"] - k)) for k in range(start["at"], end["at"], n)]

    def read(self, partition) -> Iterator[tuple]:
        o, (begin, n) = self.options, partition.value
        document = _asked(o, {o.get("offset_param", "offset"): begin, o.get("limit_param", "limit"): n})
        if document is None:
            raise RuntimeError(f"no answer for records {begin} to {begin + n}: the batch is tried again")
        return _rows(document, o)


class ApiSource(DataSource):
    """spark.read.format("json_api").options(endpoint=, params= as JSON, text_field=, label_field=, results_key=). As a stream
    (total_key=, offset_param=, limit_param=, page_size=): the records that are new."""

    @classmethod
    def name(cls) -> str:
        return "json_api"

    def schema(self) -> str:
        return "text string, label string"

    def reader(self, schema) -> DataSourceReader:
        return _ApiReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ApiStream(self.options)


def _records(rows: DataFrame, endpoint: str, auto_label: bool, collected_at: str | None = None) -> DataFrame:
    label = F.coalesce("label", expr.sentiment(F.col("text"))) if auto_label else F.col("label")
    now = F.lit(collected_at) if collected_at else expr.iso_now()
    return rows.select("text", label.alias("label"), F.lit(f"api_{endpoint}").alias("source"), now.alias("collected_at")).select(*RECORD.names)


def fetch(spark, endpoint: str, params: dict | None = None, text_field: str = "text", label_field: str = "label", results_key: str | None = None, auto_label: bool = False, collected_at: str | None = None) -> DataFrame:
    spark.dataSource.register(ApiSource)
    options = {"endpoint": endpoint, "params": json.dumps(params or {}), "text_field": text_field, "label_field": label_field, **({"results_key": results_key} if results_key else {})}
    return _records(spark.read.format("json_api").options(**options).load(), endpoint, auto_label, collected_at)


def fetch_new(spark, endpoint: str, target: str, checkpoint: str, auto_label: bool = False, **options):
    """Adds the records that have come since the last run to target; what was read stands in the checkpoint."""
    spark.dataSource.register(ApiSource)
    rows = spark.readStream.format("json_api").options(endpoint=endpoint, **{k: str(v) for k, v in options.items()}).load()
    return _records(rows, endpoint, auto_label).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fields(df: DataFrame, column: str, names: dict[str, str], results_key: str | None = None) -> DataFrame:
    """Fields of JSON documents in a column, by path; with results_key a row for each element under it. Stays in generated code."""
    if results_key:
        df = df.withColumn(column, F.explode(F.from_json(F.get_json_object(column, f"$.{results_key}"), "array<string>")))
    return df.withColumns({c: expr.json_field(F.col(column), path) for c, path in names.items()})
