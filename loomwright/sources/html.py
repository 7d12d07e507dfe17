"""Scraping: a small CSS selector over the standard library's HTML parser, and a data source with a partition a page."""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.functions import udtf

from loomwright.functions import expr
from loomwright.schema import RECORD
from loomwright.sources import web

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Step:
    """One compound of a selector: tag, #id, .classes, [attr] or [attr=value]; child: right below the one before."""

    tag: str | None
    ident: str | None
    classes: frozenset[str]
    attrs: tuple[tuple[str, str | None], ...]
    child: bool

    def fits(self, tag: str, attrs: dict[str, str]) -> bool:
        return (self.tag in (None, tag)) and (self.ident is None or attrs.get("id") == self.ident) and self.classes <= set(attrs.get("class", "").split()) and all(k in attrs and v in (None, attrs[k]) for k, v in self.attrs)


def parse_selector(selector: str) -> list[list[Step]]:
    """Alternatives apart by commas, each a path of compounds apart by spaces or >."""
    out = []
    for alternative in selector.split(","):
        path, child = [], False
        for part in re.findall(r">|[^\s>]+", alternative):
            if part == ">":
                child = True
                continue
            if not re.fullmatch(r"(\*|[\w-]+)?(#[\w-]+|\.[\w-]+|\[[\w-]+(=[\"']?[^\]\"']*[\"']?)?\])*", part):
                raise ValueError(f"the selector {selector!r} has a part that isn't supported: {part}")
            tag = re.match(r"[\w-]+|\*", part)
            attrs = tuple((k, v.strip("\"'") if eq else None) for k, eq, v in re.findall(r"\[([\w-]+)(=?)([^\]]*)\]", part))
            bare = re.sub(r"\[[^\]]*\]", "", part)
            ident = re.search(r"#([\w-]+)", bare)
            path.append(Step(tag[0].lower() if tag and tag[0] != "*" else None, ident and ident[1], frozenset(re.findall(r"\.([\w-]+)", bare)), attrs, child))
            child = False
        if not path:
            raise ValueError(f"empty selector in {selector!r}")
        out.append(path)
    return out


class _Select(HTMLParser):
    def __init__(self, paths: list[list[Step]], mark: str = ""):
        super().__init__(convert_charrefs=True)
        self.paths, self.mark, self.open, self.found, self.live = paths, mark, [], [], []

    def _hit(self) -> bool:
        def match(path: list[Step], k: int, at: int) -> bool:
            if not path[k].fits(*self.open[at]):
                return False
            if k == 0:
                return True
            above = [at - 1] if path[k].child else range(at - 1, -1, -1)
            return any(i >= 0 and match(path, k - 1, i) for i in above)

        return any(match(p, len(p) - 1, len(self.open) - 1) for p in self.paths)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.open.append((tag, {k: self._plain(v or "") for k, v in attrs}))
        if self._hit():
            self.found.append([])
            self.live.append((len(self.open), self.found[-1]))
        if tag in VOID:
            self._close(len(self.open) - 1)

    def _plain(self, data: str) -> str:
        return data.replace(self.mark, "&") if self.mark else data

    def _close(self, depth: int) -> None:
        del self.open[depth:]
        self.live = [x for x in self.live if x[0] <= depth]

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                return self._close(k)

    def handle_data(self, data: str) -> None:
        for _, parts in self.live:
            parts.append(self._plain(data).strip())


def select_text(page: str | None, selector: str, references: tuple[str, ...] | None = None) -> list[str]:
    """The text of each element found, in order: pieces stripped and joined, quotes off the ends; empty ones are left out.

    references: the character references (lt, #x27) that are decoded, with their semicolon only; others stay as they are
    written. None: all that HTML knows, some of which need no semicolon, as browsers do it.
    """
    page, mark = page or "", ""
    if references is not None:
        mark = next(c for c in map(chr, range(0xE000, 0x110000)) if c not in page)  # stands for an & that begins none of them
        page = re.sub(rf"&(?!(?:{'|'.join(map(re.escape, references))});)" if references else "&", mark, page)
    parser = _Select(parse_selector(selector), mark)
    parser.feed(page)
    parser.close()
    return [t for t in ("".join(parts).strip(expr.QUOTES) for parts in parser.found) if t]


def page_url(url: str, k: int) -> str:
    return url if k == 1 else f"{url.rstrip('/')}/page/{k}/"


@udtf(returnType="text string")
class ScrapeText:
    """TABLE function: the rows that a selector finds in a page."""

    def eval(self, page: str, selector: str):
        for text in select_text(page, selector):
            yield (text,)


class _Page(InputPartition):
    def __init__(self, k: int):
        super().__init__(k)


def _read_page(options, k: int) -> Iterator[tuple]:
    """A page that fails is skipped."""
    if got := web.get(page_url(options["url"], k), options):
        for text in select_text(got[0].decode(got[1], "replace"), options["selector"]):
            yield (k, text)


class _ScrapeReader(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def pages(self) -> Iterator[int]:
        return iter(range(1, int(self.options.get("max_pages", "1")) + 1))

    def partitions(self):
        return [_Page(k) for k in self.pages()]

    def read(self, partition) -> Iterator[tuple]:
        return _read_page(self.options, partition.value)


_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda a, b: a in b}


class _FilteringReader(_ScrapeReader):
    """Pages that a filter on their number leaves out aren't asked for."""

    def __init__(self, options):
        super().__init__(options)
        self.filters = []

    def pushFilters(self, filters):
        for f in filters:
            if f.attribute == ("page",) and type(f) in _TESTS:
                self.filters.append(f)
            else:
                yield f

    def pages(self) -> Iterator[int]:
        return (k for k in super().pages() if all(_TESTS[type(f)](k, f.value) for f in self.filters))


class _ScrapeStream(DataSourceStreamReader):
    """Offsets are numbers of pages: what is new are the pages behind the last one that was read."""

    def __init__(self, options):
        self.options, self.known = options, 0

    def initialOffset(self) -> dict:
        return {"page": 0}

    def latestOffset(self) -> dict:
        there = lambda k: web.get(page_url(self.options["url"], k), self.options) is not None
        self.known = web.last_there(there, self.known, int(self.options.get("max_pages", "1000000")))
        return {"page": self.known}

    def partitions(self, start: dict, end: dict):
        return [_Page(k) for k in range(start["page"] + 1, end["page"] + 1)]

    def read(self, partition) -> Iterator[tuple]:
        return _read_page(self.options, partition.value)

    def commit(self, end: dict) -> None:
        self.known = max(self.known, end["page"])


class ScrapeSource(DataSource):
    """spark.read.format("scrape").options(url=, selector=, max_pages=): a task for each page; with push=true filters on
    page are pushed. As a stream: the pages that are new."""

    @classmethod
    def name(cls) -> str:
        return "scrape"

    def schema(self) -> str:
        return "page int, text string"

    def reader(self, schema) -> DataSourceReader:
        return _FilteringReader(self.options) if self.options.get("push") == "true" else _ScrapeReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _ScrapeStream(self.options)


def as_records(texts: DataFrame, tag: str, auto_label: bool, collected_at: str | None = None) -> DataFrame:
    now = F.lit(collected_at) if collected_at else expr.iso_now()
    label = expr.sentiment(F.col("text")) if auto_label else F.lit(None).cast("string")
    return texts.select("text", label.alias("label"), F.lit(tag).alias("source"), now.alias("collected_at")).select(*RECORD.names)


def _options(url: str, selector: str, max_pages: int, more: dict | None) -> dict:
    parse_selector(selector)
    return {"url": url, "selector": selector, "max_pages": str(max_pages), **{k: str(v) for k, v in (more or {}).items()}}


def scrape(spark, url: str, selector: str, max_pages: int = 1, auto_label: bool = False, collected_at: str | None = None, **options) -> DataFrame:
    """Records of the pages of an address; options go to web.get."""
    spark.dataSource.register(ScrapeSource)
    rows = spark.read.format("scrape").options(**_options(url, selector, max_pages, options)).load()
    return as_records(rows, f"scrape_{url}", auto_label, collected_at)


def scraped(spark, url: str, selector: str, max_pages: int = 1, **options) -> DataFrame:
    """page, text; a filter on page decides which pages are asked for."""
    spark.dataSource.register(ScrapeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("scrape").options(**_options(url, selector, max_pages, {**options, "push": "true"})).load()


def scrape_new(spark, url: str, selector: str, target: str, checkpoint: str, max_pages: int = 1_000_000, auto_label: bool = False, **options):
    """Adds the records of the pages that have come since the last run to target; what was read stands in the checkpoint."""
    spark.dataSource.register(ScrapeSource)
    rows = spark.readStream.format("scrape").options(**_options(url, selector, max_pages, options)).load()
    return as_records(rows, f"scrape_{url}", auto_label).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def scrape_pages(pages: DataFrame, selector: str, column: str = "html", keep: tuple[str, ...] = (), references: tuple[str, ...] | None = None) -> DataFrame:
    """Pages that are already a table: a row for each element found, with its position; references as in select_text."""
    import pyarrow as pa

    parse_selector(selector)
    src = pages.select(F.struct(*keep).alias("row") if keep else F.struct(F.lit(0).alias("_")).alias("row"), F.col(column).cast("string").alias("page"))
    kind = src.schema["row"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                found = [select_text(p, selector, references) for p in b.column(1).slice(at, 256).to_pylist()]
                rows = b.column(0).slice(at, 256).take(pa.array([i for i, f in enumerate(found) for _ in f], pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, pa.array([k for f in found for k in range(len(f))], pa.int32()), pa.array([t for f in found for t in f], pa.string())], ["row", "position", "text"])

    return src.mapInArrow(run, f"row {kind}, position int, text string").select(*([f"row.{c}" for c in keep]), "position", "text")
