"""Quality classifier by co-training: a view of the text and a view of the metadata teach each other."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice
from operator import itemgetter, ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.common import release, shared_dir, written


@dataclass(frozen=True)
class CoTraining:
    """The model is fitted on at most labelled rows with labels and unlabelled ones without, those with the smallest
    hashes of their ids. It knows at most features words and beginnings of words, the most frequent of those in at least
    min_docs rows; every value of lang and source is known, by one of slots columns that its hash gives it.

    Each of the rounds, a view gives the labels that it is confident of to the other view, at most share of the
    unlabelled rows, in the proportion of the classes. valid: the share of labelled rows on which views are calibrated
    and combined. reject: a document is rejected if it is bad, or toxic, with more than this probability.
    """

    labelled: int = 12_000
    unlabelled: int = 4_000
    features: int = 40_000
    min_docs: int = 4
    rounds: int = 3
    confident: float = 0.98
    share: float = 0.25
    valid: float = 0.25
    reject: float = 0.5
    prefix: int = 5
    slots: int = 4096


#: What the text view knows beside words: figures of the whole text, cut into bins.
SHAPE = ("words", "different", "runs", "upper", "signs", "digits", "long", "mean", "lines", "signed", "top")
BINS = 12


def words(text: str | None) -> list[bytes]:
    return text.encode(errors="surrogatepass").lower().split() if text else []


def shape(text: str | None, w: list[bytes]) -> list[float]:
    """Figures of the text as UTF-8; lengths in bytes."""
    if not w:
        return [0.0] * len(SHAPE)
    raw = text.encode(errors="surrogatepass")
    n, size, different = len(w), len(raw), len(set(w))
    gone = lambda which: size - len(raw.translate(None, which))
    upper, letters = gone(_UPPER), gone(_LETTERS)
    runs, signed = sum(map(ne, w, islice(w, 1, None))) + 1, sum(map(_SIGN_ENDS.__contains__, map(itemgetter(-1), w)))
    sizes = list(map(len, w))
    return [float(np.log1p(n)), different / n, runs / n, upper / max(1, letters), gone(_SIGNS) / size, gone(_DIGITS) / size, max(sizes) / 10, sum(sizes) / n, (raw.count(b"\n") + 1) / n, signed / n, (n - different) / n]


_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'")
_SIGN_ENDS = frozenset(b"!#$%&*+/<=>?@\\^_`|~")


def _hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token) - (1 << 63)


def tokens(w: list[bytes], prefix: int) -> set[bytes]:
    """Different words, and beginnings of longer ones (marked by a space in front)."""
    out = set(w)
    return out | {b" " + x[:prefix] for x in out if len(x) > prefix}


class _Features(dict):
    """Tokens to their columns, -1 for those that the model doesn't know; what is forgotten is looked up again."""

    KEPT = 120_000

    def __init__(self, columns: dict[int, int]):
        self.columns = columns

    def __missing__(self, token: bytes) -> int:
        if len(self) > self.KEPT:
            self.clear()
        at = self[token] = self.columns.get(_hash(token), -1)
        return at

    def of(self, w: list[bytes], prefix: int) -> np.ndarray:
        found = tokens(w, prefix)
        at = np.fromiter(map(self.__getitem__, found), np.int64, len(found))
        return at[at >= 0]


class Rows:
    """Sparse rows of ones: columns of all rows one after another."""

    def __init__(self, rows: list[np.ndarray], width: int):
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        self.col = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n)

    def take(self, which: np.ndarray) -> Rows:
        place = np.full(self.n, -1)
        place[which] = np.arange(len(which))
        out = Rows([], self.width)
        keep = place[self.row] >= 0
        out.n, out.row, out.col = len(which), place[self.row[keep]], self.col[keep]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def telling(x: Rows, y: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """The columns whose log-odds between the classes are at least so many standard errors away from none, and a start
    for their weights: the log-odds less two standard errors."""
    n1, n0 = y.sum(), len(y) - y.sum()
    a, b = np.bincount(x.col, y[x.row], x.width), np.bincount(x.col, 1 - y[x.row], x.width)
    odds, error = np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)), np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
    use = np.abs(odds) >= least * error
    return use, np.where(use, np.sign(odds) * np.maximum(np.abs(odds) - 2 * error, 0), 0)


def fit(x: Rows, y: np.ndarray, steps: int = 60, rate: float = 0.05, least: float = 3.0) -> np.ndarray:
    """Logistic regression on the columns that tell, with a bias last: from their start, a few gradient steps scaled for
    each column (Adam), which stop before the weights of separable classes grow without bound."""
    w = np.zeros(x.width + 1)
    if not len(y):
        return w
    use, w[:-1] = telling(x, y, least)
    use = np.append(use, True)
    m, v = np.zeros_like(w), np.zeros_like(w)
    p0 = (y.sum() + 1) / (len(y) + 2)
    w[-1] = np.log(p0 / (1 - p0))
    for t in range(1, steps + 1):
        r = _sigmoid(x.dot(w[:-1]) + w[-1]) - y
        g = np.append(np.bincount(x.col, r[x.row], x.width), r.sum()) / len(y) * use
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def calibrate(score: np.ndarray, y: np.ndarray, hold: float = 20.0) -> tuple[float, float]:
    """Platt's a, b: the probability is sigmoid(a score + b). They are held near 1 and 0, for where the classes are far
    apart the rows alone don't say where between them the even chance lies."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target, a, b = np.where(y > 0, hi, lo), 1.0, 0.0
    for _ in range(100):
        p = _sigmoid(a * score + b)
        d = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(score * (p - target)).sum() + hold * (a - 1), (p - target).sum() + hold * b])
        h = np.array([[(score * score * d).sum() + hold, (score * d).sum()], [(score * d).sum(), d.sum() + hold]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 0.5 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
    return max(a, 0.0), b


@dataclass
class Head:
    """One question (is it bad, is it toxic) with its two views, each calibrated, and the prior of both."""

    text: np.ndarray
    meta: np.ndarray
    text_ab: tuple[float, float]
    meta_ab: tuple[float, float]
    prior: float

    def combine(self, text_score: np.ndarray, meta_score: np.ndarray) -> np.ndarray:
        """Log-odds of the views add up, once without the prior that both have in them."""
        return _sigmoid(self.text_ab[0] * text_score + self.text_ab[1] + self.meta_ab[0] * meta_score + self.meta_ab[1] - self.prior)


def co_train(text: Rows, meta: Rows, y: np.ndarray, valid: np.ndarray, how: CoTraining) -> Head:
    """y: 1, 0, or -1 for unlabelled rows. Rows of valid don't train; they calibrate."""
    known = (y >= 0) & ~valid
    own, other = y.copy(), y.copy()
    views = [(text, own), (meta, other)]
    weights = [np.zeros(0), np.zeros(0)]
    for turn in range(how.rounds + 1):
        for k, (x, labels) in enumerate(views):
            rows = np.flatnonzero((labels >= 0) & ~valid)
            weights[k] = fit(x.take(rows), labels[rows].astype(float))
        if turn == how.rounds:
            break
        for k, (x, _) in enumerate(views):
            labels = views[1 - k][1]
            rows = np.flatnonzero(valid & (y >= 0))
            score = x.dot(weights[k][:-1]) + weights[k][-1]
            a, b = calibrate(score[rows], y[rows].astype(float)) if len(rows) else (1.0, 0.0)
            p = _sigmoid(a * score + b)
            free = np.flatnonzero((y < 0) & (labels < 0))
            most = how.share * (y < 0).sum()
            rate = y[known].mean() if known.any() else 0.5
            for value, sure, part in ((1, p, rate), (0, 1 - p, 1 - rate)):
                good = free[sure[free] >= how.confident]
                good = good[np.argsort(-sure[good], kind="stable")][: int(most * part)]
                labels[good] = value
    rows = np.flatnonzero(valid & (y >= 0))
    rows = rows if len(rows) else np.flatnonzero(y >= 0)
    scores = [x.dot(w[:-1]) + w[-1] for (x, _), w in zip(views, weights)]
    ab = [calibrate(s[rows], y[rows].astype(float)) if len(rows) else (1.0, 0.0) for s in scores]
    p = ((y[y >= 0] == 1).sum() + 1) / ((y >= 0).sum() + 2)
    return Head(weights[0], weights[1], ab[0], ab[1], float(np.log(p / (1 - p))))


@dataclass
class Model:
    columns: dict[int, int]
    edges: list[list[float]]
    slots: int = 4096
    size_edges: list[float] = field(default_factory=list)
    meta_width: int = 1
    heads: list[Head] = field(default_factory=list)
    prefix: int = 5

    @property
    def text_width(self) -> int:
        return len(self.columns) + len(SHAPE) * BINS

    def text_row(self, found: np.ndarray, figures: list[float]) -> np.ndarray:
        bins = [len(self.columns) + k * BINS + int(np.searchsorted(e, v, side="right")) for k, (e, v) in enumerate(zip(self.edges, figures))]
        return np.concatenate([found, np.array(bins, np.int64)])

    def meta_row(self, lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
        slot = lambda value: xxhash.xxh64_intdigest(str(value).encode(errors="surrogatepass"), 3) % self.slots
        at = [slot(lang), self.slots + slot(source)]
        return np.array([*at, self.meta_width - BINS - 1 + (int(np.searchsorted(self.size_edges, n_chars, side="right")) if n_chars is not None else BINS)], np.int64)


def _quantiles(values: list[float]) -> list[float]:
    return sorted(set(np.quantile(values, np.arange(1, BINS) / BINS).tolist()))[: BINS - 1] if values else []


def train(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining()) -> Model:
    """Fits the model on the driver from the bounded sample; documents without the columns lang, source, n_chars count as null there."""
    folder = shared_dir(docs.sparkSession)
    key = F.xxhash64(F.lit(17), "doc_id")
    marked = labels.where("doc_id is not null and quality is not null and toxic is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    marked = marked.orderBy(key, "doc_id").limit(how.labelled)
    rest = docs.where("doc_id is not null").select("doc_id").join(labels.select("doc_id"), "doc_id", "left_anti").distinct().orderBy(key, "doc_id").limit(how.unlabelled)
    chosen = written(marked.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).unionByName(rest.select("doc_id", F.lit(None).cast("int").alias("quality"), F.lit(None).cast("int").alias("toxic"))), folder, "chosen")
    parts = [(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in (("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"))]
    sample = docs.select("doc_id", *parts).join(F.broadcast(chosen), "doc_id")
    prefix = how.prefix

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                split = [(t, words(t)) for t in part.column(1).to_pylist()]
                hashes = [[_hash(x) for x in tokens(w, prefix)] for _, w in split]
                figures = [shape(t, w) for t, w in split]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hashes, pa.list_(pa.int64())), pa.array(figures, pa.list_(pa.float64())), *(part.column(k) for k in range(2, 7))], ["doc_id", "hashes", "figures", "lang", "source", "n_chars", "quality", "toxic"])

    kind = sample.schema["doc_id"].dataType.simpleString()
    sample = written(sample.mapInArrow(read, f"doc_id {kind}, hashes array<bigint>, figures array<double>, lang string, source string, n_chars bigint, quality int, toxic int"), folder, "sample")
    counts = sample.select(F.explode("hashes").alias("h")).groupBy("h").count().where(F.col("count") >= how.min_docs)
    columns = {r.h: k for k, r in enumerate(counts.orderBy(F.desc("count"), "h").limit(how.features).collect())}
    get = columns.get

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [[k for h in row if (k := get(h)) is not None] for row in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at, pa.list_(pa.int32())), *(b.column(k) for k in range(2, 8))], ["doc_id", "at", *b.schema.names[2:]])

    rows = sample.mapInArrow(narrow, f"doc_id {kind}, at array<int>, figures array<double>, lang string, source string, n_chars bigint, quality int, toxic int").toArrow().sort_by("doc_id")
    figures, sizes = rows["figures"].to_pylist(), [n for n in rows["n_chars"].to_pylist() if n is not None]
    model = Model(columns, [_quantiles([f[k] for f in figures]) for k in range(len(SHAPE))], prefix=prefix, size_edges=_quantiles(sizes))
    model.slots = how.slots
    model.meta_width = 2 * how.slots + BINS + 1
    text = Rows([model.text_row(a.values.to_numpy().astype(np.int64), f) for a, f in zip(rows["at"], figures)], model.text_width)
    meta = Rows([model.meta_row(*m) for m in zip(*(rows[c].to_pylist() for c in ("lang", "source", "n_chars")))], model.meta_width)
    ids = [str(i).encode() for i in rows["doc_id"].to_pylist()]
    valid = np.array([xxhash.xxh64_intdigest(i, 5) % 1000 < 1000 * how.valid for i in ids], bool)
    fill = lambda name: np.array([-1 if v is None else v for v in rows[name].to_pylist()], np.int64)
    quality, toxic = fill("quality"), fill("toxic")
    model.heads = [co_train(text, meta, y, valid, how) for y in (np.where(quality < 0, -1, (quality == 0).astype(int)), np.where(toxic < 0, -1, (toxic > 0).astype(int)))]
    return model


def score(docs: DataFrame, model: Model, how: CoTraining = CoTraining()) -> DataFrame:
    """Every row of docs with p_bad, p_toxic, score (the probability of neither) and rejected."""
    names = ("p_bad", "p_toxic", "score", "rejected")
    docs = docs.select(*(docs[c] for c in docs.columns if c not in names))
    spark, schema = docs.sparkSession, docs.schema
    own, at = spark.sparkContext.broadcast(model), {c: k for k, c in enumerate(docs.columns)}
    reject = how.reject

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = own.value
        features = _Features(model.columns)
        for b in batches:
            for begin in range(0, b.num_rows, 256):
                part = b.slice(begin, 256)
                column = lambda c: part.column(at[c]).to_pylist() if c in at else [None] * part.num_rows  # noqa: B023, E731
                text, meta = [], []
                for t, lang, source, n in zip(column("text"), column("lang"), column("source"), column("n_chars")):
                    w = words(t)
                    text.append(model.text_row(features.of(w, model.prefix), shape(t, w)))
                    meta.append(model.meta_row(lang, source, n))
                x, z = Rows(text, model.text_width), Rows(meta, model.meta_width)
                p = [h.combine(x.dot(h.text[:-1]) + h.text[-1], z.dot(h.meta[:-1]) + h.meta[-1]) for h in model.heads]
                more = [pa.array(p[0]), pa.array(p[1]), pa.array((1 - p[0]) * (1 - p[1])), pa.array((p[0] > reject) | (p[1] > reject))]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *names])
        features.clear()
        release()

    from pyspark.sql.types import BooleanType, DoubleType, StructType

    out = StructType(list(schema.fields))
    for name in names:
        out = out.add(name, BooleanType() if name == "rejected" else DoubleType())
    return docs.mapInArrow(run, out)


def classify(docs: DataFrame, labels: DataFrame, how: CoTraining = CoTraining()) -> DataFrame:
    """Every row of docs (doc_id, text, and lang, source, n_chars if there) with p_bad, p_toxic, score and rejected.

    labels: doc_id, quality (0 is bad) and toxic (1 is toxic). Rows with a null there are no labels; of repeated labels
    the worse counts. Null and empty texts are scored by the shape of an empty text and by their metadata. Without any
    label both probabilities are even and nothing is known: every document then has 0.5 for each question. Texts of any
    length are read whole. Rows that repeat a doc_id are scored each for itself, and count each where the id is in the
    sample; a null doc_id is scored and never in the sample. Columns of the result's names are replaced, others stay.
    """
    return score(docs, train(docs, labels, how), how)
