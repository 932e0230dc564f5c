"""Quality classifier by co-training a view of the text and a view of the page's metadata.

1. A sample of at most ``LABELLED`` labelled rows (smallest hashes of ids) is fitted on the driver; a quarter of it is kept
   for calibration. Nothing else is sampled.
2. Every whole text becomes the few of ``FEATURES`` chosen word, prefix and suffix features that it has, and shares of shouting,
   symbols, repeats and so on; these small rows are written once.
3. In each of ``ROUNDS`` rounds both views score all documents without a label, in one pass; the ``EXCHANGED`` surest different ones of
   each class go as pseudo-labels to the *other* view and leave the pool, if the view that gives them is at least ``SURE`` of them by
   its calibrated score. A view whose data say nothing about the class is never sure and gives nothing. Copies count as one document.
4. Both views' calibrated log odds are combined by a logistic model fitted on the calibration rows, and all documents are scored.

A document is good if its quality is 1 and it isn't toxic.

Defined cases: null or empty text has no features; null metadata is a category of its own; labels with a null or without
a document are left out, of repeated labels the worse counts; with fewer than ``LEAST`` usable labels or one class only every
score is the share of good labels (1 without labels), and all documents with at least 0.5 are kept; repeated documents are scored each for
itself; an empty table gives no rows. Other columns are kept as they are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import OWN, drop_table, materialise
from .words import SPACED, U, Words, byte_hashes, mix, rolling, slices

LABELLED, LEAST = 6000, 20
FEATURES, LEAST_ROWS = 1024, 4
#: Least G-squared of a chosen feature: chance gives as much to one in a hundred.
SIGNIFICANT = 6.63
ROUNDS, EXCHANGED, SURE = 3, 200, 0.97
_SPACE = 1 << 22
_SHARES = 9
#: Hashed categories of metadata: language, source, both together, and the size's power of two.
_LANGS, _SOURCES, _PAIRS, _SIZES = 16, 64, 128, 32
_KINDS, _META = 4, _LANGS + _SOURCES + _PAIRS + _SIZES
_DENSE = 4


def text_rows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of some texts (feature, its text; distinct) and their shares."""
    words = Words(data, off, SPACED, lower=True)
    n, doc = len(off) - 1, words.doc
    raw, begin = data, words.start
    last = words.end.copy()
    for _ in range(3):  # without closing punctuation
        c = raw[np.maximum(last - 1, begin)]
        last -= ((c < 0x30) | ((c > 0x39) & (c < 0x41)) | ((c > 0x5A) & (c < 0x61)) | ((c > 0x7A) & (c < 0x80))) & (last > begin + 1)
    kinds = [byte_hashes(words.data, begin, last), byte_hashes(words.data, begin, np.minimum(begin + 6, last)) ^ U(1), byte_hashes(words.data, np.maximum(last - 6, begin), last) ^ U(2)]
    feature = np.concatenate([(h >> U(42)).astype(np.int64) for h in kinds])
    both = np.unique(np.tile(doc, 3) * _SPACE + feature)
    size = np.maximum(np.diff(words.off), 1).astype(float)
    per = lambda flags, at: np.bincount(at, flags, n) / size
    cut = np.concatenate([[0], np.cumsum((raw >= 0x41) & (raw <= 0x5A))])
    capitals = (cut[words.end] - cut[words.start]) >= np.maximum(2, (words.end - words.start) // 2)
    symbol = np.isin(raw, np.frombuffer(b"!#$%&*|<>{}[]=_~^+@\\", np.uint8))
    cut = np.concatenate([[0], np.cumsum(symbol)])
    symbols = cut[words.end] - cut[words.start] > 0
    digit = np.concatenate([[0], np.cumsum((raw >= 0x30) & (raw <= 0x39))])
    digits = digit[words.end] - digit[words.start] > 0
    again = np.zeros(len(words), bool)
    again[1:] = (kinds[0][1:] == kinds[0][:-1]) & (doc[1:] == doc[:-1])
    _, first = np.unique(doc.astype(U) * U(0x9E3779B97F4A7C15) ^ kinds[0], return_index=True)
    distinct = np.bincount(doc[first], minlength=n) / size
    line = np.concatenate([[0], np.cumsum(raw == 0x0A)])[off]
    shares = np.stack([per(capitals, doc), per(symbols, doc), per(digits, doc), per(again, doc), distinct, np.log1p(size) / 8, np.bincount(doc, words.end - words.start, n) / size / 8, np.diff(line) / size, 1.0 - np.minimum(1, np.diff(words.off))], axis=1)
    return both % _SPACE, both // _SPACE, shares.astype(np.float32)


def _meta_rows(batch) -> tuple[np.ndarray, np.ndarray]:
    """Categories (language, source, both, size) and numbers (size, its square, length and share of digits of the source's name)."""
    lang, source = ([x or "\0" for x in batch.column(OWN + c).to_pylist()] for c in ("lang", "source"))
    hashed = lambda names, n: np.array([zlib.crc32(x.encode()) % n for x in names], np.int64)
    size = np.log1p(np.maximum(np.array([x or 0 for x in batch.column(OWN + "size").to_pylist()], float), 0))
    category = [hashed(lang, _LANGS), _LANGS + hashed(source, _SOURCES), _LANGS + _SOURCES + hashed([f"{x}\0{y}" for x, y in zip(lang, source)], _PAIRS), _META - _SIZES + np.minimum(size / np.log(2), _SIZES - 1).astype(np.int64)]
    name = np.array([len(x) for x in source], float)
    digits = np.array([sum(c.isdigit() for c in x) for x in source], float) / np.maximum(name, 1)
    return np.stack(category, axis=1), np.stack([size / 8, size * size / 64, name / 16, digits], axis=1).astype(np.float32)


@dataclass
class Logistic:
    """Sparse 0/1 features and dense ones, fitted by full-batch Adam with an L2 penalty."""

    n: int
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    slope: tuple[float, float] = (1.0, 0.0)

    def fit(self, feature, row, dense, y, steps: int = 300, penalty: float = 2e-3) -> "Logistic":
        self.mean, self.scale = dense.mean(axis=0), dense.std(axis=0) + 1e-6
        dense = np.column_stack([(dense - self.mean) / self.scale, np.ones(len(y))])
        w, m, v = np.zeros(self.n + dense.shape[1]), 0.0, 0.0
        for t in range(1, steps + 1):
            z = np.bincount(row, w[feature], len(y)) + dense @ w[self.n :]
            g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(y)
            grad = np.concatenate([np.bincount(feature, g[row], self.n), dense.T @ g])
            grad[:-1] += penalty / 10 * w[:-1]
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        self.weight = w
        return self

    def odds(self, feature, row, dense) -> np.ndarray:
        dense = np.column_stack([(dense - self.mean) / self.scale, np.ones(len(dense))])
        return np.bincount(row, self.weight[feature], len(dense)) + dense @ self.weight[self.n :]

    def calibrate(self, odds, y) -> None:
        """Platt scaling."""
        own = Logistic(0).fit(np.empty(0, int), np.empty(0, int), odds[:, None], y, penalty=0)
        self.slope = (own.weight[0] / own.scale[0], own.weight[1] - own.weight[0] * own.mean[0] / own.scale[0])

    def calibrated(self, odds) -> np.ndarray:
        return self.slope[0] * odds + self.slope[1]


class Views:
    """Both fitted views and how they are combined. ``share``: the score of everything where nothing could be fitted."""

    def __init__(self, share: float):
        self.share, self.chosen, self.text, self.meta, self.both = share, np.empty(0, np.int64), None, None, None
        self.given: list[dict[tuple[str, int], list[int]]] = []  # of each round, the ids that a view gave as a class

    def choose(self, feature: np.ndarray, row: np.ndarray, y: np.ndarray) -> None:
        """The features whose presence says most about the class (G-squared on the fitted rows)."""
        names, at = np.unique(feature, return_inverse=True)
        number = np.bincount(at).astype(float)
        bad = np.bincount(at, 1 - y[row])
        good, n, n_bad = number - bad, len(y), float((1 - y).sum())
        g = bad * np.log(np.maximum(bad, 0.5) / np.maximum(number * n_bad / n, 1e-9)) + good * np.log(np.maximum(good, 0.5) / np.maximum(number * (n - n_bad) / n, 1e-9))
        g[(number < LEAST_ROWS) | (2 * g < SIGNIFICANT)] = -1
        self.chosen = np.sort(names[np.argsort(-g, kind="stable")[: min(FEATURES, int((g > 0).sum()))]])

    def narrow(self, feature: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.chosen):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.chosen, feature), len(self.chosen) - 1)
        own = self.chosen[k] == feature
        return k[own], row[own]

    def scores(self, text, meta) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Probabilities of a good document: by text, by metadata, by both."""
        p = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        n = len(text[2])
        if self.both is None:
            return (np.full(n, self.share),) * 3
        a, b = self.text.calibrated(self.text.odds(*text)), self.meta.calibrated(self.meta.odds(*meta))
        return p(a), p(b), p(self.both.odds(np.empty(0, int), np.empty(0, int), np.column_stack([a, b])))


def _meta_flat(category: np.ndarray, dense: np.ndarray):
    return category.ravel(), np.repeat(np.arange(len(category)), _KINDS), dense


def _sample_rows(batches):
    """Hashed features, shares and metadata of labelled rows."""
    for batch in batches:
        category, dense = _meta_rows(batch)
        features, shares = [], []
        for i, j, data, off in slices(batch.column(OWN + "text")):
            feature, row, own = text_rows(data, off)
            features += np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, j - i)))
            shares.append(own)
        if batch.num_rows:
            yield pa.RecordBatch.from_arrays([batch.column(OWN + "id"), batch.column(OWN + "y"), pa.array(features, pa.list_(pa.int32())), pa.array(np.concatenate(shares).tolist(), pa.list_(pa.float32())), pa.array(category.tolist(), pa.list_(pa.int32())), pa.array(dense.tolist(), pa.list_(pa.float32()))], names=["id", "y", "feature", "shares", "category", "size"])


def _text_of(batch, views):
    feature, row, shares = [], [], []
    for i, _, data, off in slices(batch.column(OWN + "text")):
        f, r, s = text_rows(data, off)
        f, r = views.narrow(f, r)
        feature.append(f)
        row.append(r + i)
        shares.append(s)
    return np.concatenate(feature), np.concatenate(row), np.concatenate(shares)


def _compact(views):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                category, dense = _meta_rows(batch)
                feature, row, shares = _text_of(batch, views.value)
                own = np.split(feature.astype(np.int32), np.searchsorted(row, np.arange(1, batch.num_rows)))
                yield pa.RecordBatch.from_arrays([batch.column(OWN + "id"), pa.array(own, pa.list_(pa.int32())), pa.array(shares.tolist(), pa.list_(pa.float32())), pa.array(category.tolist(), pa.list_(pa.int32())), pa.array(dense.tolist(), pa.list_(pa.float32()))], names=["id", "feature", "shares", "category", "size"])

    return run


def _lists(column) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list column, without Python objects."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False), np.asarray(lists.value_lengths().fill_null(0))


def _stack(column, width: int) -> np.ndarray:
    return _lists(column)[0].reshape(-1, width)


def _matrix(table) -> tuple[tuple, tuple]:
    """Both views' inputs from rows of compact features."""
    feature, size = _lists(table.column("feature"))
    text = feature, np.repeat(np.arange(len(size), dtype=np.int32), size), _stack(table.column("shares"), _SHARES)
    return text, _meta_flat(_stack(table.column("category"), _KINDS), _stack(table.column("size"), _DENSE))


def _twins(batch) -> np.ndarray:
    """Hashes of rows' features: copies have equal ones."""
    feature, size = _lists(batch.column("feature"))
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(feature.astype(U)))])[np.concatenate([[0], np.cumsum(size)])]
    numbers = np.concatenate([_stack(batch.column("shares"), _SHARES).view(np.uint32), _stack(batch.column("category"), _KINDS).astype(np.uint32), _stack(batch.column("size"), _DENSE).view(np.uint32)], axis=1)
    runs = rolling(numbers.astype(U).ravel(), numbers.shape[1])[:: numbers.shape[1]]
    return mix(np.diff(total) + runs).view(np.int64)


_ROW = "id long, feature array<int>, shares array<float>, category array<int>, size array<float>"


def _surest(views, exchanged: int):
    """Of a task's documents, the ``exchanged`` surest different ones of each view (0: text, 1: metadata) and class."""

    def run(batches):
        held: dict[tuple[int, int], list] = {}

        def cut(parts):
            rows = pa.Table.from_batches(parts).sort_by([("doubt", "ascending"), ("id", "ascending")])
            _, first = np.unique(rows.column("twin").to_numpy(), return_index=True)
            return rows.take(pa.array(np.sort(first)[:exchanged])).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            scores = views.value.scores(*_matrix(batch))
            twin = None
            for view in (0, 1):
                for y in (0, 1):
                    doubt = 1 - scores[view] if y else scores[view]
                    at = np.flatnonzero(doubt <= 1 - SURE)
                    if not len(at):
                        continue
                    twin = _twins(batch) if twin is None else twin
                    own = pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(np.full(len(at), view, np.int32)), pa.array(np.full(len(at), y, np.int32)), pa.array(doubt[at]), pa.array(twin[at])], names=[*batch.schema.names, "view", "y", "doubt", "twin"])
                    held[view, y] = cut([*held.get((view, y), []), own])
        for parts in held.values():
            yield from parts

    return run


def _prepared(docs: DataFrame, doc_id: str, text: str, meta: tuple[str, str, str]) -> DataFrame:
    lang, source, size = (F.col(c) if c in docs.columns else F.lit(None) for c in meta)
    own = {"id": F.col(doc_id).cast("long"), "text": F.col(text), "lang": lang.cast("string"), "source": source.cast("string"), "size": size.cast("double")}
    return docs.withColumns({OWN + k: v for k, v in own.items()})


def _together(parts: list[tuple]) -> tuple:
    base, feature, row = 0, [], []
    for f, r, d in parts:
        feature.append(f)
        row.append(r + base)
        base += len(d)
    return np.concatenate(feature), np.concatenate(row), np.concatenate([d for *_, d in parts])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", meta: tuple[str, str, str] = ("lang", "source", "n_chars"), labelled: int = LABELLED, rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> Views:
    """Fit both views on a bounded labelled sample and on confident pseudo-labels from all documents."""
    spark = docs.sparkSession
    rows = _prepared(docs, doc_id, text, meta).select(*(OWN + c for c in ("id", "text", "lang", "source", "size")))
    good = F.when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), 1).otherwise(0)
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias(OWN + "id")).agg(F.min(good).alias(OWN + "y"))
    picked = known.orderBy(F.xxhash64(OWN + "id"), OWN + "id").limit(labelled)  # the documented bound
    sample = rows.join(F.broadcast(picked), OWN + "id").mapInArrow(_sample_rows, "id long, y int, feature array<int>, shares array<float>, category array<int>, size array<float>").toArrow()
    y = np.array(sample.column("y").to_pylist(), float)
    views = Views(float(y.mean()) if len(y) else 1.0)
    if len(y) < LEAST or y.min() == y.max():
        return views
    order = np.argsort([zlib.crc32(str(x).encode()) for x in sample.column("id").to_pylist()], kind="stable")
    fitted = np.ones(len(y), bool)
    fitted[order[::4]] = False
    if y[fitted].min() == y[fitted].max() or y[~fitted].min() == y[~fitted].max():
        return views
    part = lambda keep: sample.filter(pa.array(keep))
    (f, r, s), meta_fit = _matrix(part(fitted))
    views.choose(f, r, y[fitted])
    text_fit = (*views.narrow(f, r), s)
    (f, r, s), meta_cal = _matrix(part(~fitted))
    text_cal, y_cal = (*views.narrow(f, r), s), y[~fitted]
    text_parts, meta_parts, text_y, meta_y = [text_fit], [meta_fit], [y[fitted]], [y[fitted]]
    compact, given = None, []
    for k in range(rounds + 1):
        views.text = Logistic(len(views.chosen)).fit(*_together(text_parts), np.concatenate(text_y))
        views.meta = Logistic(_META).fit(*_together(meta_parts), np.concatenate(meta_y))
        views.text.calibrate(views.text.odds(*text_cal), y_cal)
        views.meta.calibrate(views.meta.odds(*meta_cal), y_cal)
        both = np.column_stack([views.text.calibrated(views.text.odds(*text_cal)), views.meta.calibrated(views.meta.odds(*meta_cal))])
        views.both = Logistic(0).fit(np.empty(0, int), np.empty(0, int), both, y_cal, penalty=0)
        if k == rounds:
            break
        if compact is None:
            free = rows.mapInArrow(_compact(spark.sparkContext.broadcast(views)), _ROW)
            compact = materialise(free.join(F.broadcast(picked.select(F.col(OWN + "id").alias("id"))), "id", "left_anti"), "features")
        pool = compact
        if given:  # at most 4 * exchanged a round
            pool = compact.join(F.broadcast(spark.createDataFrame([(x,) for x in given], "id long")), "id", "left_anti")
        sure = materialise(pool.mapInArrow(_surest(spark.sparkContext.broadcast(views), exchanged), _ROW + ", view int, y int, doubt double, twin long"), "sure")
        found = {}
        for view, parts, ys in ((0, meta_parts, meta_y), (1, text_parts, text_y)):
            for y_new in (1, 0):
                own = sure.filter((F.col("view") == view) & (F.col("y") == y_new))
                best = own.groupBy("twin").agg(F.min(F.struct("doubt", "id", "feature", "shares", "category", "size")).alias("x")).select("x.*").orderBy("doubt", "id").limit(exchanged).toArrow()
                if best.num_rows:
                    parts.append(_matrix(best)[1 - view])
                    ys.append(np.full(best.num_rows, float(y_new)))
                found["metadata" if view else "text", y_new] = best.column("id").to_pylist()
        drop_table(sure)
        views.given.append(found)
        given += [x for ids in found.values() for x in ids]
        if not any(found.values()):
            break
    if compact is not None:
        drop_table(compact)
    return views


def _score(views, names):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                scores = views.value.scores(_text_of(batch, views.value), _meta_flat(*_meta_rows(batch)))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(s) for s in scores)], names=[*names, OWN + "p_text", OWN + "p_meta", OWN + "p"])

    return run


def scan(docs: DataFrame, views: Views, doc_id: str = "doc_id", text: str = "text", meta: tuple[str, str, str] = ("lang", "source", "n_chars")) -> DataFrame:
    """The documents with the probability of being good by text, by metadata, and by both (own names)."""
    added = StructType.fromDDL(f"{OWN}p_text double, {OWN}p_meta double, {OWN}p double")
    return _prepared(docs, doc_id, text, meta).mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(views), docs.columns), StructType([*docs.schema.fields, *added.fields]))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that the classifier doesn't reject."""
    return scan(docs, train(docs, labels)).filter(F.col(OWN + "p") >= threshold).select(*docs.columns)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    out = scan(docs, train(docs, labels))
    return out.select("doc_id", F.col(OWN + "p_text").alias("text_score"), F.col(OWN + "p_meta").alias("metadata_score"), F.col(OWN + "p").alias("score"), (F.col(OWN + "p") >= threshold).alias("keep"))
