"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Words are runs of letters, digits and non-ASCII characters of text with A-Z in lower case. A window is
``n`` consecutive words of a benchmark item; a shorter item that has words is one window. Every window of
every whole training text is hashed and looked up; a hit counts only after its words were compared with the
window's. There is no shuffle: the only thing that travels is the benchmark, in chunks of bounded size
(``CHUNK_BYTES`` each; a larger benchmark takes more passes over the rows, inside the same tasks).

Defined cases: null or empty text has no words and is never hit; null or empty items have no windows; items
without an id are left out; repeated items count once per id; repeated documents each get their own row; an
empty table gives no rows. Other columns of the documents are kept as they are.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import OWN
from .words import ALNUM, U, Words, rolling, slices

WINDOW = 13
#: Bytes of benchmark text in one broadcast hash set.
CHUNK_BYTES = 32 << 20
_SPANS, _ITEMS, _COUNT = OWN + "spans", OWN + "items", OWN + "words"


class WindowSet:
    """Windows of some benchmark items, by length, as sorted hashes with texts and item ids."""

    def __init__(self, rows: list[tuple[str, str]], n: int):
        texts = pa.array([t for _, t in rows], pa.string())
        found: dict[int, dict[int, dict[bytes, set[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for i, j, data, off in slices(texts):
            words = Words(data, off, ALNUM, lower=True)
            h = words.hashes()
            for doc in range(j - i):
                a, b = int(words.off[doc]), int(words.off[doc + 1])
                size = min(n, b - a)
                if size:
                    for k, x in enumerate(rolling(h[a:b], size)):
                        found[size][int(x)][words.text(a + k, a + k + size)].add(rows[i + doc][0])
        self.by_size = {}
        for size, windows in found.items():
            keys = np.array(sorted(windows), U)
            sieve = np.zeros(1 << 20, bool)
            sieve[keys >> U(44)] = True
            self.by_size[size] = keys, sieve, [{t: sorted(ids) for t, ids in windows[int(k)].items()} for k in keys]

    def hits(self, words: Words) -> tuple[list[tuple[int, int]], list[tuple[int, list[str]]]]:
        """Word ranges that are windows; with the first word of each, the items."""
        spans, items = [], []
        if not len(words):
            return spans, items
        h, doc = words.hashes(), words.doc
        for size, (keys, sieve, texts) in self.by_size.items():
            g = rolling(h, size)
            at = np.flatnonzero(sieve[g >> U(44)])
            if not len(at):
                continue
            k = np.minimum(np.searchsorted(keys, g[at]), len(keys) - 1)
            good = (keys[k] == g[at]) & (doc[at] == doc[at + size - 1])
            for i, x in zip(at[good].tolist(), k[good].tolist()):
                if (ids := texts[x].get(words.text(i, i + size))) is not None:
                    spans.append((i, i + size))
                    items.append((i, ids))
        return spans, items


def _chunks(benchmark: DataFrame, item_id: str, text: str, chunk_bytes: int) -> list[list[tuple[str, str]]]:
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).filter("i IS NOT NULL AND t IS NOT NULL")
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-int(size) // chunk_bytes))
    if n == 1:
        return [[tuple(r) for r in rows.collect()]]
    return [[tuple(r) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).collect()] for k in range(n)]


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The documents with what was found in each: number of words, hit byte spans of the text, hit words, item ids."""
    added = StructType.fromDDL(f"{_COUNT} long, {_SPANS} array<struct<i:int,j:int>>, {_ITEMS} array<string>")
    schema = StructType([*docs.schema.fields, *added.fields])
    out = docs
    for chunk in _chunks(benchmark, item_id, item_text, chunk_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(WindowSet(chunk, n))
        out = out.mapInArrow(_mark(text, shared), schema)
    return out


def _mark(text: str, shared):
    def run(batches):
        for batch in batches:
            count, spans, items = np.zeros(batch.num_rows, np.int64), [None] * batch.num_rows, [None] * batch.num_rows
            for i, j, data, off in slices(batch.column(text)):
                words = Words(data, off, ALNUM, lower=True)
                count[i:j] = np.diff(words.off)
                doc_spans, doc_items = defaultdict(list), defaultdict(set)
                found, ids = shared.value.hits(words)
                for (a, b), (_, x) in zip(found, ids):
                    d = int(np.searchsorted(words.off, a, "right")) - 1
                    first = int(words.off[d])
                    doc_spans[d].append((a - first, b - first))
                    doc_items[d].update(x)
                for d in doc_spans:
                    spans[i + d], items[i + d] = doc_spans[d], doc_items[d]
            if _SPANS in batch.schema.names:  # an earlier chunk of the benchmark has been here
                for k, (s, x) in enumerate(zip(batch.column(_SPANS).to_pylist(), batch.column(_ITEMS).to_pylist())):
                    spans[k] = [(r["i"], r["j"]) for r in s] + (spans[k] or [])
                    items[k] = set(x) | (items[k] or set())
                batch = batch.select([c for c in batch.schema.names if c not in (_COUNT, _SPANS, _ITEMS)])
            merged = [_merge(s) for s in spans]
            kind = pa.struct([("i", pa.int32()), ("j", pa.int32())])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(count), pa.array([[{"i": a, "j": b} for a, b in s] for s in merged], pa.list_(kind)), pa.array([sorted(x or ()) for x in items], pa.list_(pa.string()))],
                names=[*batch.schema.names, _COUNT, _SPANS, _ITEMS],
            )

    return run


def _merge(spans: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _hit_words():
    return F.aggregate(F.col(_SPANS), F.lit(0).cast("long"), lambda s, x: s + (x["j"] - x["i"]))


def _contaminated(percent: int):
    return (_hit_words() > 0) & (100 * _hit_words() >= percent * F.col(_COUNT))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, remove: str = "documents", percent: int = 5, text: str = "text", **options) -> DataFrame:
    """The documents without those of which ``percent`` of the words are hit, or (``remove="spans"``) without the hit words.

    With spans, a changed text is its remaining words and everything between them; unhit documents stay byte for byte.
    """
    marked = scan(docs, benchmark, text=text, **options)
    if remove == "documents":
        return marked.filter(~_contaminated(percent)).select(*docs.columns)
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    names = docs.columns

    def cut(batches):
        for batch in batches:
            texts, spans = batch.column(text).to_pylist(), batch.column(_SPANS).to_pylist()
            for k, s in enumerate(spans):
                if s:
                    raw = texts[k].encode()
                    words = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), ALNUM, lower=True)
                    at, kept = 0, []
                    for r in s:
                        kept.append(raw[at : words.start[r["i"]]])
                        at = int(words.end[r["j"] - 1])
                    texts[k] = b"".join([*kept, raw[at:]]).decode()
            at = batch.schema.get_field_index(text)
            yield batch.select(names).set_column(at, text, pa.array(texts, batch.schema.field(text).type))

    return marked.mapInArrow(cut, docs.schema)


def report(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", percent: int = 5, **options) -> DataFrame:
    """Per document: words, hit words, items with occurring windows and their digest, and the verdict."""
    marked = scan(docs.select(doc_id, text), benchmark, text=text, **options)
    return marked.select(
        doc_id,
        F.col(_COUNT).alias("n_words"),
        _hit_words().alias("n_hit"),
        F.size(_ITEMS).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", _ITEMS), 256).alias("items_sha256"),
        _contaminated(percent).alias("contaminated"),
    )
