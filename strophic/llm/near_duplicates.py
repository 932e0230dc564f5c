"""MinHash near-dedup with SuperMinHash signatures.

A document's set is its distinct shingles of ``words`` consecutive words (A-Z in lower case); with fewer words the whole
sequence is one shingle. Two documents are linked if 100 * intersection >= ``percent`` * union of their full sets; groups are the
connected components of the links.

1. Texts whose words are the same in the same order collapse into a class (128-bit BLAKE2 digest of the words); the smallest id
   stands for it. Copies cost one row each.
2. Signatures of ``BANDS`` x ``ROWS`` slots; classes that agree in a band share a bucket. A pair with Jaccard similarity 0.8 shares none
   of 24 bands with probability 3.2e-6; the estimates of step 3 lose another 1e-8 (binomial).
3. Inside buckets, estimates (shares of equal slots) of at least ``LEAST`` of 1 (six standard errors under 0.8) join
   classes into candidate groups. A bucket gives at most one row per member: a spanning forest, found by union-find.
4. Every class is compared with the smallest one it was joined to, on the full sets of words, not of hashes. Only in groups that this doesn't
   connect, every pair that isn't connected yet is compared too, again giving a spanning forest.
5. Connected components of the confirmed links.

Buckets and groups of any size are whole: one with over ``CHUNK`` members or ``CHUNK_BYTES`` of text is dealt to chunks and each
two chunks meet in a task.

Defined cases: null or empty text has an empty set and is linked with nothing; rows with the same id are one node, whose
text is that with the smallest digest; a row without an id stands alone; an empty table gives no rows. Other columns are kept as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import OWN, components, drop_table, materialise, null_as_empty, salted_join
from .runs import numbers, whole_runs
from .superminhash import signatures
from .words import SPACED, U, Words, mix, release_memory, rolling, slices

BANDS, ROWS = 24, 4
LEAST = 0.55
CHUNK = 1024
CHUNK_BYTES = 8 << 20
#: Rows of one key (a class, a bucket, a group) that a task takes before the key is split.
PER_SALT = 1000


def shingle_sets(data: np.ndarray, off: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of some texts in ascending order, and the first of each text."""
    w = Words(data, off, SPACED, lower=True)
    h = w.hashes()
    count = np.diff(w.off)
    doc = w.doc
    g = rolling(h, words)
    same = doc[: len(g)] == doc[words - 1 :] if len(g) else np.empty(0, bool)
    elements, of = [g[same]], [doc[: len(g)][same]]
    for n in range(1, words):
        short = np.flatnonzero(count == n)
        if len(short):
            elements.append(rolling(h, n)[w.off[short]])
            of.append(short)
    elements, of = np.concatenate(elements), np.concatenate(of)
    order = np.lexsort((elements, of))
    elements, of = elements[order], of[order]
    keep = np.ones(len(of), bool)
    keep[1:] = (elements[1:] != elements[:-1]) | (of[1:] != of[:-1])
    elements, of = elements[keep], of[keep]
    return elements, np.searchsorted(of, np.arange(len(off)))


def _normal(raw: bytes) -> bytes:
    """A-Z in lower case, words joined by one space."""
    return b" ".join(raw.lower().split())


def _digest(normal: bytes) -> bytes:
    return hashlib.blake2b(normal, digest_size=16).digest()


def _sketch(words: int):
    def run(batches):
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                elements, of = shingle_sets(data, off, words)
                slots = signatures(elements, of, BANDS * ROWS)
                keys = np.empty((j - i, BANDS), U)
                for b in range(BANDS):
                    keys[:, b] = rolling(slots[:, b * ROWS : (b + 1) * ROWS].ravel(), ROWS)[::ROWS] + U(b)
                short = (mix(slots) >> U(48)).astype("<u2")
                raw = data.tobytes()
                digests = [_digest(_normal(raw[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(np.diff(of)), pa.array(digests, pa.binary()), pa.FixedSizeListArray.from_arrays(pa.array(mix(keys).view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64())), pa.array([x.tobytes() for x in short], pa.binary())],
                    names=["id", "n", "digest", "bands", "signature"],
                )
        release_memory()

    return run


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node that each of ``n`` nodes is connected with, by the edges a-b."""
    root = np.arange(n)
    while len(a):
        x, y = root[a], root[b]
        low, high = np.minimum(x, y), np.maximum(x, y)
        apart = low != high
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        np.minimum.at(root, high, low)
        while not np.array_equal(root[root], root):
            root = root[root]
    return root


def _similar(percent: int):
    """Rows of buckets to a spanning forest of the pairs whose estimates are high enough."""

    def run(batches):
        for batch in whole_runs(batches, ("key", "c1", "c2")):
            run_of, ids, n = numbers(batch, ("key", "c1", "c2")), np.asarray(batch.column("id")), np.asarray(batch.column("n"))
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(len(ids), -1)
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            longest = int(np.bincount(run_of).max())
            for d in range(1, longest):
                at = np.flatnonzero(run_of[d:] == run_of[:-d])
                low, high = np.minimum(n[at], n[at + d]), np.maximum(n[at], n[at + d])
                at = at[100 * low >= percent * high]
                at = at[(sig[at] == sig[at + d]).mean(axis=1) >= LEAST]
                a.append(at)
                b.append(at + d)
                if len(a) > 64:
                    root = _forest(len(ids), np.concatenate(a), np.concatenate(b))
                    tied = np.flatnonzero(root != np.arange(len(root)))
                    a, b = [tied], [root[tied]]
            root = _forest(len(ids), np.concatenate(a), np.concatenate(b))
            tied = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[tied]), pa.array(ids[root[tied]])], names=["a", "b"])

    return run


def _shingles(normal: bytes, words: int) -> set[tuple[bytes, ...]]:
    w = normal.split(b" ")
    return set(zip(*(w[k:] for k in range(words)))) if len(w) >= words else {tuple(w)}


def _with_head(words: int, percent: int):
    """Rows (id, its text, the smallest id it was joined to, that one's text) to the links among them."""

    def run(batches):
        head, held = None, set()
        for batch in batches:
            out = []
            for x, text, star, other in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "star", "head"))):
                if star != head:
                    head, held = star, _shingles(other, words)
                own = _shingles(text, words)
                both = len(own & held)
                if 100 * both >= percent * (len(own) + len(held) - both):
                    out.append((x, star))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64())], names=["a", "b"])
        release_memory()

    return run


def numbered(texts: list[bytes], words: int) -> list[np.ndarray]:
    """The distinct shingles of some texts as numbers: equal numbers are equal words."""
    number: dict[bytes, int] = {}
    rows = [np.array([number.setdefault(w, len(number)) for w in t.split(b" ")], np.int64) for t in texts]
    long = [r for r in rows if len(r) >= words]
    own = [r[: len(r) - words + 1] for r in long]
    for k in range(1, words):  # a run of k + 1 words is a run of k words and a word
        at = np.cumsum([0, *map(len, own)])
        joined = np.concatenate(own) * len(number) + np.concatenate([r[k : len(r) - words + 1 + k] for r in long]) if own else np.empty(0, np.int64)
        _, joined = np.unique(joined, return_inverse=True)
        own = [joined[a:b] for a, b in zip(at[:-1], at[1:])]
    whole: dict[bytes, int] = {}
    found = iter(own)
    return [np.unique(next(found)) if len(r) >= words else np.array([-1 - whole.setdefault(t, len(whole))]) for r, t in zip(rows, texts)]


def _linked(words: int, percent: int):
    """Rows of candidate groups to a spanning forest of the confirmed links, beside those already known (equal ``root``)."""

    def run(batches):
        for batch in whole_runs(batches, ("grp", "c1", "c2")):
            run_of, ids, known = numbers(batch, ("grp", "c1", "c2")), np.asarray(batch.column("id")), np.asarray(batch.column("root"))
            texts = batch.column("text")
            out_a, out_b = [], []
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(run_of)) + 1, [len(ids)]])
            for lo, hi in zip(bounds[:-1], bounds[1:]):
                _, first, back = np.unique(known[lo:hi], return_index=True, return_inverse=True)
                root = _confirm(numbered(texts.slice(lo, hi - lo).to_pylist(), words), percent, first[back])
                tied = np.flatnonzero(root != np.arange(hi - lo))
                out_a.append(ids[lo + tied])
                out_b.append(ids[lo + root[tied]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))], names=["a", "b"])
        release_memory()

    return run


def _confirm(sets: list[np.ndarray], percent: int, known: np.ndarray) -> np.ndarray:
    """Components of the links among some sets, ``known`` ones included. Intersections are counted exactly, by blocks of a 0/1 matrix product."""
    n, size = len(sets), np.array([len(s) for s in sets])
    tied = np.flatnonzero(known != np.arange(n))
    root = _forest(n, tied, known[tied])
    if n == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([0, 0 if root[1] == 0 or 100 * both >= percent * (size.sum() - both) else 1])
    flat, of = np.concatenate(sets), np.repeat(np.arange(n), size)
    word, back, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[back] > 1
    number = np.cumsum(count > 1) - 1
    of, col = of[shared], number[back][shared]
    order = np.argsort(col, kind="stable")
    of, col = of[order], col[order]
    width, block = 2048, 256
    edges = np.searchsorted(col, np.arange(0, int(number[-1]) + 1 + width, width)) if len(number) else np.zeros(1, int)
    for i in range(0, n, block):
        for j in range(i, n, block):
            ni, nj = min(block, n - i), min(block, n - j)
            if (root[i : i + ni] == root[i]).all() and (root[j : j + nj] == root[i]).all():
                continue  # all are connected
            both = np.zeros((ni, nj), np.float32)
            for e in range(len(edges) - 1):
                o, c = of[edges[e] : edges[e + 1]], col[edges[e] : edges[e + 1]] - e * width
                x, y = np.zeros((ni, width), np.float32), np.zeros((nj, width), np.float32)
                k = (o >= i) & (o < i + ni)
                x[o[k] - i, c[k]] = 1
                k = (o >= j) & (o < j + nj)
                y[o[k] - j, c[k]] = 1
                both += x @ y.T
            union = size[i : i + ni, None] + size[None, j : j + nj] - both
            p, q = np.nonzero(100 * both >= percent * union)
            known = np.flatnonzero(root != np.arange(n))
            root = _forest(n, np.concatenate([p + i, known]), np.concatenate([q + j, root[known]]))
    return root


def _chunked(rows: DataFrame, key: str, size: Column | None = None) -> DataFrame:
    """Rows with ``c1``, ``c2``: every two rows of a key meet in some (key, c1, c2) of bounded size. Keys of one row go."""
    need = F.ceil(F.count(F.lit(1)) / CHUNK)
    if size is not None:
        need = F.greatest(need, F.ceil(F.sum(size) / CHUNK_BYTES))
    chunks = rows.groupBy(key).agg(F.count(F.lit(1)).alias("members"), need.cast("int").alias("chunks")).filter("members > 1").select(key, "chunks")
    mine = F.pmod(F.xxhash64("id"), F.col("chunks").cast("long")).cast("int")
    met = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda x: F.struct(F.least(x, F.col("mine")).alias("c1"), F.greatest(x, F.col("mine")).alias("c2")))
    return salted_join(rows, chunks, key, rows_per_salt=PER_SALT).withColumn("mine", mine).withColumn("met", F.explode(met)).select(*rows.columns, "met.c1", "met.c2")


def _together(rows: DataFrame, key: str, run: Callable, schema: str, *order: str) -> DataFrame:
    return rows.repartition(key, "c1", "c2").sortWithinPartitions(key, "c1", "c2", *order, "id").mapInArrow(run, schema)


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 2, percent: int = 80) -> DataFrame:
    """(``id``, ``n_shingles``, ``class_id``, ``component_id``) for each distinct id."""
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), null_as_empty(text).alias("text")).filter("id IS NOT NULL")
    sketches = materialise(plain.mapInArrow(_sketch(words), "id long, n long, digest binary, bands array<long>, signature binary"), "sketches")
    nodes = materialise(sketches.groupBy("id").agg(F.min(F.struct("digest", "n")).alias("x")).select("id", "x.digest", "x.n"), "nodes")
    classes = nodes.filter("n > 0").groupBy("digest").agg(F.min("id").alias("class_id"))
    members = salted_join(nodes, classes, "digest", "left", PER_SALT).select("id", "n", "digest", F.coalesce("class_id", "id").alias("class_id"))
    members = materialise(members, "members")
    drop_table(nodes)
    chosen = members.filter("id = class_id AND n > 0").select("id", "digest")
    heads = materialise(sketches.join(chosen, ["id", "digest"]).dropDuplicates(["id"]).select("id", "n", "bands", "signature"), "heads")
    drop_table(sketches)
    keys = materialise(heads.select(F.explode("bands").alias("key"), "id"), "keys")
    buckets = _chunked(keys, "key").join(heads.select("id", "n", "signature"), "id")
    near = materialise(_together(buckets, "key", _similar(percent), "a long, b long").distinct(), "similar")
    drop_table(heads)
    drop_table(keys)
    links = _confirmed(plain, near, members, words, percent)
    found = components(links, "a", "b").select(F.col("node").alias("class_id"), F.col("root").alias("component_id"))
    drop_table(links)
    hot = salted_join(members.select("id", "n", "class_id"), found, "class_id", "left", PER_SALT)
    return hot.select("id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component_id", "class_id").alias("component_id"))


def _confirmed(plain: DataFrame, near: DataFrame, members: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (``a``, ``b``) that hold on full sets and connect all that such links connect in a candidate group."""
    candidates = components(near, "a", "b").select(F.col("node").alias("id"), F.col("root").alias("grp"))
    wanted = candidates.join(members.filter("id = class_id").select("id", "digest"), "id")
    texts = materialise(plain.join(wanted, "id").mapInArrow(_texts, "grp long, id long, text binary").dropDuplicates(["id"]), "texts")
    stars = near.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("star"))
    own = materialise(stars.join(texts.select("id", "text"), "id"), "stars")
    pairs = salted_join(own, texts.select(F.col("id").alias("star"), F.col("text").alias("head")), "star", rows_per_salt=PER_SALT)
    sure = materialise(pairs.sortWithinPartitions("star").mapInArrow(_with_head(words, percent), "a long, b long"), "links")
    drop_table(own)
    drop_table(near)
    roots = materialise(texts.select("grp", "id").join(components(sure, "a", "b").select(F.col("node").alias("id"), "root"), "id", "left").select("grp", "id", F.coalesce("root", "id").alias("root")), "roots")
    apart = roots.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("grp")
    rest = materialise(salted_join(roots, apart, "grp", rows_per_salt=PER_SALT).join(texts.select("id", "text"), "id"), "apart")
    drop_table(texts)
    drop_table(roots)
    more = _together(_chunked(rest, "grp", F.octet_length("text")), "grp", _linked(words, percent), "a long, b long", "root")
    both = materialise(sure.unionByName(more).distinct(), "links")
    drop_table(sure)
    drop_table(rest)
    return both


def _texts(batches):
    """Normalised texts of candidates; of rows with one id, those with the chosen digest."""
    for batch in batches:
        normal = [_normal(x) for x in batch.column("text").cast("binary").to_pylist()]
        keep = np.flatnonzero([_digest(x) == y for x, y in zip(normal, batch.column("digest").to_pylist())])
        yield pa.RecordBatch.from_arrays([batch.column("grp").take(pa.array(keep)), batch.column("id").take(pa.array(keep)), pa.array([normal[k] for k in keep], pa.binary())], names=["grp", "id", "text"])
    release_memory()


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with one of each group: the one with the smallest id. Rows without an id stay."""
    found = groups(docs, doc_id, text, words, percent).filter("id <> component_id").select(F.col("id").alias(OWN + "gone"))
    return docs.join(found, F.col(doc_id).cast("long") == F.col(OWN + "gone"), "left_anti")


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 2, percent: int = 80) -> DataFrame:
    """Per document: size of its set, its group, whether it is kept, and its class of equal sets."""
    found = groups(docs, doc_id, text, words, percent)
    out = docs.select(F.col(doc_id).alias("doc_id")).join(found, F.col("doc_id").cast("long") == F.col("id"), "left")
    return out.select("doc_id", F.coalesce("n_shingles", F.lit(0).cast("long")).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), "class_id")
