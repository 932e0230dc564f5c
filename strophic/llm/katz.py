"""Katz backoff n-gram model with Good-Turing discounts, counted and evaluated over blocks of documents.

Documents are packed into blocks of bounded size, written once. For each order, a block sends its distinct n-grams
(64-bit hashes with training counts) to ranges of the hash space, one compressed row per (block, range); a range adds up
the counts of all blocks and answers each block with the totals in the block's own order. So a hot n-gram is one
entry a block, no table is sent to every task, and what travels and what is stored grows with the corpus: a block sends at most a
row per n-gram of its own, however many ranges there are.

``fit`` stores the count and weight tables, keyed by hash and partitioned by range, and ``evaluate`` scores any texts with them: blocks
ask ranges for their n-grams. ``score`` does both for one table and asks for counts and weights while they are added up.
Hashes aren't linear in the bytes (``words.py``); no words of up to 8 bytes and equal length share one.

Model, for an n-gram h+w whose training count is c, with c(h) the count of its context:

* c > ``cutoff`` (for n-grams of order above 1; 0, the default, keeps all): p(w|h) = d(c) * c / c(h), with
  the Good-Turing discount d(c) for c <= ``K`` and 1 above;
* otherwise p(w|h) = a(h) * p(w|h'), h' being h without its first token. a(h) = (1 - sum of p over kept successors) / (1 - sum of p(.|h') over
  kept successors), so that probabilities add up to 1 exactly; a(h) = 1 if h has no kept successor;
* order 1: p(w) = d(c) * c / N; what the discounts leave is the probability of the one class of unknown tokens.

Where counts of counts give no discount in (0, 1], it is 1 (order 1: one is added to N for unknown tokens). A context whose
kept successors would take all its mass gets one count more in its denominator.

A document is its words and an end token, seen after ``order - 1`` start marks, which aren't tokens. Defined cases: null or empty
text is the end token alone; rows with one id are scored each for itself; a null id counts as the empty text; without
training documents every token has probability 1 of being unknown; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, buckets_of, drop_table, materialise, null_as_empty, parts_for
from .words import SPACED, U, Words, mix, release_memory, slices

ORDER = 3
K = 5
CUTOFF = 0
BLOCK = 4 << 20
#: Sums over successors of contexts of two tokens or more travel in so many goes, each with its share of the ranges.
GOES = 2
_START, _END = U(0x1B873593CC9E2D51), U(0xE6546B64A1B2C3D5)
_Q = U(0xD1342543DE82EF95)
_MANY = "block long, range int, payload binary"
_TABLES = "kind string, order int, range int, payload binary"
#: The block of rows that hold the keyed table of a range.
_TABLE = -1


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length, byte planes apart, compressed."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(b"".join([len(arrays[0]).to_bytes(8, "little"), *planes]), 1)


def _pack_keyed(keys: np.ndarray, *arrays: np.ndarray) -> bytes:
    """With ascending 64-bit keys, of which differences are kept."""
    return _pack(np.diff(keys, prepend=U(0)), *arrays)


def _unpack(raw: bytes, *kinds: str) -> list[np.ndarray]:
    raw = zstandard.decompress(raw)
    n, at, out = int.from_bytes(raw[:8], "little"), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel())
        at += n * width
    return out


def _unpack_keyed(raw: bytes, *kinds: str) -> list[np.ndarray]:
    steps, *more = _unpack(raw, "<u8", *kinds)
    return [np.cumsum(steps), *more]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and each value's place among them."""
    by = np.argsort(keys)
    own = keys[by]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    back = np.empty(len(keys), np.int32)
    back[by] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return own[new], back


def _first_of(back: np.ndarray, n: int, none: int = -1) -> np.ndarray:
    """Where each of ``n`` places comes first; ``none`` if it doesn't."""
    out = np.full(n, none)
    out[back[::-1]] = np.arange(len(back))[::-1]  # the last assignment stays
    return out


_BLOCKS = "block long, ids array<long>, sizes binary, words binary, places binary"


def _blocks(batches):
    """Documents to rows (block, ids, numbers of tokens, distinct tokens' hashes, each token's place among them)."""
    part, number = TaskContext.get().partitionId(), 0
    ids, texts, size = [], [], 0

    def row():
        off = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        words = Words(np.frombuffer(b"".join(texts), np.uint8), off, SPACED, lower=True)
        counts = np.diff(words.off)
        sizes = (counts + 1).astype(np.int32)
        tokens = np.full(int(sizes.sum()) + 1, _END, U)
        tokens[np.arange(len(words)) + np.repeat(np.arange(len(ids)), counts)] = words.hashes()
        tokens[-1] = _START  # a context, not a token
        keys, places = np.unique(tokens, return_inverse=True)
        packed = sizes.tobytes(), _pack_keyed(keys), _pack(places.astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array([(part << 32) | number]), pa.array([list(ids)], pa.list_(pa.int64())), *(pa.array([x], pa.binary()) for x in packed)], names=["block", "ids", "sizes", "words", "places"])

    for batch in batches:
        for i, j, data, off in slices(batch.column("text")):
            names, raw = batch.column("id").slice(i, j - i).to_pylist(), data.tobytes()
            for k in range(j - i):
                ids.append(names[k])
                texts.append(raw[off[k] : off[k + 1]])
                size += len(texts[-1])
                if size >= BLOCK:
                    yield row()
                    ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield row()
    release_memory()


def _one_by_one(batch):
    for k in range(batch.num_rows):
        yield batch.slice(k, 1).to_pylist()[0]


class Block:
    """Tokens of a block, and for each order the distinct n-grams with their place for each token."""

    def __init__(self, row: dict, fold: int, folds: int):
        self.ids, self.n_tokens = row["ids"], np.frombuffer(row["sizes"], np.int32).astype(np.int64)
        (keys,), (back,) = _unpack_keyed(row["words"]), _unpack(row["places"], "<i4")
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        self.held = np.array([zlib.crc32(b"" if x is None else str(x).encode()) % folds == fold for x in self.ids], bool)
        self.tokens, self.train = keys[back[:-1]], np.repeat(~self.held, self.n_tokens)
        self._grams: list[np.ndarray] = [self.tokens]
        self._distinct: dict[int, tuple] = {1: (keys, back)}

    def grams(self, order: int) -> np.ndarray:
        """The hash of the ``order`` tokens that end at each token; start marks fill up."""
        while len(self._grams) < order:
            before = self.context(len(self._grams))
            self._grams.append(mix(before * _Q + self.tokens + U(len(self._grams))))
        return self._grams[order - 1]

    def context(self, size: int) -> np.ndarray:
        """The hash of the ``size`` tokens before each token."""
        own = self.grams(size)
        out = np.empty_like(own)
        out[1:] = own[:-1]
        out[self.first] = _start(size)
        return out

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams, contexts of first tokens (start marks alone) included; the place of each token's."""
        keys, back = self._all(order)
        return keys, back[:-1]

    def _all(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        if order not in self._distinct:
            self._distinct[order] = _numbered(np.append(self.grams(order), _start(order)))
        return self._distinct[order]

    def counts(self, order: int) -> np.ndarray:
        """Training counts of the distinct n-grams."""
        keys, back = self._all(order)
        counts = np.bincount(back[:-1], self.train, len(keys)).astype(np.uint32)
        counts[back[-1]] = (~self.held).sum()  # start marks alone are a context once a document
        return counts


def _start(size: int) -> np.uint64:
    h = np.array([_START], U)
    for n in range(1, size):
        h = mix(h * _Q + _START + U(n))
    return h[0]


def _range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return ((keys >> U(32)) * U(ranges)) >> U(32)


def _rows(block: int, ranges: int, keys: np.ndarray, *more: np.ndarray):
    """A row for each range that has some of the ascending keys."""
    of = _range(keys, ranges)
    first = np.flatnonzero(np.diff(of, prepend=U(ranges)))
    cuts = zip(first.tolist(), [*first[1:].tolist(), len(keys)])
    payloads = [_pack_keyed(keys[a:b], *(m[a:b] for m in more)) for a, b in cuts]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(first), block, np.int64)), pa.array(of[first].astype(np.int32)), pa.array(payloads, pa.binary())], names=["block", "range", "payload"])


def _count(order: int, ranges: int, fold: int, folds: int):
    def run(batches):
        for batch in batches:
            for row in _one_by_one(batch):
                block = Block(row, fold, folds)
                yield _rows(row["block"], ranges, block.distinct(order)[0], block.counts(order))
        release_memory()

    return run


def _answers(rng: int, blocks: list, payloads: list, table: bytes | None, stats: bytes | None = None) -> pa.Table:
    """Answers to blocks; the keyed table, and numbers for the driver (no block)."""
    more = [(_TABLE, table)] * (table is not None) + [(None, stats)] * (stats is not None)
    blocks, payloads = [*blocks, *(b for b, _ in more)], [*payloads, *(x for _, x in more)]
    return pa.table({"block": pa.array(blocks, pa.int64()), "range": pa.array([rng] * len(blocks), pa.int32()), "payload": pa.array(payloads, pa.binary())})


def _add_up(order: int, keep: bool):
    """All rows of a range: every block gets the totals of its n-grams; a row without block has the counts of counts."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack_keyed(x, "<u4") for x in table.column("payload").to_pylist()]
        keys = np.concatenate([k for k, _ in parts])
        own, back = _numbered(keys)
        total = np.bincount(back, np.concatenate([c for _, c in parts]), len(own)).astype(np.int64)
        # the first block that has an n-gram speaks for it later; what one block alone has it weighs itself
        first = np.zeros(len(keys), bool)
        first[_first_of(back, len(own))] = True
        alone = (np.bincount(back) == 1)[back] & (not keep)
        answer, bounds = (total[back] << 2 | alone << 1 | first).astype(np.int64), np.cumsum([0, *(len(k) for k, _ in parts)])
        start = own == _start(order)
        seen = total[~start]
        stats = np.concatenate([np.bincount(np.minimum(seen, K + 2), minlength=K + 3)[: K + 2], [(seen > 0).sum(), seen.sum()]]).astype(np.int64)
        known = total > 0
        held = _pack_keyed(own[known], total[known]) if keep else None
        return _answers(table.column("range")[0].as_py(), table.column("block").to_pylist(), [_pack(answer[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], held, stats.tobytes())

    return run


class Model:
    """Discounts of each order, from the counts of counts."""

    def __init__(self, order: int, stats: list[np.ndarray], cutoff: int = CUTOFF):
        self.order, self.cutoff = order, cutoff
        self.discount, self.seen, self.tokens = [], 0, 0
        for m, s in enumerate(stats, 1):
            least = 0 if m == 1 else cutoff
            d = np.ones(K + 1)
            n = [int(x) for x in s[: K + 2]] + [0]
            floor = (K + 1) * n[K + 1] / n[1] if n[1] else 0.0
            for r in range(1, K + 1):
                if n[r] and floor < 1:
                    x = ((r + 1) * n[r + 1] / (r * n[r]) - floor) / (1 - floor)
                    d[r] = x if 0 < x <= 1 else 1.0
            d[: least + 1] = 0
            self.discount.append(d)
            if m == 1:
                self.seen, self.tokens = int(s[K + 2]), int(s[K + 3])
                kept = self.tokens - sum(r * n[r] * (1 - d[r]) for r in range(1, K + 1))
                self.total = float(self.tokens)
                if self.tokens - kept <= 0:
                    self.total += 1  # no discount: one count for unknown tokens
                self.unknown = (self.total - kept) / self.total if self.total else 1.0

    def kept(self, order: int, count: np.ndarray) -> np.ndarray:
        """The discounted count; 0 if the n-gram is left to backoff."""
        return np.where(count > K, count, self.discount[order - 1][np.minimum(count, K)] * count)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.kept(1, count) / max(self.total, 1.0), self.unknown)


class Answers:
    """What ranges told a block: totals of its n-grams, and weights of its contexts, by order."""

    def __init__(self, parts: list[dict]):
        self.parts = {(p["kind"], p["order"]): {} for p in parts}
        for p in parts:
            self.parts[p["kind"], p["order"]][p["range"]] = p["payload"]

    def get(self, kind: str, order: int, what: str) -> np.ndarray:
        own = self.parts.get((kind, order), {})
        found = [_unpack(own[r], what)[0] for r in sorted(own)]
        return np.concatenate(found) if found else np.empty(0, what)


def _evaluate(block: Block, answers: Answers, model: Model, order: int, weighed: bool = True):
    """p(token | order - 1 tokens before it) of each token; the parts that the highest order needs for its weights, if it isn't ``weighed`` yet."""
    keys, back = block.distinct(1)
    told = answers.get("count", 1, "<i8")
    count = told >> 2
    p, count = model.unigram(count)[back], count[back]
    state = None
    for m in range(2, order + 1):
        context_keys, context_told = keys, told
        at = np.concatenate([[0], back[:-1]])  # the context is the gram before; of first tokens, start marks
        at[block.first] = np.searchsorted(context_keys, _start(m - 1))
        keys, back = block.distinct(m)
        told = answers.get("count", m, "<i8")
        kept, contexts = model.kept(m, told >> 2)[back], context_told >> 2
        one = _first_of(back, len(keys))  # a token of each n-gram
        own = np.flatnonzero(one >= 0)
        own = own[kept[one[own]] > 0]
        state = (at, one, own, told, context_told, kept, p)
        if m < order or weighed:
            open_ = _open(contexts, model.cutoff)
            alone = open_ & ((context_told >> 1 & 1) == 1)
            weight = np.ones(len(context_keys))
            weight[open_ & ~alone] = answers.get("weight", m, "<f8")
            mass, low = _sums(at, one[own], kept, p, len(context_keys))
            weight[alone] = _weight(contexts[alone], mass[alone], low[alone])
            more = np.where(weight < 0, contexts / (contexts + 1.0), 1.0)  # a context that keeps a count back
            p = np.where(kept > 0, kept / np.maximum(contexts[at], 1) * more[at], np.abs(weight)[at] * p)
    return p, count, state


def _sums(at: np.ndarray, tokens: np.ndarray, kept: np.ndarray, lower: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each context: the discounted counts of its successors at ``tokens``, and their lower-order probabilities."""
    return np.bincount(at[tokens], kept[tokens], n), np.bincount(at[tokens], lower[tokens], n)


def _weight(count: np.ndarray, mass: np.ndarray, low: np.ndarray) -> np.ndarray:
    """Backoff weights of contexts; negative if the context's denominator has one count more."""
    full = (mass >= count * (1 - 1e-12)) & (mass > 0)
    left = np.where(full, 1 - mass / (count + 1), 1 - mass / np.maximum(count, 1))
    weight = np.where(mass > 0, left / np.maximum(1 - low, 1e-300), 1.0)
    return np.where(full, -weight, weight)


def _open(count: np.ndarray, cutoff: int) -> np.ndarray:
    """Contexts that can have a kept successor."""
    return count > cutoff


def _context_sums(order: int, ranges: int, model, fold: int, folds: int, go: int, goes: int):
    """A block's part of the sums over kept successors of each context; its contexts, to be told the weights."""

    def run(batches):
        for batch in batches:
            for row in _one_by_one(batch):
                block, answers = Block(row, fold, folds), Answers(row["answers"])
                _, _, (at, one, own, told, context_told, kept, lower) = _evaluate(block, answers, model.value, order, weighed=False)
                own = own[(told[own] & 1) == 1]
                keys, _ = block.distinct(order - 1)
                total = context_told >> 2
                mass, low = _sums(at, one[own], kept, lower, len(keys))
                ask = _open(total, model.value.cutoff) & ((context_told >> 1 & 1) == 0)
                ask &= _range(keys, ranges) % U(goes) == U(go)
                yield _rows(row["block"], ranges, keys[ask], total[ask], mass[ask], low[ask])
        release_memory()

    return run


def _weights(keep: bool):
    """The weights of a range's contexts."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpack_keyed(x, "<i8", "<f8", "<f8") for x in table.column("payload").to_pylist()]
        own, back = _numbered(np.concatenate([k for k, *_ in parts]))
        count = np.empty(len(own), np.int64)
        count[back] = np.concatenate([c for _, c, _, _ in parts])  # a context's count is the same everywhere
        mass, low = np.bincount(back, np.concatenate([x for _, _, x, _ in parts])), np.bincount(back, np.concatenate([x for _, _, _, x in parts]))
        weight = _weight(count, mass, low)
        bounds, told = np.cumsum([0, *(len(k) for k, *_ in parts)]), weight[back]
        return _answers(table.column("range")[0].as_py(), table.column("block").to_pylist(), [_pack(told[a:b]) for a, b in zip(bounds[:-1], bounds[1:])], _pack_keyed(own, weight) if keep else None)

    return run


def _scores(order: int, model, fold: int, folds: int):
    def run(batches):
        for batch in batches:
            for row in _one_by_one(batch):
                block = Block(row, fold, folds)
                p, count, _ = _evaluate(block, Answers(row["answers"]), model.value, order)
                base = np.log10((count + 0.5) / (model.value.tokens + 0.5 * (model.value.seen + 1)))
                add = lambda x: np.add.reduceat(x, block.first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(block.held), pa.array(block.n_tokens.astype(np.int64)), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(row["ids"]), model.value.tokens, np.int64)), pa.array(add(base)), pa.array(add(np.log10(np.maximum(p, 1e-300))))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
        release_memory()

    return run


_SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _blocks_of(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """The blocks, in a table bucketed by block: what blocks are told travels to them, they don't travel."""
    blocks = docs.select(F.col(doc_id).cast("long").alias("id"), null_as_empty(text).alias("text")).mapInArrow(_blocks, _BLOCKS)
    return bucketed(blocks, "blocks", "block", parts_for(docs, 0.5, 16), compression="uncompressed")


def _with_answers(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Each block with what it was told; that is bounded by the block's size. Answers come dealt by block like the blocks, so nothing travels."""
    out, told = blocks, [f"told{k}" for k in range(len(answers))]
    for name, table in zip(told, answers):
        own = table.groupBy("block").agg(F.collect_list(F.struct("kind", "order", "range", "payload")).alias(name))
        out = out.join(own, "block", "left")  # a block may have no context to ask for
    return out.select(*blocks.columns, F.flatten(F.filter(F.array(*told), lambda x: x.isNotNull())).alias("answers"))


class _Run:
    """Counting and weighing over blocks: answers to blocks, the model, and all tables written."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, order: int, fold: int, folds: int, cutoff: int, keep: bool):
        spark, self.order, self.fold, self.folds = docs.sparkSession, order, fold, folds
        self.ranges, self.answers, self.tables, self.written, self.keep, stats = parts_for(docs, 0.5, 16), [], [], [], keep, []
        self.blocks = _blocks_of(docs, doc_id, text)
        for m in range(1, order + 1):
            sent = self.blocks.mapInArrow(_count(m, self.ranges, fold, folds), _MANY)
            added = materialise(sent.groupBy("range").applyInArrow(_add_up(m, keep), _MANY), f"counts{m}", compression="uncompressed")
            numbers = [np.frombuffer(r["payload"], np.int64) for r in added.filter("block IS NULL").select("payload").collect()]  # K + 4 numbers a range
            self.told(m, "count", added)
            stats.append(sum(numbers, np.zeros(K + 4, np.int64)))
            self.model = Model(m, stats, cutoff)
            goes = min(m - 1, GOES)
            known, model = list(self.answers), spark.sparkContext.broadcast(self.model)
            for go in range(goes):
                sums = _with_answers(self.blocks, known).mapInArrow(_context_sums(m, self.ranges, model, fold, folds, go, goes), _MANY)
                self.told(m, "weight", materialise(sums.groupBy("range").applyInArrow(_weights(keep), _MANY), f"weights{m}", compression="uncompressed"))

    def told(self, order: int, kind: str, table: DataFrame) -> None:
        """Answers, written by range, are written again by block; so they travel once, when what they were made of has gone."""
        own = table.select("block", F.lit(kind).alias("kind"), F.lit(order).alias("order"), "range", "payload")
        answers = bucketed(own.filter(F.col("block") > _TABLE), f"told_{kind}{order}", "block", buckets_of(self.blocks), compression="uncompressed")
        self.answers.append(answers)
        self.written.append(answers)
        if self.keep:
            self.written.append(table)
            self.tables.append(own.filter(F.col("block") == _TABLE).drop("block"))
        else:
            drop_table(table)

    def scores(self) -> DataFrame:
        model = self.blocks.sparkSession.sparkContext.broadcast(self.model)
        return _with_answers(self.blocks, self.answers).mapInArrow(_scores(self.order, model, self.fold, self.folds), _SCORES)

    def drop(self) -> None:
        for t in (self.blocks, *self.written):
            drop_table(t)


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, fold: int = 1, folds: int = 5, cutoff: int = CUTOFF) -> DataFrame:
    """Train on documents whose crc32(id) mod ``folds`` isn't ``fold``; give log10 probabilities of all documents."""
    run = _Run(docs, doc_id, text, order, fold, folds, cutoff, keep=False)
    out = materialise(run.scores(), "scores")
    run.drop()
    return out


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", order: int = ORDER, fold: int = -1, folds: int = 5, cutoff: int = CUTOFF) -> tuple[Model, DataFrame]:
    """The model and its tables (``kind`` count or weight, ``order``, ``range``, ``payload``: ascending keys and their values), partitioned by
    kind, order and range. With the fold -1 all documents are trained on."""
    run = _Run(docs, doc_id, text, order, fold, folds, cutoff, keep=True)
    run.model.ranges = run.ranges
    tables = run.tables[0]
    for more in run.tables[1:]:
        tables = tables.unionByName(more)
    out = materialise(tables.repartition("kind", "order", "range"), "model")
    run.drop()
    return run.model, out


def _ask(order: int, ranges: int):
    def run(batches):
        for batch in batches:
            for row in _one_by_one(batch):
                keys, _ = Block(row, -1, 1).distinct(order)
                yield _rows(row["block"], ranges, keys)

    return run


def _reply(order: int, highest: int, cutoff: int):
    """Counts of the n-grams that blocks ask for and, if higher orders back off to them, the weights of those that are open contexts."""

    def run(asked: pa.Table, table: pa.Table) -> pa.Table:
        held = {r["kind"]: r["payload"] for r in table.to_pylist()}
        keys, total = _unpack_keyed(held["count"], "<i8") if "count" in held else (np.empty(0, U), np.empty(0, np.int64))
        contexts, weight = _unpack_keyed(held["weight"], "<f8") if "weight" in held else (np.empty(0, U), np.empty(0))
        out = []
        for row in asked.to_pylist():
            (wanted,) = _unpack_keyed(row["payload"])
            count = _look_up(keys, total, wanted, 0)
            out.append((row["block"], "count", order, row["range"], _pack(count << 2)))
            if order < highest:
                out.append((row["block"], "weight", order + 1, row["range"], _pack(_look_up(contexts, weight, wanted[_open(count, cutoff)], 1.0))))
        columns = list(zip(*out)) or [()] * 5
        kinds = pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.binary()
        return pa.table({c: pa.array(x, k) for c, x, k in zip(("block", "kind", "order", "range", "payload"), columns, kinds)})

    return run


def _look_up(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default, values.dtype)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def evaluate(docs: DataFrame, model: Model, tables: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores of any texts by a fitted model. No document is called held out."""
    blocks, told = _blocks_of(docs, doc_id, text), []
    for m in range(1, model.order + 1):
        asked = blocks.mapInArrow(_ask(m, model.ranges), _MANY)
        own = tables.filter(((F.col("kind") == "count") & (F.col("order") == m)) | ((F.col("kind") == "weight") & (F.col("order") == m + 1))).select("range", "kind", "payload")
        replies = asked.groupBy("range").cogroup(own.groupBy("range")).applyInArrow(_reply(m, model.order, model.cutoff), "block long, " + _TABLES)
        told.append(replies.repartition(buckets_of(blocks), "block"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = materialise(_with_answers(blocks, told).mapInArrow(_scores(model.order, shared, -1, 1), _SCORES), "scores")
    drop_table(blocks)
    return out
