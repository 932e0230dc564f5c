"""Best-fit packing planned over a histogram of lengths.

1. Every whole text becomes pieces: its ids and an end id, cut into ``capacity`` ids only if longer.
2. The numbers of pieces by length (``capacity`` numbers at most) go to the driver. Best-fit decreasing is
   run on these counts: bins with equal room are one entry, so planning costs the same for any number of documents.
3. The plan is a list of runs: pieces ``first`` to ``last`` of a length go ``per`` to a bin, from bin ``bin`` and
   offset ``at``. A piece finds its slot by its rank within its length.

Ranks come from counts per (slab of rows, length), so a length that a third of all pieces have isn't sorted in one task.

Defined cases: null text is empty and gives one piece with the end id alone; repeated rows are packed each for
itself; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise
from .encoding import Encoder
from .words import slices

CAPACITY = 2048
END = 0
_PIECES = "slab long, doc_id long, piece int, start long, length int, ids_crc32 long, local long"


def _cut(tokenizer: str, end: int, capacity: int, keep_ids: bool):
    def run(batches):
        slab, encoder, tail = TaskContext.get().partitionId(), Encoder.of(tokenizer), np.array([end], "<u4").tobytes()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for i, j, data, off in slices(batch.column("text")):
                doc, piece, start, length, crc, local, ids = [], [], [], [], [], [], []
                names = batch.column("doc_id").slice(i, j - i).to_pylist()
                for d, x in zip(names, encoder.encode_bytes(data, off)):
                    x += tail
                    for p, at in enumerate(range(0, len(x), 4 * capacity)):
                        own = x[at : at + 4 * capacity]
                        size = len(own) // 4
                        doc.append(d)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(size)
                        crc.append(zlib.crc32(own))
                        local.append(seen[size])
                        seen[size] += 1
                        if keep_ids:
                            ids.append(np.frombuffer(own, "<i4"))
                arrays = [pa.array(np.full(len(doc), slab, np.int64)), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(local, pa.int64())]
                names = ["slab", "doc_id", "piece", "start", "length", "ids_crc32", "local"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return run


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, first rank, end rank, pieces per bin, first bin, offset)."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs of bins (first bin, number)
    rooms: list[int] = []  # rooms in use, ascending

    def put(left: int, first: int, number: int) -> None:
        if left and number:
            if not room[left]:
                rooms.insert(bisect_right(rooms, left), left)
            room[left].append((first, number))

    out, bins = [], 0
    for length in sorted(histogram, reverse=True):
        rank, rest = 0, histogram[length]
        while rest:
            k = bisect_right(rooms, length - 1)
            left = rooms[k] if k < len(rooms) else capacity
            if k < len(rooms):
                first, number = room[left].pop()
                if not room[left]:
                    rooms.pop(k)
            else:
                first, number = bins, -(-rest // (capacity // length))
                bins += number
            per = left // length
            full = min(number, rest // per)
            at = capacity - left
            if full:
                out.append((length, rank, rank + full * per, per, first, at))
                put(left - per * length, first, full)
                rank, rest, first, number = rank + full * per, rest - full * per, first + full, number - full
            if number and rest:  # one bin takes fewer
                out.append((length, rank, rank + rest, rest, first, at))
                put(left - rest * length, first, 1)
                rest, first, number = 0, first + 1, number - 1
            put(left, first, number)
    return out


def _place(runs):
    def run(batches):
        table = runs.value
        for batch in batches:
            length, rank = np.asarray(batch.column("length")), np.asarray(batch.column("rank"))
            bins, at = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for size in np.unique(length):
                mine = np.flatnonzero(length == size)
                first, per, bin0, offset = table[int(size)]
                k = np.searchsorted(first, rank[mine], "right") - 1
                step = rank[mine] - first[k]
                bins[mine], at[mine] = bin0[k] + step // per[k], offset[k] + step % per[k] * size
            keep = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(bins), pa.array(at)], names=[*keep, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END, keep_ids: bool = False) -> DataFrame:
    """One row per piece: where it comes from and where it lies. ``keep_ids`` adds its ids as ``ids``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = _PIECES + (", ids array<int>" if keep_ids else "")
    pieces = materialise(rows.mapInArrow(_cut(tokenizer, end, capacity, keep_ids), kind), "pieces")
    counts = pieces.groupBy("slab", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table: dict[int, list] = defaultdict(list)
    for length, rank, _, per, first, at in plan(histogram, capacity):
        table[length].append((rank, per, first, at))
    shared = docs.sparkSession.sparkContext.broadcast({k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in table.items()})
    earlier = Window.partitionBy("length").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("slab", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["slab", "length"]).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", *["ids"] * keep_ids, (F.col("base") + F.col("local")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids + ", sequence_id long, offset long"
    return ranked.mapInArrow(_place(shared), schema)


def sequences(docs: DataFrame, tokenizer: str, *, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The packed sequences themselves: ``sequence_id``, ``ids`` and the document of each piece. A group has ``capacity`` ids at most."""
    packed = pack(docs, tokenizer, capacity=capacity, end=end, keep_ids=True)
    own = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    return packed.groupBy("sequence_id").agg(own.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["piece"].alias("piece"), x["offset"].alias("offset"), x["length"].alias("length"))).alias("pieces")
    )
