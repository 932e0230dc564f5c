"""Motifs compared by a global alignment that knows no transposition: evidence for each channel, and what was changed."""

from __future__ import annotations

import math
from statistics import fmean, median_high

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strophic.operators.alignment import GLOBAL_GAP, align

#: Shares of a pair's cost, and the cost from which a pair is a substitution.
PAIR_COST = {"interval": 0.4, "contour": 0.18, "shape": 0.12, "rhythm": 0.25, "metric": 0.05}
SUBSTITUTED = 0.16
#: The shortest time value, and shares in the evidence.
SHORTEST = 0.0625
SIMILARITY = {"melodic": 0.4, "shape": 0.2, "rhythm": 0.25, "coverage": 0.15}

FIELDS = ("similarity", "melodic", "interval", "contour", "shape", "rhythm", "coverage", "matched")


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def _direction(step: float) -> int:
    return (step > 0) - (step < 0)


def _size(step: float) -> int:
    """Unison, step or leap."""
    return 0 if step == 0 else 1 if abs(step) <= 2 else 2


def _octaves(a: float, b: float) -> float:
    return min(1.0, abs(math.log2(max(SHORTEST, a) / max(SHORTEST, b))) / 2)


def _relative(values: list[float]) -> list[float]:
    unit = median_high(values) if values else 1.0
    return [x / unit for x in values]


class Motif:
    """Notes (``p``, ``d``, ``o``, perhaps ``metric``) with time values relative to the motif's own medians."""

    def __init__(self, notes: list[dict]):
        self.notes = notes
        self.p, times = [n["p"] for n in notes], [n["o"] for n in notes]
        self.step = [0, *(b - a for a, b in zip(self.p, self.p[1:]))]
        self.length = _relative([max(SHORTEST, n["d"] or SHORTEST) for n in notes])
        self.distance = [1.0, *_relative([max(SHORTEST, b - a) for a, b in zip(times, times[1:])])]
        self.metric = [n.get("metric") for n in notes]

    def rhythm(self, i: int, other: Motif, j: int) -> float:
        return 0.55 * _octaves(self.length[i], other.length[j]) + 0.45 * _octaves(self.distance[i], other.distance[j])

    def cost(self, i: int, other: Motif, j: int) -> float:
        if not i or not j:
            return 0.18 * _octaves(self.length[i], other.length[j])
        a, b, x, y = self.step[i], other.step[j], self.metric[i], other.metric[j]
        parts = {
            "interval": min(1.0, abs(a - b) / 7), "contour": 0.0 if _direction(a) == _direction(b) else 0.8, "shape": 0.0 if _size(a) == _size(b) else 0.45,
            "rhythm": self.rhythm(i, other, j), "metric": 0.0 if x is None or y is None else min(1.0, abs(x - y)),
        }
        return sum(PAIR_COST[k] * v for k, v in parts.items())


def _percent(costs: list[float]) -> int:
    return _half_up(100 * max(0.0, min(1.0, 1 - (fmean(costs) if costs else 0.0))))


def compare(left: list[dict], right: list[dict]) -> dict:
    """Percentages of ``FIELDS``, the transformations that make ``right`` of ``left``, and the path of (left, right, kind).

    Equally cheap paths: a pair first, then a deletion, then an insertion. Without notes on a side everything is 0 and empty.
    """
    if not left or not right:
        return dict.fromkeys(FIELDS, 0) | {"transformations": [], "path": []}
    a, b = Motif(left), Motif(right)
    # ``align`` prefers what only its candidate has: that is the left side here
    steps = align(len(right), len(left), lambda j, i: a.cost(i, b, j), lambda i: GLOBAL_GAP, lambda j: GLOBAL_GAP, free_ends=False)["path"]
    path = [(i, j, "deletion" if j is None else "insertion" if i is None else "substitution" if c > SUBSTITUTED else "match") for j, i, c, _ in steps]
    pairs = [(i, j) for i, j, _ in path if i is not None and j is not None]
    moves = [(a.p[i2] - a.p[i1], b.p[j2] - b.p[j1]) for (i1, j1), (i2, j2) in zip(pairs, pairs[1:])]
    turned, resized = [float(_direction(x) != _direction(y)) for x, y in moves], [float(_size(x) != _size(y)) for x, y in moves]
    out = {"interval": _percent([min(1.0, abs(x - y) / 7) for x, y in moves]), "contour": _percent(turned), "rhythm": _percent([a.rhythm(i, b, j) for i, j in pairs])}
    out["shape"] = _percent([0.65 * x + 0.35 * y for x, y in zip(turned, resized)])
    out |= {"coverage": _half_up(100 * len(pairs) / max(len(left), len(right))), "melodic": _half_up(0.65 * out["interval"] + 0.35 * out["contour"]), "matched": len(pairs)}
    out["similarity"] = _half_up(sum(share * out[k] for k, share in SIMILARITY.items()))
    return out | {"transformations": _transformations(a, b, path, pairs, out), "path": path}


def _transformations(a: Motif, b: Motif, path: list, pairs: list, found: dict) -> list[str]:
    kinds = {kind for *_, kind in path}
    shift = b.p[pairs[0][1] if pairs else 0] - a.p[pairs[0][0] if pairs else 0]
    repeated = any(now == "insertion" and before is not None and b.p[before] == b.p[j] for (_, before, _), (_, j, now) in zip(path, path[1:]))
    longer = b.p[-1] - a.p[-1] == shift and abs(a.notes[-1]["d"] - b.notes[-1]["d"]) > 0.25
    tags = {
        "transposition": shift != 0, "ornament-insertion": "insertion" in kinds, "note-deletion": "deletion" in kinds, "pitch-substitution": found["interval"] < 99,
        "rhythm-variation": found["rhythm"] < 99, "repeat-expansion": repeated, "terminal-extension": longer,
    }
    return [tag for tag, holds in tags.items() if holds]


_OUT = pa.schema([("sid", pa.int64()), ("start", pa.int64()), *((x, pa.int32()) for x in FIELDS), ("transformations", pa.string())])


def _compared(base: list[dict]):
    def run(batches):
        for batch in batches:
            rows = [r | compare(base, r["notes"]) for r in batch.to_pylist()]
            for r in rows:
                r["transformations"] = ",".join(r["transformations"])
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in _OUT.names} for r in rows], schema=_OUT)

    return run


def compare_passages(notes: DataFrame, passages: DataFrame, base: list[dict], length: int) -> DataFrame:
    """Each passage (``sid``, ``start``) of ``length`` notes against the notes of ``base``; a row has one passage's notes.

    Passages beyond a stream's end are compared with the notes they have; those without any give no rows.
    """
    at = passages.select("sid", "start", F.explode(F.sequence(F.col("start"), F.col("start") + length - 1)).alias("pos"))
    own = at.join(notes.select("sid", "pos", "p", "d", "o"), ["sid", "pos"]).groupBy("sid", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "p", "d", "o"))).alias("notes"))
    kinds = ", ".join(f"{x} int" for x in FIELDS)
    return own.select(F.col("sid").cast("long").alias("sid"), F.col("start").cast("long").alias("start"), "notes").mapInArrow(_compared(base), f"sid long, start long, {kinds}, transformations string")
