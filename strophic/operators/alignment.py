"""Alignments by dynamic programming: nested folds over arrays for bounded windows, and plain functions for paths.

The folds stay in the JVM and give costs; the functions give costs and paths and run in Arrow batches over the candidates
that survive. Both follow the same recurrences, and tests hold them against each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the search's scoring.
SIMILARITY_SCALE, RHYTHM_SCALE, GLOBAL_GAP = 0.48, 0.42, 0.48


def local_cost(q: Column, c: Column, gap_query: Column | float, gap_candidate: Column | float, substitution) -> Column:
    """Least cost of aligning all of ``q`` within ``c``; a prefix and a suffix of ``c`` are free.

    ``substitution(i, j)`` gives the cost for element i of the query and j of the candidate, both from 1.
    """
    zero = F.transform(F.sequence(F.lit(0), F.size(c)), lambda _: F.lit(0.0))

    def next_row(row: Column, i: Column) -> Column:
        first = F.array(F.element_at(row, 1) + gap_query)

        def cell(done: Column, j: Column) -> Column:
            best = F.least(F.element_at(row, j) + substitution(i, j), F.element_at(done, j) + gap_candidate, F.element_at(row, j + 1) + gap_query)
            return F.concat(done, F.array(best))

        return F.aggregate(F.sequence(F.lit(1), F.size(c)), first, cell)

    return F.array_min(F.aggregate(F.sequence(F.lit(1), F.size(q)), zero, next_row))


def interval_substitution(q_p: Column, c_p: Column):
    """A seventh of the difference of intervals, at most 1; direction changes cost .3 of it more."""

    def cost(i: Column, j: Column) -> Column:
        a = F.element_at(q_p, i) - F.element_at(q_p, F.greatest(i - 1, F.lit(1)))
        b = F.when(j > 1, F.element_at(c_p, j) - F.element_at(c_p, F.greatest(j - 1, F.lit(1)))).otherwise(99)
        return F.when(i == 1, 0.0).otherwise(0.7 * F.least(F.lit(1.0), F.abs(a - b) / 7.0) + F.when(F.signum(a) == F.signum(b), 0.0).otherwise(0.3))

    return cost


def duration_distance(a: float, b: float) -> float:
    """Distance of two time values; an eighth of an octave either way is free."""
    off = max(0.0, abs(math.log2(max(0.03125, a) / max(0.03125, b))) - 0.125)
    return min(1.5, off + 1.35 * off * off)


def rhythm_dtw(q: list[float], c: list[float]) -> tuple[float, float]:
    """Cost and similarity of two lists of time values: 1:1, 1:2 and 2:1 steps near the diagonal, tempo taken out."""
    n, m = len(q), len(c)
    if not n or not m:
        return math.inf, 0.0
    tempo = (sum(c) / sum(q) if sum(q) else 0) or 1.0
    c = [x / tempo for x in c]
    rows = [[math.inf] * (m + 1) for _ in range(n + 1)]
    rows[0][0] = 0.0
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            if abs(i / n - j / m) > 0.22 + 1 / max(n, m):
                continue
            ways = [rows[i - 1][j - 1] + duration_distance(q[i - 1], c[j - 1])]
            if j >= 2:
                ways.append(rows[i - 1][j - 2] + duration_distance(q[i - 1], c[j - 2] + c[j - 1]) + 0.14)
            if i >= 2:
                ways.append(rows[i - 2][j - 1] + duration_distance(q[i - 2] + q[i - 1], c[j - 1]) + 0.14)
            rows[i][j] = min(ways)
    cost = rows[n][m]
    similarity = 0.0 if math.isinf(cost) else min(100.0, 100 * math.exp(-cost / max(n, m) / RHYTHM_SCALE))
    return cost, similarity


def align(n: int, m: int, substitute, insert, delete, free_ends: bool = True) -> dict:
    """Alignment with its path. ``substitute(i, j)``, ``insert(j)``, ``delete(i)`` from 0; ties: substitution, insertion, deletion.

    A path step is (query index or None, candidate index or None, cost, type). With free ends a prefix and a suffix of the
    candidate cost nothing, and the earliest cheapest end counts.
    """
    cost = [[0.0] * (m + 1) for _ in range(n + 1)]
    came: list[list[tuple | None]] = [[None] * (m + 1) for _ in range(n + 1)]
    if not free_ends:
        for j in range(1, m + 1):
            step = insert(j - 1)
            cost[0][j], came[0][j] = cost[0][j - 1] + step, (0, j - 1, "insertion", step)
    for i in range(1, n + 1):
        step = delete(i - 1)
        cost[i][0], came[i][0] = cost[i - 1][0] + step, (i - 1, 0, "deletion", step)
        for j in range(1, m + 1):
            s, a, b = substitute(i - 1, j - 1), insert(j - 1), step
            options = [(cost[i - 1][j - 1] + s, 0, (i - 1, j - 1, "match" if s < 0.18 else "substitution", s)), (cost[i][j - 1] + a, 1, (i, j - 1, "insertion", a)), (cost[i - 1][j] + b, 2, (i - 1, j, "deletion", b))]
            cost[i][j], _, came[i][j] = min(options, key=lambda x: (x[0], x[1]))
    end = min(range(m + 1), key=lambda j: (cost[n][j], j)) if free_ends else m
    path, i, j = [], n, end
    while (i > 0 or not free_ends and j > 0) and came[i][j]:
        pi, pj, kind, c = came[i][j]
        path.append((None if kind == "insertion" else i - 1, None if kind == "deletion" else j - 1, c, kind))
        i, j = pi, pj
    path.reverse()
    mapped = [y for x, y, *_ in path if x is not None and y is not None]
    coverage = len(mapped) / max(1, n)
    similarity = max(0.0, min(100.0, 100 * math.exp(-cost[n][end] / max(1, n) / SIMILARITY_SCALE) * coverage))
    return {"path": path, "start": min(mapped, default=0), "end": max(mapped, default=0), "coverage": coverage, "cost": cost[n][end], "similarity": similarity}
