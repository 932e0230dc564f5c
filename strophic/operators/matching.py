"""Exact occurrences and per-channel scores of a query against aligned notes, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophic.functions.sequence import clamp, eighths, interval_shape, upper_median
from strophic.sources.adapters import stream_order


def intervals(p: Column) -> Column:
    """Differences of neighbours."""
    return F.zip_with(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), F.slice(p, 1, F.greatest(F.size(p) - 1, F.lit(0))), lambda b, a: b - a)


def mean(x: Column) -> Column:
    """Mean of an array; 0 for an empty one."""
    return F.when(F.size(x) == 0, 0.0).otherwise(F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x))


def windows(notes: DataFrame, n: int, columns: tuple[str, ...] = ("p", "d")) -> DataFrame:
    """Every run of ``n`` notes of a stream, as arrays; one sort of each stream."""
    w = stream_order().rowsBetween(0, n - 1)
    out = notes.select("sid", F.col("pos").alias("start"), *(F.collect_list(c).over(w).alias(c) for c in columns))
    return out.filter(F.size(columns[0]) == n)


def time_values(o: Column, d: Column) -> Column:
    """Time from each onset to the next; the last note's own duration."""
    n = F.size(o)
    gaps = F.zip_with(F.slice(o, 2, F.greatest(n - 1, F.lit(0))), F.slice(o, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.greatest(F.lit(1 / 64), b - a))
    return F.concat(gaps, F.array(F.greatest(F.lit(1 / 64), F.element_at(d, -1))))


def exact_occurrences(notes: DataFrame, query_p: list[int], query_rhythm: list[float] | None = None) -> DataFrame:
    """Starts whose intervals (and times between onsets) equal the query's, in any transposition."""
    n = len(query_p)
    own = windows(notes, n, ("p", "d", "o"))
    steps = F.array(*(F.lit(b - a) for a, b in zip(query_p, query_p[1:]))) if n > 1 else F.array().cast("array<int>")
    hit = intervals(F.col("p")) == steps
    if query_rhythm:
        off = F.zip_with(time_values(F.col("o"), F.col("d")), F.array(*(F.lit(float(x)) for x in query_rhythm)), lambda a, b: F.abs(a - b) < 1e-6)
        hit = hit & F.forall(off, lambda x: x)
    return own.filter(hit).select("sid", "start", (F.col("start") + n - 1).alias("end"), (F.element_at("p", 1) - query_p[0]).alias("transposition"))


def transposition_residual(q: Column, c: Column) -> Column:
    """How well pitches agree after the upper-median transposition."""
    moved = F.zip_with(q, c, lambda a, b: F.coalesce(b, a) - a)
    best = upper_median(moved)
    return clamp(100 - mean(F.transform(moved, lambda x: F.least(F.lit(100.0), F.abs(x - best) * 14.0))))


def rhythm_ratios(d: Column) -> Column:
    base = F.coalesce(F.element_at(F.filter(d, lambda x: x > 0), 1), F.lit(1.0))
    return F.transform(d, lambda x: eighths(x / base))


def channel_scores(q_p: Column, q_d: Column, c_p: Column, c_d: Column) -> dict[str, Column]:
    """Pitch, interval, contour and rhythm scores of aligned notes."""
    qi, ci = intervals(q_p), intervals(c_p)
    contour = 100 - mean(F.zip_with(qi, ci, lambda a, b: F.when(F.signum(a) == F.signum(b), 0.0).otherwise(100.0)))
    edge = 100 - mean(F.zip_with(qi, ci, lambda a, b: F.least(F.lit(100.0), F.abs(a - F.coalesce(b, a + 7)) * 14.0)))
    residual = transposition_residual(q_p, c_p)
    rhythm = 100 - mean(F.zip_with(rhythm_ratios(q_d), rhythm_ratios(c_d), lambda a, b: F.least(F.lit(100.0), F.abs(a - F.coalesce(b, a + 8)) * 45.0 / 8)))
    return {"pitch": residual, "interval": clamp(0.6 * edge + 0.4 * residual), "contour": clamp(contour), "rhythm": clamp(rhythm)}


def contour_mode_score(q_p: Column, q_s: Column, c_p: Column, c_s: Column, weight: Column) -> Column:
    """Share of weight on steps and leaps of the same shape."""
    at = lambda p, s: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda k: interval_shape(F.element_at(p, k + 1) - F.element_at(p, k), F.element_at(s, k), F.element_at(s, k + 1)))
    lost = F.zip_with(F.zip_with(at(q_p, q_s), at(c_p, c_s), lambda a, b: a != b), weight, lambda bad, w: F.when(bad, 100.0 * w).otherwise(0.0))
    total = F.aggregate(weight, F.lit(0.0), lambda s, x: s + x)
    return clamp(100 - F.aggregate(lost, F.lit(0.0), lambda s, x: s + x) / F.when(total == 0, 1.0).otherwise(total))


def equality_similarity(q: Column, c: Column) -> Column:
    """Share of all pairs of notes that are equal in both or different in both."""
    n = F.size(q)
    pairs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(F.lit(1), n), lambda j: F.when(j > i, ((F.element_at(q, i) == F.element_at(q, j)) == (F.element_at(c, i) == F.element_at(c, j))).cast("int")))))
    known = F.filter(pairs, lambda x: x.isNotNull())
    return F.when((n != F.size(c)) | (n < 2), 0.0).otherwise(100.0 * F.aggregate(known, F.lit(0), lambda s, x: s + x) / F.size(known))


def true_median(x: Column) -> Column:
    s = F.sort_array(x)
    n = F.size(s)
    low, high = F.element_at(s, F.floor((n + 1) / 2).cast("int")), F.element_at(s, F.floor(n / 2 + 1).cast("int"))
    return (low + high) / 2


def rhythm_shape(q: Column, c: Column) -> Column:
    """Likeness of two lists of time values by short, normal and long classes and by their ratios to the median."""
    scale = lambda x: F.transform(x, lambda v: F.least(F.lit(2.0), v / F.when(true_median(x) == 0, 1.0).otherwise(true_median(x))))
    label = lambda r: F.when(r < 0.75, 0).when(r > 1.5, 2).otherwise(1)
    a, b = scale(q), scale(c)
    classes = F.zip_with(a, b, lambda x, y: F.when(label(x) == label(y), 0.0).when((label(x) == 1) | (label(y) == 1), 55.0).otherwise(100.0))
    ratios = F.zip_with(a, b, lambda x, y: F.least(F.lit(100.0), 60 * F.abs(F.log2(F.greatest(F.lit(0.125), x) / F.greatest(F.lit(0.125), y)))))
    both = clamp(0.5 * (100 - mean(classes)) + 0.5 * (100 - mean(ratios)))
    return F.when((F.size(q) != F.size(c)) | (F.size(q) == 0), 0.0).otherwise(both)


def relocate(notes: DataFrame, query_p: list[int]) -> DataFrame:
    """The window of each stream whose intervals differ least from the query's (first of equals)."""
    n = len(query_p)
    steps = F.array(*(F.lit(b - a) for a, b in zip(query_p, query_p[1:])))
    cost = F.aggregate(F.zip_with(intervals(F.col("p")), steps, lambda a, b: F.abs(a - b)), F.lit(0), lambda s, x: s + x)
    return windows(notes, n, ("p",)).withColumn("cost", cost).groupBy("sid").agg(F.min(F.struct("cost", "start")).alias("x")).select("sid", "x.start", "x.cost")


def occurrence_choice(spans: DataFrame) -> DataFrame:
    """Of a stream's spans the one with most phrase evidence, fewest conflicts, earliest start."""
    w = Window.partitionBy("sid").orderBy(F.col("score").desc(), "conflicts", "start")
    return spans.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")
