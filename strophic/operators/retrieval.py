"""Candidates for a query: posting join, evidence per aligned start, bonuses, and diversified top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Query positions a word of bits holds; one bit more is the next word's first, so that neighbours over the border are seen.
_WORD = 62


def evidence(postings: DataFrame, query_tokens: DataFrame, n_notes: int) -> DataFrame:
    """Evidence per (stream, aligned start). Only the query, a few dozen rows, is broadcast.

    Weights: 50 for five intervals, 3 for three, 1 for others. Starts before a stream's first note count as 0. The positions of
    three-interval tokens that hit are bits, so that one partial aggregation gives their number and ``seeds``, the
    neighbouring ones that agree: each pair is a seed of four intervals.
    """
    q = query_tokens.select("token", F.col("pos").cast("int").alias("qpos"), "kind")
    found = postings.select("token", "sid", "pos").join(F.broadcast(q), "token")
    weight = F.when(F.col("kind") == "i5", 50).when(F.col("kind") == "i", 3).otherwise(1)
    on = lambda c: F.col("kind") == c
    interval = on("i") | on("i5")
    words = [f"bits{k}" for k in range(max(0, n_notes - 1) // _WORD + 1)]

    def bits(k: int) -> Column:
        own = on("i") & F.col("qpos").between(_WORD * k, _WORD * (k + 1))
        return F.bit_or(F.when(own, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("qpos") - _WORD * k)).otherwise(F.lit(0).cast("long")))

    def total(count) -> Column:
        return sum((count(F.col(w)) for w in words), F.lit(0).cast("long"))

    hits = found.groupBy("sid", F.greatest(F.lit(0), F.col("pos") - F.col("qpos")).alias("start")).agg(
        F.sum(weight).alias("evidence"), F.count_if(interval).alias("interval_hits"), F.sum(F.when(interval, weight).otherwise(0)).alias("interval_evidence"),
        F.count_if(on("r")).alias("rhythm_hits"), F.min(F.when(on("i"), F.col("qpos"))).alias("low"), F.max(F.when(on("i"), F.col("qpos"))).alias("high"),
        *(bits(k).alias(w) for k, w in enumerate(words)),
    )
    positions = total(lambda w: F.bit_count(w.bitwiseAND(F.lit((1 << _WORD) - 1).cast("long"))))
    seeds = total(lambda w: F.bit_count(w.bitwiseAND(F.shiftright(w, 1))))
    return hits.withColumns({"positions": positions, "seeds": seeds}).drop(*words)


def split_bonus(positions: Column, low: Column, high: Column, n_notes: int) -> Column:
    """For short tokens that hit far apart: an edit in the middle must not hide a seed."""
    need = max(3, -(-max(1, n_notes - 4) * 6 // 10))
    return F.when((positions >= 2) & (high - low >= need), 650 + 50 * F.least(F.lit(3), positions - 2)).otherwise(0)


def coverage_bonus(hits: Column, total: int) -> Column:
    share = F.least(F.lit(1.0), hits / max(total, 1)) if total else F.lit(0.0)
    long = 1000 * share * share if total >= 4 else F.lit(0.0)
    return F.when(share >= 0.999, 10000.0).when(share >= 0.6, long).otherwise(0.0)


def adjacent_seeds(postings: DataFrame, query_tokens: DataFrame, n_notes: int) -> DataFrame:
    """Number of neighbouring three-interval tokens that agree on (stream, start), where there are some."""
    return evidence(postings, query_tokens.filter("kind = 'i'"), n_notes).filter("seeds > 0").select("sid", "start", "seeds")


def candidates(postings: DataFrame, query_tokens: DataFrame, n_notes: int, n_interval_tokens: int) -> DataFrame:
    """All evidence together: (``sid``, ``start``, ``evidence``)."""
    e = evidence(postings, query_tokens, n_notes)
    total = F.col("evidence") + split_bonus(F.col("positions"), F.col("low"), F.col("high"), n_notes) + 20 * F.col("seeds")
    return e.withColumn("evidence", total + coverage_bonus(F.col("interval_hits"), n_interval_tokens))


def scoped(rows: DataFrame, allowed: list[int] | None = None, excluded: list[int] | None = None) -> DataFrame:
    """Only allowed streams, and none that are excluded."""
    if allowed:
        rows = rows.filter(F.col("sid").isin(list(allowed)))
    return rows.filter(~F.col("sid").isin(list(excluded))) if excluded else rows


def diversified(rows: DataFrame, per_stream: int, limit: int) -> DataFrame:
    """Round-robin over streams: the best of each stream in order of evidence, then the second of each, and so on."""
    own = Window.partitionBy("sid")
    # the literal limit lets Spark cut each stream before the shuffle
    ranked = rows.withColumn("place", F.row_number().over(own.orderBy(F.col("evidence").desc(), "start"))).filter(F.col("place") <= per_stream)
    return ranked.withColumns({"round": F.col("place") - 1, "top": F.max("evidence").over(own)}).drop("place").orderBy("round", F.col("top").desc(), "sid").limit(limit)


def full_scan_streams(lists: list[tuple[DataFrame, str, int]]) -> DataFrame:
    """Union of the top streams of several evidences; a stream keeps its first place."""
    out = None
    for k, (rows, column, limit) in enumerate(lists):
        best = rows.groupBy("sid").agg(F.max(column).alias("value")).filter("value > 0").orderBy(F.col("value").desc(), "sid").limit(limit)
        own = best.withColumn("list", F.lit(k)).withColumn("place", F.row_number().over(Window.orderBy(F.col("value").desc(), "sid")))
        out = own if out is None else out.unionByName(own)
    first = Window.partitionBy("sid").orderBy("list")
    return out.withColumn("n", F.row_number().over(first)).filter("n = 1").select("sid", "list", "place", "value")


def deep_seeds(rows: DataFrame, streams: DataFrame, per_stream: int = 4) -> DataFrame:
    """The best starts of each fully scanned stream."""
    own = rows.join(streams.select("sid"), "sid", "left_semi")
    within = Window.partitionBy("sid").orderBy(F.col("evidence").desc(), "start")
    return own.withColumn("n", F.row_number().over(within)).filter(F.col("n") <= per_stream).select("sid", "start", "evidence", "n")
