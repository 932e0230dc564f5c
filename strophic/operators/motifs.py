"""Repeated motifs: windows grouped by their intervals, scored, without motifs inside better ones; families and importance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophic.functions.sequence import clamp
from strophic.operators.matching import intervals, windows


def motif_windows(notes: DataFrame, low: int = 6, high: int = 12) -> DataFrame:
    """All windows of each length with their interval key, pitch statistics and span."""
    out = None
    for n in range(low, high + 1):
        own = windows(notes, n, ("p", "d")).withColumn("length", F.lit(n))
        out = own if out is None else out.unionByName(own)
    steps = intervals(F.col("p"))
    distinct = F.array_distinct("p")
    top = F.array_max(F.transform(distinct, lambda x: F.size(F.filter("p", lambda y: y == x))))
    return out.select(
        "sid", "start", "length", F.array_join(F.transform(steps, lambda x: x.cast("string")), ",").alias("key"), F.aggregate("d", F.lit(0.0), lambda s, x: s + x).alias("span"),
        F.size(distinct).alias("distinct"), (top / F.col("length")).alias("dominant"), (F.size(F.filter(steps, lambda x: x == 0)) / (F.col("length") - 1)).alias("same"),
    )


def ranked_motifs(notes: DataFrame, low: int = 6, high: int = 12, top: int = 8) -> DataFrame:
    """The best repeated motifs of each stream."""
    w = motif_windows(notes, low, high)
    # statistics are those of the last occurrence, the example is the first
    g = w.groupBy("sid", "key", "length").agg(F.count(F.lit(1)).alias("count"), F.sum("span").alias("total"), F.min("start").alias("first"), F.max_by(F.struct("distinct", "dominant", "same"), "start").alias("s"))
    kept = g.filter((F.col("count") >= 2) & (F.col("s.distinct") >= F.least(F.lit(4), F.ceil(F.col("length") * 0.6))) & (F.col("s.dominant") < 0.5) & (F.col("s.same") <= 0.34))
    diversity = 0.55 * (F.col("s.distinct") / F.col("length")) + 0.45 * (1 - F.col("s.same"))
    size = F.when(F.col("length").between(8, 10), 1.25).when(F.col("length") >= 11, 1.08).otherwise(0.88)
    score = F.col("count") * (1 + 0.18 * (F.col("length") - 6)) * F.log2(2 + F.col("total") / F.col("count")) * (0.45 + 0.55 * diversity) * size
    scored = kept.select("sid", "key", "length", "count", "first", F.round(score, 6).alias("score"))
    inner, outer = scored.alias("a"), scored.alias("b")
    inside = F.expr("a.sid = b.sid AND b.length > a.length AND b.score >= a.score AND instr(concat(',', b.key, ','), concat(',', a.key, ',')) > 0")
    alone = inner.join(outer, inside, "left_anti")
    order = Window.partitionBy("sid").orderBy(F.col("score").desc(), F.col("length").desc(), "first")
    return alone.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def importance(role: Column, occurrences: Column, motif_length: Column, stream_length: Column) -> Column:
    share = clamp(100 * occurrences * motif_length / F.greatest(stream_length, F.lit(1)))
    repetition = clamp(100 * F.log2(1 + occurrences) / F.log2(F.lit(9.0)))
    return clamp(0.5 * (55 + 45 * clamp(role * 100) / 100) + 0.35 * repetition + 0.15 * share)


def family_summary(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """Spans (``sid``, ``family``, ``start``, ``end``) as counts, covered notes, coverage and variants of each family."""
    covered = spans.withColumn("at", F.explode(F.sequence("start", "end"))).groupBy("sid", "family").agg(F.count_distinct("at").alias("covered"))
    per = spans.groupBy("sid", "family").agg(F.count_distinct("start", "end").alias("spans"), F.count_distinct((F.col("end") - F.col("start")).alias("l")).alias("variants"))
    return per.join(covered, ["sid", "family"]).join(lengths, "sid").select("sid", "family", "spans", "variants", "covered", F.round(100 * F.col("covered") / F.col("n"), 6).alias("coverage"))


def histograms(rows: DataFrame, key: str, column: str, top: int = 8) -> DataFrame:
    """The most frequent values of each key, ties by value."""
    counts = rows.groupBy(key, column).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(key).orderBy(F.col("n").desc(), column)
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
