"""Chords and cadences: sounding notes of segments, template fits, merged segments, functions and cadence evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Chord qualities as semitones above the root.
TEMPLATES = {"major": [0, 4, 7], "minor": [0, 3, 7], "diminished": [0, 3, 6], "dominant7": [0, 4, 7, 10]}


def dedupe(events: DataFrame) -> DataFrame:
    """One event per stream, onset, pitch and duration (the last); without cues and events of no duration."""
    order = Window.partitionBy("sid", "o", "p", "d").orderBy(F.col("pos").desc())
    return events.filter("NOT cue AND d > 0").withColumn("n", F.row_number().over(order)).filter("n = 1").drop("n")


def segments(events: DataFrame, key: str = "src") -> DataFrame:
    """Atoms between all onsets and ends of a work."""
    points = events.select(key, F.explode(F.array(F.col("o"), F.col("o") + F.col("d"))).alias("at")).distinct()
    w = Window.partitionBy(key).orderBy("at")
    return points.select(key, F.col("at").alias("begin"), F.lead("at").over(w).alias("end")).filter("end IS NOT NULL")


def sounding(segs: DataFrame, events: DataFrame, key: str = "src", bin_size: float = 2.0) -> DataFrame:
    """Pitch classes and bass of the notes that sound in the middle of each segment.

    A range join through bins: a note is copied to the bins that it reaches, a segment lies in its middle's bin, and the join
    is an equality of key and bin. Notes are short, so copies are few.
    """
    mid = segs.withColumn("mid", (F.col("begin") + F.col("end")) / 2).withColumn("bin", F.floor(F.col("mid") / bin_size))
    reach = events.select(key, "o", "d", "p", F.explode(F.sequence(F.floor(F.col("o") / bin_size), F.floor((F.col("o") + F.col("d")) / bin_size))).alias("bin"))
    hit = mid.join(reach, [key, "bin"]).filter("o <= mid AND mid < o + d")
    return hit.groupBy(key, "begin", "end").agg(F.sort_array(F.collect_set(F.pmod("p", F.lit(12)))).alias("pcs"), F.min("p").alias("low"))


def fit(segments_with_notes: DataFrame, key: str = "src") -> DataFrame:
    """The best of 12 roots x 4 templates for each segment of at least two pitch classes.

    Precision, completeness, bass and at most two extra notes count; fewer than two matches cost 0.3, a dominant seventh of fewer than
    three pitch classes or without its third 0.18. Ties: fewer missing tones, then the lower root. A major or minor chord of which
    neither third sounds is ``third-ambiguous`` and loses 0.08.
    """
    tones = lambda root, steps: F.array(*(F.lit((root + x) % 12) for x in steps))
    partner = {"major": "minor", "minor": "major"}
    options = F.array(*(F.struct(F.lit(r).alias("root"), F.lit(q).alias("quality"), F.lit(k).alias("order"), tones(r, t).alias("tones"), tones(r, TEMPLATES[partner.get(q, q)]).alias("other")) for r in range(12) for k, (q, t) in enumerate(TEMPLATES.items())))
    x = segments_with_notes.filter(F.size("pcs") >= 2).withColumn("t", F.explode(options))  # 48 rows a segment
    clamped = lambda c: F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)), 6)
    has = lambda step: F.array_contains("pcs", F.pmod(F.col("t.root") + step, F.lit(12)))

    def score(own: str) -> Column:
        hits = F.size(F.array_intersect("pcs", own))
        plain = 0.52 * hits / F.size("pcs") + 0.36 * hits / F.size(own) + F.when(F.pmod("low", F.lit(12)) == F.col("t.root"), 0.12).otherwise(0.0) - 0.08 * F.least(F.lit(2), F.size("pcs") - hits)
        seventh = (F.col("t.quality") == "dominant7") & ((F.size("pcs") < 3) | ~has(4))
        return clamped(plain - F.when(hits < 2, 0.3).otherwise(0.0) - F.when(seventh, 0.18).otherwise(0.0))

    missing = F.size("t.tones") - F.size(F.array_intersect("pcs", "t.tones"))
    scored = x.withColumns({"fit": score("t.tones"), "missing": missing})
    best = Window.partitionBy(key, "begin").orderBy(F.col("fit").desc(), "missing", "t.root", "t.order")
    first = scored.withColumn("n", F.row_number().over(best)).filter("n = 1")
    third = F.when(F.col("t.quality") == "major", has(4)).otherwise(has(3))
    ambiguous = F.col("t.quality").isin(*partner) & (F.abs(score("t.other") - F.col("fit")) < 1e-6) & ~third
    quality, own = F.when(ambiguous, "third-ambiguous").otherwise(F.col("t.quality")), F.when(ambiguous, clamped(F.col("fit") - 0.08)).otherwise(F.col("fit"))
    return first.select(key, "begin", "end", "pcs", F.col("t.root").alias("root"), quality.alias("quality"), own.alias("fit"))


def merge(chords: DataFrame, key: str = "src") -> DataFrame:
    """Neighbouring segments with the same chord become one; those that then fit worse than 0.38 go.

    The fit of merged segments is the running mean of the fit so far and the next one.
    """
    w = Window.partitionBy(key).orderBy("begin")
    new = ~(F.col("root").eqNullSafe(F.lag("root").over(w)) & F.col("quality").eqNullSafe(F.lag("quality").over(w)) & F.col("begin").eqNullSafe(F.lag("end").over(w)))
    island = chords.withColumn("island", F.sum(new.cast("int")).over(w))
    fits = F.transform(F.sort_array(F.collect_list(F.struct("begin", "fit"))), lambda x: x["fit"])
    merged = island.groupBy(key, "island").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.first("root").alias("root"), F.first("quality").alias("quality"), F.count(F.lit(1)).alias("atoms"), fits.alias("fits")).drop("island")
    running = F.aggregate(F.slice("fits", 2, F.size("fits")), F.element_at("fits", 1), lambda s, x: F.round((s + x) / 2, 6))
    return merged.filter(running >= 0.38).drop("fits")


def function_of(root: Column, quality: Column, tonic: int, minor: bool = False) -> Column:
    """Tonic, subdominant, dominant or other, by the degree of a chord's root."""
    degree = F.pmod(root - tonic, F.lit(12))
    tonics = [0, 9, 4] if not minor else [0, 3, 8]
    return F.when((degree == 7) | ((degree == 11) & (quality == "diminished")), "dominant").when(degree.isin(5, 2), "subdominant").when(degree.isin(*tonics), "tonic").otherwise("other")


def cadences(chords: DataFrame, tonic: int, key: str = "src") -> DataFrame:
    """What each change of chord could close: authentic, half, deceptive, plagal, or nothing clear."""
    w = Window.partitionBy(key).orderBy("begin")
    degree = F.pmod(F.col("root") - tonic, F.lit(12))
    x = chords.withColumns({"degree": degree, "function": function_of(F.col("root"), F.col("quality"), tonic)})
    x = x.withColumns({"before": F.lag("function").over(w), "before_root": F.lag("degree").over(w)})
    kind = (
        F.when((F.col("before") == "dominant") & (F.col("degree") == 0), F.when(F.col("before_root") == 7, "authentic").otherwise("imperfect"))
        .when((F.col("before") == "dominant") & F.col("degree").isin(9, 8), "deceptive").when((F.col("before") == "subdominant") & (F.col("degree") == 0), "plagal")
        .when((F.col("function") == "dominant") & (F.col("before") != "dominant"), "half").otherwise("none")
    )
    return x.filter("before IS NOT NULL").select(key, "begin", "end", "root", "quality", "function", kind.alias("cadence"))


def around_boundaries(boundaries: DataFrame, chords: DataFrame, key: str = "src", before: float = 8.0, after: float = 2.0, recent: float = 2.0) -> DataFrame:
    """For each boundary (key, ``at``) the chords near it and the one it arrives at.

    An arrival begins at the boundary, else sounds over it, else has ended at most ``recent`` quarters earlier. Overlaps are found
    through bins as long as the window before the boundary, so the join is an equality.
    """
    size = before
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / size), F.floor(b / size)))
    b = boundaries.select(key, "at", spread(F.col("at") - before, F.col("at") + after).alias("bin"))
    c = chords.select(key, "begin", "end", "root", "quality", spread(F.col("begin"), F.col("end")).alias("bin"))
    near = b.join(c, [key, "bin"]).filter((F.col("end") > F.col("at") - before) & (F.col("begin") < F.col("at") + after)).drop("bin").distinct()
    kind = F.when(F.col("begin") == F.col("at"), 1).when((F.col("begin") < F.col("at")) & (F.col("end") > F.col("at")), 2).when((F.col("end") <= F.col("at")) & (F.col("at") - F.col("end") <= recent), 3)
    best = F.min(F.when(kind.isNotNull(), F.struct(kind.alias("kind"), (-F.col("begin")).alias("late"), "root", "quality")))
    found = near.groupBy(key, "at").agg(F.count(F.lit(1)).alias("chords"), best.alias("x"))
    return found.select(key, "at", "chords", F.col("x.kind").alias("arrival"), F.col("x.root").alias("root"), F.col("x.quality").alias("quality"))
