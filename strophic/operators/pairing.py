"""Targets and symbols paired with notes by their place in the score, the closest passage where that fails, and bars filled with rests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophic.operators.matching import intervals, windows
from strophic.sources.adapters import stream_order

#: Steps of a beat. Times within half a step are one place; a step is under 1e-6 of a beat, and a note value of an odd
#: divisor times a power of two up to the 20th never lies on the border between two steps, so that rounding can't part equal times.
GRID = 1 << 20
#: Lengths that rests are written in, in quarters.
REST_VALUES = [4.0, 3.0, 2.0, 1.5, 1.0, 0.5, 0.25, 0.125, 0.0625]


def place(time: Column) -> Column:
    return F.round(time * GRID).cast("long")


def pair(targets: DataFrame, notes: DataFrame, keys: list[str], time: str, target_order: list[str], note_order: list[str]) -> DataFrame:
    """Targets with the notes of equal keys and place: the first target takes the first note, each note counts once.

    The columns are ``keys`` and all others of both tables but the time, which must have different names. Targets without a note are left out.
    """
    own = [*keys, "place"]

    def turns(rows: DataFrame, order: list[str]) -> DataFrame:
        rows = rows.withColumn("place", place(F.col(time))).drop(time)
        return rows.withColumn("turn", F.row_number().over(Window.partitionBy(*own).orderBy(*order)))

    return turns(targets, target_order).join(turns(notes, note_order), [*own, "turn"]).drop("place", "turn")


def closest_window(notes: DataFrame, query_p: list[int]) -> DataFrame:
    """Of each stream, the first run as long as the query with the least sum of interval differences; a wrong direction costs 8 more."""
    steps = F.array(*(F.lit(b - a) for a, b in zip(query_p, query_p[1:]))).cast("array<int>")
    off = F.zip_with(intervals(F.col("p")), steps, lambda a, b: F.when(F.signum(a) == F.signum(b), 0).otherwise(8) + F.abs(F.abs(a) - F.abs(b)))
    cost = F.aggregate(off, F.lit(0), lambda s, x: s + x).cast("long")
    best = windows(notes, len(query_p), ("p",)).groupBy("sid").agg(F.min(F.struct(cost.alias("cost"), "start")).alias("best"))
    return best.select("sid", "best.start", "best.cost")


def symbols_at(notes: DataFrame, symbols: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Notes with the sorted names of the symbols (``symbol``) of equal keys and place; an empty array where there is none."""
    found = symbols.withColumn("place", place(F.col(time))).groupBy(*keys, "place").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    with_place = notes.withColumn("place", place(F.col(time)))
    none = F.array().cast("array<string>")
    return with_place.join(found, [*keys, "place"], "left").drop("place").withColumn("symbols", F.coalesce("symbols", none))


def lookup(items: DataFrame, key: str, names: list[Column], known: DataFrame) -> DataFrame:
    """For each item the ``value`` of the first of its names that ``known`` (``name``, ``value``, a name once) has; null if none.

    All names go through one join, not one join a name.
    """
    asked = items.select(key, F.posexplode(F.array(*names)).alias("turn", "name"))
    hits = asked.join(known.select("name", "value"), "name", "left")
    return hits.groupBy(key).agg(F.min_by("value", F.when(F.col("value").isNotNull(), F.col("turn"))).alias("value"))


def filled_bars(notes: DataFrame, beats: float = 4.0) -> DataFrame:
    """Notes (``sid``, ``pos``, ``m``, ``b``, ``d``) split at bar lines, and rests wherever a bar of the stream is silent.

    ``part`` counts a note's pieces from 0 and is null for rests, as is ``pos``. Pieces under a thousandth of a beat are dropped;
    a silence is written with the longest rests that fit, and what is shorter than the shortest stays out. An empty table gives no rows.
    """
    begin, end = F.col("b") - 1, F.col("b") - 1 + F.col("d")
    last = F.greatest(F.lit(0), F.ceil((end - 0.001) / beats) - 1).cast("int")
    pieces = notes.withColumn("part", F.explode(F.sequence(F.lit(0), last)))
    start = F.greatest(begin, F.col("part") * beats)
    pieces = pieces.select("sid", (F.col("m") + F.col("part")).alias("m"), (start - F.col("part") * beats + 1).alias("b"), (F.least(end, (F.col("part") + 1) * beats) - start).alias("d"), "pos", "part").filter("d > 0.001")
    # a mark at the end of each bar closes its last silence, and the whole of an empty bar
    bars = pieces.groupBy("sid").agg(F.min("m").alias("low"), F.max("m").alias("high")).select("sid", F.explode(F.sequence("low", "high")).alias("m"), F.lit(beats + 1).alias("b"), F.lit(0.0).alias("d"))
    before = Window.partitionBy("sid", "m").orderBy("b", F.col("part").isNull(), "pos", "part").rowsBetween(Window.unboundedPreceding, -1)
    marks = pieces.unionByName(bars, allowMissingColumns=True).withColumn("cursor", F.greatest(F.lit(1.0), F.max(F.col("b") + F.col("d")).over(before)))

    def written(state: Column, value: Column) -> Column:
        n = F.floor((state["left"] + 0.0001) / value).cast("int")
        return F.struct((state["left"] - n * value).alias("left"), F.concat(state["out"], F.array_repeat(value, n)).alias("out"))

    first = F.struct((F.col("b") - F.col("cursor")).alias("left"), F.array().cast("array<double>").alias("out"))
    values = F.aggregate(F.array(*(F.lit(x) for x in REST_VALUES)), first, written, lambda s: s["out"])
    rests = marks.filter(F.col("b") - F.col("cursor") > 0.001).withColumn("values", values).select("sid", "m", "cursor", "values", F.posexplode("values").alias("k", "d"))
    at = F.col("cursor") + F.aggregate(F.slice("values", F.lit(1), F.col("k")), F.lit(0.0), lambda s, x: s + x)
    return pieces.unionByName(rests.select("sid", "m", at.alias("b"), "d"), allowMissingColumns=True)


def roles(boundaries: DataFrame, notes: DataFrame) -> DataFrame:
    """How surely each note opens a phrase (the boundary before it) and closes one (the boundary after it)."""
    marks = notes.select("sid", "pos").join(boundaries.select("sid", "pos", "strength"), ["sid", "pos"], "left")
    opening = F.coalesce("strength", F.lit(0.0))
    return marks.select("sid", "pos", opening.alias("opening"), F.lead(opening, 1, 0.0).over(stream_order()).alias("closing"))


def phrase_evidence(roles_: DataFrame, opening: list[float], closing: list[float], attack: bool = True, sure: float = 0.55) -> DataFrame:
    """Score (0 to 100) and conflicts of the phrase roles of each run as long as the query's.

    Of inner notes, an equal sure role adds 8, a missing one takes 12, one too many 6; a sure opening at the start adds 15, a sure
    closing at the end 10; a start that closes without opening takes 35 if the query starts with an attack.
    """
    runs = windows(roles_, len(opening), ("opening", "closing"))
    score, conflicts = F.lit(70.0), F.lit(0)
    for role, wanted in (("opening", opening), ("closing", closing)):
        for k in range(1, len(wanted) - 1):
            has = F.element_at(role, k + 1) >= sure
            score += F.when(has, 8 if wanted[k] >= sure else -6).otherwise(-12 if wanted[k] >= sure else 0)
            conflicts += (has != F.lit(wanted[k] >= sure)).cast("int")
    score += F.when(F.element_at("opening", 1) >= sure, 15).otherwise(0) + F.when(F.element_at("closing", -1) >= sure, 10).otherwise(0)
    late = F.lit(attack) & (F.element_at("closing", 1) > 0.6) & (F.element_at("opening", 1) < 0.3)
    score, conflicts = score - F.when(late, 35).otherwise(0), conflicts + late.cast("int")
    return runs.select("sid", "start", F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)).alias("score"), conflicts.alias("conflicts"))
