"""Features of note streams as window expressions: intervals, contours, rhythm ratios, roles, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophic.sources.adapters import stream_order


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def eighths(x: Column) -> Column:
    """A ratio in whole eighths."""
    return half_up(x * 8).cast("int")


def clamp(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def upper_median(values: Column) -> Column:
    """The element at half the length of the sorted array."""
    return F.element_at(F.sort_array(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


def contour5(interval: Column) -> Column:
    return F.when(interval == 0, "SAME").when(interval > 2, "LU").when(interval > 0, "SU").when(interval < -2, "LD").when(interval < 0, "SD")


def letter(spelling: Column) -> Column:
    """0 to 6 for C to B; -1 for none."""
    return F.instr(F.lit("CDEFGAB"), F.upper(F.substring(spelling, 1, 1))) - 1


def interval_shape(interval: Column, spelling: Column, following: Column) -> Column:
    """S, STEP_U, STEP_D, LEAP_U or LEAP_D; three semitones are a step between neighbouring letters only."""
    a, b = letter(spelling), letter(following)
    near = (a >= 0) & (b >= 0) & F.pmod(b - a, F.lit(7)).isin(1, 6)
    step = (F.abs(interval) <= 2) | ((F.abs(interval) == 3) & near)
    return F.when(interval == 0, "S").otherwise(F.concat(F.when(step, "STEP").otherwise("LEAP"), F.when(interval > 0, "_U").otherwise("_D")))


def features(notes: DataFrame) -> DataFrame:
    """Per note: interval to the next note and its classes, ratios of its duration, pitch from the first, time to the next."""
    w = stream_order()
    whole = Window.partitionBy("sid")
    up = F.lead("p").over(w) - F.col("p")
    out = notes.withColumn("interval", up)
    first_d = F.first(F.when(F.col("d") > 0, F.col("d")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return out.select(
        *notes.columns, "interval", F.signum("interval").cast("int").alias("c3"), contour5(F.col("interval")).alias("c5"),
        interval_shape(F.col("interval"), F.col("spelling"), F.lead("spelling").over(w)).alias("shape"),
        F.when(F.col("interval") == 0, 0).when(F.abs("interval") <= 2, 1).when(F.col("interval").isNotNull(), 2).alias("iclass"),
        eighths(F.col("d") / F.coalesce(first_d, F.lit(1.0))).alias("r8"),
        (F.col("d") / F.avg("d").over(whole)).alias("rmean"),
        (F.col("p") - F.first("p").over(w)).alias("relative"),
        F.greatest(F.lit(1 / 64), F.coalesce(F.lead("o").over(w) - F.col("o"), F.col("d"))).alias("ioi"),
    )


def tie_merge(notes: DataFrame, same: list[str]) -> DataFrame:
    """Adjacent notes with equal ``same`` columns and pitch become one: first onset, summed duration, last measure."""
    w = stream_order()
    new = F.lit(False)
    for c in ["p", *same]:
        new = new | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    islands = notes.withColumn("island", F.sum(F.when(new | (F.row_number().over(w) == 1), 1).otherwise(0)).over(w))
    return islands.groupBy("sid", "island").agg(
        F.min("pos").alias("pos"), F.first("p").alias("p"), F.min("o").alias("o"), F.sum("d").alias("d"), F.max("m").alias("tm"), F.count(F.lit(1)).alias("n")
    )


def skyline(notes: DataFrame, key: str = "src") -> DataFrame:
    """At each onset of a work the highest sounding note (ties: smallest stream, position)."""
    best = F.min_by(F.struct("sid", "pos", "p", "d"), F.struct(-F.col("p"), "sid", "pos"))
    return notes.filter("d > 0").groupBy(key, "o").agg(best.alias("x")).select(key, "o", "x.*")


def melody_role(notes: DataFrame) -> DataFrame:
    """How melodic a stream is: monophony, length and height."""
    per = notes.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("height"), F.count_distinct("o").alias("onsets"))
    height = clamp((F.col("height") - 48) / 36, 0.0, 1.0)
    role = 0.35 + 0.25 * (F.col("onsets") / F.col("n")) + 0.2 * F.least(F.lit(1.0), F.col("n") / 64) + 0.2 * height
    return per.select("sid", "n", F.least(F.lit(1.0), role).alias("role"))


def structural_streams(notes: DataFrame) -> DataFrame:
    """Streams whose cues outnumber their other notes two to one keep a second stream of the others, if these are three or more."""
    per = Window.partitionBy("sid")
    counted = notes.withColumn("plain", F.count(F.when(~F.col("cue"), 1)).over(per)).withColumn("cues", F.count(F.when(F.col("cue"), 1)).over(per))
    own = counted.filter("NOT cue AND plain >= 3 AND cues >= 2 * plain")
    return own.select("sid", (F.row_number().over(stream_order()) - 1).alias("pos"), "p", "d", "o")


def finalize(notes: DataFrame, least: int = 3) -> DataFrame:
    """Without notes of no duration and streams that are then shorter than ``least``; positions anew."""
    sound = notes.filter("d > 0").withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("sid"))).filter(F.col("size") >= least)
    return sound.withColumn("pos", F.row_number().over(stream_order()) - 1)


def drop_rests(events: DataFrame) -> DataFrame:
    """Rests removed before onsets are summed, as a query without rests is."""
    from strophic.sources.adapters import with_onsets

    return with_onsets(events.withColumn("gap", F.lit(0.0)).drop("o", "m", "b"))


def gestures(points: DataFrame) -> DataFrame:
    """A drawn line (``sid``, ``pos``, ``y`` in pixels, upwards smaller) to steps: same, step of 2 or leap of 5 semitones."""
    w = stream_order()
    moved = points.withColumn("dy", F.lag("y").over(w) - F.col("y"))
    sizes = moved.groupBy("sid").agg(upper_median(F.collect_list(F.abs("dy"))).alias("middle"))
    leap = F.greatest(F.lit(14.0), 1.8 * F.col("middle"))
    size = F.when(F.abs("dy") <= 4, 0).when(F.abs("dy") >= leap, 5).otherwise(2)
    stepped = moved.join(sizes, "sid").withColumn("step", F.coalesce(F.signum("dy").cast("int") * size, F.lit(0)))
    return stepped.select("sid", "pos", "step", (F.lit(60) + F.sum("step").over(w)).alias("p"))


def autocorrelation_lag(samples: Column, low: int, high: int) -> Column:
    """The lag between ``low`` and ``high`` whose autocorrelation is largest (first of equals)."""
    at = lambda k: F.aggregate(F.zip_with(F.slice(samples, 1, F.size(samples) - k), F.slice(samples, k + 1, F.size(samples) - k), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    best = F.array_max(F.transform(F.sequence(F.lit(low), F.lit(high)), lambda k: F.struct(F.round(at(k), 6).alias("value"), (-k).alias("lag"))))
    return -best["lag"]


def thinned(marks: Column, dense: int = 4, span: int = 3, gap: int = 4, ratio: float = 1.25) -> Column:
    """Tempo marks (structs of ``measure`` and ``tempo``, in order) without those that crowd.

    A mark with at least ``dense`` marks within ``span`` measures from it stays only if it is ``gap`` measures after the last kept one or
    its tempo differs from that one's by ``ratio``.
    """
    counted = F.transform(marks, lambda x: F.struct(x["measure"].alias("measure"), x["tempo"].alias("tempo"), F.size(F.filter(marks, lambda y: F.abs(y["measure"] - x["measure"]) < span)).alias("near")))

    def keep(done: Column, x: Column) -> Column:
        last = F.get(done, F.size(done) - 1)
        change = F.greatest(x["tempo"], last["tempo"]) / F.least(x["tempo"], last["tempo"])
        stays = (F.size(done) == 0) | (x["near"] < dense) | (x["measure"] - last["measure"] >= gap) | (change >= ratio)
        return F.when(stays, F.concat(done, F.array(x))).otherwise(done)

    return F.aggregate(counted, F.slice(counted, 1, 0), keep)
