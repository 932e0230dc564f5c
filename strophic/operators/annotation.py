"""Structural annotation of notes by windows over their stream: meter, rests, ornaments, weights and roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophic.functions.sequence import clamp, upper_median
from strophic.sources.adapters import stream_order


def _near(a: Column, b: float) -> Column:
    return F.abs(a - b) < 1e-6


def metric_weight(position: Column, count: int = 4, unit: int = 4) -> Column:
    """Weight of a position in a bar (quarters from 1). Compound and asymmetric eighth meters have group beats."""
    eighth = 1 + (position - 1) * 2
    whole, whole8 = position == F.floor(position), eighth == F.floor(eighth)
    if unit == 8 and count >= 6 and count % 3 == 0:
        rest = F.pmod(eighth - 1, F.lit(3.0))
        third = F.floor((eighth - 1) / 3 + 0.5)
        beat = F.when((F.lit(count) == 12) & (third == 2), 0.72).otherwise(0.68)
        body = F.when(_near(rest, 0), beat).when(_near(rest, 1) | _near(rest, 2), 0.34).otherwise(0.15)
    elif unit == 8 and count in (5, 7):
        starts = (3,) if count == 5 else (3, 5)
        body = F.when(F.greatest(*(_near(eighth, s).cast("int") for s in (*starts, starts[-1]))) == 1, 0.7).when(whole8, 0.32).otherwise(0.15)
    elif unit == 4 and count in (2, 3, 4, 5, 7):
        strong = {2: {2: 0.5}, 3: {}, 4: {3: 0.65}, 5: {4: 0.7}, 7: {3: 0.68, 5: 0.68}}[count]
        other, weak = {2: (0.4, 0.2), 3: (0.45, 0.2), 4: (0.45, 0.2), 5: (0.4, 0.18), 7: (0.38, 0.16)}[count]
        body = F.when(whole, other).otherwise(weak)
        for at, value in strong.items():
            body = F.when(_near(position, at), value).otherwise(body)
    else:
        body = F.when(whole8, 0.35).otherwise(0.15)
    return F.when(_near(position, 1), 1.0).otherwise(body)


def annotate(notes: DataFrame, count: int = 4, unit: int = 4) -> DataFrame:
    """Weights and roles of notes (``sid``, ``pos``, ``p``, ``d``, ``o``, ``b``, ``cue``; optional ``ts``, ``te``, ``m``, ``tm`` for ties)."""
    w, whole = stream_order(), Window.partitionBy("sid")
    col = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in notes.columns else F.lit(other)
    typical = notes.groupBy("sid").agg(upper_median(F.collect_list(F.when(F.col("d") == 0, 0.25).otherwise(F.col("d")))).alias("typical"))
    n = notes.join(typical, "sid")
    left, right = F.col("p") - F.lag("p").over(w), F.lead("p").over(w) - F.col("p")
    n = n.withColumns({"left": left, "right": right, "metric": metric_weight(F.col("b"), count, unit)})
    n = n.withColumns({"first": F.row_number().over(w) == 1, "last": F.row_number().over(w) == F.count(F.lit(1)).over(whole), "rest_before": F.greatest(F.lit(0.0), F.coalesce(F.col("o") - F.lag(F.col("o") + F.col("d")).over(w), F.lit(0.0))), "rest_after": F.greatest(F.lit(0.0), F.coalesce(F.lead("o").over(w) - F.col("o") - F.col("d"), F.lit(0.0)))})
    inside = F.col("left").isNotNull() & F.col("right").isNotNull()
    small = F.abs("left") <= 2
    n = n.withColumns({
        "passing_shape": F.coalesce(inside & (F.signum("left") == F.signum("right")) & small & (F.abs("right") <= 2), F.lit(False)),
        "neighbor_shape": F.coalesce(inside & (F.col("left") + F.col("right") == 0) & small, F.lit(False)),
        "extreme": F.coalesce(inside & (F.col("left") * F.col("right") < 0), F.lit(False)),
        "long": F.col("d") >= F.col("typical") * 1.5, "short": F.col("d") <= F.col("typical") * 0.6, "weak": F.col("metric") < 0.5,
        "rest_least": F.least(F.lit(0.5), F.greatest(F.lit(0.125), F.col("typical") * 0.5)),
        "continues": col("te", False) & ~col("ts", False), "tied": col("ts", False) | col("te", False) | (col("tm", 0) > 0), "crosses": (col("tm", 0) > 0) & (col("tm", 0) > col("m", 0)),
    })
    yes = lambda c, v: F.when(c, v).otherwise(0.0)
    before, after = F.col("rest_before") >= F.col("rest_least"), F.col("rest_after") >= F.col("rest_least")
    attack = ~F.col("continues")
    n = n.withColumns({
        "opening": clamp(100 * (yes(F.col("first"), 0.15) + yes(before, 0.62) + yes(before & attack, 0.18) - yes(F.col("continues"), 0.75))) / 100,
        "closing": clamp(100 * (yes(F.col("last"), 0.15) + yes(after, 0.58) + yes(after & F.col("long"), 0.14) + yes(after & F.col("crosses"), 0.13))) / 100,
        "passing": F.col("passing_shape") & (F.col("short") | F.col("weak")), "neighbor": F.col("neighbor_shape") & (F.col("short") | F.col("weak")),
    })
    n = n.withColumn("boundary", (attack & (F.col("opening") >= 0.55)) | (F.col("closing") >= 0.55))
    aux = ((F.col("passing") | F.col("neighbor")).cast("int") + F.col("short").cast("int") + F.col("weak").cast("int")) / 3
    weight = (
        0.3 + 0.3 * F.col("metric") + yes(F.col("long"), 0.2) + yes(F.col("tied"), 0.16) + 0.48 * F.greatest("opening", "closing") + yes(F.col("extreme"), 0.08)
        - yes(F.col("passing"), 0.18) * aux - yes(F.col("neighbor"), 0.16) * aux - yes(F.col("short") & F.col("weak") & ~F.col("boundary"), 0.1) - yes(col("cue", False), 0.45)
    )
    n = n.withColumn("weight", clamp(weight, 0.12, 1.0))
    role = F.when(col("cue", False), "cue").when(F.col("passing"), "passing").when(F.col("neighbor"), "neighbor").when((F.col("weight") >= 0.68) | (F.col("boundary") & (F.col("weight") >= 0.6)), "pillar").otherwise("surface")
    return n.withColumn("role", role).drop("left", "right", "passing_shape", "neighbor_shape", "passing", "neighbor", "rest_least", "first", "last", "typical")


def discrimination(notes: DataFrame) -> DataFrame:
    """How much a stream says: shares of distinct, dominant and repeated pitches, and whether that is too little."""
    w = stream_order()
    steps = notes.withColumn("interval", F.lead("p").over(w) - F.col("p"))
    per = steps.groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("distinct"), F.count_if(F.col("interval") == 0).alias("repeats"))
    top = notes.groupBy("sid", "p").agg(F.count(F.lit(1)).alias("k")).groupBy("sid").agg(F.max("k").alias("top"))
    x = per.join(top, "sid").withColumns({"dominance": F.col("top") / F.col("n"), "unique_ratio": F.col("distinct") / F.col("n"), "repeat_ratio": F.col("repeats") / F.greatest(F.col("n") - 1, F.lit(1))})
    low = (F.col("n") >= 6) & ((F.col("dominance") >= 0.45) | (F.col("repeat_ratio") >= 0.45) | (F.col("distinct") <= F.greatest(F.lit(2), F.floor(F.col("n") * 0.25))))
    specificity = clamp(100 * (0.45 * F.col("unique_ratio") + 0.35 * (1 - F.col("dominance")) + 0.2 * (1 - F.col("repeat_ratio"))))
    return x.select("sid", "n", "dominance", "unique_ratio", "repeat_ratio", specificity.alias("specificity"), low.alias("low_information"))
