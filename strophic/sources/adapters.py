"""Tables as streams of notes: any keyed, ordered event table is a set of streams.

A note row has ``sid`` (stream), ``src`` (work), ``pos`` (0, 1, ...), ``p`` (pitch), ``d`` (duration), ``gap`` (rest after it), ``o``
(onset), ``m`` (measure), ``b`` (beat, from 1), ``spelling`` and ``cue``. Time is musical: onsets are running sums of durations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Names of the twelve pitch classes.
PITCH_NAMES = ["C", "C#", "D", "D#", "E", "F", "F#", "G", "G#", "A", "A#", "B"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream_order(*keys: str) -> Window:
    return Window.partitionBy(*(keys or ("sid",))).orderBy("pos")


def pitch_name(p: Column) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in PITCH_NAMES)), (F.pmod(p, F.lit(12)) + 1).cast("int"))


def with_onsets(notes: DataFrame, quarters: float = 4.0) -> DataFrame:
    """Onsets from durations and rests (a rest moves the clock without being a note), then measures and beats."""
    before = stream_order().rowsBetween(Window.unboundedPreceding, -1)
    out = notes.withColumn("o", F.coalesce(F.sum(F.col("d") + F.col("gap")).over(before), F.lit(0.0)))
    bar = F.floor(F.col("o") / quarters)
    return out.withColumn("m", (bar + 1).cast("int")).withColumn("b", F.col("o") - bar * quarters + 1)


def event_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as notes: a user is a stream, users modulo 50 are works, errors are cues followed by a rest."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value", "props")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    step = F.floor("value").cast("int") % 4
    notes = e.select(
        F.col("user_id").alias("sid"),
        (F.col("user_id") % 50).alias("src"),
        (F.row_number().over(order) - 1).alias("pos"),
        (F.get_json_object("props", "$.k").cast("int") % 8 + 60).alias("p"),
        F.when(step == 0, 0.25).when(step == 1, 0.5).when(step == 2, 1.0).otherwise(2.0).alias("d"),
        F.when(F.col("event_type") == "error", 0.5).otherwise(0.0).alias("gap"),
        (F.col("event_type") == "error").alias("cue"),
        F.col("event_type").alias("kind"),
    )
    return with_onsets(notes).withColumn("spelling", pitch_name(F.col("p")))


#: The same view in the oracle's SQL; follows WITH.
NOTES_SQL = """raw AS (SELECT user_id AS sid, user_id % 50 AS src, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS pos,
  60 + CAST(json_extract_string(props, '$.k') AS INT) % 8 AS p,
  CAST(CASE CAST(floor(value) AS INT) % 4 WHEN 0 THEN 0.25 WHEN 1 THEN 0.5 WHEN 2 THEN 1 ELSE 2 END AS DOUBLE) AS d,
  CAST(CASE WHEN event_type = 'error' THEN 0.5 ELSE 0 END AS DOUBLE) AS gap, event_type = 'error' AS cue, event_type AS kind FROM events),
timed AS (SELECT *, coalesce(sum(d + gap) OVER (PARTITION BY sid ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM raw),
notes AS (SELECT *, CAST(floor(o / 4) AS INT) + 1 AS m, o - 4 * floor(o / 4) + 1 AS b,
  ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][p % 12 + 1] AS spelling FROM timed)"""


def query_notes(notes: DataFrame, sid: int = 7, first: int = 10, size: int = 11, change: dict[int, int] | None = None) -> DataFrame:
    """A passage of a stream as a query, positions from 0; ``change`` replaces pitches at some positions."""
    q = notes.filter((F.col("sid") == sid) & F.col("pos").between(first, first + size - 1)).withColumn("pos", F.col("pos") - first)
    p = F.col("p")
    for at, value in (change or {}).items():
        p = F.when(F.col("pos") == at, value).otherwise(p)
    return q.withColumn("p", p)


QUERY_SQL = "q AS (SELECT * REPLACE (pos - 10 AS pos) FROM notes WHERE sid = 7 AND pos BETWEEN 10 AND 20)"
