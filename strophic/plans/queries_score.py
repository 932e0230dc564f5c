"""Queries that tie streams to places of the score: targets, symbols, names, bars and phrase roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strophic.operators import comparison, pairing, phrase
from strophic.plans.queries_sequence import _LOCAL_SQL
from strophic.plans.registry import query
from strophic.sources.adapters import NOTES_SQL, QUERY_SQL, event_notes, query_notes, table


@query(f"""WITH {NOTES_SQL}, t AS (SELECT src, m, p, round(b * 1048576)::BIGINT AS k, row_number() OVER (PARTITION BY src, m, p, round(b * 1048576) ORDER BY sid, pos) AS n, sid AS target, pos AS target_pos FROM notes WHERE d = 2),
e AS (SELECT src, m, p, round(b * 1048576)::BIGINT AS k, row_number() OVER (PARTITION BY src, m, p, round(b * 1048576) ORDER BY sid, pos) AS n, sid, pos FROM notes) SELECT src, m, p, target, target_pos, sid, pos FROM t JOIN e USING (src, m, p, k, n)""")
def target_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long notes, their beats a little off, as targets among all notes of the work; each note is used once."""
    n = event_notes(spark, sf_dir)
    targets = n.filter("d = 2").select("src", "m", "p", (F.col("b") + 1e-8).alias("b"), F.col("sid").alias("target"), F.col("pos").alias("target_pos"))
    return pairing.pair(targets, n.select("src", "m", "p", "b", "sid", "pos"), ["src", "m", "p"], "b", ["target", "target_pos"], ["sid", "pos"])


@query(f"""WITH {NOTES_SQL}, {QUERY_SQL}, s AS (SELECT pos, p - lag(p) OVER (ORDER BY pos) AS x FROM q), n AS (SELECT sid, pos, p - lag(p) OVER (PARTITION BY sid ORDER BY pos) AS x, count(*) OVER (PARTITION BY sid) AS size FROM notes),
c AS (SELECT n.sid, n.pos - s.pos AS start, sum(CASE WHEN sign(n.x) = sign(s.x) THEN 0 ELSE 8 END + abs(abs(n.x) - abs(s.x)))::BIGINT AS cost FROM n JOIN s ON n.pos >= s.pos AND n.pos - s.pos + 10 < size WHERE s.pos > 0 GROUP BY ALL)
SELECT sid, arg_min(start, (cost, start))::BIGINT AS start, min(cost) AS cost FROM c GROUP BY sid""")
def closest_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J13's other way: the closest passage of each stream."""
    n = event_notes(spark, sf_dir)
    wanted = [r["p"] for r in query_notes(n).orderBy("pos").collect()]  # the 11 notes of the query
    return pairing.closest_window(n, wanted).withColumn("start", F.col("start").cast("long"))


@query(f"""WITH {NOTES_SQL}, s AS (SELECT src, m, p, round(b * 1048576)::BIGINT AS k, CASE WHEN d = 2 THEN 'caesura' ELSE 'breath-mark' END AS symbol FROM notes WHERE cue)
SELECT sid, pos, coalesce((SELECT string_agg(DISTINCT symbol, ',' ORDER BY symbol) FROM s WHERE s.src = notes.src AND s.m = notes.m AND s.p = notes.p AND s.k = round(notes.b * 1048576)::BIGINT), '') AS symbols FROM notes""")
def breath_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues of a work as symbols, found again at the notes of their place."""
    n = event_notes(spark, sf_dir)
    symbols = n.filter("cue").select("src", "m", "p", "b", F.when(F.col("d") == 2, "caesura").otherwise("breath-mark").alias("symbol"))
    return pairing.symbols_at(n.select("src", "m", "p", "b", "sid", "pos"), symbols, ["src", "m", "p"], "b").select("sid", "pos", F.array_join("symbols", ",").alias("symbols"))


@query("""WITH v AS (SELECT name, min(p_partkey) AS value FROM (SELECT p_partkey, CASE WHEN p_size < 15 THEN p_partkey::VARCHAR WHEN p_size < 30 THEN p_name ELSE lower(p_name) END AS name FROM part WHERE p_retailprice > 910) GROUP BY name)
SELECT p.p_partkey, coalesce(a.value, b.value, c.value) AS value FROM part p LEFT JOIN v a ON a.name = p.p_partkey::VARCHAR LEFT JOIN v b ON b.name = p.p_name LEFT JOIN v c ON c.name = lower(p.p_name)""")
def name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A recording by id, else by title, else by the title in lower case."""
    part = table(spark, sf_dir, "part")
    name = F.when(F.col("p_size") < 15, F.col("p_partkey").cast("string")).when(F.col("p_size") < 30, F.col("p_name")).otherwise(F.lower("p_name"))
    known = part.filter("p_retailprice > 910").groupBy(name.alias("name")).agg(F.min("p_partkey").alias("value"))
    return pairing.lookup(part, "p_partkey", [F.col("p_partkey").cast("string"), F.col("p_name"), F.lower("p_name")], known)


@query(f"""WITH RECURSIVE {NOTES_SQL}, x AS (SELECT *, unnest(range(0, greatest(1, ceil((b - 1 + d - 0.001) / 4)::INT))) AS part FROM notes), y AS (SELECT sid, m + part AS m, greatest(b - 1, part * 4) - part * 4 + 1 AS b, least(b - 1 + d, part * 4 + 4) - greatest(b - 1, part * 4) AS d, pos, part FROM x),
z AS (SELECT * FROM y WHERE d > 0.001), bars AS (SELECT sid, unnest(range(min(m), max(m) + 1)) AS m FROM z GROUP BY sid), u AS (SELECT sid, m, b, d, pos, part FROM z UNION ALL SELECT sid, m, 5, 0, NULL, NULL FROM bars),
g AS (SELECT sid, m, b, greatest(1, max(b + d) OVER (PARTITION BY sid, m ORDER BY b, part IS NULL, pos, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS c FROM u),
r AS (SELECT sid, m, c AS b, NULL::DOUBLE AS d, b - c AS rest FROM g WHERE b - c > 0.001 UNION ALL SELECT sid, m, b + coalesce(d, 0), v, rest - v FROM (SELECT *, list_filter([4, 3, 2, 1.5, 1, 0.5, 0.25, 0.125, 0.0625], lambda w: w <= rest + 0.0001)[1]::DOUBLE AS v FROM r) WHERE v IS NOT NULL)
SELECT sid, m::INT AS m, b::DOUBLE AS b, d::DOUBLE AS d, pos, part::INT AS part FROM z UNION ALL SELECT sid, m::INT, b::DOUBLE, d, NULL, NULL FROM r WHERE d IS NOT NULL""")
def filled_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes split at bar lines and silences written as rests."""
    return pairing.filled_bars(event_notes(spark, sf_dir))


@query(f"""WITH {_LOCAL_SQL}, rl AS (SELECT sid, pos, coalesce(strength, 0) AS opening, coalesce(lead(coalesce(strength, 0)) OVER (PARTITION BY sid ORDER BY pos), 0) AS closing, count(*) OVER (PARTITION BY sid) AS size FROM notes LEFT JOIN loc USING (sid, pos)),
qr AS (SELECT pos - 10 AS i, opening >= 0.55 AS qo, closing >= 0.55 AS qc FROM rl WHERE sid = 7 AND pos BETWEEN 10 AND 20),
ws AS (SELECT sid, pos - i AS start, i, qo, qc, opening >= 0.55 AS wo, closing >= 0.55 AS wc, closing > 0.6 AND opening < 0.3 AS late FROM rl JOIN qr ON pos >= i AND pos - i + 10 < size)
SELECT sid, start::BIGINT AS start, greatest(0, least(100, 70 + sum(CASE WHEN i = 0 THEN CASE WHEN wo THEN 15 ELSE 0 END - CASE WHEN late THEN 35 ELSE 0 END WHEN i = 10 THEN CASE WHEN wc THEN 10 ELSE 0 END
 ELSE CASE WHEN qo THEN CASE WHEN wo THEN 8 ELSE -12 END WHEN wo THEN -6 ELSE 0 END + CASE WHEN qc THEN CASE WHEN wc THEN 8 ELSE -12 END WHEN wc THEN -6 ELSE 0 END END)))::DOUBLE AS score,
 sum(CASE WHEN i = 0 THEN late::INT WHEN i = 10 THEN 0 ELSE (qo <> wo)::INT + (qc <> wc)::INT END)::INT AS conflicts FROM ws GROUP BY sid, start""")
def phrase_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase roles of every passage against those of the query."""
    n = event_notes(spark, sf_dir)
    r = pairing.roles(phrase.local_boundaries(n), n)
    wanted = r.filter("sid = 7 AND pos BETWEEN 10 AND 20").orderBy("pos").collect()  # the 11 notes of the query
    found = pairing.phrase_evidence(r, [x["opening"] for x in wanted], [x["closing"] for x in wanted])
    return found.withColumn("start", F.col("start").cast("long"))


@query()
def motif_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query against the closest passage of each stream."""
    n = event_notes(spark, sf_dir)
    base = [r.asDict() for r in query_notes(n).select("pos", "p", "d", "o").orderBy("pos").collect()]  # the 11 notes of the query
    return comparison.compare_passages(n, pairing.closest_window(n, [r["p"] for r in base]), base, len(base))
