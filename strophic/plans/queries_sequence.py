"""Queries over note streams: features, tokens, retrieval, exact matching, scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophic.functions import sequence as seq
from strophic.operators import alignment, annotation, matching, motifs, phrase, retrieval, tokens
from strophic.plans.registry import query
from strophic.sources.adapters import NOTES_SQL, QUERY_SQL, event_notes, query_notes, table

_W = "WINDOW w AS (PARTITION BY sid ORDER BY pos)"
_FEATURES_SQL = f"""{NOTES_SQL},
f AS (SELECT *, lead(p) OVER w - p AS interval, sign(lead(p) OVER w - p)::INT AS c3, floor(d / first_value(d) OVER w * 8 + 0.5)::INT AS r8 FROM notes {_W})"""
_GRAMS_SQL = _FEATURES_SQL + """,
wide AS (SELECT sid, pos, interval::VARCHAR || ',' || lead(interval, 1) OVER w || ',' || lead(interval, 2) OVER w AS i, c3::VARCHAR || ',' || lead(c3, 1) OVER w || ',' || lead(c3, 2) OVER w AS c,
  r8::VARCHAR || ',' || lead(r8, 1) OVER w || ',' || lead(r8, 2) OVER w AS r, interval::VARCHAR || ',' || lead(interval, 1) OVER w || ',' || lead(interval, 2) OVER w || ',' || lead(interval, 3) OVER w || ',' || lead(interval, 4) OVER w AS i5
  FROM f WINDOW w AS (PARTITION BY sid ORDER BY pos)),
grams AS (SELECT sid, pos, 'i' AS kind, 'i:' || i AS token FROM wide WHERE i IS NOT NULL UNION ALL SELECT sid, pos, 'c', 'c:' || c FROM wide WHERE c IS NOT NULL
  UNION ALL SELECT sid, pos, 'r', 'r:' || r FROM wide WHERE r IS NOT NULL UNION ALL SELECT sid, pos, 'i5', 'i5:' || i5 FROM wide WHERE i5 IS NOT NULL)"""
#: The query's own tokens: its intervals end where it ends, its rhythm starts from its own first duration.
_QGRAMS_SQL = _GRAMS_SQL + f""", {QUERY_SQL},
qf AS (SELECT pos, lead(p) OVER w - p AS interval, sign(lead(p) OVER w - p)::INT AS c3, floor(d / first_value(d) OVER w * 8 + 0.5)::INT AS r8 FROM q WINDOW w AS (ORDER BY pos)),
qw AS (SELECT pos, interval::VARCHAR || ',' || lead(interval, 1) OVER w || ',' || lead(interval, 2) OVER w AS i, c3::VARCHAR || ',' || lead(c3, 1) OVER w || ',' || lead(c3, 2) OVER w AS c,
  r8::VARCHAR || ',' || lead(r8, 1) OVER w || ',' || lead(r8, 2) OVER w AS r, interval::VARCHAR || ',' || lead(interval, 1) OVER w || ',' || lead(interval, 2) OVER w || ',' || lead(interval, 3) OVER w || ',' || lead(interval, 4) OVER w AS i5
  FROM qf WINDOW w AS (ORDER BY pos)),
qg AS (SELECT pos AS qpos, 'i' AS kind, 'i:' || i AS token FROM qw WHERE i IS NOT NULL UNION ALL SELECT pos, 'c', 'c:' || c FROM qw WHERE c IS NOT NULL
  UNION ALL SELECT pos, 'r', 'r:' || r FROM qw WHERE r IS NOT NULL UNION ALL SELECT pos, 'i5', 'i5:' || i5 FROM qw WHERE i5 IS NOT NULL)"""
_HITS_SQL = _QGRAMS_SQL + """,
hits AS (SELECT g.sid, greatest(0, g.pos - qpos) AS start, qg.kind, qpos, token FROM grams g JOIN qg USING (token)),
ev AS (SELECT sid, start, sum(CASE kind WHEN 'i5' THEN 50 WHEN 'i' THEN 3 ELSE 1 END) AS evidence, count(*) FILTER (kind IN ('i', 'i5')) AS interval_hits,
  sum(CASE kind WHEN 'i5' THEN 50 WHEN 'i' THEN 3 ELSE 0 END) AS interval_evidence, count(*) FILTER (kind = 'r') AS rhythm_hits,
  min(qpos) FILTER (kind = 'i') AS low, max(qpos) FILTER (kind = 'i') AS high, count(DISTINCT qpos) FILTER (kind = 'i') AS positions FROM hits GROUP BY ALL)"""
_CAND_SQL = _HITS_SQL + """,
hat AS (SELECT DISTINCT sid, start, qpos FROM hits WHERE kind = 'i'),
seeds AS (SELECT a.sid, a.start, count(*) AS seeds FROM hat a JOIN hat b ON a.sid = b.sid AND a.start = b.start AND b.qpos = a.qpos + 1 GROUP BY ALL),
cand AS (SELECT sid, start, evidence + CASE WHEN positions >= 2 AND high - low >= 5 THEN 650 + 50 * least(3, positions - 2) ELSE 0 END + 20 * coalesce(seeds, 0)
  + CASE WHEN interval_hits / 14 >= 0.999 THEN 10000.0 WHEN interval_hits / 14 >= 0.6 THEN 1000 * power(interval_hits / 14, 2) ELSE 0 END AS evidence FROM ev LEFT JOIN seeds USING (sid, start))"""


def _notes(spark, sf_dir) -> DataFrame:
    return event_notes(spark, sf_dir)


def _query_tokens(notes: DataFrame) -> DataFrame:
    return tokens.tokens(query_notes(notes).withColumn("sid", F.lit(-1).cast("long"))).drop("sid")


def _query_pitches(notes: DataFrame) -> tuple[list[int], list[float], list[float]]:
    rows = query_notes(notes).orderBy("pos").collect()
    return [r["p"] for r in rows], [r["d"] for r in rows], [r["o"] for r in rows]


@query(f"WITH {NOTES_SQL} SELECT sid, src, pos, p, d, gap, o, m, b, spelling FROM notes")
def notes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Onsets are sums of earlier durations and rests."""
    return _notes(spark, sf_dir).select("sid", "src", "pos", "p", "d", "gap", "o", "m", "b", "spelling")


@query(f"""WITH {NOTES_SQL}, f AS (SELECT *, lead(p) OVER w - p AS interval, lead(spelling) OVER w AS s2, lead(o) OVER w AS o2 FROM notes {_W}),
g AS (SELECT *, instr('CDEFGAB', left(spelling, 1)) - 1 AS l1, instr('CDEFGAB', left(s2, 1)) - 1 AS l2 FROM f)
SELECT sid, pos, interval, sign(interval)::INT AS c3, CASE WHEN interval = 0 THEN 'SAME' WHEN interval > 2 THEN 'LU' WHEN interval > 0 THEN 'SU' WHEN interval < -2 THEN 'LD' WHEN interval < 0 THEN 'SD' END AS c5,
 CASE WHEN interval IS NULL THEN NULL WHEN interval = 0 THEN 'S' ELSE (CASE WHEN abs(interval) <= 2 OR (abs(interval) = 3 AND (l2 - l1 + 7) % 7 IN (1, 6)) THEN 'STEP' ELSE 'LEAP' END) || (CASE WHEN interval > 0 THEN '_U' ELSE '_D' END) END AS shape,
 CASE WHEN interval = 0 THEN 0 WHEN abs(interval) <= 2 THEN 1 WHEN interval IS NOT NULL THEN 2 END AS iclass, floor(d / first_value(d) OVER w * 8 + 0.5)::INT AS r8, round(d / avg(d) OVER (PARTITION BY sid), 5) AS rmean,
 p - first_value(p) OVER w AS relative, greatest(1 / 64, coalesce(o2 - o, d)) AS ioi FROM g {_W}""")
def note_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P1 to P9."""
    f = seq.features(_notes(spark, sf_dir))
    shape = F.when(F.col("interval").isNotNull(), F.col("shape")).alias("shape")
    return f.select("sid", "pos", "interval", "c3", "c5", shape, "iclass", "r8", F.round("rmean", 5).alias("rmean"), "relative", "ioi")


@query(f"""WITH {NOTES_SQL}, x AS (SELECT *, CASE WHEN lag(p) OVER w = p AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS new FROM notes {_W}), y AS (SELECT *, sum(new) OVER w AS island FROM x {_W})
SELECT sid, min(pos) AS pos, any_value(p) AS p, min(o) AS o, sum(d) AS d, max(m) AS tm, count(*) AS n FROM y GROUP BY sid, island""")
def tie_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of one pitch and tie group become one note."""
    return seq.tie_merge(_notes(spark, sf_dir), ["kind"]).drop("island")


@query(f"WITH {NOTES_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY src, o ORDER BY p DESC, sid, pos) AS n FROM notes WHERE d > 0) SELECT src, o, sid, pos, p, d FROM r WHERE n = 1")
def skyline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12, S18."""
    return seq.skyline(_notes(spark, sf_dir))


@query(f"WITH {NOTES_SQL} SELECT sid, count(*) AS n, round(least(1, 0.35 + 0.25 * (count(DISTINCT o) / count(*)) + 0.2 * least(1, count(*) / 64) + 0.2 * least(1, greatest(0, (avg(p) - 48) / 36))), 6) AS role FROM notes GROUP BY sid")
def melody_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P13."""
    return seq.melody_role(_notes(spark, sf_dir)).withColumn("role", F.round("role", 6))


@query(f"""WITH {NOTES_SQL}, c AS (SELECT *, kind <> 'view' AS q FROM notes), n AS (SELECT *, count(*) FILTER (NOT q) OVER (PARTITION BY sid) AS plain, count(*) FILTER (q) OVER (PARTITION BY sid) AS cues FROM c)
SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY pos) - 1 AS pos, p, d, o FROM n WHERE NOT q AND plain >= 3 AND cues >= 2 * plain""")
def structural_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14, here with every event but views as a cue."""
    return seq.structural_streams(_notes(spark, sf_dir).withColumn("cue", F.col("kind") != "view"))


@query(f"""WITH {NOTES_SQL}, k AS (SELECT *, count(*) OVER (PARTITION BY sid) AS size FROM notes WHERE d > 0)
SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY pos) - 1 AS pos, p, d FROM k WHERE size >= 5""")
def finalize_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P15 over all notes of all streams."""
    return seq.finalize(_notes(spark, sf_dir), 5).select("sid", "pos", "p", "d")


@query("""WITH pts AS (SELECT user_id AS sid, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, floor(value)::DOUBLE AS y FROM events),
mv AS (SELECT *, lag(y) OVER (PARTITION BY sid ORDER BY pos) - y AS dy FROM pts),
md AS (SELECT sid, list_sort(list(abs(dy)) FILTER (dy IS NOT NULL)) AS l FROM mv GROUP BY sid), m2 AS (SELECT sid, l[(len(l) // 2 + 1)::INT] AS middle FROM md),
st AS (SELECT sid, pos, coalesce(sign(dy)::INT * CASE WHEN abs(dy) <= 4 THEN 0 WHEN abs(dy) >= greatest(14, 1.8 * middle) THEN 5 ELSE 2 END, 0) AS step FROM mv JOIN m2 USING (sid))
SELECT sid, pos, step, 60 + sum(step) OVER (PARTITION BY sid ORDER BY pos) AS p FROM st""")
def contour_gestures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18 on the events' values as a drawn line."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pts = table(spark, sf_dir, "events").select(F.col("user_id").alias("sid"), (F.row_number().over(w) - 1).alias("pos"), F.floor("value").cast("double").alias("y"))
    return seq.gestures(pts)


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
l AS (SELECT vec_id, x, unnest(range(4, 33)) AS lag FROM e), c AS (SELECT vec_id, lag, round(list_sum(list_transform(range(1, 65 - lag), lambda i: x[i] * x[i + lag])), 6) AS v FROM l)
SELECT vec_id, arg_max(lag, (v, -lag)) AS lag FROM c GROUP BY vec_id""")
def pitch_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best autocorrelation lag of a sample array."""
    return table(spark, sf_dir, "embeddings").select("vec_id", seq.autocorrelation_lag(F.col("embedding"), 4, 32).cast("long").alias("lag"))


@query(f"WITH {_GRAMS_SQL} SELECT sid, pos, kind, token FROM grams")
def index_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1: the inverted index."""
    return tokens.tokens(_notes(spark, sf_dir))


@query(f"WITH {_QGRAMS_SQL} SELECT qpos AS pos, kind, token FROM qg")
def query_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G2."""
    return _query_tokens(_notes(spark, sf_dir))


@query(f"WITH {_QGRAMS_SQL} SELECT mode, qpos AS pos, kind, token FROM qg, (VALUES ('rhythm', 'r'), ('contour', 'c')) v(mode, k) WHERE kind = k")
def query_tokens_by_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rhythm and contour searches keep."""
    q = _query_tokens(_notes(spark, sf_dir))
    out = [tokens.for_mode(q, m).select(F.lit(m).alias("mode"), "pos", "kind", "token") for m in ("rhythm", "contour")]
    return out[0].unionByName(out[1])


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '') AS w FROM documents), g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ':' || w[i + 1] || ':' || w[i + 2])) AS gram FROM w)
SELECT gram, count(*) AS n, count(DISTINCT doc_id) AS docs FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1""")
def generic_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colon-joined runs of three words that several documents have."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "").alias("w"))
    runs = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda i: F.concat_ws(":", F.slice("w", i, 3))))
    return w.select("doc_id", F.explode(runs).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("docs")).filter("docs > 1")


@query(f"WITH {_QGRAMS_SQL} SELECT token, count(*) AS total FROM grams WHERE token IN (SELECT token FROM qg) GROUP BY token")
def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G4."""
    n = _notes(spark, sf_dir)
    return tokens.frequencies(tokens.tokens(n).join(F.broadcast(_query_tokens(n).select("token").distinct()), "token", "left_semi"))


_CAPS_SQL = _QGRAMS_SQL + """,
df AS (SELECT token, count(*) AS total FROM grams GROUP BY token),
cq AS (SELECT qg.*, coalesce(total, 0) AS total FROM qg LEFT JOIN df USING (token)),
rk AS (SELECT *, row_number() OVER (ORDER BY total, qpos, kind) - 1 AS rank FROM cq WHERE total > 0 AND kind IN ('i', 'i5')),
ii AS (SELECT *, qpos IN (min(qpos) OVER (), max(qpos) OVER ()) AS edge, row_number() OVER (PARTITION BY qpos > 3.5 ORDER BY total, qpos) = 1 AS rarest FROM rk WHERE kind = 'i'),
lim AS (SELECT cq.qpos, cq.kind, cq.token, cq.total, CASE WHEN edge THEN -1 WHEN rarest THEN 0 ELSE rk.rank END AS rank FROM cq LEFT JOIN rk USING (qpos, kind) LEFT JOIN ii USING (qpos, kind)),
caps AS (SELECT qpos AS pos, kind, token, total, rank, least(total, CASE WHEN kind = 'i5' THEN CASE WHEN coalesce(rank, 99) < 2 THEN 18000 ELSE 6000 END
  WHEN kind = 'i' THEN CASE WHEN rank < 0 THEN 100000 WHEN rank < 2 THEN 50000 ELSE 16000 END ELSE 3000 END) AS cap FROM lim)"""


@query(f"WITH {_CAPS_SQL} SELECT pos, kind, token, total, rank, cap FROM caps")
def row_caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rarity ranks and how many postings each token may read."""
    n = _notes(spark, sf_dir)
    return tokens.rarity(_query_tokens(n), tokens.frequencies(tokens.tokens(n)), 11).select("pos", "kind", "token", "total", F.col("rank").cast("long").alias("rank"), "cap")


@query(f"""WITH {_CAPS_SQL}, p AS (SELECT g.sid, g.pos, g.token, c.pos AS qpos, cap, row_number() OVER (PARTITION BY g.token, c.pos ORDER BY g.sid, g.pos) AS seq FROM grams g JOIN caps c USING (token))
SELECT token, qpos, count(*) AS read, max(seq) AS last FROM p WHERE seq <= cap GROUP BY ALL""")
def posting_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings read per token, in ingest order up to the cap."""
    n = _notes(spark, sf_dir)
    index = tokens.tokens(n)
    own = tokens.capped_postings(index, tokens.rarity(_query_tokens(n), tokens.frequencies(index), 11))
    return own.groupBy("token", "qpos").agg(F.count(F.lit(1)).alias("read"), F.max("seq").alias("last"))


@query("""WITH t AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM documents), b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS q FROM benchmark)
SELECT doc_id, item_id, round(len(list_filter(q, lambda x: list_contains(w, x))) / len(q), 6) AS share FROM t, b WHERE len(list_filter(q, lambda x: list_contains(w, x))) / len(q) >= 0.5""")
def token_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All benchmark items as queries against all documents."""
    bag = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: x != ""))
    t = table(spark, sf_dir, "documents").select("doc_id", bag("text").alias("w"))
    b = table(spark, sf_dir, "benchmark").select("item_id", bag("text").alias("q"))
    return tokens.overlaps(b, t, 0.5).select("doc_id", "item_id", F.round("share", 6).alias("share"))


@query(f"WITH {_HITS_SQL} SELECT sid, start, evidence, interval_hits, interval_evidence, rhythm_hits, positions FROM ev")
def retrieve_aligned_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship posting join; evidence per stream and aligned start."""
    n = _notes(spark, sf_dir)
    return retrieval.evidence(tokens.tokens(n), _query_tokens(n), 11).select("sid", "start", "evidence", "interval_hits", "interval_evidence", "rhythm_hits", "positions")


@query(f"WITH {_HITS_SQL} SELECT sid, count(DISTINCT qpos) AS contours FROM hits WHERE kind = 'c' GROUP BY sid")
def contour_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3."""
    n = _notes(spark, sf_dir)
    q = _query_tokens(n).filter("kind = 'c'").select("token", F.col("pos").alias("qpos"))
    return tokens.tokens(n).join(F.broadcast(q), "token").groupBy("sid").agg(F.count_distinct("qpos").alias("contours"))


@query(f"WITH {_CAND_SQL} SELECT a.sid, a.start, count(*) AS seeds FROM hat a JOIN hat b ON a.sid = b.sid AND a.start = b.start AND b.qpos = a.qpos + 1 GROUP BY ALL")
def adjacent_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-interval seeds as intersections of neighbouring three-interval ones."""
    n = _notes(spark, sf_dir)
    return retrieval.adjacent_seeds(tokens.tokens(n), _query_tokens(n), 11)


def _candidates(n: DataFrame) -> DataFrame:
    return retrieval.candidates(tokens.tokens(n), _query_tokens(n), 11, 14)


@query(f"WITH {_CAND_SQL} SELECT sid, start, round(evidence, 6) AS evidence FROM cand")
def candidate_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4, A5: evidence with split, adjacency and coverage bonuses."""
    return _candidates(_notes(spark, sf_dir)).select("sid", "start", F.round("evidence", 6).alias("evidence"))


@query(f"WITH {_CAND_SQL} SELECT sid, round(max(evidence), 6) AS evidence FROM cand GROUP BY sid")
def work_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6."""
    return _candidates(_notes(spark, sf_dir)).groupBy("sid").agg(F.round(F.max("evidence"), 6).alias("evidence"))


@query(f"""WITH {_CAND_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY evidence DESC, start) - 1 AS round, max(evidence) OVER (PARTITION BY sid) AS top FROM cand WHERE sid NOT IN (3, 5)),
o AS (SELECT sid, start, round, row_number() OVER (ORDER BY round, top DESC, sid) AS place FROM r WHERE round < 8) SELECT sid, start, round, place FROM o WHERE place <= 1400""")
def diversified_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round-robin over streams, without excluded ones."""
    rows = retrieval.diversified(retrieval.scoped(_candidates(_notes(spark, sf_dir)), excluded=[3, 5]), 8, 1400)
    return rows.withColumn("place", F.row_number().over(Window.orderBy("round", F.col("top").desc(), "sid"))).select("sid", "start", F.col("round").cast("long").alias("round"), F.col("place").cast("long").alias("place"))


_SCAN_SQL = _CAND_SQL + """,
l0 AS (SELECT sid, max(evidence) AS value, 0 AS list FROM cand GROUP BY sid ORDER BY value DESC, sid LIMIT 10), l1 AS (SELECT sid, max(interval_evidence) AS value, 1 AS list FROM ev GROUP BY sid HAVING max(interval_evidence) > 0 ORDER BY value DESC, sid LIMIT 8),
l2 AS (SELECT sid, max(rhythm_hits) AS value, 2 AS list FROM ev GROUP BY sid HAVING max(rhythm_hits) > 0 ORDER BY value DESC, sid LIMIT 6),
un AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2), scan AS (SELECT sid, min(list) AS list FROM un GROUP BY sid)"""


def _scan_streams(n: DataFrame) -> tuple[DataFrame, DataFrame]:
    c = _candidates(n)
    e = retrieval.evidence(tokens.tokens(n), _query_tokens(n), 11)
    return c, retrieval.full_scan_streams([(c, "evidence", 10), (e, "interval_evidence", 8), (e, "rhythm_hits", 6)])


@query(f"WITH {_SCAN_SQL} SELECT sid, list FROM scan")
def full_scan_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of ranked lists, first place kept."""
    return _scan_streams(_notes(spark, sf_dir))[1].select("sid", "list")


@query(f"WITH {_SCAN_SQL}, d AS (SELECT sid, start, round(evidence, 6) AS evidence, row_number() OVER (PARTITION BY sid ORDER BY cand.evidence DESC, start) AS n FROM cand JOIN scan USING (sid)) SELECT sid, start, evidence, n FROM d WHERE n <= 4")
def deep_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O4."""
    c, s = _scan_streams(_notes(spark, sf_dir))
    return retrieval.deep_seeds(c, s).select("sid", "start", F.round("evidence", 6).alias("evidence"), F.col("n").cast("long").alias("n"))


_FIVE_SQL = f"""{NOTES_SQL}, fq AS (SELECT list(p ORDER BY pos) AS qp FROM notes WHERE sid = 7 AND pos BETWEEN 10 AND 13),
w AS (SELECT sid, pos AS start, list(p) OVER v AS wp, list(d) OVER v AS wd, list(o) OVER v AS wo FROM notes WINDOW v AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))"""


@query(f"""WITH {_FIVE_SQL} SELECT sid, start, start + 3 AS "end", wp[1] - qp[1] AS transposition FROM w, fq WHERE len(wp) = 4 AND wp[2] - wp[1] = qp[2] - qp[1] AND wp[3] - wp[2] = qp[3] - qp[2] AND wp[4] - wp[3] = qp[4] - qp[3]""")
def exact_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every transposed occurrence of four notes."""
    n = _notes(spark, sf_dir)
    p, _, _ = _query_pitches(n)
    return matching.exact_occurrences(n, p[:4])


@query(f"""WITH {_FIVE_SQL}, rq AS (SELECT list(d ORDER BY pos) AS qd, list(o ORDER BY pos) AS qo FROM notes WHERE sid = 7 AND pos BETWEEN 10 AND 13)
SELECT sid, start FROM w, fq, rq WHERE len(wp) = 4 AND wp[2] - wp[1] = qp[2] - qp[1] AND wp[3] - wp[2] = qp[3] - qp[2] AND wp[4] - wp[3] = qp[4] - qp[3]
 AND wo[2] - wo[1] = qo[2] - qo[1] AND wo[3] - wo[2] = qo[3] - qo[2] AND wo[4] - wo[3] = qo[4] - qo[3] AND wd[4] = qd[4]""")
def exact_rhythm_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with times between onsets."""
    n = _notes(spark, sf_dir)
    p, d, o = _query_pitches(n)
    t = [max(1 / 64, b - a) for a, b in zip(o[:4], o[1:4])] + [max(1 / 64, d[3])]
    return matching.exact_occurrences(n, p[:4], t).select("sid", "start")


def _windows_with_query(n: DataFrame, size: int) -> tuple[DataFrame, object, object, object]:
    p, d, o = _query_pitches(n)
    lit = lambda x: F.array(*(F.lit(v) for v in x[:size]))
    return matching.windows(n, size, ("p", "d", "o")), lit(p), lit(d), lit(o)


@query(f"""WITH {NOTES_SQL}, fq AS (SELECT list(p ORDER BY pos) AS qp, list(d ORDER BY pos) AS qd FROM notes WHERE sid = 7 AND pos BETWEEN 10 AND 15),
w AS (SELECT sid, pos AS start, list(p) OVER v AS wp, list(d) OVER v AS wd FROM notes WINDOW v AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
x AS (SELECT sid, start, qp, wp, list_transform(range(1, 7), lambda i: wp[i] - qp[i]) AS mv, list_transform(range(1, 6), lambda i: qp[i + 1] - qp[i]) AS qi, list_transform(range(1, 6), lambda i: wp[i + 1] - wp[i]) AS wi,
 list_transform(qd, lambda v: floor(v / qd[1] * 8 + 0.5)) AS qr, list_transform(wd, lambda v: floor(v / wd[1] * 8 + 0.5)) AS wr FROM w, fq WHERE len(wp) = 6),
y AS (SELECT *, list_sort(mv)[4] AS md FROM x),
s AS (SELECT sid, start, greatest(0, 100 - list_avg(list_transform(mv, lambda v: least(100, 14.0 * abs(v - md))))) AS pitch, 100 - list_avg(list_transform(range(1, 6), lambda i: least(100, 14.0 * abs(qi[i] - wi[i])))) AS edge,
 100 - list_avg(list_transform(range(1, 6), lambda i: CASE WHEN sign(qi[i]) = sign(wi[i]) THEN 0.0 ELSE 100.0 END)) AS contour, greatest(0, 100 - list_avg(list_transform(range(1, 7), lambda i: least(100, abs(qr[i] - wr[i]) * 45.0 / 8)))) AS rhythm FROM y)
SELECT sid, start, round(pitch, 6) AS pitch, round(least(100, greatest(0, 0.6 * edge + 0.4 * pitch)), 6) AS interval, round(contour, 6) AS contour, round(rhythm, 6) AS rhythm FROM s""")
def window_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel scores of every window against a query."""
    w, p, d, _ = _windows_with_query(_notes(spark, sf_dir), 6)
    s = matching.channel_scores(p, d, F.col("p"), F.col("d"))
    return w.select("sid", "start", *(F.round(c, 6).alias(k) for k, c in s.items()))


@query(f"""WITH {NOTES_SQL}, fq AS (SELECT list(p ORDER BY pos) AS qp FROM notes WHERE sid = 7 AND pos BETWEEN 10 AND 15), w AS (SELECT sid, pos AS start, list(p) OVER v AS wp FROM notes WINDOW v AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
ij AS (SELECT i, j FROM range(1, 7) a(i), range(1, 7) b(j) WHERE i < j) SELECT sid, start, round(100.0 * count(*) FILTER ((qp[i] = qp[j]) = (wp[i] = wp[j])) / count(*), 6) AS equality FROM w, fq, ij WHERE len(wp) = 6 GROUP BY ALL""")
def equality_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A14."""
    w, p, _, _ = _windows_with_query(_notes(spark, sf_dir), 6)
    return w.select("sid", "start", F.round(matching.equality_similarity(p, F.col("p")), 6).alias("equality"))


@query(f"""WITH {NOTES_SQL}, fq AS (SELECT list(d ORDER BY pos) AS q FROM notes WHERE sid = 7 AND pos BETWEEN 10 AND 15), w AS (SELECT sid, pos AS start, list(d) OVER v AS c FROM notes WINDOW v AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
m AS (SELECT sid, start, list_transform(q, lambda x: least(2, x / list_median(q))) AS a, list_transform(c, lambda x: least(2, x / list_median(c))) AS b FROM w, fq WHERE len(c) = 6),
l AS (SELECT *, list_transform(a, lambda x: CASE WHEN x < 0.75 THEN 0 WHEN x > 1.5 THEN 2 ELSE 1 END) AS la, list_transform(b, lambda x: CASE WHEN x < 0.75 THEN 0 WHEN x > 1.5 THEN 2 ELSE 1 END) AS lb FROM m)
SELECT sid, start, round(least(100, greatest(0, 0.5 * (100 - list_avg(list_transform(range(1, 7), lambda i: CASE WHEN la[i] = lb[i] THEN 0.0 WHEN la[i] = 1 OR lb[i] = 1 THEN 55.0 ELSE 100.0 END)))
 + 0.5 * (100 - list_avg(list_transform(range(1, 7), lambda i: least(100, 60 * abs(log2(greatest(0.125, a[i]) / greatest(0.125, b[i])))))))))  , 6) AS likeness FROM l""")
def rhythm_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short, normal and long classes around the true median."""
    w, _, d, _ = _windows_with_query(_notes(spark, sf_dir), 6)
    return w.select("sid", "start", F.round(matching.rhythm_shape(d, F.col("d")), 6).alias("likeness"))


@query(f"""WITH {NOTES_SQL}, fq AS (SELECT list(p ORDER BY pos) AS qp FROM notes WHERE sid = 7 AND pos BETWEEN 10 AND 15), w AS (SELECT sid, pos AS start, list(p) OVER v AS wp FROM notes WINDOW v AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)),
c AS (SELECT sid, start, list_sum(list_transform(range(1, 6), lambda i: abs((wp[i + 1] - wp[i]) - (qp[i + 1] - qp[i]))))::BIGINT AS cost FROM w, fq WHERE len(wp) = 6) SELECT sid, arg_min(start, (cost, start)) AS start, min(cost) AS cost FROM c GROUP BY sid""")
def span_relocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D19."""
    n = _notes(spark, sf_dir)
    return matching.relocate(n, _query_pitches(n)[0][:6]).withColumn("cost", F.col("cost").cast("long"))


@query(f"""WITH {NOTES_SQL}, fq AS (SELECT list(p ORDER BY pos) AS q FROM notes WHERE sid = 7 AND pos BETWEEN 10 AND 14), w AS (SELECT sid, pos AS start, list(p) OVER v AS c FROM notes WINDOW v AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
x AS (SELECT sid, start, q, c FROM w, fq WHERE len(c) = 8),
s AS (SELECT sid, start, list_transform(range(1, 6), lambda i: list_transform(range(1, 9), lambda j: CASE WHEN i = 1 THEN 0.0 ELSE 0.7 * least(1.0, abs((q[i] - q[i - 1]) - (CASE WHEN j > 1 THEN c[j] - c[j - 1] ELSE 99 END)) / 7.0)
  + CASE WHEN sign(q[i] - q[i - 1]) = sign(CASE WHEN j > 1 THEN c[j] - c[j - 1] ELSE 99 END) THEN 0.0 ELSE 0.3 END END)) AS sub FROM x),
dp AS (SELECT sid, start, list_reduce(list_concat([list_transform(range(0, 9), lambda z: 0.0::DOUBLE)], sub), lambda r, srow: list_reduce(list_concat([[r[1] + 0.5]], list_transform(range(1, 9), lambda j: [j::DOUBLE])), lambda done, jj: list_append(done, least(r[jj[1]::INT] + srow[jj[1]::INT], done[-1] + 0.4, r[jj[1]::INT + 1] + 0.5)))) AS fin FROM s)
SELECT sid, start, round(list_min(fin), 6) AS cost FROM dp""")
def alignment_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi-global alignment by nested folds, in the JVM."""
    n = _notes(spark, sf_dir)
    p = _query_pitches(n)[0][:5]
    q = F.array(*(F.lit(x) for x in p))
    w = matching.windows(n, 8, ("p",))
    cost = alignment.local_cost(q, F.col("p"), 0.5, 0.4, alignment.interval_substitution(q, F.col("p")))
    return w.select("sid", "start", F.round(cost, 6).alias("cost"))


_ANN_SQL = f"""{NOTES_SQL}, ty AS (SELECT sid, list_sort(list(d))[(count(*) // 2 + 1)::INT] AS typical FROM notes GROUP BY sid),
a0 AS (SELECT notes.*, typical, p - lag(p) OVER w AS l, lead(p) OVER w - p AS r, row_number() OVER w = 1 AS fst, lead(p) OVER w IS NULL AS lst, greatest(0, coalesce(o - lag(o + d) OVER w, 0)) AS rb, greatest(0, coalesce(lead(o) OVER w - o - d, 0)) AS ra,
 CASE WHEN b = 1 THEN 1.0e0 WHEN b = 3 THEN 0.65e0 WHEN b = floor(b) THEN 0.45e0 ELSE 0.2e0 END AS metric FROM notes JOIN ty USING (sid) WINDOW w AS (PARTITION BY sid ORDER BY pos)),
a1 AS (SELECT *, d >= typical * 1.5e0 AS long, d <= typical * 0.6e0 AS short, metric < 0.5e0 AS weak, least(0.5e0, greatest(0.125e0, typical * 0.5e0)) AS lim, l IS NOT NULL AND r IS NOT NULL AS ins FROM a0),
a2 AS (SELECT *, least(1, greatest(0, CASE WHEN fst THEN 0.15e0 ELSE 0 END + CASE WHEN rb >= lim THEN 0.8e0 ELSE 0 END)) AS opening, least(1, greatest(0, CASE WHEN lst THEN 0.15e0 ELSE 0 END + CASE WHEN ra >= lim THEN 0.58e0 ELSE 0 END + CASE WHEN ra >= lim AND long THEN 0.14e0 ELSE 0 END)) AS closing,
 ins AND sign(l) = sign(r) AND abs(l) <= 2 AND abs(r) <= 2 AND (short OR weak) AS passing, ins AND l + r = 0 AND abs(l) <= 2 AND (short OR weak) AS neighbor, ins AND l * r < 0 AS extreme FROM a1),
a3 AS (SELECT *, opening >= 0.55e0 OR closing >= 0.55e0 AS boundary, ((passing OR neighbor)::INT + short::INT + weak::INT) / 3 AS aux FROM a2),
ann AS (SELECT *, least(1, greatest(0.12e0, 0.3e0 + 0.3e0 * metric + CASE WHEN long THEN 0.2e0 ELSE 0 END + 0.48e0 * greatest(opening, closing) + CASE WHEN extreme THEN 0.08e0 ELSE 0 END - CASE WHEN passing THEN 0.18e0 * aux ELSE 0 END
 - CASE WHEN neighbor THEN 0.16e0 * aux ELSE 0 END - CASE WHEN short AND weak AND NOT boundary THEN 0.1e0 ELSE 0 END - CASE WHEN cue THEN 0.45e0 ELSE 0 END)) AS weight FROM a3)"""


@query(f"""WITH {_ANN_SQL} SELECT sid, pos, metric::DOUBLE AS metric, long, short, weak, round(opening, 6)::DOUBLE AS opening, round(closing, 6)::DOUBLE AS closing, round(weight, 6)::DOUBLE AS weight,
 CASE WHEN cue THEN 'cue' WHEN passing THEN 'passing' WHEN neighbor THEN 'neighbor' WHEN weight >= 0.68e0 OR (boundary AND weight >= 0.6e0) THEN 'pillar' ELSE 'surface' END AS role FROM ann""")
def structural_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights and roles of all notes."""
    a = annotation.annotate(_notes(spark, sf_dir).drop("m"))
    return a.select("sid", "pos", "metric", "long", "short", "weak", F.round("opening", 6).alias("opening"), F.round("closing", 6).alias("closing"), F.round("weight", 6).alias("weight"), "role")


_METERS = [(2, 4), (3, 4), (4, 4), (5, 4), (7, 4), (6, 8), (12, 8), (5, 8), (7, 8), (3, 2)]


@query("""WITH m AS (SELECT count_, unit, 1 + i * 0.25 AS pos FROM (VALUES (2, 4), (3, 4), (4, 4), (5, 4), (7, 4), (6, 8), (12, 8), (5, 8), (7, 8), (3, 2)) v(count_, unit), range(0, 24) r(i)), e AS (SELECT *, 1 + (pos - 1) * 2 AS e FROM m)
SELECT count_ || '/' || unit AS meter, pos::DOUBLE AS position, CASE WHEN pos = 1 THEN 1.0
 WHEN unit = 8 AND count_ % 3 = 0 THEN CASE WHEN (e - 1) % 3 = 0 THEN CASE WHEN count_ = 12 AND (e - 1) / 3 = 2 THEN 0.72 ELSE 0.68 END WHEN (e - 1) % 3 IN (1, 2) THEN 0.34 ELSE 0.15 END
 WHEN unit = 8 THEN CASE WHEN (count_ = 5 AND e = 3) OR (count_ = 7 AND e IN (3, 5)) THEN 0.7 WHEN e = floor(e) THEN 0.32 ELSE 0.15 END
 WHEN unit = 4 THEN CASE count_ WHEN 2 THEN CASE WHEN pos = 2 THEN 0.5 WHEN pos = floor(pos) THEN 0.4 ELSE 0.2 END WHEN 3 THEN CASE WHEN pos = floor(pos) THEN 0.45 ELSE 0.2 END WHEN 4 THEN CASE WHEN pos = 3 THEN 0.65 WHEN pos = floor(pos) THEN 0.45 ELSE 0.2 END
  WHEN 5 THEN CASE WHEN pos = 4 THEN 0.7 WHEN pos = floor(pos) THEN 0.4 ELSE 0.18 END ELSE CASE WHEN pos IN (3, 5) THEN 0.68 WHEN pos = floor(pos) THEN 0.38 ELSE 0.16 END END
 ELSE CASE WHEN e = floor(e) THEN 0.35 ELSE 0.15 END END::DOUBLE AS weight FROM e""")
def metric_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All supported meters."""
    out = None
    for count, unit in _METERS:
        one = spark.range(24).select(F.lit(f"{count}/{unit}").alias("meter"), (1 + F.col("id") * 0.25).cast("double").alias("position"))
        one = one.withColumn("weight", annotation.metric_weight(F.col("position"), count, unit).cast("double"))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {NOTES_SQL}, s AS (SELECT *, lead(p) OVER (PARTITION BY sid ORDER BY pos) - p AS i FROM notes), g AS (SELECT sid, count(*) AS n, count(DISTINCT p) AS k, count(*) FILTER (i = 0) AS z FROM s GROUP BY sid),
t AS (SELECT sid, max(c) AS top FROM (SELECT sid, p, count(*) AS c FROM notes GROUP BY ALL) GROUP BY sid)
SELECT sid, n, round(100 * (0.45 * k / n + 0.35 * (1 - top / n) + 0.2 * (1 - z / greatest(n - 1, 1))), 6) AS specificity, n >= 6 AND (top / n >= 0.45 OR z / greatest(n - 1, 1) >= 0.45 OR k <= greatest(2, floor(n * 0.25))) AS low_information FROM g JOIN t USING (sid)""")
def query_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8."""
    return annotation.discrimination(_notes(spark, sf_dir)).select("sid", "n", F.round("specificity", 6).alias("specificity"), "low_information")


@query(f"""WITH {NOTES_SQL}, k AS (SELECT unnest(range(6, 13)) AS length), w AS (SELECT sid, pos AS start, length, list(p ORDER BY q) AS p, sum(dd) AS span FROM (SELECT a.sid, a.pos, length, b.p, b.pos AS q, b.d AS dd FROM notes a, k JOIN notes b ON b.sid = a.sid AND b.pos BETWEEN a.pos AND a.pos + length - 1) GROUP BY ALL HAVING count(*) = length),
x AS (SELECT sid, start, length, list_transform(range(1, length), lambda i: p[i + 1] - p[i]) AS iv, span, len(list_distinct(p)) AS dis, list_max(list_transform(list_distinct(p), lambda v: len(list_filter(p, lambda y: y = v)))) / length AS dom FROM w),
y AS (SELECT *, array_to_string(iv, ',') AS key, len(list_filter(iv, lambda v: v = 0)) / (length - 1) AS same FROM x),
g AS (SELECT sid, key, length, count(*) AS count, sum(span) AS total, min(start) AS first, arg_max(dis, start) AS dis, arg_max(dom, start) AS dom, arg_max(same, start) AS same FROM y GROUP BY sid, key, length),
h AS (SELECT *, round(count * (1 + 0.18 * (length - 6)) * log2(2 + total / count) * (0.45 + 0.55 * (0.55 * (dis / length) + 0.45 * (1 - same))) * CASE WHEN length >= 8 THEN 1.25 ELSE 0.88 END, 6) AS score FROM g WHERE count >= 2 AND dis >= least(4, ceil(length * 0.6)) AND dom < 0.5 AND same <= 0.34),
z AS (SELECT * FROM h a WHERE NOT EXISTS (SELECT 1 FROM h b WHERE b.sid = a.sid AND b.length > a.length AND b.score >= a.score AND instr(',' || b.key || ',', ',' || a.key || ',') > 0))
SELECT sid, key, length, count, first, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, length DESC, first) AS rank FROM z) WHERE rank <= 8""")
def ranked_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A12, for lengths 6 to 12."""
    return motifs.ranked_motifs(_notes(spark, sf_dir)).select("sid", "key", F.col("length").cast("long").alias("length"), "count", "first", "score", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {NOTES_SQL}, s AS (SELECT sid, count(*) AS n, count(DISTINCT p) AS k FROM notes GROUP BY sid) SELECT sid, round(0.5 * (55 + 45 * least(100, greatest(0, 100 * 0.8)) / 100) + 0.35 * least(100, 100 * log2(1 + k) / log2(9.0)) + 0.15 * least(100, 100.0 * k * 6 / greatest(n, 1)), 6) AS importance FROM s""")
def motif_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A13, with the number of pitches as occurrences of a motif of six notes."""
    s = _notes(spark, sf_dir).groupBy("sid").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("p").alias("k"))
    return s.select("sid", F.round(motifs.importance(F.lit(0.8), F.col("k"), F.lit(6), F.col("n")), 6).alias("importance"))


@query(f"""WITH {NOTES_SQL}, s AS (SELECT sid, p % 3 AS family, pos AS start, pos + 2 + p % 2 AS "end" FROM notes WHERE pos % 4 = 0), l AS (SELECT sid, count(*) AS n FROM notes GROUP BY sid),
c AS (SELECT sid, family, count(DISTINCT k) AS covered FROM (SELECT sid, family, unnest(range(start, "end" + 1)) AS k FROM s) GROUP BY ALL), t AS (SELECT sid, family, count(DISTINCT (start, "end")) AS spans, count(DISTINCT "end" - start) AS variants FROM s GROUP BY ALL)
SELECT sid, family, spans, variants, covered, round(100 * covered / n, 6) AS coverage FROM t JOIN c USING (sid, family) JOIN l USING (sid)""")
def motif_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A17."""
    n = _notes(spark, sf_dir)
    spans = n.filter("pos % 4 = 0").select("sid", (F.col("p") % 3).alias("family"), F.col("pos").alias("start"), (F.col("pos") + 2 + F.col("p") % 2).alias("end"))
    return motifs.family_summary(spans, n.groupBy("sid").agg(F.count(F.lit(1)).alias("n")))


@query(f"""WITH {NOTES_SQL}, c AS (SELECT sid, p, count(*) AS n FROM notes GROUP BY ALL) SELECT sid, p, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY n DESC, p) AS rank FROM c) WHERE rank <= 8""")
def top_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11."""
    return motifs.histograms(_notes(spark, sf_dir), "sid", "p").withColumn("rank", F.col("rank").cast("long"))


_LOCAL_SQL = f"""{NOTES_SQL}, n0 AS (SELECT *, abs(p - lag(p) OVER w) AS step, o - lag(o) OVER w AS ioi, o - lag(o + d) OVER w AS rest, row_number() OVER w AS place, lag(d) OVER w AS bd FROM notes {_W}),
n1 AS (SELECT *, list({{'k': pos, 'ioi': ioi}}) OVER v AS arnd, list(d) OVER v AS durs, lag(step) OVER w AS s1, lead(step) OVER w AS s2, lag(ioi) OVER w AS t1, lead(ioi) OVER w AS t2 FROM n0 WINDOW w AS (PARTITION BY sid ORDER BY pos), v AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
n2 AS (SELECT *, list_sort(list_filter(list_transform(list_filter(arnd, lambda x: x.k <> n1.pos), lambda x: x.ioi), lambda x: x > 0)) AS li, list_sort(list_filter(list_append(durs, bd), lambda x: x > 0)) AS ld,
 CASE WHEN step > 0 AND step >= s1 AND step >= s2 THEN (step - (s1 + s2) / 2) / (step + (s1 + s2) / 2) ELSE 0 END AS pp, CASE WHEN ioi > 0 AND ioi >= t1 AND ioi >= t2 THEN (ioi - (t1 + t2) / 2) / (ioi + (t1 + t2) / 2) ELSE 0 END AS tp FROM n1),
n3 AS (SELECT *, rest / CASE WHEN len(li) > 0 THEN li[(len(li) // 2 + 1)::INT] ELSE ld[(len(ld) // 2 + 1)::INT] END AS ratio FROM n2),
n4 AS (SELECT *, CASE WHEN ratio >= 0.25 THEN least(0.95, 0.55 + 0.2 * log2(1 + ratio)) ELSE 0 END AS gp FROM n3),
loc AS (SELECT sid, pos, round(pp, 6) AS pitch_peak, round(tp, 6) AS time_peak, round(gp, 6) AS gap, round(least(1, round(0.25 * pp + 0.25 * tp, 6) + round(gp, 6)), 6) AS strength, CASE WHEN coalesce(ratio >= -1e-6 AND ratio <= 0.03, false) AND pp <= 0.25 AND tp <= 0.25 THEN 0.85 ELSE 0 END::DOUBLE AS continuity FROM n4 WHERE place > 1)"""


@query(f"WITH {_LOCAL_SQL} SELECT *, CASE WHEN strength >= 0.65 THEN 'boundary' WHEN continuity >= 0.75 THEN 'continuous' ELSE 'unknown' END AS state FROM loc")
def local_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M1, W7, W8, W9."""
    return phrase.local_boundaries(_notes(spark, sf_dir))


@query(f"""WITH {_LOCAL_SQL}, mk AS (SELECT notes.sid, notes.pos, sum(CASE WHEN strength >= 0.65 THEN 1 ELSE 0 END) OVER (PARTITION BY notes.sid ORDER BY notes.pos) AS phrase FROM notes LEFT JOIN loc ON notes.sid = loc.sid AND notes.pos = loc.pos)
SELECT sid, phrase::BIGINT AS phrase, min(pos) AS start, max(pos) + 1 AS "end" FROM mk GROUP BY ALL""")
def phrase_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W10."""
    n = _notes(spark, sf_dir)
    return phrase.spans(phrase.local_boundaries(n), n)


_SIG_SQL = f"""{NOTES_SQL}, k AS (SELECT unnest(range(4, 9)) AS length), w AS (SELECT sid, pos AS start, length, list(p ORDER BY q) AS p, list(dd ORDER BY q) AS d, list(oo ORDER BY q) AS o FROM (SELECT a.sid, a.pos, length, b.p, b.pos AS q, b.d AS dd, b.o AS oo FROM notes a, k JOIN notes b ON b.sid = a.sid AND b.pos BETWEEN a.pos AND a.pos + length - 1) GROUP BY ALL HAVING count(*) = length),
x AS (SELECT *, list_transform(range(1, length), lambda i: p[i + 1] - p[i]) AS iv, list_transform(range(1, length), lambda i: o[i + 1] - o[i]) AS tv FROM w),
sig AS (SELECT sid, start, length, length || '|' || array_to_string(iv, ',') || '|' || array_to_string(list_transform(d, lambda v: floor(v / d[1] * 64 + 0.5)::BIGINT), ',') || '|' || array_to_string(list_transform(tv, lambda v: floor(v / d[1] * 64 + 0.5)::BIGINT), ',') AS key
 FROM x WHERE len(list_distinct(iv)) >= 3 AND list_max(iv) > 0 AND list_min(iv) < 0 AND list_min(tv) > 0)"""


@query(f"WITH {_SIG_SQL} SELECT sid, start, length, key FROM sig")
def motif_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M2."""
    return phrase.motif_signatures(_notes(spark, sf_dir)).withColumn("length", F.col("length").cast("long"))


@query(f"""WITH {_SIG_SQL}, nb AS (SELECT *, row_number() OVER (PARTITION BY sid, key ORDER BY start) AS k FROM sig), pr AS (SELECT a.sid, a.start, a.length, b.start AS previous, a.start - b.start AS distance FROM nb a JOIN nb b ON a.sid = b.sid AND a.key = b.key AND a.k - b.k BETWEEN 1 AND 4 WHERE a.start - b.start BETWEEN a.length AND 64)
SELECT sid, start, length, previous, distance, distance <= 2 * length AS close FROM (SELECT *, row_number() OVER (PARTITION BY sid, start ORDER BY length DESC, previous DESC) AS n FROM pr) WHERE n = 1""")
def motif_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M3: earlier occurrences of a motif within reach."""
    return phrase.motif_relations(phrase.motif_signatures(_notes(spark, sf_dir))).withColumn("length", F.col("length").cast("long"))


@query(f"""WITH {NOTES_SQL}, w AS (SELECT sid, pos AS start, list(d) OVER v AS d, list(o) OVER v AS o FROM notes WINDOW v AS (PARTITION BY sid ORDER BY pos ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)), u AS (SELECT *, list_sort(d[1:4])[3] AS unit FROM w WHERE len(d) = 5),
x AS (SELECT sid, start, list_transform(d[1:4], lambda v: v / unit) AS r, (o[5] - o[1]) / unit AS span, d[5] / unit AS last FROM u), y AS (SELECT *, list_min(r) >= 0.8 AND list_max(r) <= 1.2 AS straight FROM x WHERE list_min(r) >= 0.45 AND list_max(r) <= 1.65 AND span BETWEEN 3.5 AND 4.5 AND last >= 3.5)
SELECT sid, start, start + 4 AS "end", CASE WHEN straight THEN 'straight' ELSE 'syncopated' END AS variant, round(last, 6) AS terminal FROM y WHERE straight OR abs(list_sum(r) - 4) <= 0.25""")
def long_arrival_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M9."""
    return phrase.long_arrivals(_notes(spark, sf_dir))


@query()
def phrase_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passes over each stream."""
    return phrase.boundaries(_notes(spark, sf_dir)).withColumn("cues", F.concat_ws(",", "cues"))


_CMP_SQL = _LOCAL_SQL + """,
pr AS (SELECT notes.sid AS pair_id, notes.pos AS ord, notes.pos AS q, notes.pos + 2 * (notes.pos // 9) AS c FROM notes),
jn AS (SELECT pr.*, coalesce(a.strength, 0) AS qs, coalesce(a.gap, 0) AS qg, coalesce(b.strength, 0) AS cs, coalesce(b.continuity, 0) AS cc FROM pr LEFT JOIN loc a ON a.sid = pair_id AND a.pos = q LEFT JOIN loc b ON b.sid = pair_id AND b.pos = c)"""


@query(f"""WITH {_CMP_SQL}, f AS (SELECT *, q = lag(q) OVER w + 1 AND c = lag(c) OVER w + 1 AS nx FROM jn WINDOW w AS (PARTITION BY pair_id ORDER BY ord)),
x AS (SELECT *, CASE WHEN cs >= 0.65 THEN least(qs, cs) WHEN qg >= 0.65 AND cc >= 0.75 THEN -qg * cc ELSE 0 END AS wt FROM f WHERE nx AND q > 0 AND c > 0 AND qs >= 0.65 AND (cs >= 0.65 OR cc >= 0.75)),
g AS (SELECT pair_id, count(*) FILTER (cs >= 0.65) AS support, count(*) FILTER (cs < 0.65 AND qg >= 0.65 AND cc >= 0.75) AS conflicts, sum(wt) AS weighted FROM x GROUP BY pair_id)
SELECT pair_id, support, conflicts, round(3 * greatest(-1, least(1, weighted / greatest(2, support + conflicts))), 6) AS adjustment FROM g""")
def boundary_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream's boundaries against its own, shifted by two notes after every ninth."""
    n = _notes(spark, sf_dir)
    loc = phrase.local_boundaries(n)
    side = lambda k: loc.select(F.col("sid").alias("pair_id"), F.col("pos").alias(k), *(F.col(x).alias(f"{k}_{x}") for x in ("strength", "continuity", "gap")))
    pairs = n.select(F.col("sid").alias("pair_id"), F.col("pos").alias("ord"), F.col("pos").alias("q"), (F.col("pos") + 2 * F.floor(F.col("pos") / 9)).cast("int").alias("c"))
    both = pairs.join(side("q"), ["pair_id", "q"], "left").join(side("c"), ["pair_id", "c"], "left").fillna(0.0)
    return phrase.compare_boundaries(both)


