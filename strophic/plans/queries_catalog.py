"""Queries over records: catalog text, merges, joins, harmony, evaluation, whole searches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strophic.functions import text
from strophic.operators import catalog, harmony, phrase, tokens
from strophic.plans import evaluation, search
from strophic.plans.queries_sequence import _LOCAL_SQL
from strophic.plans.registry import query
from strophic.sources import tables
from strophic.sources.adapters import NOTES_SQL, event_notes, pitch_name, query_notes, table

_TITLE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(t), '\\([^)]*\\)|\\[[^\\]]*\\]', ' ', 'g'), '\\b(?:piano (?:solo|duet|trio|quartet|quintet)|melody|violin|viola|cello|contrabass|duet|trio|quartet|string orchestra)\\b', ' ', 'g'), '[^\\p{L}\\p{N}]+', ' ', 'g'))"


@query(f"WITH x AS (SELECT p_partkey, p_name || ' (' || p_brand || ') Piano Solo ' || p_type AS t FROM part) SELECT p_partkey, {_TITLE} AS title FROM x")
def normalised_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X6."""
    raw = F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") Piano Solo "), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", catalog.normalise_title(raw).alias("title"))


@query("SELECT doc_id, len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'))::BIGINT AS n, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')[1] AS first FROM documents")
def catalog_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X8 without NFKC, which is a function of its own."""
    w = catalog.words(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(w).cast("long").alias("n"), F.get(w, F.lit(0)).alias("first"))


@query("SELECT p_partkey FROM part WHERE len(list_filter(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), lambda w: starts_with(w, 'pa'))) > 0 AND len(list_filter(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), lambda w: w = '7')) > 0")
def prefix_title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms are prefixes; a term of one character is a whole word."""
    return table(spark, sf_dir, "part").filter(catalog.title_matches(catalog.words(F.col("p_name")), ["pa", "7"])).select("p_partkey")


_BM25_SQL = """t AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents), e AS (SELECT doc_id, len(w) AS length, unnest(w) AS term FROM t),
ix AS (SELECT term, doc_id, length, count(*) AS tf FROM e GROUP BY ALL), ct AS (SELECT count(*) AS n, avg(length) AS mean FROM (SELECT DISTINCT doc_id, length FROM ix)),
f AS (SELECT q, doc_id, length, sum(tf) AS tf FROM (SELECT *, CASE WHEN starts_with(term, 'thin') THEN 'thin' WHEN starts_with(term, 'erhe') THEN 'erhe' END AS q FROM ix) WHERE q IS NOT NULL GROUP BY ALL),
df AS (SELECT q, count(*) AS df FROM f GROUP BY q)"""


@query(f"WITH {_BM25_SQL} SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean))), 6) AS score, count(*) AS terms FROM f JOIN df USING (q), ct GROUP BY doc_id")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of two prefixes over all documents."""
    return catalog.bm25(catalog.term_table(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id", ["thin", "erhe"])


@query("""WITH r AS (SELECT p_partkey, p_name, p_brand, CASE WHEN len(list_filter(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), lambda w: starts_with(w, '12'))) > 0 THEN 0 WHEN contains(lower(p_name), '12') THEN 1 WHEN contains(lower(p_name || ' ' || p_type), '12') THEN 2 END AS rank FROM part),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY rank, p_name, p_partkey) AS n FROM r WHERE rank IS NOT NULL) SELECT p_partkey, p_name, p_brand, rank FROM b WHERE n = 1 ORDER BY rank, p_name, p_partkey LIMIT 20 OFFSET 2""")
def catalog_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title prefixes, then containment, one row per source, a page of the result."""
    p = table(spark, sf_dir, "part").withColumn("hay", F.concat_ws(" ", "p_name", "p_type"))
    return catalog.search(p, "p_partkey", "p_name", "hay", "12", "p_brand", 20, 2)


@query("WITH x AS (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations) SELECT conv_id, turn, trim(l[1]) AS composer FROM x")
def display_composer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X7."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", catalog.first_line_by(F.col("text")).alias("composer"))


@query("SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Bau' WHEN 'MACHINERY' THEN 'Maschinen' ELSE c_mktsegment END AS name FROM customer")
def translated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X12."""
    return table(spark, sf_dir, "customer").select("c_custkey", catalog.translate(F.col("c_mktsegment"), {"BUILDING": "Bau", "MACHINERY": "Maschinen"}).alias("name"))


@query("SELECT s_suppkey, sha256(s_name) AS id, left(sha1(s_name), 8) AS suffix FROM supplier")
def hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X26."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.sha2("s_name", 256).alias("id"), F.left(F.sha1("s_name"), F.lit(8)).alias("suffix"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS again FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X27."""
    s = F.from_json("props", "k int")
    return table(spark, sf_dir, "events").select("event_id", s["k"].alias("k"), F.to_json(s).alias("again"))


@query("""WITH b AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS q FROM benchmark), d AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^a-z]+'), lambda x: x <> '')) AS w FROM documents WHERE doc_id % 20 = 0)
SELECT doc_id, max(round(100.0 * len(list_intersect(q, w)) / len(q), 6)) AS recall FROM b, d GROUP BY doc_id""")
def title_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best share of wanted words, for every twentieth document as a stated query set."""
    bag = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: x != ""))
    b = table(spark, sf_dir, "benchmark").select(bag("text").alias("q"))
    d = table(spark, sf_dir, "documents").filter("doc_id % 20 = 0").select("doc_id", bag("text").alias("w"))
    return d.crossJoin(F.broadcast(b)).groupBy("doc_id").agg(F.max(F.round(catalog.token_recall(F.col("q"), F.col("w")), 6)).alias("recall"))


@query("SELECT p, ['C','C#','D','D#','E','F','F#','G','G#','A','A#','B'][p % 12 + 1] AS name, p % 12 IN (1, 3, 6, 8, 10) AS black, round(440 * power(2, (p - 69) / 12), 6) AS frequency FROM range(21, 109) t(p)")
def pitch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X23, X25."""
    p = spark.range(21, 109).withColumnRenamed("id", "p")
    return p.select("p", pitch_name(F.col("p")).alias("name"), (F.col("p") % 12).isin(1, 3, 6, 8, 10).alias("black"), F.round(text.frequency(F.col("p")), 6).alias("frequency"))


@query(f"WITH {NOTES_SQL} SELECT sid, pos, 12 * (p // 12) + p % 12 AS p FROM notes")
def spelling_to_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes written as text and read again."""
    n = event_notes(spark, sf_dir)
    name = F.concat("spelling", (F.floor(F.col("p") / 12) - 1).cast("string"))
    return n.select("sid", "pos", text.spelled_pitch(name).cast("int").alias("p"))


@query("""SELECT m, CASE WHEN m = 'x' THEN 4 ELSE list_sum(list_transform(string_split(split_part(m, '/', 1), '+'), lambda x: x::INT))::INT END AS count, CASE WHEN m = 'x' THEN 4 ELSE split_part(m, '/', 2)::INT END AS unit FROM (VALUES ('4/4'), ('3+2/8'), ('6/8'), ('2+2+3/8'), ('x')) v(m)""")
def parsed_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X3."""
    m = spark.createDataFrame([(x,) for x in ("4/4", "3+2/8", "6/8", "2+2+3/8", "x")], "m string")
    return m.select("m", text.meter(F.col("m"))["count"].alias("count"), text.meter(F.col("m"))["unit"].alias("unit"))


@query("SELECT event_id, greatest(0, least(100, value)) AS clamped, floor(value * 8 + 0.5) / 8 AS quantized, CASE WHEN value > 0 THEN value END AS positive FROM events")
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X1, X2, X4."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.greatest(F.lit(0.0), F.least(F.lit(100.0), v)).alias("clamped"), (F.floor(v * 8 + 0.5) / 8).alias("quantized"), text.optional_positive(v).alias("positive"))


@query("""WITH q AS (SELECT list(c_nationkey ORDER BY c_custkey) AS x FROM customer WHERE c_custkey <= 12) SELECT array_to_string(list_transform(x, lambda v: v + 5), ',') AS up, array_to_string(list_concat(list_append(x[1:4], 99), x[5:]), ',') AS inserted FROM q""")
def query_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transposition and insertion."""
    x = table(spark, sf_dir, "customer").filter("c_custkey <= 12").agg(F.sort_array(F.collect_list(F.struct("c_custkey", "c_nationkey"))).alias("s")).select(F.col("s.c_nationkey").alias("x"))
    return x.select(F.array_join(evaluation.transpose(F.col("x"), 5).cast("array<string>"), ",").alias("up"), F.array_join(evaluation.insert_after(F.col("x"), 3, F.lit(99)).cast("array<string>"), ",").alias("inserted"))


@query("""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html lang="([a-z]*)"', 1) AS lang, len(regexp_extract_all(html, '<p>'))::BIGINT AS paragraphs, regexp_extract_all(html, '<a href="([^"]*)"', 1)[1] AS link FROM pages""")
def markup_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of markup by regular expressions."""
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html lang="([a-z]*)"', 1).alias("lang"), F.regexp_count("html", F.lit("<p>")).cast("long").alias("paragraphs"), F.get(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1)), F.lit(0)).alias("link"))


@query("""WITH x AS (SELECT page_id, regexp_extract_all(html, '<(h1|p|li|div)[ >]', 1) AS tags FROM pages), e AS (SELECT page_id, unnest(tags) AS tag, generate_subscripts(tags, 1) AS k FROM x)
SELECT page_id, k::INT AS k, tag, sum(CASE tag WHEN 'p' THEN 4 WHEN 'li' THEN 1 WHEN 'h1' THEN 2 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k)::BIGINT - CASE tag WHEN 'p' THEN 4 WHEN 'li' THEN 1 WHEN 'h1' THEN 2 ELSE 0 END AS onset FROM e""")
def ordered_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S1's pattern, X14, X15, M18: siblings in document order with a running clock."""
    tags = F.regexp_extract_all("html", F.lit("<(h1|p|li|div)[ >]"), F.lit(1))
    e = table(spark, sf_dir, "pages").select("page_id", F.posexplode(tags).alias("k", "tag")).withColumn("k", F.col("k") + 1)
    length = F.when(F.col("tag") == "p", 4).when(F.col("tag") == "li", 1).when(F.col("tag") == "h1", 2).otherwise(0)
    return e.withColumn("onset", F.sum(length).over(Window.partitionBy("page_id").orderBy("k")) - length)


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def first_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7, S12."""
    return tables.first_wins(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("""WITH u AS (SELECT c_custkey AS k, 0 AS s FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 1 FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 2 FROM customer WHERE c_custkey < 500), n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY s) AS n FROM u)
SELECT s AS source_order, count(*) FILTER (n > 1) AS dropped, count(*) FILTER (n = 1) AS kept FROM n GROUP BY s""")
def merge_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three sources merged, first id wins, duplicates per source."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return tables.duplicates([c.filter("k % 3 = 0"), c.filter("k % 2 = 0"), c.filter("k < 500")], "k")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, S15, J5."""
    return tables.missing(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey")


@query("SELECT 'customers in orders' AS what, count(*) AS n FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT 'parts in lineitem', count(*) FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)")
def collision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Guards as semi joins."""
    one = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")
    two = table(spark, sf_dir, "part").join(table(spark, sf_dir, "lineitem"), F.col("p_partkey") == F.col("l_partkey"), "left_semi")
    return one.agg(F.count(F.lit(1)).alias("n")).select(F.lit("customers in orders").alias("what"), "n").unionByName(two.agg(F.count(F.lit(1)).alias("n")).select(F.lit("parts in lineitem").alias("what"), "n"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 AND s_acctbal > 0 THEN s_acctbal * 2 ELSE s_acctbal END AS s_acctbal FROM supplier")
def metadata_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New values where there are some."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return tables.updated(s, s.filter("s_suppkey % 4 = 0 AND s_acctbal > 0").withColumn("s_acctbal", F.col("s_acctbal") * 2), "s_suppkey", ["s_acctbal"])


@query("SELECT o_orderkey, n_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE lower(c_mktsegment) = 'building' AND o_orderstatus = 'F'")
def inventory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-insensitive filter before joins with small tables."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").filter(F.lower("c_mktsegment") == "building").select("c_custkey", "c_nationkey", "c_mktsegment")
    return o.join(c, o.o_custkey == c.c_custkey).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "n_name", "c_mktsegment")


@query("WITH a AS (SELECT s_suppkey, CAST(regexp_extract(s_name, '([0-9]+)', 1) AS BIGINT) AS no FROM supplier), b AS (SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT) AS no FROM customer) SELECT c_custkey, s_suppkey, lpad(no::VARCHAR, 9, '0') AS padded FROM b LEFT JOIN a USING (no)")
def number_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers joined whatever their padding."""
    a = table(spark, sf_dir, "supplier").select("s_suppkey", tables.unpadded(F.col("s_name")).alias("no"))
    b = table(spark, sf_dir, "customer").select("c_custkey", tables.unpadded(F.col("c_name")).alias("no"))
    return b.join(a, "no", "left").select("c_custkey", "s_suppkey", F.lpad(F.col("no").cast("string"), 9, "0").alias("padded"))


@query("SELECT count(*) AS total, count(*) FILTER (o_custkey IS NOT NULL) AS matched, round(100.0 * count(*) FILTER (o_custkey IS NOT NULL) / count(*), 6) AS rate, min(c_custkey) FILTER (o_custkey IS NULL) AS low, max(c_custkey) FILTER (o_custkey IS NULL) AS high FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders) ON c_custkey = o_custkey")
def match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A20."""
    o = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    x = table(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    lone = F.when(F.col("o_custkey").isNull(), F.col("c_custkey"))
    return x.agg(F.count(F.lit(1)).alias("total"), F.count("o_custkey").alias("matched"), F.round(100 * F.count("o_custkey") / F.count(F.lit(1)), 6).alias("rate"), F.min(lone).alias("low"), F.max(lone).alias("high"))


@query("WITH e AS (SELECT event_id, user_id AS k, ts FROM events WHERE event_type <> 'error'), s AS (SELECT user_id AS k, ts, event_id AS state FROM events WHERE event_type = 'error') SELECT e.event_id, state FROM e ASOF LEFT JOIN s ON e.k = s.k AND e.ts >= s.ts")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last state at or before each event."""
    e = table(spark, sf_dir, "events")
    events = e.filter("event_type <> 'error'").select("event_id", F.col("user_id").alias("k"), "ts")
    states = e.filter("event_type = 'error'").select(F.col("user_id").alias("k"), "ts", F.col("event_id").alias("state"))
    return tables.as_of(events, states, "k", "ts", ["state"]).select("event_id", "state")


_HARM_SQL = f"""{NOTES_SQL}, ev AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY sid, o, p, d ORDER BY pos DESC) AS n FROM notes WHERE NOT cue AND d > 0) WHERE n = 1),
pt AS (SELECT DISTINCT src, x AS at_ FROM (SELECT src, unnest([o, o + d]) AS x FROM ev)), sg AS (SELECT src, at_ AS "begin", lead(at_) OVER (PARTITION BY src ORDER BY at_) AS "end" FROM pt),
sn AS (SELECT sg.src, "begin", "end", list_sort(list_distinct(list(p % 12))) AS pcs, min(p) AS low FROM sg JOIN ev ON ev.src = sg.src AND o <= ("begin" + "end") / 2 AND ("begin" + "end") / 2 < o + d WHERE "end" IS NOT NULL GROUP BY ALL),
tp AS (SELECT r AS root, q AS quality, k, list_transform(t, lambda x: (x + r) % 12) AS tones, list_transform(u, lambda x: (x + r) % 12) AS other, third FROM range(0, 12) a(r), (VALUES (0, 'major', [0, 4, 7], [0, 3, 7], 4), (1, 'minor', [0, 3, 7], [0, 4, 7], 3), (2, 'diminished', [0, 3, 6], [0, 3, 6], 3), (3, 'dominant7', [0, 4, 7, 10], [0, 4, 7, 10], 4)) b(k, q, t, u, third)),
hits AS (SELECT *, len(list_intersect(pcs, tones)) AS h, len(list_intersect(pcs, other)) AS h2, CASE WHEN low % 12 = root THEN 0.12e0 ELSE 0e0 END AS bass, CASE WHEN quality = 'dominant7' AND (len(pcs) < 3 OR NOT list_contains(pcs, (root + 4) % 12)) THEN 0.18e0 ELSE 0e0 END AS seventh FROM sn, tp WHERE len(pcs) >= 2),
ft AS (SELECT *, round(greatest(0e0, least(1e0, 0.52e0 * h / len(pcs) + 0.36e0 * h / len(tones) + bass - 0.08e0 * least(2, len(pcs) - h) - CASE WHEN h < 2 THEN 0.3e0 ELSE 0e0 END - seventh)), 6) AS fit1,
 round(greatest(0e0, least(1e0, 0.52e0 * h2 / len(pcs) + 0.36e0 * h2 / len(other) + bass - 0.08e0 * least(2, len(pcs) - h2) - CASE WHEN h2 < 2 THEN 0.3e0 ELSE 0e0 END - seventh)), 6) AS fit2 FROM hits),
b1 AS (SELECT *, quality IN ('major', 'minor') AND abs(fit2 - fit1) < 1e-6 AND NOT list_contains(pcs, (root + third) % 12) AS vague FROM (SELECT *, row_number() OVER (PARTITION BY src, "begin" ORDER BY fit1 DESC, len(tones) - h, root, k) AS n FROM ft) WHERE n = 1),
ch AS (SELECT src, "begin", "end", root, CASE WHEN vague THEN 'third-ambiguous' ELSE quality END AS quality, CASE WHEN vague THEN round(greatest(0e0, fit1 - 0.08e0), 6) ELSE fit1 END AS fit FROM b1),
mg AS (SELECT *, CASE WHEN root = lag(root) OVER w AND quality = lag(quality) OVER w AND "begin" = lag("end") OVER w THEN 0 ELSE 1 END AS nw FROM ch WINDOW w AS (PARTITION BY src ORDER BY "begin")),
ml AS (SELECT *, sum(nw) OVER (PARTITION BY src ORDER BY "begin") AS isl FROM mg), mc AS (SELECT * FROM (SELECT src, min("begin") AS "begin", max("end") AS "end", any_value(root) AS root, any_value(quality) AS quality, count(*) AS atoms, list_reduce(list(fit ORDER BY "begin"), lambda s, x: round((s + x) / 2, 6)) AS mean FROM ml GROUP BY src, isl) WHERE mean >= 0.38)"""


def _chords(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = harmony.dedupe(event_notes(spark, sf_dir))
    return harmony.fit(harmony.sounding(harmony.segments(ev), ev))


@query(f'WITH {_HARM_SQL} SELECT src, "begin", "end", array_to_string(pcs, \',\') AS pcs, low FROM sn')
def sounding_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which notes sound in the middle of each segment."""
    ev = harmony.dedupe(event_notes(spark, sf_dir))
    return harmony.sounding(harmony.segments(ev), ev).withColumn("pcs", F.array_join(F.col("pcs").cast("array<string>"), ","))


@query(f'WITH {_HARM_SQL} SELECT src, "begin", "end", root::INT AS root, quality, fit::DOUBLE AS fit FROM ch')
def chord_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M20."""
    return _chords(spark, sf_dir).drop("pcs")


@query(f'WITH {_HARM_SQL} SELECT src, "begin", "end", root::INT AS root, quality, atoms FROM mc')
def harmonic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M21."""
    return harmony.merge(_chords(spark, sf_dir))


@query(f"""WITH {_HARM_SQL}, fn AS (SELECT *, root % 12 AS dg, CASE WHEN root % 12 = 7 OR (root % 12 = 11 AND quality = 'diminished') THEN 'dominant' WHEN root % 12 IN (5, 2) THEN 'subdominant' WHEN root % 12 IN (0, 9, 4) THEN 'tonic' ELSE 'other' END AS function FROM mc),
bf AS (SELECT *, lag(function) OVER w AS bfn, lag(dg) OVER w AS bdg FROM fn WINDOW w AS (PARTITION BY src ORDER BY "begin"))
SELECT src, "begin", "end", root::INT AS root, quality, function, CASE WHEN bfn = 'dominant' AND dg = 0 THEN CASE WHEN bdg = 7 THEN 'authentic' ELSE 'imperfect' END WHEN bfn = 'dominant' AND dg IN (9, 8) THEN 'deceptive' WHEN bfn = 'subdominant' AND dg = 0 THEN 'plagal' WHEN function = 'dominant' AND bfn <> 'dominant' THEN 'half' ELSE 'none' END AS cadence FROM bf WHERE bfn IS NOT NULL""")
def cadences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions in C and what each change could close."""
    return harmony.cadences(harmony.merge(_chords(spark, sf_dir)), 0)


@query(f"""WITH {_HARM_SQL}, bd AS (SELECT DISTINCT src, o + d AS at_ FROM ev WHERE d = 2), nr AS (SELECT bd.src, at_, "begin", "end", root, quality, CASE WHEN "begin" = at_ THEN 1 WHEN "begin" < at_ AND "end" > at_ THEN 2 WHEN "end" <= at_ AND at_ - "end" <= 2 THEN 3 END AS kind
 FROM bd JOIN mc ON mc.src = bd.src AND "end" > at_ - 8 AND "begin" < at_ + 2)
SELECT src, at_ AS "at", count(*) AS chords, min(kind)::INT AS arrival, (arg_min(root, (kind, -"begin", root)) FILTER (kind IS NOT NULL))::INT AS root, arg_min(quality, (kind, -"begin", root)) FILTER (kind IS NOT NULL) AS quality FROM nr GROUP BY src, at_""")
def boundary_harmony(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chords around the ends of long notes, and which one they arrive at."""
    ev = harmony.dedupe(event_notes(spark, sf_dir))
    return harmony.around_boundaries(ev.filter("d = 2").select("src", (F.col("o") + F.col("d")).alias("at")).distinct(), harmony.merge(_chords(spark, sf_dir)))


@query("SELECT count(DISTINCT l_orderkey) AS works, count(*) AS streams FROM lineitem")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10."""
    return table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey").alias("works"), F.count(F.lit(1)).alias("streams"))


@query("SELECT l_orderkey, l_partkey, l_extendedprice, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def best_per_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A7."""
    w = Window.partitionBy("l_orderkey").orderBy(F.col("l_extendedprice").desc(), "l_linenumber")
    x = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(w)).filter("n = 1")
    return x.select("l_orderkey", "l_partkey", "l_extendedprice", "l_linenumber")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n, count(*) OVER (PARTITION BY l_suppkey, l_returnflag) AS parts, sum(l_quantity) OVER (PARTITION BY l_suppkey, l_returnflag) AS q FROM lineitem)
SELECT l_suppkey, l_returnflag, l_orderkey, l_extendedprice, parts, q FROM r WHERE n = 1""")
def grouped_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of each group, with what the others add."""
    best = F.max_by(F.struct("l_orderkey", "l_extendedprice"), F.struct("l_extendedprice", -F.col("l_orderkey"), -F.col("l_linenumber")))
    x = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(best.alias("b"), F.count(F.lit(1)).alias("parts"), F.sum("l_quantity").alias("q"))
    return x.select("l_suppkey", "l_returnflag", "b.l_orderkey", "b.l_extendedprice", "parts", "q")


@query("SELECT o_orderkey, o_totalprice, CASE WHEN o_totalprice > 200000 THEN 'exact' ELSE 'similar' END AS kind, row_number() OVER (PARTITION BY o_totalprice > 200000 ORDER BY o_totalprice DESC, o_orderkey) AS place FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200)")
def ranked_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report in two buckets."""
    top = table(spark, sf_dir, "orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(200)
    kind = F.when(F.col("o_totalprice") > 200000, "exact").otherwise("similar")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.col("o_totalprice").desc(), "o_orderkey")).cast("long")
    return top.withColumn("kind", kind).withColumn("place", place).select("o_orderkey", "o_totalprice", "kind", "place")


@query("SELECT c_nationkey, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY md5(c_name), c_custkey) AS n FROM customer) WHERE n <= 7")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bounded, repeatable sample of each stratum."""
    w = Window.partitionBy("c_nationkey").orderBy(F.md5("c_name"), "c_custkey")
    return table(spark, sf_dir, "customer").withColumn("n", F.row_number().over(w)).filter("n <= 7").select("c_nationkey", "c_custkey")


@query("SELECT c_custkey AS k FROM customer WHERE c_custkey % 2 = 0 EXCEPT SELECT o_custkey FROM orders UNION ALL SELECT -count(DISTINCT o_custkey) FROM orders")
def set_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """U3, U5."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    c = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return c.exceptAll(o.distinct()).unionByName(o.agg((-F.count_distinct("k")).alias("k")))


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderkey % 5 > 0), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS v FROM orders WHERE o_orderkey % 3 > 0)
SELECT coalesce(a.k, b.k) AS k, a.v AS old, b.v AS new, CASE WHEN b.k IS NULL THEN 'lost' WHEN a.k IS NULL THEN 'added' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v <> b.v""")
def run_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J17, U3."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"))
    b = o.filter("k % 3 > 0").withColumn("v", F.when(F.col("k") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return tables.changed(o.filter("k % 5 > 0"), b, "k", "v")


_JUDGE_SQL = """res AS (SELECT o_custkey AS case_id, o_orderkey AS item, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders), ex AS (SELECT c_custkey AS case_id, c_custkey % 5 AS kind, item FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderkey) AS item FROM orders GROUP BY 1) ON o_custkey = c_custkey),
jd AS (SELECT ex.case_id, kind, min(rank) AS rank FROM ex LEFT JOIN res ON res.case_id = ex.case_id AND res.item = ex.item GROUP BY ALL)"""


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    o = table(spark, sf_dir, "orders")
    res = o.select(F.col("o_custkey").alias("case_id"), F.col("o_orderkey").alias("item"), F.row_number().over(w).cast("long").alias("rank"))
    last = o.groupBy(F.col("o_custkey").alias("case_id")).agg(F.max("o_orderkey").alias("item"))
    ex = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id")).join(last, "case_id", "left")
    return evaluation.judge(res, ex).withColumn("kind", F.col("case_id") % 5)


@query(f"WITH {_JUDGE_SQL} SELECT case_id, kind, rank, CASE WHEN rank = 1 THEN 'top1' WHEN rank <= 5 THEN 'top5' WHEN rank <= 10 THEN 'top10' WHEN rank <= 100 THEN 'top100' ELSE 'missed' END AS label FROM jd")
def case_judgement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X32."""
    return _judged(spark, sf_dir).select("case_id", "kind", "rank", "label")


@query(f"""WITH {_JUDGE_SQL}, l AS (SELECT kind, list_sort(list(rank) FILTER (rank IS NOT NULL)) AS r, count(*) AS cases, count(*) FILTER (rank <= 1) AS top1, count(*) FILTER (rank <= 5) AS top5, count(*) FILTER (rank <= 10) AS top10, count(*) FILTER (rank <= 100) AS top100, count(*) FILTER (rank IS NULL) AS missed FROM jd GROUP BY kind)
SELECT kind, cases, top1, top5, top10, top100, missed, r[least(len(r) - 1, floor(len(r) * 0.5))::INT + 1] AS median_rank, r[least(len(r) - 1, floor(len(r) * 0.9))::INT + 1] AS p90_rank FROM l""")
def evaluation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, with kinds as mutations."""
    return evaluation.summary(_judged(spark, sf_dir), "kind")


@query("""SELECT n_regionkey, c_mktsegment, count(*) AS n, grouping(n_regionkey, c_mktsegment) AS level FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (n_regionkey, c_mktsegment)""")
def evaluation_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extension: any two dimensions of an evaluation at every level."""
    x = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return x.cube("n_regionkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def _melody(notes: DataFrame, **options) -> search.Query:
    rows = query_notes(notes, change=options.pop("change", None)).orderBy("pos").collect()
    base = rows[0]["o"]
    return search.Query([{"p": r["p"], "d": r["d"], "o": r["o"] - base, "spelling": r["spelling"], "cue": r["cue"]} for r in rows], **options)


def _search(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    n = event_notes(spark, sf_dir).persist()  # read once for the index, the passages and the query
    return search.search(n, tokens.tokens(n).persist(), _melody(n, **options))


@query()
def melody_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry A: the whole search for a passage with one changed pitch."""
    return _search(spark, sf_dir, change={5: 70})


@query()
def melody_search_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry A, exact occurrences only."""
    return _search(spark, sf_dir, exact_only=True)


@query()
def melody_search_rhythm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry A by rhythm alone."""
    return _search(spark, sf_dir, mode="rhythm")


@query()
def melody_search_contour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry A by contour alone."""
    return _search(spark, sf_dir, mode="contour")


_GATE_SQL = """g AS (SELECT l_orderkey AS k, l_linenumber AS j, l_quantity * 2 AS local, l_extendedprice / 1000 AS interval, 50 + l_quantity AS rhythm, l_discount * 1000 AS structural FROM lineitem)"""


@query(f"WITH {_GATE_SQL} SELECT k, j, (local >= 55 AND interval >= 65 AND rhythm >= 55) OR (local >= 50 AND interval >= 60 AND structural >= 82 AND rhythm >= 45) AS admitted, least(97, greatest(0, 0.55 * local + 0.45 * (0.75 * least(100, interval) + 0.25 * rhythm) + greatest(-3, least(1, structural / 50 - 1)))) > 60 AS high FROM g")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates and calibrated ranking as expressions."""
    li = table(spark, sf_dir, "lineitem")
    g = li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("j"), (F.col("l_quantity") * 2).alias("local"), (F.col("l_extendedprice") / 1000).alias("interval"), (50 + F.col("l_quantity")).alias("rhythm"), (F.col("l_discount") * 1000).alias("structural"))
    plain = (F.col("local") >= 55) & (F.col("interval") >= 65) & (F.col("rhythm") >= 55)
    other = (F.col("local") >= 50) & (F.col("interval") >= 60) & (F.col("structural") >= 82) & (F.col("rhythm") >= 45)
    moved = F.greatest(F.lit(-3.0), F.least(F.lit(1.0), F.col("structural") / 50 - 1))
    ranking = F.least(F.lit(97.0), F.greatest(F.lit(0.0), 0.55 * F.col("local") + 0.45 * (0.75 * F.least(F.lit(100.0), F.col("interval")) + 0.25 * F.col("rhythm")) + moved))
    return g.select("k", "j", (plain | other).alias("admitted"), (ranking > 60).alias("high"))


@query(f"""WITH {_LOCAL_SQL}, s AS (SELECT sid, pos, strength FROM loc WHERE strength >= 0.65), i AS (SELECT sid, greatest(0, pos - 11) AS a, pos + 22 AS b, strength FROM s), m AS (SELECT *, max(b) OVER (PARTITION BY sid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pb FROM i),
g AS (SELECT *, sum(CASE WHEN pb IS NULL OR a > pb THEN 1 ELSE 0 END) OVER (PARTITION BY sid ORDER BY a, b) AS isl FROM m) SELECT sid, min(a)::BIGINT AS start, max(b)::BIGINT AS "end", max(strength) AS evidence FROM g GROUP BY sid, isl""")
def seed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows around seeds, overlapping ones merged."""
    s = phrase.local_boundaries(event_notes(spark, sf_dir)).filter("strength >= 0.65")
    i = s.select("sid", F.greatest(F.lit(0), F.col("pos") - 11).cast("long").alias("a"), (F.col("pos") + 22).cast("long").alias("b"), "strength")
    w = Window.partitionBy("sid").orderBy("a", "b")
    reach = F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1))
    g = i.withColumn("reach", reach).withColumn("island", F.sum(F.when(F.col("reach").isNull() | (F.col("a") > F.col("reach")), 1).otherwise(0)).over(w))
    return g.groupBy("sid", "island").agg(F.min("a").alias("start"), F.max("b").alias("end"), F.max("strength").alias("evidence")).drop("island")


@query(f"WITH {NOTES_SQL} SELECT sid, pos, dense_rank() OVER (PARTITION BY sid ORDER BY m) AS ordinal, m - min(m) OVER (PARTITION BY sid) AS label FROM notes")
def measure_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W12, W13."""
    n = event_notes(spark, sf_dir)
    w = Window.partitionBy("sid")
    return n.select("sid", "pos", F.dense_rank().over(w.orderBy("m")).cast("long").alias("ordinal"), (F.col("m") - F.min("m").over(w)).alias("label"))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) WHERE b IS NULL OR b <> event_type")
def consecutive_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W15."""
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    b = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("b", b).filter("b IS NULL OR b <> event_type").select("user_id", "event_id", "event_type")


@query(f"WITH {NOTES_SQL}, g AS (SELECT sid, p - lag(p, 12) OVER (PARTITION BY sid ORDER BY pos) AS x, pos FROM notes), c AS (SELECT sid, x, count(*) AS n, min(pos) AS f FROM g WHERE x IS NOT NULL GROUP BY ALL) SELECT sid, arg_max(x, (n, -f)) AS mode, max(n) AS n FROM c GROUP BY sid")
def transposition_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common difference, the first seen among equals."""
    n = event_notes(spark, sf_dir).withColumn("x", F.col("p") - F.lag("p", 12).over(Window.partitionBy("sid").orderBy("pos"))).filter("x IS NOT NULL")
    c = n.groupBy("sid", "x").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("f"))
    return c.groupBy("sid").agg(F.max_by("x", F.struct("n", -F.col("f"))).alias("mode"), F.max("n").alias("n"))

