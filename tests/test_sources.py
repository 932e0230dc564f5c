import pytest
from pyspark.sql import functions as F

from strophic.operators.tokens import tokens
from strophic.sources import musicxml, tables
from strophic.streaming import incremental

SCORE = """<?xml version="1.0"?><score-partwise><work><work-title>Round</work-title></work><identification><creator type="composer">Nobody</creator></identification>
<part-list><score-part id="P1"><part-name>Voice</part-name></score-part></part-list><part id="P1">
<measure number="1"><attributes><divisions>2</divisions><time><beats>4</beats><beat-type>4</beat-type></time></attributes>
<note><pitch><step>C</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice></note>
<note><pitch><step>E</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice></note>
<note><chord/><pitch><step>G</step><octave>4</octave></pitch><duration>2</duration><voice>1</voice></note>
<note><rest/><duration>2</duration><voice>1</voice></note><note><pitch><step>F</step><alter>1</alter><octave>4</octave></pitch><duration>2</duration><tie type="start"/><voice>1</voice></note>
<backup><duration>8</duration></backup><note><pitch><step>C</step><octave>3</octave></pitch><duration>8</duration><voice>2</voice></note></measure>
<measure number="2"><note><pitch><step>F</step><alter>1</alter><octave>4</octave></pitch><duration>4</duration><tie type="stop"/><voice>1</voice></note>
<note><grace/><pitch><step>A</step><octave>4</octave></pitch><voice>1</voice></note><note><pitch><step>G</step><octave>4</octave></pitch><duration>4</duration><voice>1</voice></note></measure>
</part></score-partwise>"""


def test_musicxml():
    work = musicxml.parse(SCORE.encode())
    one, two = work["streams"]
    assert [(n["o"], n["d"], n["p"], n["s"], n["tm"]) for n in one["notes"]] == [(0, 1, 60, "C", None), (1, 1, 67, "G", None), (3, 3, 66, "F#", 2), (6, 2, 67, "G", None)]
    assert two["id"] == "P1:1:2" and work["title"] == "Round" and work["work_id"].startswith("work-")
    with pytest.raises(ValueError):
        musicxml.parse(b"<score-timewise/>")


def test_musicxml_files(spark, tmp_path):
    import zipfile

    (tmp_path / "a.xml").write_text(SCORE)
    (tmp_path / "bad.xml").write_text("<oops")
    with zipfile.ZipFile(tmp_path / "b.mxl", "w") as z:
        z.writestr("META-INF/container.xml", "<container/>")
        z.writestr("score.xml", SCORE.replace("Round", "Canon"))
    works = musicxml.read(spark, str(tmp_path)).cache()
    assert sorted((r.title or "", r.error is None) for r in works.collect()) == [("", False), ("Canon", True), ("Round", True)]
    streams = musicxml.streams(works)
    assert streams.count() == 4
    assert tokens(musicxml.notes(streams)).filter("kind = 'i'").count() == 2
    raw = spark.createDataFrame([("x", SCORE)], "path string, text string")
    assert [tuple(r) for r in musicxml.meter_timeline(raw).collect()] == [("x", "P1", 1, 4, 4)]


def test_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_bytes('{"id": 1, "t": "a\\u2028b"}\n{"id": 2, "t": "a b"}\nbroken\n'.encode())
    good, bad = tables.read_jsonl(spark, str(tmp_path), "id int, t string")
    assert good.count() == 2 and [r.line for r in bad.collect()] == ["broken"]


def test_merges(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", "s1"), (2, "y", "s1")], "id int, t string, source string")
    b = spark.createDataFrame([(2, "z", "s2"), (3, "w", "s2")], "id int, t string, source string")
    assert {(r.id, r.t) for r in tables.merge_first([a, b], "id", "t").collect()} == {(1, "x"), (2, "y"), (3, "w")}
    with pytest.raises(ValueError):
        tables.append_checked(a, b, "id", "source")
    assert tables.append_checked(a, b.filter("id = 3"), "id", "source").count() == 3
    postings = spark.createDataFrame([("i:1,2,3", 1, 0), ("i:1,2,4", 1, 1)], "token string, sid long, pos int")
    path = str(tmp_path / "index")
    tables.write_index(postings, path, 4)
    tables.validate(spark, path, ["token", "sid", "pos"])
    assert tables.lookup(spark, path, postings.filter("pos = 1"), 4).select("pos").collect()[0].pos == 1
    with pytest.raises(ValueError):
        tables.validate(spark, path, ["nothing"])


def test_incremental(spark, tmp_path):
    src, out, check = (str(tmp_path / x) for x in ("src", "out", "check"))
    rows = spark.range(6).select(F.lit(1).cast("long").alias("sid"), F.col("id").cast("int").alias("pos"))
    double = lambda df: df.withColumn("pos", F.col("pos") * 2)
    for part in ("pos < 3", "pos >= 3"):
        rows.filter(part).write.mode("append").parquet(src)
        incremental.index_available(spark, "sid long, pos int", src, out, check, double).awaitTermination()
    assert sorted(r.pos for r in spark.read.parquet(out).collect()) == [0, 2, 4, 6, 8, 10]
