"""Score files to notes: MusicXML and zipped MXL, parsed in the executors; one file is one row.

Order among siblings matters (notes, backups and forwards move one clock), so a file is parsed as a whole. Times are exact
fractions while parsing. A file that can't be read gives a row with ``error`` and no notes.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections import defaultdict
from fractions import Fraction
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOTE = "struct<m:int,mn:string,b:double,o:double,d:double,p:int,s:string,ts:boolean,te:boolean,tm:int,u:boolean>"
WORK = f"path string, work_id string, hash string, title string, composer string, duration double, streams array<struct<id:string,part:string,part_name:string,staff:string,voice:string,role:double,notes:array<{NOTE}>>>, error string"
_SEMITONE = {"C": 0, "D": 2, "E": 4, "F": 5, "G": 7, "A": 9, "B": 11}


def unzip(raw: bytes) -> bytes:
    """The score inside an MXL archive: its first XML entry that isn't the container."""
    if raw[:2] != b"PK":
        return raw
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if n.lower().endswith((".xml", ".musicxml")) and not n.lower().endswith("container.xml")]
        if not names:
            raise ValueError("no score in the archive")
        return z.read(names[0])


def _text(node, path: str, other: str = "") -> str:
    found = node.find(path)
    return (found.text or "").strip() if found is not None else other


def _quarters(time) -> Fraction:
    beats = sum(int(x) for x in _text(time, "beats", "4").split("+"))
    return Fraction(4 * beats, int(_text(time, "beat-type", "4")))


class Part:
    """Walks the measures of one part with a clock in quarters."""

    def __init__(self, part):
        self.events: dict[tuple[str, str], list[dict]] = defaultdict(list)
        self.start, self.divisions, self.nominal = Fraction(0), 1, Fraction(4)
        for ordinal, measure in enumerate(part.findall("measure"), 1):
            self.clock = self.reached = self.chord = Fraction(0)
            for node in measure:
                getattr(self, "_" + node.tag.replace("-", "_"), lambda *_: None)(node, ordinal, measure.get("number", ""))
            pickup = ordinal == 1 and 0 < self.reached < self.nominal
            self.start += self.reached if pickup else max(self.nominal, self.reached)

    def _length(self, node) -> Fraction:
        return Fraction(_text(node, "duration", "0") or "0") / self.divisions

    def _attributes(self, node, *_):
        self.divisions = int(_text(node, "divisions", str(self.divisions)))
        if node.find("time") is not None and node.find("time/beats") is not None:
            self.nominal = _quarters(node.find("time"))

    def _backup(self, node, *_):
        self.clock = max(Fraction(0), self.clock - self._length(node))

    def _forward(self, node, *_):
        self.clock += self._length(node)
        self.reached = max(self.reached, self.clock)

    def _note(self, node, ordinal: int, number: str):
        grace = node.find("grace") is not None
        length = Fraction(0) if grace else self._length(node)
        at = self.chord if node.find("chord") is not None else self.clock
        if node.find("chord") is None:
            self.chord = at
            self.clock += length
            self.reached = max(self.reached, self.clock)
        pitch = node.find("pitch")
        if pitch is None:
            return
        step, alter = _text(pitch, "step"), int(float(_text(pitch, "alter", "0") or 0))
        ties = {t.get("type") for t in node.findall("tie")}
        cue = node.find("cue") is not None or _text(node, "type") == "cue" or (node.find("type") is not None and node.find("type").get("size") == "cue")
        self.events[_text(node, "staff", "1"), _text(node, "voice", "1")].append({
            "m": ordinal, "mn": number, "b": at + 1, "o": self.start + at, "d": length, "p": 12 * (int(_text(pitch, "octave", "4")) + 1) + _SEMITONE[step] + alter,
            "s": step + {1: "#", -1: "b", 2: "##", -2: "bb"}.get(alter, ""), "ts": "start" in ties, "te": "stop" in ties, "tm": None, "u": cue,
        })


def highest(events: list[dict]) -> list[dict]:
    """One note at each onset: the highest that sounds."""
    best: dict[Fraction, dict] = {}
    for e in events:
        if e["d"] > 0 and (e["o"] not in best or e["p"] > best[e["o"]]["p"]):
            best[e["o"]] = e
    return [best[o] for o in sorted(best)]


def joined(notes: list[dict]) -> list[dict]:
    """Tied notes as one; the tie's end keeps its measure."""
    out: list[dict] = []
    for n in notes:
        last = out[-1] if out else None
        if n["te"] and last and last["ts"] and last["p"] == n["p"] and last["o"] + last["d"] == n["o"]:
            last["d"], last["tm"], last["ts"] = last["d"] + n["d"], n["m"], n["ts"] or last["ts"]
        else:
            out.append(dict(n))
    return out


def role(notes: list[dict], n_onsets: int) -> float:
    height = sum(n["p"] for n in notes) / len(notes)
    return min(1.0, 0.35 + 0.25 * min(1.0, len(notes) / max(1, n_onsets)) + 0.2 * min(1.0, len(notes) / 64) + 0.2 * max(0.0, min(1.0, (height - 48) / 36)))


def parse(raw: bytes) -> dict:
    """A work with its monophonic streams, one per part, staff and voice."""
    raw = unzip(raw)
    root = ElementTree.fromstring(raw)
    if root.tag != "score-partwise":
        raise ValueError(f"{root.tag} isn't score-partwise")
    digest = hashlib.sha256(raw).hexdigest()
    names = {p.get("id"): _text(p, "part-name") for p in root.findall("part-list/score-part")}
    composer = next((c.text or "" for c in root.iter("creator") if c.get("type") == "composer"), "")
    work = {"work_id": f"work-{digest[:16]}", "hash": digest, "title": _text(root, "work/work-title") or _text(root, "movement-title"), "composer": composer.strip(), "duration": 0.0, "streams": []}
    for part in root.findall("part"):
        walked = Part(part)
        work["duration"] = max(work["duration"], float(walked.start))
        for (staff, voice), events in sorted(walked.events.items()):
            notes = joined(highest(events))
            if not notes:
                continue
            own = {"id": f"{part.get('id')}:{staff}:{voice}", "part": part.get("id"), "part_name": names.get(part.get("id"), ""), "staff": staff, "voice": voice, "role": role(notes, len({e["o"] for e in events})), "notes": notes}
            work["streams"].append(own)
            plain = [n for n in notes if not n["u"]]
            if len(plain) >= 3 and len(notes) - len(plain) >= 2 * len(plain):
                work["streams"].append(own | {"id": own["id"] + ":structural", "role": min(1.0, own["role"] + 0.15), "notes": plain})
    for s in work["streams"]:
        s["notes"] = [{k: round(float(v), 6) if isinstance(v, Fraction) else v for k, v in n.items()} for n in s["notes"]]
    return work


def _parse_files(batches):
    for pdf in batches:
        rows = []
        for path, raw in zip(pdf["path"], pdf["content"]):
            row = dict.fromkeys(("work_id", "hash", "title", "composer", "duration", "streams", "error"))
            try:
                row |= parse(bytes(raw))
            except (ValueError, KeyError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                row["error"] = str(e)
            rows.append({"path": path} | row)
        yield pd.DataFrame(rows, columns=["path", "work_id", "hash", "title", "composer", "duration", "streams", "error"])


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All score files under a folder, one row a file; files are dealt to tasks by size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{xml,musicxml,mxl}").load(folder)
    return files.select("path", "content").mapInPandas(_parse_files, WORK)


def streams(works: DataFrame) -> DataFrame:
    """One row a stream; the first keeps its work's id, the others add a hash of their own."""
    each = works.filter("error IS NULL").select("work_id", "title", "composer", "path", F.posexplode("streams").alias("k", "s"))
    name = F.when(F.col("k") == 0, F.col("work_id")).otherwise(F.concat_ws("-", "work_id", F.left(F.sha1("s.id"), F.lit(8))))
    return each.select(name.alias("stream"), "work_id", "title", "composer", F.col("path").alias("source"), F.col("s.id").alias("stream_id"), "s.part_name", "s.role", "s.notes")


def notes(streams_: DataFrame) -> DataFrame:
    """One row a note, keyed by a 64-bit hash of the stream's name as ``sid`` and of its source as ``src``."""
    each = streams_.select(F.xxhash64("stream").alias("sid"), F.xxhash64("source").alias("src"), "stream", F.posexplode("notes").alias("pos", "n"))
    n = each.select("sid", "src", "stream", "pos", *(F.col(f"n.{c}").alias(c) for c in ("p", "d", "o", "m", "b", "ts", "te", "tm")), F.col("n.s").alias("spelling"), F.col("n.u").alias("cue"))
    return n.withColumn("gap", F.lit(0.0))


def meter_timeline(xml: DataFrame) -> DataFrame:
    """(``path``, ``part``, ``measure``, ``count``, ``unit``) of declared meters, in the JVM: ordered siblings by regular expressions."""
    part = F.explode(F.expr(r"""regexp_extract_all(text, '(?s)<part [^>]*id="[^"]*".*?</part>', 0)""")).alias("x")
    parts = xml.select("path", part).withColumn("part", F.regexp_extract("x", r'<part [^>]*id="([^"]*)"', 1))
    each = parts.select("path", "part", F.posexplode(F.expr(r"regexp_extract_all(x, '(?s)<measure[ >].*?</measure>', 0)")).alias("k", "measure_xml"))
    beats = F.aggregate(F.split(F.regexp_extract("measure_xml", r"<beats>([0-9+]+)</beats>", 1), r"\+"), F.lit(0), lambda s, x: s + F.try_to_number(x, F.lit("999")).cast("int"))
    own = each.filter(F.col("measure_xml").contains("<beats>"))
    return own.select("path", "part", (F.col("k") + 1).alias("measure"), beats.alias("count"), F.regexp_extract("measure_xml", r"<beat-type>(\d+)<", 1).cast("int").alias("unit"))


def expand_empty_measures(text):
    """Self-closing measures as empty elements, so that ordinals count them."""
    return F.regexp_replace(text, r"<measure([^>]*)/>", "<measure$1></measure>")
