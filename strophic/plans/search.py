"""The whole melody search: retrieve, match, align, score, gate, rank.

Retrieval, exact occurrences and ranking are DataFrame plans. What survives retrieval, at most a few thousand windows a
query, is scored in Arrow batches by ``Scorer``, whose note annotations come from the window operators.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strophic.operators import alignment, annotation, matching, retrieval
from strophic.operators.tokens import capped_postings, for_mode, frequencies, rarity, tokens

AUXILIARY = {"passing", "neighbor"}


@dataclass
class Query:
    """A melody and how to search for it. ``notes``: dicts with ``p``, ``d``, ``o`` and optional ``spelling``, ``ts``, ``te``, ``cue``."""

    notes: list[dict]
    mode: str = "melody_rhythm"
    meter: tuple[int, int] = (4, 4)
    exact_only: bool = False
    exact_intervals: bool = False
    exact_pitch: bool = False
    exact_rhythm: bool = False
    downbeat_boost: bool = False
    starts_on_downbeat: bool = False
    scope: list[int] = field(default_factory=list)
    exclude: list[int] = field(default_factory=list)

    @classmethod
    def of(cls, events: list[dict], rests: bool = True, **options) -> "Query":
        """From events (``kind`` note or rest, ``p``, ``d``, optional ``tie``): onsets are sums, tied notes one note."""
        notes, at = [], 0.0
        for e in events:
            d = float(e.get("d") or 0)
            if e.get("kind", "note") == "note" and e.get("p") is not None:
                last = notes[-1] if notes else None
                if e.get("tie") and last and last.get("tie") == e["tie"] and last["p"] == e["p"]:
                    last["d"] += d
                else:
                    notes.append({**e, "d": d, "o": at})
            elif not rests:
                continue
            at += d
        return cls(notes, **options)

    def frame(self, spark) -> DataFrame:
        quarters = self.meter[0] * 4 / self.meter[1]
        rows = [(0, k, n["p"], float(n["d"]), float(n["o"]), float(n["o"]) % quarters + 1, bool(n.get("cue")), n.get("spelling") or "", bool(n.get("ts")), bool(n.get("te"))) for k, n in enumerate(self.notes)]
        return spark.createDataFrame(rows, "sid long, pos int, p int, d double, o double, b double, cue boolean, spelling string, ts boolean, te boolean")


def retrieve(notes: DataFrame, postings: DataFrame, query: Query) -> DataFrame:
    """Diversified candidates (``sid``, ``start``, ``evidence``) of a query."""
    n = len(query.notes)
    q = _held(for_mode(tokens(query.frame(notes.sparkSession)).drop("sid"), query.mode))  # a few dozen rows
    steps = [b["p"] - a["p"] for a, b in zip(query.notes, query.notes[1:])]
    robust = query.mode != "rhythm" and n >= 8 and not _says_little(query.notes, steps)
    limits = _held(rarity(q, frequencies(postings.join(F.broadcast(q.select("token").distinct()), "token")), n, robust))
    own = capped_postings(postings, limits).select("token", "sid", "pos").distinct()
    found = retrieval.candidates(own, q, n, q.filter("kind IN ('i', 'i5')").count())
    found = retrieval.scoped(found, query.scope, query.exclude)
    return retrieval.diversified(found, 8 if n >= 8 else 3, 1800 if query.exact_only else 1400 if n >= 8 else 350)


def _held(rows: DataFrame) -> DataFrame:
    """A table of bounded size as rows on the driver: what follows is planned without what went before."""
    return rows.sparkSession.createDataFrame(rows.collect(), rows.schema)


def _says_little(notes: list[dict], steps: list[int]) -> bool:
    n, pitches = len(notes), [x["p"] for x in notes]
    top = max(pitches.count(p) for p in set(pitches)) / max(1, n)
    return n >= 6 and (top >= 0.45 or steps.count(0) / max(1, len(steps)) >= 0.45 or len(set(pitches)) <= max(2, n // 4))


def _clip(x: float, low: float = 0.0, high: float = 100.0) -> float:
    return max(low, min(high, x))


def _mean(x: list[float]) -> float:
    return sum(x) / len(x) if x else 0.0


def _sign(x: float) -> int:
    return (x > 0) - (x < 0)


def _shape(a: dict, b: dict) -> str:
    step = b["p"] - a["p"]
    if not step:
        return "S"
    letters = ["CDEFGAB".find((n.get("spelling") or " ")[0].upper()) for n in (a, b)]
    near = min(letters) >= 0 and (letters[1] - letters[0]) % 7 in (1, 6)
    return ("STEP" if abs(step) <= 2 or abs(step) == 3 and near else "LEAP") + ("_U" if step > 0 else "_D")


def residual(q: list[dict], c: list[dict]) -> float:
    moved = sorted(b["p"] - a["p"] for a, b in zip(q, c))
    best = moved[len(moved) // 2] if moved else 0
    return _clip(100 - _mean([min(100.0, 14 * abs(b["p"] - a["p"] - best)) for a, b in zip(q, c)]))


def times(notes: list[dict]) -> list[float]:
    return [max(1 / 64, b["o"] - a["o"]) for a, b in zip(notes, notes[1:])] + [max(1 / 64, notes[-1]["d"])] if notes else []


def rhythm_likeness(q: list[dict], c: list[dict]) -> float:
    a, b = times(q), times(c)
    if len(a) != len(b) or not a:
        return 0.0

    def scaled(x):
        s = sorted(x)
        middle = (s[(len(s) - 1) // 2] + s[len(s) // 2]) / 2 or 1
        return [min(2.0, v / middle) for v in x]

    a, b = scaled(a), scaled(b)
    label = lambda v: 0 if v < 0.75 else 2 if v > 1.5 else 1
    kinds = _mean([0 if label(x) == label(y) else 55 if 1 in (label(x), label(y)) else 100 for x, y in zip(a, b)])
    sizes = _mean([min(100.0, 60 * abs(math.log2(max(0.125, x) / max(0.125, y)))) for x, y in zip(a, b)])
    return _clip(100 - 0.5 * kinds - 0.5 * sizes)


def channel_scores(q: list[dict], c: list[dict], mode: str) -> dict[str, float]:
    qi, ci = ([b["p"] - a["p"] for a, b in zip(x, x[1:])] for x in (q, c))
    contour = 100 - _mean([0.0 if _sign(a) == _sign(b) else 100.0 for a, b in zip(qi, ci)])
    edge = 100 - _mean([min(100.0, 14 * abs(a - b)) for a, b in zip(qi, ci)])
    moved = residual(q, c)

    def ratios(x):
        base = next((n["d"] for n in x if n["d"] > 0), 1)
        return [math.floor(n["d"] / base * 8 + 0.5) / 8 for n in x]

    rhythm = 100 - _mean([min(100.0, 45 * abs(a - b)) for a, b in zip(ratios(q), ratios(c))])
    if mode == "contour":
        weight = [float(n.get("confidence", 1)) for n in q[1:]]
        lost = sum(w for w, k in zip(weight, range(len(qi))) if _shape(q[k], q[k + 1]) != _shape(c[k], c[k + 1]))
        moved = _clip(100 - 100 * lost / (sum(weight) or 1))
        return {"pitch": moved, "interval": moved, "contour": _clip(contour), "rhythm": _clip(contour)}
    return {"pitch": moved, "interval": _clip(0.6 * edge + 0.4 * moved), "contour": _clip(contour), "rhythm": _clip(rhythm)}


def equality(q: list[dict], c: list[dict]) -> float:
    pairs = [(q[i]["p"] == q[j]["p"]) == (c[i]["p"] == c[j]["p"]) for i in range(len(q)) for j in range(i + 1, len(q))] if len(q) == len(c) else []
    return 100 * sum(pairs) / len(pairs) if pairs else 0.0


def align_notes(q: list[dict], c: list[dict], mode: str) -> dict:
    """Alignment of annotated notes by intervals, direction, shape and (with rhythm) ratios of durations."""

    def substitute(i: int, j: int) -> float:
        if not i:
            return 0.0
        a = q[i]["p"] - q[i - 1]["p"]
        b = c[j]["p"] - c[j - 1]["p"] if j else 99
        turned = _sign(a) != _sign(b)
        shape = 0.0 if (_shape(q[i - 1], q[i]) == _shape(c[j - 1], c[j]) if j else _shape(q[i - 1], q[i]) == "LEAP_U") else 0.32
        if mode == "contour":
            return 1.0 if turned else shape * float(q[i].get("confidence", 1))
        size = min(1.0, abs(a - b) / 7)
        importance = 0.45 + 0.55 * min(q[i].get("weight", 1.0), c[j].get("weight", 1.0))
        if mode != "melody_rhythm":
            return importance * (0.58 * size + 0.3 * turned + 0.12 * shape)
        ratio = lambda x, k: x[k]["d"] / (x[k - 1]["d"] or 1)
        uneven = min(1.0, abs(math.log2(max(0.0625, ratio(q, i)) / max(0.0625, ratio(c, j) if j else 4.0))) / 2)
        return importance * (0.48 * size + 0.3 * turned + 0.14 * shape + 0.08 * uneven)

    def insert(j: int) -> float:
        w = c[j].get("weight", 0.8)
        return 0.18 + 0.22 * w if c[j].get("role") in AUXILIARY else 0.32 + 0.36 * w

    return alignment.align(len(q), len(c), substitute, insert, lambda i: 0.24 + 0.38 * q[i].get("weight", 0.8))


def _pillars(notes: list[dict], skeleton: bool) -> list[dict]:
    if skeleton:
        able = [n for n in notes if n.get("attack", True) and n.get("role") not in {"cue", *AUXILIARY}]
        own = [n for n in able if n["metric"] >= 0.62 or n["weight"] >= 0.72]
        few = 4
    else:
        able, own, few = notes, [n for n in notes if n["weight"] >= 0.68], 3
    if len(own) < 3:
        own = sorted(sorted(able, key=lambda n: -n["weight"])[: min(few, len(notes))], key=lambda n: n["o"])
    return [{**n, "weight": 1.0} for n in own]


def compare_pillars(q: list[dict], c: list[dict]) -> tuple[float, float]:
    """Similarity of the heaviest notes, and the bonus for it."""
    a, b = _pillars(q, False), _pillars(c, False)
    if min(len(a), len(b)) < 3:
        return 0.0, 0.0
    x = align_notes(a, b, "melody")
    sure = min(1.0, len(a) / 5, len(b) / 5) * x["coverage"]
    step = next((v for least, v in ((92, 10), (82, 6), (70, 3), (60, 1)) if x["similarity"] >= least), 0)
    return x["similarity"], min(12.0, sure * step)


def compare_skeletons(q: list[dict], c: list[dict]) -> dict[str, float]:
    """Likeness of notes on strong beats, without ornaments."""
    a, b = _pillars(q, True), _pillars(c, True)
    if min(len(a), len(b)) < 3:
        return dict.fromkeys(("similarity", "pitch", "contour", "coverage", "strong"), 0.0)
    x = align_notes(a, b, "melody")
    pairs = [(i, j) for i, j, *_ in x["path"] if i is not None and j is not None]
    s = channel_scores([a[i] for i, _ in pairs], [b[j] for _, j in pairs], "melody")
    strong = {i for i, n in enumerate(a) if n["metric"] >= 0.62 or n["weight"] >= 0.72}
    hit = len(strong & {i for i, _ in pairs}) / max(1, len(strong))
    return {"similarity": _clip(0.45 * x["similarity"] + 0.4 * s["pitch"] + 0.1 * s["interval"] + 0.05 * s["contour"]), "pitch": s["pitch"], "contour": s["contour"], "coverage": x["coverage"], "strong": hit}


def metric_evidence(q: list[dict], c: list[dict], steps: list[tuple]) -> dict[str, float]:
    """Strong beats of the query on equal beats of the candidate; conflicts; weak notes on strong beats."""
    pairs = [(q[i], c[j], cost) for i, j, cost, _ in steps if i is not None and j is not None]
    strong = [x for x in pairs if x[0]["metric"] >= 0.65]
    if not strong:
        return {"score": 50.0, "adjustment": 0.0, "matches": 0}
    hits = sum(abs(a["metric"] - b["metric"]) <= 0.2 and cost < 0.18 for a, b, cost in strong)
    over = sum(a["metric"] < 0.5 and b["metric"] >= 0.65 for a, b, _ in pairs) / max(1, len(pairs))
    hit, miss = hits / len(strong), 1 - hits / len(strong)
    return {"score": _clip(50 + 50 * hit - 35 * miss - 45 * over), "adjustment": 6 * hit - 14 * miss - 8 * over, "matches": hits}


def skipped_are_ornaments(path: list[tuple], c: list[dict]) -> bool:
    """Whether the candidate's skipped notes can be explained."""
    skipped = [j for i, j, _, kind in path if kind == "insertion"]
    if not skipped:
        return True
    if len(skipped) == 1:
        return c[skipped[0]].get("role") != "pillar"

    def explained(j: int) -> bool:
        n = c[j]
        return n.get("role") == "cue" or (n.get("role") in AUXILIARY) + bool(n.get("short")) + bool(n.get("weak")) >= 2

    if sum(map(explained, skipped)) / len(skipped) < 0.8:
        return False
    run: list[int] = []
    for j in sorted(skipped):
        run = [*run, j] if run and j == run[-1] + 1 else [j]
        if len(run) >= 3 and not all(map(explained, run)):
            return False
    return True


def admitted(mode: str, exact: bool, local: float, s: dict[str, float], structural: float, n: int) -> bool:
    if mode == "contour" or exact:
        return True
    timed = mode == "melody_rhythm"
    plain = local >= 55 and s["interval"] >= 65 and (not timed or s["rhythm"] >= 55)
    by_structure = local >= 50 and s["interval"] >= 60 and structural >= 82 and (not timed or s["rhythm"] >= 45)
    long = timed and n >= 8 and local >= 68 and s["interval"] >= 90 and s["contour"] >= 85 and s["rhythm"] >= 35
    return plain or by_structure or long


def calibrated(exact: bool, local: float, s: dict[str, float], mode: str, adjustment: float) -> float:
    if exact:
        return 100.0
    mix = {"melody_rhythm": (0.75, 0.0, 0.25), "contour": (0.3, 0.7, 0.0), "rhythm": (0.0, 0.0, 1.0)}.get(mode, (0.85, 0.15, 0.0))
    surface = mix[0] * s["interval"] + mix[1] * s["contour"] + mix[2] * s["rhythm"]
    return _clip(min(97.0, 0.55 * local + 0.45 * surface + _clip(adjustment, -3, 1)))


class Scorer:
    """Scores one candidate window against an annotated query; None if a gate rejects it."""

    def __init__(self, query: Query, notes: list[dict]):
        self.query, self.notes, self.n = query, notes, len(notes)
        self.steps = [b["p"] - a["p"] for a, b in zip(notes, notes[1:])]
        self.little = _says_little(notes, self.steps)

    def __call__(self, window: list[dict], start: int, span: tuple[int, int] | None, hits: float, role: float) -> dict | None:
        q, mode, n = self.notes, self.query.mode, self.n
        timed, contour, rhythm_only = mode == "melody_rhythm", mode == "contour", mode == "rhythm"
        strict = self.query.exact_only or self.query.exact_intervals
        if strict and not span or len(window) < max(4, n - 1):
            return None
        exact_span = span is not None and not rhythm_only
        if exact_span or rhythm_only or contour:
            at = span[0] if exact_span else start
            size = min(n, len(window) - at)
            x = {"path": [(k, at + k, 0.0, "match") for k in range(size)], "start": at, "end": at + size - 1, "coverage": size / n, "similarity": 100.0}
        else:
            x = align_notes(q, window, mode)
        if x["coverage"] < 0.75 or not skipped_are_ornaments(x["path"], window):
            return None
        pairs = [(i, j) for i, j, *_ in x["path"] if i is not None and j is not None]
        if not exact_span and not contour and len(pairs) / (x["end"] - x["start"] + 1) < 0.6:
            return None
        a, b = [q[i] for i, _ in pairs], [window[j] for _, j in pairs]
        body = window[x["start"] : x["end"] + 1]
        s = channel_scores(a, b, mode)
        dtw = alignment.rhythm_dtw(times(q), times(body))[1] if timed or rhythm_only else None
        if exact_span:
            s |= {"pitch": 100.0, "interval": 100.0, "contour": 100.0}
        if dtw is not None:
            s["rhythm"] = rhythm_likeness(q, body) if exact_span and not strict else dtw
        gaps = sum(kind in ("insertion", "deletion") for *_, kind in x["path"])
        whole = len(pairs) == n and not gaps
        like = rhythm_likeness(q, body)
        if self.query.exact_pitch and not (whole and all(u["p"] == v["p"] for u, v in zip(a, b))) or self.query.exact_rhythm and not (whole and like >= 99.9):
            return None
        if rhythm_only:
            s |= {"pitch": 0.0, "interval": 0.0, "contour": 0.0}
        if contour and s["contour"] < 99.9:
            return None
        same = equality(a, b)
        plain = contour or rhythm_only
        metric = {"score": 50.0, "adjustment": 0.0, "matches": 0} if plain else metric_evidence(q, window, x["path"])
        structural, bonus = (0.0, 0.0) if plain else compare_pillars(q, body)
        skeleton = dict.fromkeys(("similarity", "pitch", "contour", "coverage", "strong"), 0.0) if plain else compare_skeletons(q, body)
        melodic = 0.7 * x["similarity"] + 0.3 * s["interval"]
        base = dtw if rhythm_only else 0.7 * s["interval"] + 0.3 * s["contour"] if contour else 0.88 * melodic + 0.12 * dtw if timed else melodic
        times_ = 4 if self.query.downbeat_boost else 1
        moved = _clip(metric["adjustment"] * times_, (-4 if exact_span else -5) * times_, 4 * times_)
        extra = 6 if skeleton["similarity"] >= 90 else 3 if skeleton["similarity"] >= 84 else 0
        local = 100.0 if strict else _clip(base + moved + min(3 if exact_span else 10, bonus) + extra)
        by_skeleton = n >= 8 and skeleton["coverage"] >= 0.8 and skeleton["strong"] >= 0.85 and skeleton["similarity"] >= 86 and skeleton["pitch"] >= 84 and skeleton["contour"] >= 88 and metric["score"] >= 55 and (not timed or s["rhythm"] >= 35)
        if self.little and not contour and not exact_span and (x["coverage"] < 0.92 or gaps > 1 or s["pitch"] < 82 or same < 88 or metric["score"] < 60 or timed and s["rhythm"] < 78):
            return None
        if not (local >= 72 if rhythm_only else admitted(mode, exact_span, local, s, structural, n)) and not by_skeleton:
            return None
        if not exact_span and not contour and self.query.starts_on_downbeat and not metric["matches"] and structural < 50 and local < 65:
            return None
        exact = strict or (like >= 99.9 and whole if rhythm_only else s["interval"] > 99.9 if contour else not gaps and s["interval"] > 99.9 and s["contour"] > 99.9 and (mode == "melody" or s["rhythm"] > 98))
        adjustment = (0.05 if exact_span else 0.25) * min(20.0, hits) - 12 * (1 - role)
        return {"first": x["start"], "last": x["end"], "exact": exact, "local": local, "ranking": calibrated(exact, local, s, mode, adjustment), **s, "meter": metric["score"], "structural": structural, "skeleton": skeleton["similarity"], "insertions": sum(k == "insertion" for *_, k in x["path"]), "deletions": sum(k == "deletion" for *_, k in x["path"])}


_RESULT = "sid long, start long, end long, exact boolean, local double, ranking double, pitch double, interval double, contour double, rhythm double, meter double, structural double, skeleton double, insertions int, deletions int"
_NOTE = ["p", "d", "o", "m", "spelling", "metric", "weight", "role", "short", "weak"]


def search(notes: DataFrame, postings: DataFrame, query: Query, roles: DataFrame | None = None, limit: int = 100) -> DataFrame:
    """Ranked results: the best window of each stream, streams of a work with the same match kept once."""
    spark = notes.sparkSession
    if len(query.notes) < 4:
        return spark.createDataFrame([], _RESULT + ", src long, rank int")
    n = len(query.notes)
    own = annotation.annotate(query.frame(spark).withColumn("m", F.lit(1)), *query.meter).orderBy("pos").select(*_NOTE).collect()
    scorer = spark.sparkContext.broadcast(Scorer(query, [r.asDict() for r in own]))
    margin = max(3, math.ceil(0.3 * n))
    found = _held(retrieve(notes, postings, query).select("sid", "start", "evidence"))  # at most 1,800 rows
    notes = notes.join(F.broadcast(found.select("sid").distinct()), "sid", "left_semi")
    spans = matching.exact_occurrences(notes, [x["p"] for x in query.notes]).groupBy("sid").agg(F.min("start").alias("exact_start"))
    seeds = found.select("sid", "start", "evidence").join(spans, "sid", "left")
    at = F.coalesce("exact_start", "start")
    seeds = seeds.select("sid", at.alias("start"), "evidence", F.col("exact_start").isNotNull().alias("is_exact")).groupBy("sid", "start", "is_exact").agg(F.max("evidence").alias("evidence"))
    streams = annotation.annotate(notes, *query.meter)
    streams = streams.groupBy("sid").agg(F.min("src").alias("src"), F.sort_array(F.collect_list(F.struct("pos", *_NOTE))).alias("notes"))
    if roles is None:
        streams = streams.withColumn("melody_role", F.lit(1.0))
    else:
        streams = streams.join(roles.select("sid", F.col("role").alias("melody_role")), "sid", "left")
    first = F.when(F.col("is_exact"), F.col("start")).otherwise(F.greatest(F.lit(0), F.col("start") - margin))
    last = F.when(F.col("is_exact"), F.col("start") + n).otherwise(F.col("start") + n + margin)
    rows = seeds.join(streams, "sid").withColumn("first", first).withColumn("window", F.slice("notes", (first + 1).cast("int"), (last - first).cast("int"))).drop("notes")

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                window = [dict(x) if isinstance(x, dict) else x.asDict() for x in r.window]
                got = scorer.value(window, int(r.start - r.first), (0, n - 1) if r.is_exact else None, float(r.evidence), float(r.melody_role if r.melody_role == r.melody_role else 0))
                if got:
                    body = window[got["first"] : got["last"] + 1]
                    signature = ",".join(str(b["p"] - a["p"]) for a, b in zip(body, body[1:])) + "|" + ",".join(f"{math.floor(x['d'] / (body[0]['d'] or 1) * 8 + 0.5)}" for x in body)
                    out.append({"sid": r.sid, "src": r.src, "start": r.first + got.pop("first"), "end": r.first + got.pop("last"), "signature": signature, **got})
            yield pd.DataFrame(out, columns=["sid", "src", "start", "end", "signature", "exact", "local", "ranking", "pitch", "interval", "contour", "rhythm", "meter", "structural", "skeleton", "insertions", "deletions"])

    scored = rows.select("sid", "src", "start", "first", "is_exact", "evidence", "melody_role", "window").mapInPandas(run, _RESULT.replace("start long", "src long, start long") + ", signature string")
    best = Window.partitionBy("sid").orderBy(F.col("local").desc(), "start")
    kept = scored.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n")
    group = Window.partitionBy("src", "signature").orderBy(F.col("ranking").desc(), "sid")
    kept = kept.withColumn("n", F.row_number().over(group)).filter("n = 1").drop("n", "signature")
    top = kept.orderBy(F.col("ranking").desc(), F.col("local").desc(), "sid").limit(min(200, limit))
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("ranking").desc(), F.col("local").desc(), "sid")))


def excerpt(notes: DataFrame, results: DataFrame) -> DataFrame:
    """The measures that a result touches."""
    at = results.select("sid", "start", "end")
    bounds = notes.join(at, "sid").filter("pos BETWEEN start AND end").groupBy("sid").agg(F.min("m").alias("m0"), F.max("m").alias("m1"))
    return notes.join(bounds, "sid").filter("m BETWEEN m0 AND m1").drop("m0", "m1")


__all__ = ["Query", "Scorer", "excerpt", "retrieve", "search"]
