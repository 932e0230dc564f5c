"""Phrase boundaries: window rules as DataFrame expressions, and the ordered passes over one stream as an Arrow function.

The stateless rules (gaps, peaks, long-arrival cells, motif signatures, spans) are windows. The passes that see what earlier passes
changed are one function per stream, ``analyse``; a stream is as long as one part of one work.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophic.functions.sequence import clamp, upper_median
from strophic.operators.matching import intervals, windows
from strophic.sources.adapters import stream_order

SUPPORTED, RELIABLE, DEMOTED = 0.65, 0.75, 0.49


# Window rules


def peak(column: str, w: Window) -> Column:
    """How far a value stands out over both neighbours, 0 to 1."""
    value, left, right = F.col(column), F.lag(column).over(w), F.lead(column).over(w)
    base = (left + right) / 2
    return F.when((value > 0) & (value >= left) & (value >= right), clamp((value - base) / (value + base), 0.0, 1.0)).otherwise(0.0)


def gap_strength(ratio: Column) -> Column:
    return F.when(ratio >= 0.25, F.least(F.lit(0.95), 0.55 + 0.2 * F.log2(1 + ratio))).otherwise(0.0)


def local_boundaries(notes: DataFrame) -> DataFrame:
    """Strength of the boundary before each note: pitch and time peaks, and rests relative to the local unit."""
    w = stream_order()
    near = w.rowsBetween(-3, 3)
    n = notes.withColumns({"step": F.abs(F.col("p") - F.lag("p").over(w)), "ioi": F.col("o") - F.lag("o").over(w), "rest": F.col("o") - F.lag(F.col("o") + F.col("d")).over(w), "place": F.row_number().over(w), "before": F.lag("d").over(w)})
    n = n.withColumns({"around": F.collect_list(F.struct("pos", "ioi")).over(near), "durations": F.collect_list("d").over(near)})
    iois = F.filter(F.transform(F.filter("around", lambda x: x["pos"] != F.col("pos")), lambda x: x["ioi"]), lambda x: x > 0)
    durations = F.filter(F.concat("durations", F.array("before")), lambda x: x > 0)
    unit = F.when(F.size(iois) > 0, upper_median(iois)).when(F.size(durations) > 0, upper_median(durations))
    n = n.withColumns({"pitch_peak": peak("step", w), "time_peak": peak("ioi", w), "ratio": F.col("rest") / unit})
    gap = F.coalesce(gap_strength(F.col("ratio")), F.lit(0.0))
    contact = (F.col("ratio") >= -1e-6) & (F.col("ratio") <= 0.03) & (F.col("pitch_peak") <= 0.25) & (F.col("time_peak") <= 0.25)
    strength = F.round(clamp(F.round(0.25 * F.col("pitch_peak") + 0.25 * F.col("time_peak"), 6) + F.round(gap, 6), 0.0, 1.0), 6)
    out = n.filter("place > 1").select("sid", "pos", F.round("pitch_peak", 6).alias("pitch_peak"), F.round("time_peak", 6).alias("time_peak"), F.round(gap, 6).alias("gap"), strength.alias("strength"), F.when(contact, 0.85).otherwise(0.0).alias("continuity"))
    return out.withColumn("state", state(F.col("strength"), F.col("continuity")))


def state(strength: Column, continuity: Column) -> Column:
    return F.when(strength >= SUPPORTED, "boundary").when(continuity >= RELIABLE, "continuous").otherwise("unknown")


def spans(boundaries: DataFrame, notes: DataFrame) -> DataFrame:
    """Phrases between supported boundaries, as half-open ranges of positions."""
    marks = notes.select("sid", "pos").join(boundaries.select("sid", "pos", "strength"), ["sid", "pos"], "left")
    phrase = F.sum(F.when(F.col("strength") >= SUPPORTED, 1).otherwise(0)).over(stream_order())
    return marks.withColumn("phrase", phrase).groupBy("sid", "phrase").agg(F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def motif_signatures(notes: DataFrame, low: int = 4, high: int = 8) -> DataFrame:
    """Windows with an identity: intervals, durations and times between onsets relative to the first duration.

    Windows need three different intervals and both directions. Ratios are in whole 64ths, so that keys never hold doubles.
    """
    out = None
    for n in range(low, high + 1):
        own = windows(notes, n, ("p", "d", "o")).withColumn("length", F.lit(n))
        out = own if out is None else out.unionByName(own)
    steps = intervals(F.col("p"))
    unit = F.element_at("d", 1)
    grid = lambda x: F.transform(x, lambda v: F.floor(v / unit * 64 + 0.5).cast("long").cast("string"))
    time = F.zip_with(F.slice("o", 2, F.size("o") - 1), F.slice("o", 1, F.size("o") - 1), lambda b, a: b - a)
    kept = out.filter((F.size(F.array_distinct(steps)) >= 3) & F.exists(steps, lambda x: x > 0) & F.exists(steps, lambda x: x < 0) & (unit > 0) & F.forall(time, lambda x: x > 0))
    key = F.concat_ws("|", F.col("length").cast("string"), F.array_join(F.transform(steps, lambda x: x.cast("string")), ","), F.array_join(grid(F.col("d")), ","), F.array_join(grid(time), ","))
    return kept.select("sid", "start", "length", key.alias("key"))


def motif_relations(signatures: DataFrame, reach: int = 64, remembered: int = 4) -> DataFrame:
    """For each window the last of the ``remembered`` earlier ones with its key, at least a length and at most ``reach`` back.

    Occurrences of a key are numbered, so the join is on (stream, key) with a bounded difference of numbers; the longest window of a start wins.
    """
    order = Window.partitionBy("sid", "key").orderBy("start")
    numbered = signatures.withColumn("k", F.row_number().over(order))
    earlier = numbered.select("sid", "key", F.col("start").alias("previous"), F.explode(F.sequence(F.col("k") + 1, F.col("k") + remembered)).alias("k"))
    pairs = numbered.join(earlier, ["sid", "key", "k"]).withColumn("distance", F.col("start") - F.col("previous")).filter((F.col("distance") >= F.col("length")) & (F.col("distance") <= reach))
    best = F.max(F.struct("length", "previous", "distance"))
    return pairs.groupBy("sid", "start").agg(best.alias("x")).select("sid", "start", "x.length", "x.previous", "x.distance", (F.col("x.distance") <= 2 * F.col("x.length")).alias("close"))


def long_arrivals(notes: DataFrame) -> DataFrame:
    """Four short notes and a long one: straight or syncopated."""
    own = windows(notes, 5, ("p", "d", "o"))
    unit = upper_median(F.filter(F.slice("d", 1, 4), lambda x: x > 0))
    own = own.withColumn("unit", unit).filter("unit > 0")
    ratios = F.transform(F.slice("d", 1, 4), lambda x: x / F.col("unit"))
    span, last = (F.get("o", 4) - F.get("o", 0)) / F.col("unit"), F.get("d", 4) / F.col("unit")
    own = own.withColumns({"ratios": ratios, "span": span, "terminal": last}).filter(F.forall("ratios", lambda x: (x >= 0.45) & (x <= 1.65)) & F.col("span").between(3.5, 4.5) & (F.col("terminal") >= 3.5))
    straight = F.forall("ratios", lambda x: F.abs(x - 1) <= 0.2)
    total = F.aggregate("ratios", F.lit(0.0), lambda s, x: s + x)
    kind = F.when(straight, "straight").when(F.abs(total - 4) <= 0.25, "syncopated")
    return own.withColumn("variant", kind).filter("variant IS NOT NULL").select("sid", "start", (F.col("start") + 4).alias("end"), "variant", F.round("terminal", 6).alias("terminal"))


def compare_boundaries(pairs: DataFrame) -> DataFrame:
    """Support and conflict of two boundary analyses over mapped notes.

    ``pairs``: ``pair_id``, ``ord``, ``q``, ``c`` and for both sides strength, continuity and gap (``q_strength`` ...). Only neighbouring pairs count.
    """
    w = Window.partitionBy("pair_id").orderBy("ord")
    follows = (F.col("q") == F.lag("q").over(w) + 1) & (F.col("c") == F.lag("c").over(w) + 1)
    x = pairs.withColumn("follows", follows).filter("follows AND q > 0 AND c > 0")
    x = x.filter((F.col("q_strength") >= SUPPORTED) & ((F.col("c_strength") >= SUPPORTED) | (F.col("c_continuity") >= RELIABLE)))
    support = F.col("c_strength") >= SUPPORTED
    conflict = ~support & (F.col("q_gap") >= SUPPORTED) & (F.col("c_continuity") >= RELIABLE)
    weight = F.when(support, F.least("q_strength", "c_strength")).when(conflict, -F.col("q_gap") * F.col("c_continuity")).otherwise(0.0)
    g = x.groupBy("pair_id").agg(F.count_if(support).alias("support"), F.count_if(conflict).alias("conflicts"), F.sum(weight).alias("weighted"))
    adjustment = F.round(3 * F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("weighted") / F.greatest(F.lit(2), F.col("support") + F.col("conflicts")))), 6)
    return g.select("pair_id", "support", "conflicts", adjustment.alias("adjustment"))


# Ordered passes over one stream


@dataclass
class Mark:
    """The boundary before a note."""

    strength: float = 0.0
    raw: float | None = None
    continuity: float = 0.0
    gap: float = 0.0
    cues: list[str] = field(default_factory=list)
    level: str | None = None

    @property
    def before_demotion(self) -> float:
        return self.strength if self.raw is None else self.raw

    def demote(self, cue: str, continuity: float, level: str = "subphrase-cell") -> None:
        if self.raw is None:
            self.raw = self.strength
        self.continuity = max(self.continuity, continuity)
        self.cues.append(cue)
        self.level = level
        self.strength = min(self.strength, DEMOTED)

    def raise_by(self, cue: str, amount: float) -> None:
        self.cues.append(cue)
        self.strength = round(min(1.0, self.strength + amount), 6)


def _middle(values: list[float]) -> float | None:
    own = sorted(v for v in values if v and v > 0)
    return own[len(own) // 2] if own else None


def _close(a: list[float], b: list[float], tolerance: float = 0.12) -> list[bool]:
    return [abs(x - y) <= tolerance * max(1.0, abs(x), abs(y)) for x, y in zip(a, b)]


class Stream:
    """One stream's notes (dicts with ``p``, ``d``, ``o`` and optional ``attack``, ``m``, ``tm``) and the marks before them."""

    def __init__(self, notes: list[dict]):
        self.notes = notes
        self.marks = [Mark() for _ in range(len(notes) + 1)]
        self.attacks = [i for i, n in enumerate(notes) if n.get("attack", True)]
        self.relations: list[dict] = []
        self.parallel: list[dict] = []

    def _n(self, k: int) -> dict:
        return self.notes[self.attacks[k]]

    def _end(self, i: int) -> float:
        return self.notes[i]["o"] + self.notes[i]["d"]

    def _attacks_in(self, a: int, b: int) -> int:
        return sum(a <= i < b for i in self.attacks)

    def local(self) -> None:
        """Peaks of pitch and time, rests, and contact."""
        k_all = range(len(self.attacks))
        step = [abs(self._n(k)["p"] - self._n(k - 1)["p"]) if k else None for k in k_all]
        time = [self._n(k)["o"] - self._n(k - 1)["o"] if k and self._n(k)["o"] > self._n(k - 1)["o"] else None for k in k_all]

        def stands_out(x: list, k: int) -> float:
            if not 0 < k < len(x) - 1 or None in (x[k - 1], x[k], x[k + 1]) or x[k] <= 0 or x[k] < max(x[k - 1], x[k + 1]):
                return 0.0
            base = (x[k - 1] + x[k + 1]) / 2
            return max(0.0, min(1.0, (x[k] - base) / (x[k] + base)))

        for k in k_all:
            i = self.attacks[k]
            if not i:
                continue
            mark, pitch_peak, time_peak = self.marks[i], stands_out(step, k), stands_out(time, k)
            mark.strength = round(0.25 * pitch_peak + 0.25 * time_peak, 6)
            mark.cues += ["pitch-discontinuity"] * (pitch_peak > 0) + ["ioi-discontinuity"] * (time_peak > 0)
            near = range(max(0, k - 3), min(len(self.attacks), k + 4))
            unit = _middle([self._n(j)["o"] - self._n(j - 1)["o"] for j in near if j and j != k]) or _middle([self._n(j)["d"] for j in near] + [self.notes[i - 1]["d"]])
            if not unit or self.notes[i]["o"] <= self.notes[i - 1]["o"]:
                continue
            ratio = (self.notes[i]["o"] - self._end(i - 1)) / unit
            if ratio >= 0.25:
                mark.gap = min(0.95, 0.55 + 0.2 * math.log2(1 + ratio))
                mark.raise_by("observed-gap", mark.gap)
            elif -1e-6 <= ratio <= 0.03 and max(pitch_peak, time_peak) <= 0.25:
                mark.continuity = 0.85
                mark.cues.append("observed-continuity")

    def _signature(self, k: int, n: int) -> tuple | None:
        if k + n > len(self.attacks):
            return None
        own = [self._n(j) for j in range(k, k + n)]
        steps = [b["p"] - a["p"] for a, b in zip(own, own[1:])]
        unit = own[0]["d"]
        if not unit or len(set(steps)) < 3 or max(steps) <= 0 or min(steps) >= 0:
            return None
        times = [round((b["o"] - a["o"]) / unit, 6) for a, b in zip(own, own[1:])]
        if min(times) <= 0:
            return None
        into = (own[0]["p"] - self._n(k - 1)["p"], round((own[0]["o"] - self._n(k - 1)["o"]) / unit, 6)) if k else None
        return (n, *steps, *(round(x["d"] / unit, 6) for x in own), *times), into

    def motif_support(self) -> None:
        """Repeated motifs that begin at an anchored boundary; one that follows closely is inside a phrase."""
        seen: dict[tuple, list[tuple[int, tuple | None]]] = defaultdict(list)
        for k, i in enumerate(self.attacks):
            best = None
            for n in range(4, 9):
                found = self._signature(k, n)
                if not found:
                    continue
                key, into = found
                prior = next(((at, came) for at, came in reversed(seen[key]) if n <= k - at <= 64), None)
                if prior and k:
                    moved = prior[1] is not None and into is not None and prior[1] != into
                    if self.marks[i].strength >= 0.2 and (self.marks[i].gap > 0 or moved):
                        best = (n, key, prior[0])
                seen[key] = [*seen[key][-3:], (k, into)]
            if best:
                n, key, at = best
                self.relations.append({"key": key, "length": n, "previous": self.attacks[at], "current": i, "distance": k - at})
                self.marks[i].cues.append("repeated-motif-start")
                if k - at <= 2 * n:
                    self.marks[i].demote("motif-repetition-continuation", 0.82)

    def parallel_recurrence(self) -> None:
        """Two relations with one displacement, their cells as far apart before as after."""
        by_shift = defaultdict(list)
        for r in self.relations:
            by_shift[r["current"] - r["previous"]].append(r)
        for shift, own in by_shift.items():
            own.sort(key=lambda r: r["previous"])
            for a, b in zip(own, own[1:]):
                far = b["previous"] - a["previous"]
                if 0 < far <= 2 * max(a["length"], b["length"]):
                    self.parallel.append({"source": a["previous"], "again": a["current"], "shift": shift})
                    for i in (b["previous"], b["current"]):
                        self.marks[i].demote("parallel-motif-recurrence-continuation", 0.9)

    def _shape(self, k: int, n: int):
        own = [self._n(j) for j in range(k, k + n)]
        unit = _middle([x["d"] for x in own])
        if not unit:
            return None
        sign = lambda v: (v > 0) - (v < 0)
        return [round(x["d"] / unit, 6) for x in own], [round((b["o"] - a["o"]) / unit, 6) for a, b in zip(own, own[1:])], [sign(b["p"] - a["p"]) for a, b in zip(own, own[1:])]

    def _alike(self, a: int, b: int, n: int) -> float:
        x, y = self._shape(a, n), self._shape(b, n)
        if not x or not y:
            return 0.0
        share = lambda flags: sum(flags) / max(1, len(flags))
        return round(0.45 * share(_close(x[0], y[0])) + 0.35 * share(_close(x[1], y[1])) + 0.2 * share([p == q for p, q in zip(x[2], y[2])]), 6)

    def _gaps(self) -> list[int]:
        return [k for k, i in enumerate(self.attacks) if k and self.marks[i].gap >= SUPPORTED]

    def repeated_figures(self) -> list[dict]:
        """Three similar cells in a row: the rests between them don't end a phrase."""
        gaps, runs = self._gaps(), []
        for a, b in zip(gaps, gaps[1:]):
            n = b - a
            if 3 <= n <= 8 and a - n >= 0 and b + n <= len(self.attacks) and self._alike(a - n, a, n) >= 0.82 and self._alike(a, b, n) >= 0.72:
                if runs and runs[-1]["n"] == n and a - n <= runs[-1]["end"]:
                    runs[-1]["end"] = max(runs[-1]["end"], b + n)
                    runs[-1]["inner"] |= {a, b}
                else:
                    runs.append({"n": n, "start": a - n, "end": b + n, "inner": {a, b}})
        for r in runs:
            for k in r["inner"]:
                self.marks[self.attacks[k]].demote("repeated-figure-continuation", 0.9)
            first = self.attacks[r["start"]]
            last = self.attacks[r["end"]] if r["end"] < len(self.attacks) else len(self.notes)
            for i, cue in ((first, "repeated-figure-run-start"), (last, "repeated-figure-run-end")):
                if 0 < i < len(self.notes):
                    self.marks[i].cues.append(cue)
                    if self.marks[i].strength >= SUPPORTED and self.marks[i].continuity < RELIABLE:
                        self.marks[i].level = "phrase"
        return runs

    def rhythmic_gestures(self) -> None:
        """Two cells with the same short-short-long beginning before a much longer rest."""
        own = [(k, self._n(k)["o"] - self._end(self.attacks[k - 1])) for k in self._gaps()]
        for (a, _), (b, rest), (c, after) in zip(own, own[1:], own[2:]):
            if not (3 <= b - a <= 8 and 3 <= c - b <= 8) or after < max(2.0, 2.5 * rest):
                continue
            x, y = ([round(self._n(j)["d"] / self._n(k)["d"], 6) for j in range(k, k + 3)] if self._n(k)["d"] > 0 else None for k in (a, b))
            if x and y and all(_close(x, y)) and max(x[0], x[1]) <= 0.6 * x[2]:
                self.marks[self.attacks[b]].demote("rhythmic-gesture-continuation", 0.82)

    def tie_carryover(self) -> None:
        """After a tie over a barline the phrase begins at the note that is struck again."""
        for i in range(1, len(self.notes) - 1):
            a, b = self.notes[i], self.notes[i + 1]
            over = a.get("tm") is not None and a.get("m") is not None and a["tm"] > a["m"]
            if over and self.marks[i].strength >= SUPPORTED and b.get("attack", True) and a["p"] == b["p"] and abs(self._end(i) - b["o"]) <= 1e-6:
                self.marks[i].demote("tied-carryover-continuation", 0.92, "phrase-ending-carryover")
                self.marks[i + 1].raise_by("post-tie-reattack-start", 0.72)

    def repeated_passages(self) -> None:
        """Where a long passage returns, boundaries inside it without a clear break are continuous."""
        for g in self.parallel:
            n = min(g["shift"], len(self.notes) - g["again"])
            if n < 12:
                continue
            pairs = [(self.notes[g["source"] + k], self.notes[g["again"] + k]) for k in range(n)]
            moved = Counter(b["p"] - a["p"] for a, b in pairs)
            timed = [abs(a["d"] - b["d"]) / max(a["d"], b["d"]) <= 0.36 for a, b in pairs if a["d"] and b["d"]]
            if max(moved.values()) / n < 0.85 or not timed or sum(timed) / len(timed) < 0.7:
                continue
            for first, last in ((g["source"], g["again"]), (g["again"], g["again"] + n)):
                for i in range(first + 1, min(last, len(self.notes))):
                    tied = self.notes[i - 1].get("tm") is not None and self.notes[i - 1]["tm"] >= (self.notes[i].get("m") or math.inf)
                    if self.marks[i].strength < SUPPORTED or tied or self.marks[i].gap < SUPPORTED:
                        self.marks[i].continuity = max(self.marks[i].continuity, 0.8)
                        self.marks[i].cues.append("repeated-passage-continuity")

    def cells(self) -> list[dict]:
        """Long-arrival cells: four short notes and a long one."""
        out = []
        for k in range(len(self.attacks) - 4):
            own = [self._n(j) for j in range(k, k + 5)]
            unit = _middle([x["d"] for x in own[:4]])
            if not unit:
                continue
            r = [x["d"] / unit for x in own[:4]]
            if min(r) < 0.45 or max(r) > 1.65 or not 3.5 <= (own[4]["o"] - own[0]["o"]) / unit <= 4.5 or own[4]["d"] / unit < 3.5:
                continue
            straight = all(abs(x - 1) <= 0.2 for x in r)
            if straight or abs(sum(r) - 4) <= 0.25:
                out.append({"start": self.attacks[k], "end": self.attacks[k + 4], "variant": "straight" if straight else "syncopated"})
        return out

    def thematic_groups(self) -> list[tuple[int, int]]:
        """Where such cells make up most of a stream, phrases are groups of two or three of them."""
        cells = self.cells()
        if len(cells) < 8 or 5 * len(cells) / max(1, len(self.attacks)) < 0.55 or len({c["variant"] for c in cells}) < 2:
            return []
        starts = [c["start"] for c in cells]
        active = [i for i in starts if 0 < i < len(self.notes) and self.marks[i].strength >= SUPPORTED]
        if not active:
            return []
        active = sorted({*active, len(self.notes)})
        inside = lambda a, b: [s for s in starts if a <= s < b]

        def restart(i: int) -> None:
            self.marks[i].cues.append("thematic-cell-phrase-restart")
            self.marks[i].strength, self.marks[i].level = max(self.marks[i].strength, 0.7), "phrase"

        k = 0
        while k < len(active) - 2:
            here, there = inside(active[k], active[k + 1]), inside(active[k + 1], active[k + 2])
            if len(here) == 1 and len(there) == 1:
                self.marks[active[k + 1]].demote("thematic-cell-internal-continuation", 0.9)
                active.pop(k + 1)
                k = 0
            elif len(here) == 1 and len(there) >= 4:
                self.marks[active[k + 1]].demote("thematic-cell-internal-continuation", 0.9)
                restart(there[1])
                active[k + 1] = there[1]
                k = 0
            else:
                k += 1

        def leap(i: int) -> float:
            at = starts.index(i)
            return abs(self.notes[i]["p"] - self.notes[cells[at - 1]["end"]]["p"]) / 12 + 0.25 * self.marks[i].strength if at else 0.0

        for a, b in list(zip(active, active[1:])):
            own = inside(a, b)
            at, left = 0, len(own)
            while left > 3:
                size = 2 if left == 4 or left == 5 and leap(own[2]) > leap(own[3]) else 3
                at, left = at + size, left - size
                restart(own[at])
                active.append(own[at])
        active = sorted(set(active))
        return list(zip(active, active[1:]))

    def minimum_attacks(self, least: int = 4) -> None:
        """A phrase of fewer attacks is a fragment of what follows."""
        begin = 0
        for i in range(1, len(self.notes)):
            if self.marks[i].strength >= SUPPORTED:
                if self._attacks_in(begin, i) < least:
                    self.marks[i].demote("short-phrase-fragment-continuation", 0.92)
                else:
                    begin = i

    def recurring_frames(self) -> list[dict]:
        """A motif that occurs three times, with a short lead and two parts of 4 to 10 attacks, is one frame each time."""
        places = defaultdict(set)
        for r in self.relations:
            places[r["key"]] |= {r["previous"], r["current"]}
        frames = []
        candidate = lambda i: self.marks[i].before_demotion >= SUPPORTED
        for own in places.values():
            for i in sorted(own) if len(own) >= 3 else ():
                begin = max((j for j in range(1, i) if self.marks[j].strength >= SUPPORTED), default=0)
                after = [j for j in range(i + 1, len(self.notes)) if candidate(j)][:2]
                if len(after) < 2 or not 1 <= self._attacks_in(begin, i) <= 4 or not all(4 <= self._attacks_in(a, b) <= 10 for a, b in ((i, after[0]), (after[0], after[1]))):
                    continue
                for j, cue in ((i, "recurring-motif-preparation-continuation"), (after[0], "recurring-motif-answer-continuation")):
                    if candidate(j):
                        self.marks[j].demote(cue, 0.9)
                frames.append({"start": begin, "core": i, "inner": after[0], "end": after[1]})
        return frames

    def breaths(self) -> None:
        """Breath marks and caesuras on a note speak for a boundary after it; over a tie they wait for its end."""
        strength = {"caesura": 0.7, "breath": 0.55}
        for i, n in enumerate(self.notes):
            sign = n.get("breath")
            if sign:
                j = i + 1
                while j < len(self.notes) and not self.notes[j].get("attack", True):
                    j += 1
                if j < len(self.notes):
                    self.marks[j].raise_by(f"breath-symbol-{sign}", strength.get(sign, 0.45))


def analyse(notes: list[dict]) -> Stream:
    """All passes in their fixed order; a later pass sees what earlier ones have changed."""
    s = Stream(notes)
    s.local()
    s.motif_support()
    s.parallel_recurrence()
    s.repeated_figures()
    s.rhythmic_gestures()
    s.tie_carryover()
    s.repeated_passages()
    s.thematic_groups()
    if len(s.attacks) >= 12:
        s.minimum_attacks()
        s.recurring_frames()
    s.breaths()
    for i in range(1, len(notes)):
        if not notes[i].get("attack", True):
            s.marks[i].continuity = 1.0
            s.marks[i].cues.append("tie-continuation")
    return s


def boundaries(notes: DataFrame) -> DataFrame:
    """``analyse`` for every stream: (``sid``, ``pos``, ``strength``, ``continuity``, ``state``, ``cues``)."""
    extra = [c for c in ("attack", "m", "tm", "breath") if c in notes.columns]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        own = pdf[["p", "d", "o", *extra]].astype(object).where(pdf[["p", "d", "o", *extra]].notna(), None).to_dict("records")
        marks = analyse(own).marks[:-1]
        strength, keep = [round(m.strength, 6) for m in marks], [m.continuity for m in marks]
        kind = ["boundary" if a >= SUPPORTED else "continuous" if b >= RELIABLE else "unknown" for a, b in zip(strength, keep)]
        return pd.DataFrame({"sid": pdf["sid"].to_numpy(), "pos": pdf["pos"].to_numpy(), "strength": strength, "continuity": keep, "state": kind, "cues": [m.cues for m in marks]})

    rows = notes.select("sid", "pos", F.col("p").cast("double").alias("p"), F.col("d").cast("double").alias("d"), F.col("o").cast("double").alias("o"), *extra)
    return rows.groupBy("sid").applyInPandas(run, "sid long, pos long, strength double, continuity double, state string, cues array<string>").filter("pos > 0")
