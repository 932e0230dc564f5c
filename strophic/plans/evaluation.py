"""Replaying queries with known answers: mutations, validation, judgement, summaries, differences of runs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys that a case has.
REQUIRED = ["schema", "caseId", "createdAt", "status", "tags", "query", "expected", "observations", "diagnoses", "runs"]
MUTATIONS = ["pitch", "octave", "rhythm", "leap", "rest"]


def mutate(notes: list[dict], kind: str) -> list[dict]:
    """One small change of a query: an inner pitch, an octave, a duration, a leap at the end, or a rest."""
    out = [dict(n) for n in notes]
    middle = len(out) // 2
    if kind == "pitch":
        out[middle]["p"] += 1
    elif kind == "octave":
        out[middle]["p"] += 12
    elif kind == "rhythm":
        out[middle]["d"] *= 2
    elif kind == "leap":
        out[-1]["p"] += 7
    elif kind == "rest":
        out.insert(middle, {"kind": "rest", "d": 1.0, "p": None})
    else:
        raise ValueError(kind)
    return out


def transpose(p: Column, by: int) -> Column:
    return F.transform(p, lambda x: x + by)


def insert_after(x: Column, at: int, value: Column) -> Column:
    """The array with a value after element ``at`` (from 0)."""
    return F.concat(F.slice(x, 1, at + 1), F.array(value), F.slice(x, at + 2, F.size(x)))


def violations(cases: list[dict]) -> list[tuple[str, str]]:
    """(case, what is wrong); cases with any go to a table of their own and aren't run."""
    out = []
    seen: set[str] = set()
    for k, c in enumerate(cases):
        name = str(c.get("caseId") or f"#{k}")
        out += [(name, f"lacks {key}") for key in REQUIRED if key not in c]
        if name in seen:
            out.append((name, "repeated caseId"))
        seen.add(name)
        if len((c.get("query") or {}).get("events") or []) < 4:
            out.append((name, "fewer than four events"))
        if not ((c.get("expected") or {}).get("primaryTitles") or (c.get("expected") or {}).get("expectedSourceIds")):
            out.append((name, "expects nothing"))
    return out


def judge(results: DataFrame, expected: DataFrame) -> DataFrame:
    """Best rank of an expected item for each case, and what that means."""
    hit = expected.join(results, ["case_id", "item"], "left").groupBy("case_id").agg(F.min("rank").alias("rank"))
    label = F.when(F.col("rank") == 1, "top1").when(F.col("rank") <= 5, "top5").when(F.col("rank") <= 10, "top10").when(F.col("rank") <= 100, "top100").otherwise("missed")
    return hit.withColumn("label", label)


def summary(judged: DataFrame, *by: str) -> DataFrame:
    """Hits by depth, misses, and floor-index percentiles of ranks."""
    upto = lambda k: F.count_if(F.col("rank") <= k)
    ranks = F.sort_array(F.collect_list("rank"))
    at = lambda q: F.when(F.size(ranks) > 0, F.get(ranks, F.least(F.size(ranks) - 1, F.floor(F.size(ranks) * q)).cast("int")))
    return judged.groupBy(*by).agg(F.count(F.lit(1)).alias("cases"), upto(1).alias("top1"), upto(5).alias("top5"), upto(10).alias("top10"), upto(100).alias("top100"), F.count_if(F.col("rank").isNull()).alias("missed"), at(0.5).alias("median_rank"), at(0.9).alias("p90_rank"))


def eta(done: int, total: int, seconds: float) -> float | None:
    """Seconds that are left at the pace so far."""
    return None if not done else max(0.0, seconds / done * (total - done))


def percentile_rank(n: int, share: float) -> int:
    return min(n - 1, math.floor(n * share))
