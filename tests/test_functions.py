"""Expected values of scoring rules on small inputs, and invariances."""

import random

import pytest
from pyspark.sql import functions as F

from strophic.functions import sequence, text
from strophic.operators import alignment, annotation, matching, phrase, retrieval, tokens
from strophic.plans import evaluation, search


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def notes(pitches, durations=None, **more):
    out, at = [], 0.0
    for k, p in enumerate(pitches):
        d = durations[k] if durations else 1.0
        out.append({"p": p, "d": d, "o": at, "weight": 0.8, "metric": 0.5, **{key: v[k] for key, v in more.items()}})
        at += d
    return out


def test_bonuses_and_limits(spark):
    lit = F.lit
    b = one(spark, *(retrieval.coverage_bonus(lit(h), 12).alias(f"b{h}") for h in (12, 11, 5)))
    assert b.b12 == 10000 and 800 < b.b11 < 1000 and b.b5 == 0
    rows = [("i", 50000, 0, True, 50000), ("i", 300000, -1, True, 100000), ("i", 300000, 3, True, 16000), ("i", 50000, 0, False, 16000), ("i", 50000, 3, False, 4000), ("i5", 50000, 1, True, 18000), ("r", 50000, 0, True, 3000), ("i", 2750, 0, True, 2750)]
    for kind, total, rank, robust, limit in rows:
        assert one(spark, tokens.row_limit(lit(kind), lit(total), lit(rank), robust).alias("x")).x == limit
    s = one(spark, *(retrieval.split_bonus(lit(n), lit(a), lit(b), 10).alias(k) for k, n, a, b in (("far", 2, 0, 5), ("near", 2, 0, 1), ("one", 1, 5, 5))))
    assert (s.far, s.near, s.one) == (650, 0, 0)


def test_residual_and_spans(spark):
    q = [60, 64, 67, 71, 74, 72, 67]
    c = [60, 64, 67, 71, 74, 73, 67]
    arr = lambda x: F.array(*(F.lit(v) for v in x))
    assert one(spark, matching.transposition_residual(arr(q), arr(c)).alias("x")).x == pytest.approx(98)
    assert search.residual(notes(q), notes(c)) == pytest.approx(98)
    rows = [(1, k, p, 1.0, float(k)) for k, p in enumerate([72, 74, 77, 76])] + [(2, k, p, 1.0, float(k)) for k, p in enumerate([72, 74, 78, 76])]
    df = spark.createDataFrame(rows, "sid long, pos int, p int, d double, o double")
    found = matching.exact_occurrences(df, [60, 62, 65, 64]).collect()
    assert [(r.sid, r.start, r.end, r.transposition) for r in found] == [(1, 0, 3, 12)]


def test_admission():
    s = {"interval": 94.6, "contour": 92.3, "rhythm": 41.8, "pitch": 90}
    assert search.admitted("melody_rhythm", False, 78.5, s, 73, 14)
    assert not search.admitted("melody_rhythm", False, 78.5, s | {"rhythm": 47.2}, 73, 6)


def test_alignment():
    x = search.align_notes(notes([60, 62, 64, 67]), notes([50, 55, 72, 74, 76, 79, 48]), "melody")
    assert (x["start"], x["end"], x["coverage"]) == (2, 5, 1) and x["similarity"] == pytest.approx(100)
    y = search.align_notes(notes([60, 62, 64, 65, 67]), notes([72, 74, 77, 79]), "melody")
    assert any(k == "deletion" for *_, k in y["path"]) and y["coverage"] >= 0.75
    ornament = notes([60, 72, 71, 55, 70, 58], role=["surface"] * 2 + ["passing"] + ["surface"] * 3)
    ornament[2]["weight"] = 0.25
    z = search.align_notes(notes([60, 72, 55, 70, 58]), ornament, "melody")
    assert z["coverage"] == 1 and any(k == "insertion" for *_, k in z["path"]) and z["similarity"] > 60


def test_rhythm():
    assert alignment.rhythm_dtw([1, 0.5, 0.5, 1], [2, 1, 1, 2])[1] == pytest.approx(100)
    assert alignment.rhythm_dtw([1, 1, 2, 1], [1, 1, 1, 1, 1])[1] > 75
    assert search.rhythm_likeness(notes([1] * 4, [1, 0.5, 0.5, 1]), notes([1] * 4, [2, 1, 1, 2])) == pytest.approx(100)


def test_fold_costs_equal_plain_costs(spark):
    random.seed(3)
    for _ in range(3):
        q, c = [random.randint(55, 70) for _ in range(5)], [random.randint(55, 70) for _ in range(8)]
        arr = lambda x: F.array(*(F.lit(v) for v in x))
        got = one(spark, alignment.local_cost(arr(q), arr(c), 0.5, 0.4, alignment.interval_substitution(arr(q), arr(c))).alias("x")).x

        def sub(i, j):
            if not i:
                return 0.0
            a, b = q[i] - q[i - 1], c[j] - c[j - 1] if j else 99
            return 0.7 * min(1, abs(a - b) / 7) + (0 if (a > 0) - (a < 0) == (b > 0) - (b < 0) else 0.3)

        assert got == pytest.approx(alignment.align(len(q), len(c), sub, lambda j: 0.4, lambda i: 0.5)["cost"])


def test_query_events():
    q = search.Query.of([{"p": 67, "d": 1.0, "tie": "a"}, {"p": 67, "d": 1.5, "tie": "a"}, {"kind": "rest", "d": 0.5}, {"p": 60, "d": 1.0}])
    assert [(n["p"], n["d"], n["o"]) for n in q.notes] == [(67, 2.5, 0.0), (60, 1.0, 3.0)]
    assert search.Query.of([{"p": 1, "d": 1.0}, {"kind": "rest", "d": 9.0}, {"p": 2, "d": 1.0}], rests=False).notes[1]["o"] == 1.0


def test_boundaries_are_invariant():
    random.seed(5)
    own = notes([random.randint(55, 75) for _ in range(60)], [random.choice([0.5, 1, 2]) for _ in range(60)])
    for n in own[20:]:
        n["o"] += 2
    for n in own[41:]:
        n["o"] += 3
    strength = [m.strength for m in phrase.analyse([dict(n) for n in own]).marks]
    for change in (lambda n: {**n, "p": n["p"] + 5}, lambda n: {**n, "o": n["o"] + 8}, lambda n: {**n, "o": n["o"] * 2, "d": n["d"] * 2}):
        assert [m.strength for m in phrase.analyse([change(n) for n in own]).marks] == pytest.approx(strength)
    assert strength[20] >= 0.65


def test_short_fragments_and_repeats():
    own = notes([60, 62, 64, 65] * 5, [0.5] * 20)
    for n in own[2:]:
        n["o"] += 4
    s = phrase.analyse(own)
    assert "short-phrase-fragment-continuation" in s.marks[2].cues and s.marks[2].strength < 0.5


def test_window_and_stream_rules_agree(spark):
    rows = [(1, k, random.Random(k).randint(55, 70), 1.0, k + (2.0 if k > 5 else 0.0)) for k in range(14)]
    df = spark.createDataFrame(rows, "sid long, pos int, p int, d double, o double")
    window = {r.pos: (r.strength, r.continuity) for r in phrase.local_boundaries(df).collect()}
    s = phrase.Stream([{"p": p, "d": d, "o": o} for _, _, p, d, o in rows])
    s.local()
    for k in range(1, 14):
        assert (s.marks[k].strength, s.marks[k].continuity) == pytest.approx(window[k])


def test_annotation_extremes(spark):
    rows = [(1, k, p, d, float(k), 1.0 + k % 4, False) for k, (p, d) in enumerate([(60, 1.0), (67, 4.0), (60, 1.0), (61, 0.25)])]
    a = annotation.annotate(spark.createDataFrame(rows, "sid long, pos int, p int, d double, o double, b double, cue boolean")).orderBy("pos").collect()
    assert a[1]["extreme"] and a[1]["long"] and a[3]["short"] and all(0.12 <= r["weight"] <= 1 for r in a)


def test_text_repair(spark):
    assert text.repair("plain") == "plain"
    assert text.repair("가나다라".encode().decode("latin-1")) == "가나다라"
    df = spark.createDataFrame([("Ｆｕｌｌ Ⅳ",), (None,)], "t string")
    assert [r.x for r in df.select(text.nfkc("t").alias("x")).collect()] == ["full iv", None]
    assert one(spark, *(sequence.half_up(F.lit(v)).alias(k) for k, v in (("a", -2.5), ("b", 2.5)))) == (-2, 3)


def test_evaluation():
    base = [{"p": 60 + k, "d": 1.0} for k in range(8)]
    for kind in evaluation.MUTATIONS:
        assert evaluation.mutate(base, kind) != base and base[4] == {"p": 64, "d": 1.0}
    bad = evaluation.violations([{"caseId": "a"}, {"caseId": "a"}])
    assert ("a", "repeated caseId") in bad and ("a", "fewer than four events") in bad


def test_thinned_marks(spark):
    rows = [(m, t) for m, t in [(1, 100.0), (1, 101.0), (2, 102.0), (2, 140.0), (3, 141.0), (9, 100.0)]]
    marks = F.array(*(F.struct(F.lit(m).alias("measure"), F.lit(t).alias("tempo")) for m, t in rows))
    assert [(x.measure, x.tempo) for x in one(spark, sequence.thinned(marks).alias("x")).x] == [(1, 100.0), (2, 140.0), (9, 100.0)]
