"""Pairs, symbols, bars, phrase roles and motif comparison on small tables, and the registered queries against their SQL."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strophic.operators import comparison, pairing

SCORE = ["target_pairs", "closest_window", "breath_symbols", "name_lookup", "filled_bars", "phrase_evidence"]


@pytest.mark.parametrize("name", SCORE)
def test_equals_sql(spark, name):
    from tests import test_queries

    test_queries.test_equals_sql(spark, name)


def test_each_note_is_used_once(spark):
    targets = spark.createDataFrame([("s", 1, 60, 1.5, t) for t in range(3)] + [("s", 1, 61, 2.0, 9)], "sid string, m int, p int, b double, t int")
    notes = spark.createDataFrame([("s", 1, 60, 1.5 + 4e-7, 20), ("s", 1, 60, 1.5, 21), ("s", 1, 61, 2.01, 22)], "sid string, m int, p int, b double, n int")
    got = pairing.pair(targets, notes, ["sid", "m", "p"], "b", ["t"], ["n"])
    assert sorted((r["t"], r["n"]) for r in got.collect()) == [(0, 20), (1, 21)]
    assert pairing.pair(targets.limit(0), notes, ["sid", "m", "p"], "b", ["t"], ["n"]).count() == 0


def test_no_note_value_lies_between_two_places(spark):
    times = sorted({k / (odd * 2**e) for odd in (1, 3, 5, 7, 9) for e in range(8) for k in range(1, 9)})
    rows = spark.createDataFrame([(x, x - 1e-9, x + 1e-9) for x in times], "x double, low double, high double")
    same = rows.select((pairing.place(F.col("low")) == pairing.place(F.col("high"))).alias("same"), pairing.place(F.col("x")).alias("k")).collect()
    assert all(r["same"] for r in same) and len({r["k"] for r in same}) == len(times)


def test_symbols_and_names(spark):
    notes = spark.createDataFrame([("s", 1, 60, 1.0), ("s", 1, 62, 2.0)], "sid string, m int, p int, b double")
    symbols = spark.createDataFrame([("s", 1, 60, 1.0, "fermata"), ("s", 1, 60, 1.0, "caesura"), ("s", 1, 60, 1.0, "fermata")], "sid string, m int, p int, b double, symbol string")
    got = {r["p"]: r["symbols"] for r in pairing.symbols_at(notes, symbols, ["sid", "m", "p"], "b").collect()}
    assert got == {60: ["caesura", "fermata"], 62: []}
    items = spark.createDataFrame([("1", "A", "a"), ("2", "B", "b"), ("3", "C", "c"), ("4", None, None)], "id string, title string, plain string")
    known = spark.createDataFrame([("a", "x"), ("A", "y"), ("2", "z"), ("b", "w")], "name string, value string")
    found = pairing.lookup(items, "id", [F.col("id"), F.col("title"), F.col("plain")], known)
    assert {r["id"]: r["value"] for r in found.collect()} == {"1": "y", "2": "z", "3": None, "4": None}


def test_bars_are_filled(spark):
    notes = spark.createDataFrame([("s", 0, 1, 2.0, 1.0), ("s", 1, 1, 4.5, 6.0), ("s", 2, 5, 1.0, 0.0), ("s", 3, 5, 2.0, 1.0)], "sid string, pos int, m int, b double, d double")
    got = sorted((r["m"], r["b"], r["d"], r["pos"], r["part"]) for r in pairing.filled_bars(notes).collect())
    expected = [(1, 1.0, 1.0, None, None), (1, 2.0, 1.0, 0, 0), (1, 3.0, 1.5, None, None), (1, 4.5, 0.5, 1, 0), (2, 1.0, 4.0, 1, 1), (3, 1.0, 1.5, 1, 2), (3, 2.5, 2.0, None, None), (3, 4.5, 0.5, None, None), (4, 1.0, 4.0, None, None), (5, 1.0, 1.0, None, None), (5, 2.0, 1.0, 3, 0), (5, 3.0, 2.0, None, None)]
    assert got == expected
    assert pairing.filled_bars(notes.limit(0)).count() == 0


def motif(pitches, lengths):
    onsets = [0.0, *itertools.accumulate(lengths)][: len(lengths)]
    return [{"p": p, "d": d, "o": o} for p, d, o in zip(pitches, lengths, onsets)]


def cheapest(a, b):
    """Of all alignments, the least cost, one choice after another."""

    def least(i, j):
        if i == len(a.p) or j == len(b.p):
            return comparison.GLOBAL_GAP * (len(a.p) - i + len(b.p) - j)
        return min(a.cost(i, b, j) + least(i + 1, j + 1), comparison.GLOBAL_GAP + least(i + 1, j), comparison.GLOBAL_GAP + least(i, j + 1))

    return least(0, 0)


def test_motif_alignments_are_the_cheapest():
    rng = random.Random(7)
    for _ in range(60):
        left, right = (motif([rng.randrange(55, 75) for _ in range(n)], [rng.choice([0.25, 0.5, 1.0, 2.0]) for _ in range(n)]) for n in (rng.randint(1, 6), rng.randint(1, 6)))
        a, b, path = comparison.Motif(left), comparison.Motif(right), comparison.compare(left, right)["path"]
        assert [i for i, *_ in path if i is not None] == list(range(len(left))) and [j for _, j, _ in path if j is not None] == list(range(len(right)))
        cost = sum(comparison.GLOBAL_GAP if i is None or j is None else a.cost(i, b, j) for i, j, _ in path)
        assert cost == pytest.approx(cheapest(a, b))


def test_motif_transformations():
    base = motif([60, 64, 62, 67], [1.0, 0.5, 0.5, 1.0])
    same = comparison.compare(base, base)
    assert (same["similarity"], same["coverage"], same["matched"], same["transformations"]) == (100, 100, 4, [])
    assert comparison.compare(base, motif([65, 69, 67, 72], [1.0, 0.5, 0.5, 1.0]))["transformations"] == ["transposition"]
    longer = comparison.compare(base, motif([60, 64, 62, 67], [1.0, 0.5, 0.5, 2.0]))
    assert "terminal-extension" in longer["transformations"] and longer["interval"] == 100
    repeated = comparison.compare(base, motif([60, 64, 64, 62, 67], [1.0, 0.5, 0.5, 0.5, 1.0]))
    assert repeated["coverage"] == 80 and {"ornament-insertion", "repeat-expansion"} <= set(repeated["transformations"])
    assert comparison.compare([], base)["similarity"] == 0 and comparison.compare(base, [])["path"] == []


def test_passages_are_compared_as_motifs(spark):
    base = motif([60, 64, 62, 67], [1.0, 0.5, 0.5, 1.0])
    other = motif([59, 65, 69, 67, 72, 50], [2.0, 1.0, 0.5, 0.5, 1.0, 1.0])
    rows = [(s, k, n["p"], n["d"], n["o"]) for s, notes in ((1, base), (2, other)) for k, n in enumerate(notes)]
    notes = spark.createDataFrame(rows, "sid long, pos int, p int, d double, o double")
    passages = spark.createDataFrame([(1, 0), (2, 1), (2, 4), (2, 9)], "sid long, start int")
    got = {(r["sid"], r["start"]): r for r in comparison.compare_passages(notes, passages, base, 4).collect()}
    assert set(got) == {(1, 0), (2, 1), (2, 4)}
    for (sid, start), r in got.items():
        expected = comparison.compare(base, {1: base, 2: other}[sid][start : start + 4])
        assert {x: r[x] for x in comparison.FIELDS} == {x: expected[x] for x in comparison.FIELDS}
        assert r["transformations"] == ",".join(expected["transformations"])
    assert got[2, 1]["transformations"] == "transposition"
