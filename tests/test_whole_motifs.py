"""Motif queries with the lengths of their operators."""

import datetime

import pytest

import __spark_entry__  # noqa: F401 - registers the queries
from strophic.plans import registry

#: Two times the same twelve notes, with others between them.
THEME = [0, 2, 1, 4, 3, 6, 5, 7, 2, 4, 0, 5]


@pytest.fixture(scope="module")
def theme(spark, tmp_path_factory):
    t0, path = datetime.datetime(2024, 1, 1), str(tmp_path_factory.mktemp("theme"))
    steps = [*THEME, 7, 7, 0, *THEME]
    rows = [(k, t0 + datetime.timedelta(minutes=k), 7, "view", 2.0, f'{{"k": {p}}}') for k, p in enumerate(steps)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{path}/events.parquet")
    return path


def test_ranked_motifs_are_up_to_twelve_notes(spark, theme):
    rows = registry.QUERIES["ranked_motifs"](spark, theme).collect()
    assert max(r.length for r in rows) == 12
    whole = next(r for r in rows if r.length == 12)
    assert (whole["count"], whole["first"], whole["key"]) == (2, 0, ",".join(str(b - a) for a, b in zip(THEME, THEME[1:])))
    inside = f",{whole['key']},"
    assert not any(r.length < 12 and r.score <= whole.score and f",{r.key}," in inside for r in rows)


def test_motif_signatures_are_up_to_eight_notes(spark, theme):
    assert {r.length for r in registry.QUERIES["motif_signatures"](spark, theme).collect()} == {4, 5, 6, 7, 8}


def test_the_longest_motif_wins(spark, theme):
    rows = {r.start: (r.length, r.previous, r.distance) for r in registry.QUERIES["motif_relations"](spark, theme).collect()}
    assert rows[15] == (8, 0, 15) and rows[19] == (8, 4, 15)
