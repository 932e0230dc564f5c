"""Harmony queries over whole streams, against plain versions."""

import datetime

import pytest

import __spark_entry__  # noqa: F401 - registers the queries
from strophic.plans import registry

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@pytest.fixture(scope="module")
def long_streams(spark, tmp_path_factory):
    """Events of two streams of one work and one of another; their onsets run far past 40 quarters."""
    t0 = datetime.datetime(2024, 1, 1)
    rows = []
    for user, size in ((1, 60), (51, 45), (2, 50)):
        for k in range(size):
            kind = "error" if k % 11 == 5 else "view"
            rows.append((len(rows), t0 + datetime.timedelta(minutes=k), user, kind, float((k * 7 + user) % 4), f'{{"k": {(k * k + 3 * user) % 8}}}'))
    path = tmp_path_factory.mktemp("long")
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{path}/events.parquet")
    return str(path), rows


def sounding(rows):
    """(src, begin, end) to the pitches that sound in the middle."""
    clock, notes = {}, {}
    for _, _, user, kind, value, props in rows:  # in order of time
        o, d = clock.get(user, 0.0), (0.25, 0.5, 1.0, 2.0)[int(value) % 4]
        clock[user] = o + d + (0.5 if kind == "error" else 0)
        if kind != "error":
            notes.setdefault(user % 50, set()).add((o, o + d, 60 + int(props[6:-1]) % 8))
    out = {}
    for src, own in notes.items():
        points = sorted({x for a, b, _ in own for x in (a, b)})
        for a, b in zip(points, points[1:]):
            now = [p for x, y, p in own if x <= (a + b) / 2 < y]
            if now:
                out[src, a, b] = now
    return out


def test_sounding_notes_of_whole_streams(spark, long_streams):
    path, rows = long_streams
    expected = {k: (",".join(str(c) for c in sorted({p % 12 for p in v})), min(v)) for k, v in sounding(rows).items()}
    found = {(r.src, r.begin, r.end): (r.pcs, r.low) for r in registry.QUERIES["sounding_notes"](spark, path).collect()}
    assert max(end for _, _, end in expected) > 50
    assert found == expected


@pytest.mark.parametrize("name", ["chord_fit", "harmonic_segments", "cadences", "boundary_harmony"])
def test_harmony_reaches_the_end(spark, long_streams, name):
    path, _ = long_streams
    rows = registry.QUERIES[name](spark, path).collect()
    assert max(r["at"] if name == "boundary_harmony" else r["begin"] for r in rows) > 42  # notes before 40 end by 42
