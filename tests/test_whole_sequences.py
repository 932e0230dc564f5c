"""Sequence queries over all streams and items."""

import datetime
import re

import pytest

import __spark_entry__  # noqa: F401 - registers the queries
from strophic.functions import sequence as seq
from strophic.plans import registry

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark, path, streams):
    """Streams (user, steps above 60) as a table of events."""
    t0 = datetime.datetime(2024, 1, 1)
    rows = [(1000 * user + k, t0 + datetime.timedelta(minutes=k), user, "view", 2.0, f'{{"k": {p}}}') for user, steps in streams.items() for k, p in enumerate(steps)]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(f"{path}/events.parquet")


@pytest.fixture(scope="module")
def streams(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("streams"))
    events(spark, path, {u: [(k * k + u) % 8 for k in range(24)] for u in (7, 9, 33, 450)})
    return path


def test_alignment_cost_has_all_streams(spark, streams):
    rows = registry.QUERIES["alignment_cost"](spark, streams).collect()
    assert sorted((r.sid, r.start) for r in rows) == [(u, k) for u in (7, 9, 33, 450) for k in range(17)]


def test_finalize_streams_keeps_whole_streams(spark, streams):
    rows = registry.QUERIES["finalize_streams"](spark, streams).collect()
    assert sorted((r.sid, r.pos, r.p) for r in rows) == [(u, k, 60 + (k * k + u) % 8) for u in (7, 9, 33, 450) for k in range(24)]


def test_finalize_drops_silent_notes_and_short_streams(spark):
    rows = [(1, k, 60 + k, 0.0 if k % 7 == 3 else 1.0) for k in range(9)] + [(3, k, 60, 1.0) for k in range(4)] + [(6, k, 60, 0.0 if k == 3 else 1.0) for k in range(5)]
    found = seq.finalize(spark.createDataFrame(rows, "sid long, pos int, p int, d double"), 5).collect()
    assert sorted((r.sid, r.pos, r.p) for r in found) == [(1, i, 60 + k) for i, k in enumerate(k for k in range(9) if k != 3)]


def test_token_overlap_has_all_items(spark, tmp_path):
    docs = [(1, "The cat sat, on the mat"), (2, "a dog"), (3, None), (4, ""), (2, "a dog")]
    items = [(0, "cat mat"), (5, "the dog"), (7, "sat on it now"), (20, "Nothing here"), (21, ""), (22, None), (150, "a a dog cat")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    bag = lambda t: set(re.findall("[a-z]+", (t or "").lower()))
    expected = sorted((d, i, round(len(bag(q) & bag(t)) / len(bag(q)), 6)) for d, t in docs for i, q in items if bag(q) and len(bag(q) & bag(t)) / len(bag(q)) >= 0.5)
    assert {i for _, i, _ in expected} >= {5, 7, 150}
    assert sorted((r.doc_id, r.item_id, r.share) for r in registry.QUERIES["token_overlap"](spark, str(tmp_path)).collect()) == expected
