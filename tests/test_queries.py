"""Registered queries against their SQL; STROPHIC_ALL_QUERIES=1 runs all of them."""

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from strophic.plans import registry

DATA = "/root/testdata/sf0.001"
SOME = ["note_features", "index_tokens", "candidate_evidence", "structural_annotation", "exact_occurrences", "local_boundaries", "chord_fit", "as_of_join", "bm25", "run_diff"]
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables here")


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    key = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(columns), sorted(tuple(key(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL) if os.environ.get("STROPHIC_ALL_QUERIES") else SOME)
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in Path(DATA).glob("*.parquet"):
        con.execute(f"create view {f.stem} as from '{f}'")
    expected = con.execute(registry.ORACLE_SQL[name])
    columns = [c[0] for c in expected.description]
    got = registry.QUERIES[name](spark, DATA)
    assert rows(got.columns, got.collect()) == rows(columns, expected.fetchall())


def test_search_finds_its_source(spark):
    top = entry.entry(spark).orderBy("rank").first()
    assert (top["sid"], top["start"], top["rank"]) == (7, 10, 1)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
