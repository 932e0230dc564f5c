"""op7 keeps n-grams that occur once."""

import plain
import pytest

from strophic.llm import queries


def test_singletons_count(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    expected, sums = plain.katz(rows, cutoff=0)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    found = {r.doc_id: r for r in queries.op7_katz_backoff(spark, str(tmp_path)).collect()}
    assert found.keys() == expected.keys()
    assert any(abs(v[5] - c[5]) > 1 for v, c in zip(expected.values(), plain.katz(rows)[0].values()))
    for k, v in expected.items():
        assert (found[k].base_score, found[k].score) == pytest.approx(v[4:], abs=1e-6)
