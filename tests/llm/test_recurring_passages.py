"""A passage that recurs many times in a document."""

import numpy as np
import plain
import pyarrow as pa

from strophic.llm import passages

LINE = " ".join(f"w{k}" for k in range(10))


def test_a_document_gets_a_passage_once():
    """300 places of one passage in each of 20 documents, two of another in one of them."""
    claims = [(d, 0, 5 - 20 * k, 20 * k, 2) for d in range(1, 21) for k in range(300)] + [(20, 0, 900 - 7000 - 20 * k, 7000 + 20 * k, 1) for k in range(2)]
    columns = [pa.array(np.array(x, np.int64)) for x in zip(*sorted(claims))]
    out = [r for b in passages._merge([pa.RecordBatch.from_arrays(columns, names=["id", "src", "shift", "first", "number"])]) for r in b.to_pylist()]
    assert sorted(tuple(r.values()) for r in out) == sorted([*((d, 0, 5, 14) for d in range(1, 21)), (20, 0, 900, 13)])


def test_all_its_places_go(spark):
    texts = [" ".join([f"a{d}", *[LINE] * (30 + d), f"b{d}", *(f"c{d}x{k}" for k in range(20)), *[LINE] * d]) for d in range(12)]
    rows = list(enumerate(texts))
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.report(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert found == plain.passages(rows)
