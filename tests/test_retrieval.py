"""Positions and seeds of queries of any length, and the rounds of diversified candidates, against plain versions."""

import random
from collections import defaultdict

from strophic.operators import retrieval, tokens

POSTINGS, QUERY = "token string, sid int, pos int", "token string, pos int, kind string"


def test_positions_and_seeds_of_long_queries(spark):
    rng = random.Random(3)
    query = [(f"i:{k % 90}", k, "i") for k in range(150)] + [("r:1", 0, "r"), ("i5:1", 3, "i5")]
    postings = [(rng.choice([f"i:{k}" for k in range(90)] + ["r:1", "i5:1"]), rng.randrange(3), rng.randrange(170)) for _ in range(3000)]
    hits = defaultdict(list)
    for token, sid, pos in postings:
        for t, at, kind in query:
            if t == token:
                hits[sid, max(0, pos - at)].append((kind, at))
    expected = {}
    for key, own in hits.items():
        at = {k for kind, k in own if kind == "i"}
        expected[key] = (len(at), sum(k + 1 in at for k in at), min(at, default=None), sum({"i": 3, "i5": 50, "r": 1}[kind] for kind, _ in own))
    got = retrieval.evidence(spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(query, QUERY), 150).collect()
    assert {(r["sid"], r["start"]): (r["positions"], r["seeds"], r["low"], r["evidence"]) for r in got} == expected
    # neighbours over the borders of the words are among them
    assert any({61, 62} <= {k for kind, k in own if kind == "i"} for own in hits.values()) and any({123, 124} <= {k for kind, k in own if kind == "i"} for own in hits.values())
    seeds = retrieval.adjacent_seeds(spark.createDataFrame(postings, POSTINGS), spark.createDataFrame(query, QUERY), 150).collect()
    assert {(r["sid"], r["start"]): r["seeds"] for r in seeds} == {k: v[1] for k, v in expected.items() if v[1]}


def test_rounds_take_the_best_of_each_stream(spark):
    rng = random.Random(5)
    rows = [(sid, start, float(rng.randrange(6))) for sid in range(9) for start in range(rng.randrange(1, 9))]
    streams = defaultdict(list)
    for sid, start, e in rows:
        streams[sid].append((-e, start))
    order = sorted((k, min(own)[0], sid, x[1]) for sid, own in streams.items() for k, x in enumerate(sorted(own)[:3]))[:20]
    found = retrieval.diversified(spark.createDataFrame(rows, "sid int, start int, evidence double"), 3, 20)
    assert [(r["round"], -r["top"], r["sid"], r["start"]) for r in found.collect()] == order
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()


def test_caps_keep_the_first_postings_of_hot_tokens(spark):
    rows = [(f"i:{k % 2}", k * 7919 % 211, k, "i") for k in range(1000)]
    limits = {"i:0": 70, "i:1": 3}
    found = tokens.capped_postings(spark.createDataFrame(rows, "token string, sid int, pos int, kind string"), spark.createDataFrame([(t, c, 0, "i") for t, c in limits.items()], "token string, cap int, pos int, kind string"))
    expected = {(t, *x, n) for t, cap in limits.items() for n, x in enumerate(sorted((r[1], r[2]) for r in rows if r[0] == t)[:cap], 1)}
    assert {(r["token"], r["sid"], r["pos"], r["seq"]) for r in found.collect()} == expected
