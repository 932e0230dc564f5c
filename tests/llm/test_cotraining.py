"""Co-training: what the views tell each other, and odd input."""

import random

import pytest
from pyspark.sql import functions as F

from strophic.llm import cotraining

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=900, seed=3):
    """Documents whose class shows in the text for three quarters and in the source for three quarters, apart from each other."""
    r = random.Random(seed)
    words = ["".join(r.choices("abdeinorst", k=r.randint(3, 8))) for _ in range(120)]
    kind = {1: ["fine", "clear", "sound"], 0: ["spam", "junk", "scam"]}
    docs, labels = [], []
    for k in range(n):
        y = int(r.random() < 0.6)
        w = r.choices(words, k=40)
        if r.random() < 0.75:
            w[5:8] = r.choices(kind[y], k=3)
        source = r.choice(["press", "school"] if y else ["farm1", "farm2"]) if r.random() < 0.75 else f"other{r.randint(0, 3)}"
        docs.append((k, " ".join(w), "en", source, 240))
        labels.append((k, y, 0))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, SCHEMA).repartition(3).cache(), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), dict((k, y) for k, y, _ in labels)


def accuracy(views, docs, truth):
    scored = {r["doc_id"]: r["p"] for r in cotraining.scan(docs, views).select("doc_id", F.col(cotraining.OWN + "p").alias("p")).collect()}
    return sum((p >= 0.5) == bool(truth[k]) for k, p in scored.items()) / len(scored), scored


def test_views_exchange_new_documents(tables):
    docs, labels, truth = tables
    views = cotraining.train(docs, labels, labelled=400, exchanged=20)
    given = [x for found in views.given for ids in found.values() for x in ids]
    assert len(views.given) == cotraining.ROUNDS
    seen = set()
    for found in views.given:
        new = {x for ids in found.values() for x in ids}
        assert new and not new & seen  # nothing is given twice
        seen |= new
    assert {view for found in views.given for (view, _), ids in found.items() if ids} == {"text", "metadata"}
    right = sum(truth[x] == y for found in views.given for (_, y), ids in found.items() for x in ids)
    assert right >= 0.9 * len(given)
    alone = cotraining.train(docs, labels, labelled=400, rounds=0)
    (before, p0), (after, p3) = accuracy(alone, docs, truth), accuracy(views, docs, truth)
    assert p0 != p3 and after >= before - 0.01 and after > 0.85


def test_odd_rows(spark, tables):
    docs, labels, _ = tables
    odd = spark.createDataFrame([(9001, None, None, None, None), (9001, None, None, None, None), (9002, "", "en", "press", -5), (None, "fine", "en", "press", 4), (9003, "fine " * 30000, "en", "press", 150000)], SCHEMA)
    more = docs.unionByName(odd).withColumns({c: F.lit("mine") for c in ("id", "feature", "view", "y", "size", "score")})
    found = cotraining.report(more, labels.unionByName(spark.createDataFrame([(0, None, 1), (None, 1, 0), (77, 0, 1)], labels.schema)))
    rows = found.collect()
    assert len(rows) == 905 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 9001}) == 1
    assert cotraining.keep_good(more, labels).columns == more.columns
    assert cotraining.report(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in cotraining.report(docs, labels.limit(0)).collect()} == {1.0}
