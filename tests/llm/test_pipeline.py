"""The classifier's held-out accuracy, and the pipeline against plain versions of its stages."""

import random
import re

import plain
import public_tokenizers
import pytest
from conftest import SCHEMA

import corpus_pipeline
from strophic.llm import cotraining

NASTY = ["zurk", "blorf", "gnash"]


def labelled(n=900):
    r = random.Random(3)
    vocabulary = ["".join(r.choices("abdeinorst", k=r.randint(3, 8))) for _ in range(500)]
    docs, labels, truth = [], [], {}
    for k in range(n):
        w = r.choices(vocabulary, k=r.randint(20, 80))
        kind = "toxic" if k % 10 == 3 else "low" if k % 7 == 0 else "good"
        if kind == "toxic":
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(NASTY))
        if kind == "low":
            w = [x + "!!" if r.random() < 0.5 else x.upper() + "$$$" for x in w]
        text = " ".join(w)
        docs.append((k, text, r.choice(["en", "de"]), r.choice(["x", "y"]), len(text)))
        truth[k] = kind == "good"
        if k % 3:
            labels.append((k, int(kind != "low"), int(kind == "toxic")))
    return docs, labels, truth


def test_classifier(spark):
    docs, labels, truth = labelled()
    df = spark.createDataFrame(docs + [(5000, None, None, None, None), (5001, "", "en", "x", 0)], SCHEMA)
    lab = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0), (99999, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r.keep for r in cotraining.report(df, lab).collect()}
    free = [k for k in truth if k % 3 == 0]  # without labels
    assert sum(found[k] == truth[k] for k in free) / len(free) > 0.95 and {5000, 5001} <= found.keys()
    kept = cotraining.keep_good(df, lab)
    assert kept.schema == df.schema and {r.doc_id for r in kept.collect()} == {k for k, v in found.items() if v}
    assert {r.keep for r in cotraining.report(df, lab.limit(0)).collect()} == {True}
    assert cotraining.report(df.limit(0), lab).count() == 0


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs, labels, _ = labelled(300)
    good = next(d for d in docs if d[0] % 10 != 3 and d[0] % 7)
    words = good[1].split()
    near = " ".join([*words[:-1], "other"])
    r = random.Random(1)
    pool = sorted({w for d in docs[:20] if d[0] % 10 != 3 and d[0] % 7 for w in d[1].split()})
    shared = " ".join(r.choices(pool, k=30))
    docs += [(1000, good[1], "en", "x", len(good[1])), (1001, near, "en", "x", len(near))]
    for k in (1002, 1003):
        t = f"{shared} " + " ".join(r.choices(pool, k=40))
        docs.append((k, t, "en", "x", len(t)))
    bench = " ".join(r.choices(pool, k=20))
    docs.append((1004, f"{bench} {bench[::-1]}", "en", "x", 2 * len(bench) + 1))
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, shared, good[0], bench


def test_pipeline(spark, folder):
    path, docs, shared, copied, bench = folder
    kept = {r.doc_id for r in corpus_pipeline.quality_classifier(spark, spark.read.parquet(f"{path}/documents.parquet"), path).collect()}
    rows = [d for d in docs if d[0] in kept]
    rows = [d for d in rows if plain.near_duplicates(rows, 5)[d[0]][2]]
    assert not {1000, 1001} & {d[0] for d in rows} and copied in {d[0] for d in rows}
    first, out = {}, []
    for d in sorted(rows):
        w = d[1].split()
        gone = set()
        for i in range(len(w) - 12):
            if first.setdefault(tuple(w[i : i + 13]), d[0]) < d[0]:
                gone |= set(range(i, i + 13))
        out.append((d[0], " ".join(x for i, x in enumerate(w) if i not in gone) if gone else d[1]))
    assert shared not in dict(out)[1003]
    bad = plain.decontamination(out, [(1, bench)])
    final = {k: t for k, t in out if not bad[k][4]}
    assert 1004 not in final
    found = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in found} == final.keys()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in final.items()}
    total: dict[int, int] = {}
    for r in found:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == sizes
    assert [s for s, _ in corpus_pipeline.STAGES] and all(re.fullmatch(r"[\w -]+", s) for s, _ in corpus_pipeline.STAGES)
