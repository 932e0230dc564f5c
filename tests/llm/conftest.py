import random

import pytest


def corpus(seed: int = 7, n: int = 60) -> list[tuple]:
    """Documents (doc_id, text, lang, source, n_chars) with copies, near copies, shared passages, odd white space and nulls."""
    r = random.Random(seed)
    common, rare = ["the", "of", "and", "in"], ["".join(r.choices("abdeinorst", k=r.randint(3, 8))) for _ in range(400)]
    words = lambda k: [r.choice(common) if r.random() < 0.3 else r.choice(rare) for _ in range(k)]
    passage = words(40)
    texts: list[str | None] = []
    for k in range(n):
        kind = k % 6
        if kind == 1 and texts:
            texts.append(texts[-1])
        elif kind == 2 and texts[k - 2]:
            w = texts[k - 2].split()
            w[len(w) // 2] = "edited"
            texts.append(" ".join(w))
        elif kind == 3:
            w = words(30)
            texts.append(" ".join([*w[:11], *passage[r.randint(0, 10) :], *w[11:]]))
        else:
            texts.append(" ".join(words(r.choice([1, 2, 5, 20, 80, 300]))))
    texts[5], texts[11], texts[17], texts[23] = None, "", "Éa\tb  c\n\nd Ω", texts[0].upper() if texts[0] else ""
    ids = [3 * k + (k % 2) for k in range(n)]
    out = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "b", None]), len(t or "")) for i, t in zip(ids, texts)]
    r.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """More columns, with names that operators use."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit("mine") for c in ("id", "n_words", "n", "key", "kept", "range", "guest", "label", "component_id", "fingerprint", "spans")})
