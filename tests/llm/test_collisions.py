"""Words that a polynomial hash with an odd base confuses, forced hash collisions, and stored tables of the language model."""

import numpy as np
import plain
import public_tokenizers
import pytest

from strophic.llm import encoding, katz, near_duplicates, packing, passages, token_files
from strophic.llm.words import SPACED, U, Words

SCHEMA = "doc_id long, text string"


def thue_morse(length=4096):
    a = "ab"
    while len(a) < length:
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.fixture(scope="module")
def rows():
    out = []
    for size in (1024, 2048, 4096):
        a, b = thue_morse(size)
        more = [f"w{k}" for k in range(14)]
        out += [f"{a} x y", f"{b} x y", " ".join([a, *more]), " ".join([b, *more]), " ".join([b, *more, "z"]), a, b]
    return [(3 * k + 1, t) for k, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(2)


def test_hashes_differ():
    a, b = thue_morse()
    raw = f"{a} {b}".encode()
    h = Words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), SPACED).hashes()
    assert h[0] != h[1]


def test_near_duplicates(docs, rows):
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.report(docs).collect()}
    assert found == plain.near_duplicates(rows)


def test_links_are_confirmed_on_words(spark, monkeypatch):
    """Every two sets look alike to signatures; only words decide."""
    monkeypatch.setattr(near_duplicates, "CHUNK", 4)
    rows = [(k, " ".join(f"{'a' if k % 3 else 'b'}{j + k // 3 % 2 * (j == 5) * 100}" for j in range(30))) for k in range(24)]
    texts = [near_duplicates._normal(t.encode()) for _, t in rows]
    sets = near_duplicates.numbered(texts, 2)
    want = plain.near_duplicates(rows)
    root = near_duplicates._confirm(sets, 80, np.arange(len(rows)))
    assert [rows[r][0] for r in root] == [want[k][1] for k, _ in rows]
    sets = [set(s.tolist()) for s in near_duplicates.numbered([b"a b c", b"a b", b"a", b"a b c a b c", b"a"], 3)]
    assert [len(s) for s in sets] == [1, 1, 1, 3, 1] and sets[2] == sets[4] and sets[0] < sets[3] and not sets[1] & sets[2]


def test_passages(docs, rows):
    found = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in passages.report(docs).collect()}
    assert found == plain.passages(rows)


def test_automata_alone_give_the_places():
    automaton = passages.compiled([" ".join(f"w{k}" for k in range(13))], [5])
    text = " ".join(["x", *(f"w{k}" for k in range(13)), "y", "xw0", *(f"w{k}" for k in range(1, 13))]).encode()
    for doc, gone in ((9, 13), (5, 0), (4, 0), (None, 0)):
        assert passages.located(automaton, doc, text)[1].sum() == gone


def test_tokens(spark, docs, rows, monkeypatch):
    old = encoding.byte_hashes
    for forced in (False, True):
        if forced:
            monkeypatch.setattr(encoding, "byte_hashes", lambda d, a, b: old(d, a, b) & U(0xFFF00000000000F0))
        for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
            e = encoding.Encoder(public_tokenizers.path(name))
            raw = [t.encode() for _, t in rows]
            off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
            for _ in range(2):
                assert e.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), off) == e.whole([t for _, t in rows])
    a, b = token_files.report(docs, public_tokenizers.path("byte_bpe_50k.json")), packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    assert len({r.ids_crc32 for r in a.collect()}) == len({t for _, t in rows}) and b.count() >= len(rows)


def test_katz_counts_them_apart(docs, rows):
    found = {r.doc_id: (r.n_tokens, r.n_known, r.score) for r in katz.score(docs).collect()}
    want, _ = plain.katz(rows, cutoff=0)
    for k, (_, n, known, _, _, score) in want.items():
        assert found[k][:2] == (n, known) and found[k][2] == pytest.approx(score, abs=1e-6)


@pytest.mark.parametrize("cutoff", [0, 1])
def test_katz_tables_score_other_texts(spark, docs, rows, cutoff, monkeypatch):
    monkeypatch.setattr(katz, "GOES", 2)
    texts = rows + [(1000 + k, " ".join(f"c{(j * j + k) % 7}" for j in range(40))) for k in range(20)]
    df = spark.createDataFrame(texts, SCHEMA).repartition(3)
    model, tables = katz.fit(df, fold=1, cutoff=cutoff)
    scored = {r.doc_id: r.score for r in katz.score(df, cutoff=cutoff).collect()}
    again = {r.doc_id: r.score for r in katz.evaluate(df, model, tables).collect()}
    assert again == pytest.approx(scored, abs=1e-9)
    assert {(r.kind, r.order) for r in tables.select("kind", "order").distinct().collect()} == {("count", 1), ("count", 2), ("count", 3), ("weight", 2), ("weight", 3)}
    new = spark.createDataFrame([(1, "c1 never c2"), (2, None), (3, "")], SCHEMA)
    out = {r.doc_id: r for r in katz.evaluate(new, model, tables).collect()}
    assert out[1].n_known == 3 and out[2].score == out[3].score and katz.evaluate(new.limit(0), model, tables).count() == 0
