"""Operators against plain versions, with nulls, empty and odd texts, ties, repeated rows, clashing columns, empty tables."""

import array
import random
import zlib

import numpy as np
import plain
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from strophic.llm import common, decontamination, fingerprints, katz, licenses, near_duplicates, packing, passages, quotations, superminhash, token_files
from strophic.llm.encoding import Encoder
from strophic.llm.words import SPACED, U, Words, mix

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def got(df, key="doc_id", *columns):
    names = columns or tuple(c for c in df.columns if c != key)
    found = df.collect()
    out = {r[key]: tuple(r[c] for c in names) for r in found}
    assert len(out) == len(found)
    return out


def test_words():
    texts = ["", "a  bc", " x", "Ünï\nb", "tail "]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(t) for t in raw])])
    w = Words(np.frombuffer(b"".join(raw), np.uint8), off, SPACED)
    assert [w.text(a, b) for a, b in zip(w.off[:-1], w.off[1:])] == [b" ".join(t.split()) for t in raw]
    h = w.hashes()
    again = Words(np.frombuffer(b"bc x", np.uint8), np.array([0, 4]), SPACED).hashes()
    assert h[1] == again[0] and h[2] == again[1]


def test_superminhash_is_the_sequential_algorithm():
    r = np.random.default_rng(1)
    sets = [r.integers(0, 2**63, n).astype(U) for n in (1, 3, 9, 50, 0, 200)]
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    found = superminhash.signatures(np.concatenate(sets), off, 16)
    for s, mine in zip(sets, found):
        slots = [2**64 - 1] * 16
        for e in s.tolist():
            places = list(range(16))
            for j in range(16):
                draw = int(mix(np.array([(e + (2 * j + 1) * 0x9E3779B97F4A7C15) % 2**64], U))[0])
                at = j + ((draw >> 32) * (16 - j) >> 32)
                places[j], places[at] = places[at], places[j]
                value = j << 48 | int(mix(np.array([draw], U) ^ U(0xA5A5A5A5A5A5A5A5))[0]) >> 16
                slots[places[j]] = min(slots[places[j]], value)
        assert mine.tolist() == slots


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_encoder(path, rows):
    r = random.Random(2)
    odd = ["", " ", "a  b", "\n\na ", "it's we're 3.5, x. y!!", "tab\tb", "nb\xa0x y", "<|endoftext|> x", "a\x00b", "x\x1cb", "ΣΑΣ ς", "日本 語。", "🙂 a", "x" * 5000]
    odd += ["".join(r.choices([" ", "\n", "a", "B", "'s", ".", ",", "1", "é", "\t", "́", "—", "×"], k=r.randint(1, 25))) for _ in range(1500)]
    texts = odd + [t or "" for _, t, *_ in rows]
    e = Encoder(path)
    raw = [t.encode() for t in texts]
    assert e.kind in ("byte", "space")
    whole = e.whole(texts)
    assert e.encode_bytes(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])])) == whole
    assert e.encode(texts) == whole


def test_decontamination(spark, docs, rows, clashing, empty):
    long = max((t for _, t, *_ in rows if t), key=len).split()
    items = [(1, " ".join(long[5:30])), (2, "Éa b"), (3, None), (4, ""), (None, "the of"), (5, " ".join(long[40:53]).upper()), (5, "edited"), (6, "no such words at all here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = plain.decontamination(rows, [i for i in items if i[0] is not None])
    assert got(decontamination.report(clashing, bench)) == expected
    assert got(decontamination.report(docs, bench, chunk_bytes=50)) == expected  # several passes
    assert any(v[4] for v in expected.values())
    kept = decontamination.decontaminate(clashing, bench)
    assert kept.columns == clashing.columns and {r.doc_id for r in kept.select("doc_id").collect()} == {k for k, v in expected.items() if not v[4]}
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(docs, bench, remove="spans").collect()}
    again = plain.decontamination([(k, t) for k, t in cut.items()], [])
    assert all(again[k][0] == v[0] - v[1] for k, v in expected.items())
    assert all(cut[k] == t for k, t, *_ in rows if not expected[k][1])
    assert decontamination.report(empty, bench).count() == 0 and decontamination.report(docs, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_fingerprints(spark, docs, rows, clashing, empty):
    assert got(fingerprints.report(clashing)) == plain.fingerprints(rows)
    assert fingerprints.report(empty).count() == 0
    single = fingerprints.report(spark.createDataFrame([(9, None)], "doc_id long, text string")).first()
    assert (single.n_chars, single.near_edited, single.near_next) == (0, 1.0, 1.0)
    repeated = spark.createDataFrame([(1, "ab"), (1, "ab"), (1, "AB "), (None, "x")], "doc_id long, text string")
    assert fingerprints.report(repeated).count() == 4


def test_near_duplicates(docs, rows, clashing, empty):
    expected = plain.near_duplicates(rows)
    assert got(near_duplicates.report(clashing), "doc_id", "n_shingles", "component_id", "kept") == expected
    stage = near_duplicates.dedup(docs, words=5)
    assert stage.columns == docs.columns
    assert {r.doc_id for r in stage.select("doc_id").collect()} == {k for k, v in plain.near_duplicates(rows, 5).items() if v[2]}
    assert near_duplicates.report(empty).count() == 0


def test_near_duplicates_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "CHUNK", 7)
    r = random.Random(4)
    base = [f"w{r.randint(0, 60)}" for _ in range(60)]
    rows = []
    for k in range(50):  # one large group of near copies, some too far from all
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(60)] = f"x{r.randint(0, 10**6)}"
        rows.append((k, " ".join(w)))
    assert got(near_duplicates.report(spark.createDataFrame(rows, "doc_id long, text string")), "doc_id", "n_shingles", "component_id", "kept") == plain.near_duplicates(rows)


def test_passages(spark, docs, rows, clashing, empty):
    expected = plain.passages(rows)
    assert sum(v[1] for v in expected.values()) > 100
    assert got(passages.report(clashing)) == expected
    stage = passages.dedup(docs)
    assert stage.columns == docs.columns and stage.schema == docs.schema
    texts = {r.doc_id: r for r in stage.collect()}
    assert all(plain.sha(b" ".join((texts[k].text or "").encode().split())) == v[2] for k, v in expected.items())
    assert all(texts[k].text == t for k, t, *_ in rows if not expected[k][1])
    assert passages.report(empty).count() == 0
    repeated = spark.createDataFrame([(None, " ".join("abcdefghijklmnop"))] + [(k, " ".join("abcdefghijklmnop")) for k in (4, 4, 2)], "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.n_removed) for r in passages.report(repeated).collect()) == [(0, 0), (2, 0), (4, 16), (4, 16)]


def test_passages_long_and_split(spark, monkeypatch):
    monkeypatch.setattr(passages, "PATTERN", 20)
    monkeypatch.setattr(passages, "PER_ROW", 2)
    monkeypatch.setattr(passages, "SHARD", 500)
    r = random.Random(8)
    base = [f"w{r.randint(0, 40)}" for _ in range(400)]
    rows = [(k, " ".join(base[(a := r.randint(0, 200)) : a + r.randint(5, 200)])) for k in range(25)]
    assert got(passages.report(spark.createDataFrame(rows, "doc_id long, text string"))) == plain.passages(rows)


def _ids(rows, path, end):
    t = Tokenizer.from_file(path)
    return {r[0]: e.ids + [end] for r, e in zip(rows, t.encode_batch([r[1] or "" for r in rows], add_special_tokens=False))}


def _crc(ids):
    return zlib.crc32(array.array("I", ids).tobytes())


def test_token_files(spark, docs, rows, clashing, empty):
    ids, at, expected = _ids(rows, BYTE, 2), 0, {}
    for k in sorted(ids):
        expected[k] = (at, len(ids[k]), _crc(ids[k]))
        at += len(ids[k])
    assert got(token_files.report(clashing, BYTE), "doc_id", "start", "n_tokens", "ids_crc32") == expected
    path = common.new_path(spark, "tokens-test")
    token_files.write(docs, path, BYTE)
    assert {r.doc_id: r.ids for r in token_files.documents(spark, path, [0, 4]).collect()} == {k: ids[k] for k in (0, 4)}
    assert token_files.report(empty, BYTE).count() == 0


def test_token_files_have_indexes(spark, docs):
    import pyarrow.parquet as pq

    path = common.new_path(spark, "tokens-test")
    token_files.write(docs, path, BYTE)
    f = next(x for x in spark.read.parquet(path).inputFiles())
    meta = pq.ParquetFile(f.removeprefix("file://")).metadata
    by = {meta.row_group(0).column(k).path_in_schema: meta.row_group(0).column(k) for k in range(meta.num_columns)}
    assert any("DICTIONARY" in e for e in by["ids.list.element"].encodings) and "DELTA_BINARY_PACKED" in by["doc_id"].encodings
    assert by["doc_id"].has_offset_index and by["doc_id"].has_column_index


def test_packing(spark, docs, rows, clashing, empty):
    ids = _ids(rows, WORD, 0)
    expected = {(k, p): (a, len(x[a : a + 64]), _crc(x[a : a + 64])) for k, x in ids.items() for p, a in enumerate(range(0, len(x), 64))}
    found = packing.pack(clashing, WORD, capacity=64).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in found} == expected and len(found) == len(expected)
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    assert len(bins) <= -(-sum(r.length for r in found) // 64) + 1
    for r in packing.sequences(docs, WORD, capacity=64).collect():
        for p in r.pieces:
            x = ids[p.doc_id][64 * p.piece : 64 * p.piece + 64]
            assert r.ids[p.offset : p.offset + p.length] == x
    assert packing.pack(empty, WORD).count() == 0


def test_plan_is_best_fit():
    r = random.Random(6)
    for _ in range(30):
        sizes = [r.randint(1, 40) for _ in range(r.randint(1, 200))]
        histogram = {s: sizes.count(s) for s in sizes}
        room, slots = [], {}
        for s in sorted(sizes, reverse=True):  # one by one
            able = [k for k in range(len(room)) if room[k] >= s]
            if able:
                room[min(able, key=lambda k: room[k])] -= s
            else:
                room.append(40 - s)
        runs = packing.plan(histogram, 40)
        used = {}
        for length, a, b, per, first, at in runs:
            for k in range(a, b):
                assert slots.setdefault((length, k), 1)
                used.setdefault(first + (k - a) // per, []).append((at + (k - a) % per * length, length))
        assert len(slots) == len(sizes) and len(used) == len(room)
        for own in used.values():
            end = 0
            for at, length in sorted(own):
                assert at == end
                end = at + length
            assert end <= 40


def test_katz(spark, clashing, rows, empty):
    expected, sums = plain.katz(rows)
    assert all(abs(s - 1) < 1e-9 for s in sums)
    found = got(katz.score(clashing, cutoff=1))
    assert found.keys() == expected.keys()
    for k, v in expected.items():
        assert found[k][:4] == v[:4] and found[k][4:] == pytest.approx(v[4:], abs=1e-6)
    assert katz.score(empty).count() == 0
    untrained = katz.score(spark.createDataFrame([(6, "a b")], "doc_id long, text string")).first()
    assert untrained.held_out == (zlib.crc32(b"6") % 5 == 1)


def test_licenses(spark, empty):
    from pyspark.sql import functions as F

    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/c.py", "code\nmore code here"), (3, "a/b/d.py", "x = 1\ny = x + 2 * x\nprint(x, y, x + y, x * y)\n# Licensed under the Apache License, Version 2.0"), (4, "a/b/e/LICENSE", "Licensed under CC BY-NC 4.0"), (5, "a/b/e/f/g.txt", "text"), (6, "z.txt", None), (7, None, ""), (8, "z.txt", "the license"), (2, "a/b/c.py", "code\nmore code here")]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    found = sorted((r.doc_id, r.own_license, r.license, r.license_from) for r in licenses.report(df, F.col("path")).collect())
    assert found == [(1, "MIT", "MIT", "a/LICENSE"), (2, None, "MIT", "a"), (2, None, "MIT", "a"), (3, "Apache-2.0", "Apache-2.0", "a/b/d.py"), (4, "CC-BY-NC-4.0", "CC-BY-NC-4.0", "a/b/e/LICENSE"), (5, None, "CC-BY-NC-4.0", "a/b/e"), (6, None, None, None), (7, None, None, None), (8, None, None, None)]
    assert licenses.report(empty, F.col("source")).count() == 0


def test_quotations(spark):
    rows = [
        (1, 0, "user", "How are you today?\nI wonder."), (1, 1, "assistant", "On Monday A wrote:\n> How are you today?\n> I wonder.\nFine, thanks."),
        (1, 2, "user", "> > How are you  TODAY?\n> Fine, thanks.\nGood."), (1, 3, "user", "No quote"), (1, 4, "user", "> never said\nWhat?"),
        (2, 0, "user", "How are you today?\nI wonder."), (2, 5, "user", None), (2, 5, "assistant", "> How are you today?\nyes"), (None, None, None, "> No quote"), (3, 0, "user", "> "),
    ]
    found = {(r.conv_id, r.reply_pos): (r.turn, r.parent_turn, r.link, r.n_quoted, r.n_linked, r.content) for r in quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert found == {
        (1, 0): (0, None, "first", 0, 0, "How are you today?\nI wonder."), (1, 1): (1, 0, "quote", 1, 1, "Fine, thanks."), (1, 2): (2, 1, "quote", 2, 2, "Good."),
        (1, 3): (3, 2, "previous", 0, 0, "No quote"), (1, 4): (4, 3, "previous", 1, 0, "What?"), (2, 0): (0, None, "first", 0, 0, "How are you today?\nI wonder."),
        (2, 1): (5, 0, "quote", 1, 1, "yes"), (2, 2): (5, 5, "previous", 0, 0, ""), (None, 0): (None, None, "first", 1, 0, ""), (3, 0): (0, None, "first", 0, 0, ""),
    }


def test_long_conversations_and_components(spark, monkeypatch):
    monkeypatch.setattr(quotations, "CHUNK", 8)
    rows = [(1, 3 * k, "user", f"message {k}") for k in range(50)]
    found = sorted((r.reply_pos, r.turn, r.parent_turn) for r in quotations.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    assert found == [(k, 3 * k, 3 * k - 3 if k else None) for k in range(50)]
    edges = [(k, k + 1) for k in range(0, 40) if k % 10 != 9] + [(100, 100), (5, 25)]
    c = got(common.components(spark.createDataFrame(edges, "a long, b long"), "a", "b"), "node")
    assert c[39] == (30,) and c[29] == (0,) and c[9] == (0,) and 100 not in c
    many = spark.createDataFrame([(1, k) for k in range(100)] + [(2, 0)], "k long, v long")
    one = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k long, x string")
    assert common.salted_join(many, one, "k", rows_per_salt=7).count() == 101
