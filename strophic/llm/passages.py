"""Substring dedup by repeated-phrase automata.

A window is ``WINDOW`` consecutive words. A word goes if a window that covers it also starts in a document with a
smaller id; all windows are judged on the input.

1. *Anchors.* Every window has an anchor, the smallest-hashed run of ``ANCHOR`` words in it. Equal windows have equal
   anchors, so only anchors that occur under two ids matter. Consecutive windows with one anchor are a segment: about one
   row per five windows travels, and minima are taken before the shuffle, so a hot passage is one row a task.
2. *Confirmation.* Segments are compared by a second hash. If a segment occurs whole in the first document of its
   anchor, that document is the first of all its windows. Otherwise the segments' windows are compared one by one, once
   per different segment and not once per copy.
3. *Passages.* Claims "these words of d start at that word of an earlier document" are joined into passages, whose
   text is read from the earlier document.
4. *Automata.* Passages are dealt to the slabs of documents that may hold them. For each slab an Aho-Corasick automaton (``SHARD``
   characters of passages) is compiled, and every document of the slab, with or without a claim, is streamed through it. What an automaton
   locates in a document after the passage's source is what is removed: places come from it alone, and no hash decides.

Every document through every automaton would cost documents times passages, which no cluster can pay at 100 TB; dealing passages to
slabs keeps the work in proportion to the text, and a document never misses one of its passages.

Defined cases: null or empty text has no words; a document with fewer than ``WINDOW`` words loses nothing; rows with
the same id count as one document and each gets its own result; a row without an id loses nothing and is no
source; an empty table gives no rows. Other columns are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import OWN, drop_table, materialise, null_as_empty, salted_join
from .runs import whole_runs
from .words import SPACED, Words, release_memory, rolling, run_hashes, slices

WINDOW = 13
ANCHOR = 5
#: Characters of passages in one automaton.
SHARD = 1 << 20
#: Words of a passage in one pattern; longer ones are cut with an overlap of a window less one word.
PATTERN = 512
#: Bytes of documents that are streamed through one automaton.
SLAB = 4 << 20
#: Words of a source whose passages are read at once.
PER_ROW = 4096
#: Documents of one passage that a task takes before the passage is split.
PER_SALT = 1000
_NO = np.empty(0, np.int64)


def segments(h: np.ndarray, off: np.ndarray, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Segments of all documents: anchor hash, hash of the words, document, first word, number of windows.

    ``h``: hashes of the words; ``off``: first word of each document.
    """
    n_windows = np.maximum(np.diff(off) - window + 1, 0)
    total = int(n_windows.sum())
    if not total:
        return _NO, _NO, _NO, _NO, _NO
    doc = np.repeat(np.arange(len(n_windows)), n_windows)
    starts = np.arange(total) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows) + off[doc]
    runs = rolling(h, anchor)
    best, at = runs[starts], starts.copy()
    for j in range(1, window - anchor + 1):
        other = runs[starts + j]
        less = other < best
        best[less] = other[less]
        at[less] = starts[less] + j
    new = np.ones(total, bool)
    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    number = np.diff(np.append(first, total))
    a, b = starts[first], starts[first] + number + window - 1
    whole = run_hashes(h, a, b - a)
    return best[first].view(np.int64), whole.view(np.int64), doc[first], a - off[doc[first]], number


def _emit_segments(with_place: bool, window: int, anchor: int):
    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column("id"))
            for i, j, data, off in slices(batch.column("text")):
                words = Words(data, off, SPACED)
                key, whole, doc, first, number = segments(words.hashes(), words.off, window, anchor)
                columns = [pa.array(key), pa.array(ids[i:j][doc]) if len(doc) else pa.array(_NO)]
                names = ["anchor", "id"]
                if with_place:
                    columns += [pa.array(whole), pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32))]
                    names += ["whole", "first", "number"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        release_memory()

    return run


def _window_rows(window: int):
    """Windows of the segments of some documents: (segment's anchor and hash, place in it, window's hash, id)."""

    def run(batches):
        for batch in batches:
            ids, lists = np.asarray(batch.column("id")), batch.column("segments")
            bound, wanted = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]), lists.flatten()
            key, whole, first, number = (np.asarray(wanted.field(c)) for c in ("anchor", "whole", "first", "number"))
            for i, j, data, off in slices(batch.column("text")):
                words = Words(data, off, SPACED)
                g = rolling(words.hashes(), window).view(np.int64)
                own, size = slice(bound[i], bound[j]), number[bound[i] : bound[j]].astype(np.int64)
                doc = np.repeat(np.arange(j - i), np.diff(bound[i : j + 1]))
                place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                at = np.repeat(words.off[doc] + first[own], size) + place
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(key[own], size)), pa.array(np.repeat(whole[own], size)), pa.array(place.astype(np.int32)), pa.array(g[at]), pa.array(np.repeat(ids[i:j][doc], size)), pa.array((np.repeat(first[own], size) + place).astype(np.int32))],
                    names=["anchor", "whole", "place", "window", "id", "first"],
                )
        release_memory()

    return run


def claims(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> tuple[DataFrame, list[DataFrame]]:
    """(``id``, ``first``, ``number``, ``src``, ``src_first``): windows of a document that start in an earlier one.

    ``docs`` has (``id``, ``text``) without null ids. ``src`` is the first document that has the windows. The second result
    is the tables that can be dropped when the first has been read.
    """
    seen = docs.mapInArrow(_emit_segments(False, window, anchor), "anchor long, id long")
    again = materialise(seen.groupBy("anchor").agg(F.min("id").alias("src"), F.max("id").alias("last")).filter("src < last").select("anchor", "src"), "anchors")
    placed = docs.mapInArrow(_emit_segments(True, window, anchor), "anchor long, id long, whole long, first int, number int")
    found = materialise(placed.join(again, "anchor"), "segments")
    drop_table(again)
    variants = found.groupBy("anchor", "whole").agg(F.min(F.struct("id", "first", "number")).alias("at"), F.min("src").alias("src"))
    variants = materialise(variants.select("anchor", "whole", F.col("at.id").alias("from_id"), F.col("at.first").alias("from_first"), F.col("at.number").alias("number"), "src"), "variants")
    # segments that the first document of their anchor doesn't have; its own segments take part in the comparison
    mixed = variants.filter("from_id > src").select("anchor").distinct()
    apart = variants.join(mixed, "anchor", "left_semi")
    wanted = apart.groupBy(F.col("from_id").alias("id")).agg(F.collect_list(F.struct("anchor", "whole", F.col("from_first").alias("first"), "number")).alias("segments"))
    rows = materialise(docs.join(wanted, "id").mapInArrow(_window_rows(window), "anchor long, whole long, place int, window long, id long, first int"), "windows")
    firsts = rows.groupBy("anchor", "window").agg(F.min(F.struct("id", "first")).alias("from"))
    single = rows.join(firsts, ["anchor", "window"]).select("anchor", "whole", "place", F.col("from.id").alias("from_id"), F.col("from.first").alias("from_first"))
    known = variants.filter("from_id = src").select("anchor", "whole", F.lit(0).alias("place"), "number", "from_id", "from_first")
    known = known.unionByName(single.join(variants.filter("from_id > src").select("anchor", "whole"), ["anchor", "whole"], "left_semi").withColumn("number", F.lit(1)))
    out = found.select("anchor", "whole", "id", "first").join(known, ["anchor", "whole"]).filter("from_id < id").select(
        "id", (F.col("first") + F.col("place")).alias("first"), "number", F.col("from_id").alias("src"), F.col("from_first").alias("src_first")
    )
    return out, [found, variants, rows]


def _merge(batches):
    """Claims, sorted by document, source, shift and place, whose words run on in the same source become passages, cut to patterns.

    A document gets each passage once, however often its words recur there: the automaton finds all places.
    """
    step = PATTERN - WINDOW + 1
    for batch in whole_runs(batches, ("id",)):
        doc, src, shift, first, number = (np.asarray(batch.column(c)).astype(np.int64) for c in ("id", "src", "shift", "first", "number"))
        other = np.ones(len(doc), bool)  # another document, source or shift
        other[1:] = (doc[1:] != doc[:-1]) | (src[1:] != src[:-1]) | (shift[1:] != shift[:-1])
        group = np.cumsum(other)
        reached = np.maximum.accumulate((group << 32) + first + number) - (group << 32)
        new = other.copy()
        new[1:] |= first[1:] > reached[:-1]
        at = np.flatnonzero(new)
        a, end = first[at], reached[np.append(at[1:], len(doc)) - 1] + WINDOW - 1
        pieces = np.maximum(1, -(-(end - WINDOW + 1 - a) // step))
        place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        x = np.repeat(a, pieces) + place * step
        size = np.minimum(PATTERN, np.repeat(end, pieces) - x)
        own = at.repeat(pieces)
        rows = np.stack([doc[own], src[own], x + shift[own], size])
        rows = rows[:, np.lexsort(rows[::-1])]
        once = np.ones(rows.shape[1], bool)
        once[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
        doc, src, first, size = rows[:, once]
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(src), pa.array(first.astype(np.int32)), pa.array(size.astype(np.int32))], names=["id", "src", "src_first", "words"])
    release_memory()


def _read_patterns(batches):
    for batch in batches:
        src, lists, texts = np.asarray(batch.column("id")), batch.column("patterns"), batch.column("text")
        size, wanted = lists.value_lengths().to_numpy(), lists.flatten()
        first, words = (np.asarray(wanted.field(c)) for c in ("src_first", "words"))
        out, at = [], 0
        for k, n in enumerate(size.tolist()):
            own = texts[k].as_py().encode().split()
            out += [b" ".join(own[a : a + w]).decode() for a, w in zip(first[at : at + n].tolist(), words[at : at + n].tolist())]
            at += n
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(src, size)), pa.array(first), pa.array(words), pa.array(out, pa.string())], names=["src", "src_first", "words", "pattern"])
    release_memory()


def compiled(patterns: list[str], sources: list[int]):
    """An automaton of passages; a hit tells the passage's length and its first source. None without passages."""
    import ahocorasick

    first: dict[str, int] = {}
    for p, src in zip(patterns, sources):
        if src < first.get(p, src + 1):
            first[p] = src
    if not first:
        return None
    automaton = ahocorasick.Automaton()
    for p, src in first.items():
        automaton.add_word(f" {p} ", (len(p), src))
    automaton.make_automaton()
    return automaton


def located(automaton, doc: int | None, raw: bytes) -> tuple[list[bytes], np.ndarray]:
    """The words of a document and whether each lies in a passage of the automaton that an earlier document has."""
    words = raw.split()
    gone = np.zeros(len(words), bool)
    if automaton is None or doc is None or len(words) < WINDOW:
        return words, gone
    text = " " + b" ".join(words).decode() + " "
    spans = [(end - size, end) for end, (size, src) in automaton.iter(text) if src < doc]
    if spans:
        edge, blanks = np.zeros(len(words) + 1, np.int64), np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
        # a span runs from the character after a blank to the blank at its end
        a, b = np.array(spans).T
        np.add.at(edge, np.searchsorted(blanks, a) - 1, 1)
        np.add.at(edge, np.searchsorted(blanks, b), -1)
        gone = np.cumsum(edge[:-1]) > 0
    return words, gone


def _remove(text: str, schema_names: list[str]):
    """Adds the number of words, the number removed, and the text without them."""

    def run(batches):
        for batch in batches:
            texts, lists, ids = batch.column(text), batch.column(OWN + "patterns"), batch.column(OWN + "doc").to_pylist()
            bound, told = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())]), lists.flatten()
            source, pattern = told.field("src"), told.field("pattern")
            chars = np.concatenate([[0], np.cumsum(pc.binary_length(pattern).to_numpy(zero_copy_only=False))])[bound]
            size = np.concatenate([[0], np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))])
            i = 0
            while i < batch.num_rows:
                j = min(int(np.searchsorted(chars, chars[i] + SHARD, "right")), int(np.searchsorted(size, size[i] + SLAB, "right"))) - 1
                j = max(j, i + 1)
                own = slice(int(bound[i]), int(bound[j]))
                automaton = compiled(pattern[own].to_pylist(), source[own].to_pylist())
                n, gone, kept = [], [], []
                for k in range(i, j):
                    words, out = located(automaton, ids[k], (texts[k].as_py() or "").encode())
                    n.append(len(words))
                    gone.append(int(out.sum()))
                    kept.append(b" ".join(w for w, g in zip(words, out.tolist()) if not g).decode() if gone[-1] else b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in schema_names), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*schema_names, OWN + "n_words", OWN + "n_removed", OWN + "kept"])
                i = j
        release_memory()

    return run


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with their number of words, the number removed, and the remaining words joined by spaces (own names)."""
    plain = docs.select(F.col(doc_id).cast("long").alias("id"), null_as_empty(text).alias("text")).filter("id IS NOT NULL")
    claimed, used = claims(plain)
    claimed = claimed.withColumn("shift", F.col("src_first") - F.col("first")).select("id", "src", "shift", "first", "number")
    ordered = claimed.repartition("id").sortWithinPartitions("id", "src", "shift", "first")
    passages = materialise(ordered.mapInArrow(_merge, "id long, src long, src_first int, words int"), "passages")
    for t in used:
        drop_table(t)
    # a source that very many documents quote has its passages dealt to rows by their place
    near = (F.col("src_first") / PER_ROW).cast("int").alias("near")
    asked = passages.select("src", "src_first", "words").distinct().groupBy(F.col("src").alias("id"), near).agg(F.collect_list(F.struct("src_first", "words")).alias("patterns"))
    texts = plain.join(asked, "id").mapInArrow(_read_patterns, "src long, src_first int, words int, pattern string")
    texts = materialise(texts.distinct().withColumn("key", F.struct("src", "src_first", "words")).select("key", "pattern"), "patterns")
    told = salted_join(passages.select("id", F.struct("src", "src_first", "words").alias("key")), texts, "key", rows_per_salt=PER_SALT)
    mine = materialise(told.groupBy(F.col("id").alias(OWN + "id")).agg(F.collect_set(F.struct("key.src", "pattern")).alias(OWN + "patterns")), "told")
    drop_table(passages)
    drop_table(texts)
    joined = docs.withColumn(OWN + "doc", F.col(doc_id).cast("long")).join(mine, F.col(OWN + "doc") == F.col(OWN + "id"), "left").select(*docs.columns, OWN + "doc", OWN + "patterns")
    added = StructType.fromDDL(f"{OWN}n_words long, {OWN}n_removed long, {OWN}kept string")
    return joined.mapInArrow(_remove(text, docs.columns), StructType([*docs.schema.fields, *added.fields]))


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The documents with repeated passages taken out of ``text``. Unchanged texts stay byte for byte; of the others the
    remaining words are joined by spaces, and a column ``n_chars`` is counted anew."""
    marked = scan(docs, doc_id, text)
    new = F.when(F.col(OWN + "n_removed") > 0, F.col(OWN + "kept")).otherwise(F.col(text))
    out = {text: new}
    if n_chars in docs.columns:
        out[n_chars] = F.when(F.col(OWN + "n_removed") > 0, F.length(OWN + "kept")).otherwise(F.col(n_chars)).cast(docs.schema[n_chars].dataType)
    return marked.withColumns(out).select(*docs.columns)


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: words, words removed, and the digest of the remaining words joined by one space."""
    marked = scan(docs.select(doc_id, text), doc_id, text)
    return marked.select(doc_id, F.col(OWN + "n_words").alias("n_words"), F.col(OWN + "n_removed").alias("n_removed"), F.sha2(F.col(OWN + "kept"), 256).alias("kept_sha256"))


__all__ = ["claims", "dedup", "report", "scan"]
