"""Catalog text search: normalised titles, tokens, prefix matching, BM25 and fallbacks, one row per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WORDS = r"[\p{L}\p{N}]+"
#: Words that say how a work is arranged.
ARRANGEMENTS = r"\b(?:piano (?:solo|duet|trio|quartet|quintet)|melody|violin|viola|cello|contrabass|duet|trio|quartet|string orchestra)\b"


def normalise_title(title: Column, arrangements: bool = True, suffixes: bool = True) -> Column:
    """Lower case, without file suffixes, bracketed parts and (optionally) arrangement words; single spaces."""
    t = F.lower(title)
    if suffixes:
        t = F.regexp_replace(t, r"\.(?:musicxml|mxl|xml|mid)$", "")
    t = F.regexp_replace(t, r"\([^)]*\)|\[[^\]]*\]", " ")
    if arrangements:
        t = F.regexp_replace(t, ARRANGEMENTS, " ")
    return F.trim(F.regexp_replace(t, r"[^\p{L}\p{N}]+", " "))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_WORDS), F.lit(0))


def _begins(term: str):
    return lambda word: F.startswith(word, F.lit(term))


def title_matches(title_words: Column, terms: list[str]) -> Column:
    """Every term begins a word; a term of one character is a whole word."""
    out = F.lit(True)
    for t in terms:
        out = out & (F.array_contains(title_words, t) if len(t) == 1 else F.exists(title_words, _begins(t)))
    return out


def term_table(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(``term``, key, ``tf``, ``length``): an inverted index; partition it by a hash of the term."""
    w = rows.select(key, words(F.col(text)).alias("words"))
    each = w.select(key, F.size("words").alias("length"), F.explode("words").alias("term"))
    return each.groupBy("term", key, "length").agg(F.count(F.lit(1)).alias("tf"))


def bm25(index: DataFrame, key: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Scores of rows for some terms (a term of two characters or more is a prefix)."""
    per = index.select(key, "length").distinct().agg(F.count(F.lit(1)).alias("rows"), F.avg("length").alias("mean"))
    hit = F.lit(False)
    name = F.lit(None).cast("string")
    for t in terms:
        own = (F.col("term") == t) if len(t) == 1 else F.startswith("term", F.lit(t))
        hit, name = hit | own, F.when(own, t).otherwise(name)
    found = index.filter(hit).withColumn("q", name).groupBy("q", key, "length").agg(F.sum("tf").alias("tf"))
    df = found.groupBy("q").agg(F.count(F.lit(1)).alias("df"))
    x = found.join(F.broadcast(df), "q").crossJoin(F.broadcast(per))  # a row per query term; one row
    idf = F.log((F.col("rows") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return x.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("terms"))


def escape_like(term: str) -> str:
    return "".join("\\" + c if c in "\\%_" else c for c in term)


def search(rows: DataFrame, key: str, title: str, haystack: str, query: str, source: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """Rows whose title has all terms as prefixes, else whose title contains the text, else anything that contains it; one per source."""
    import re

    terms = [t for t in re.findall(r"[^\W_]+", query.lower()) if t]
    text = F.lit(query.lower())
    rank = F.when(title_matches(words(F.col(title)), terms), 0).when(F.contains(F.lower(title), text), 1).when(F.contains(F.lower(haystack), text), 2)
    found = rows.withColumn("rank", rank).filter("rank IS NOT NULL")
    best = Window.partitionBy(source).orderBy("rank", title, key)
    one = found.withColumn("n", F.row_number().over(best)).filter("n = 1")
    return one.orderBy("rank", title, key).offset(offset).limit(limit).select(key, title, source, "rank")


def first_line_by(composer: Column) -> Column:
    """The line that begins with "composed by", without these words, else the first line."""
    lines = F.transform(F.split(composer, "\n"), F.trim)
    by = F.filter(lines, lambda x: F.lower(x).like("composed by%"))
    return F.when(F.size(by) > 0, F.trim(F.substring(F.element_at(by, 1), 12, 1000))).otherwise(F.element_at(lines, 1))


def translate(names: Column, dictionary: dict[str, str]) -> Column:
    table = F.create_map(*(F.lit(x) for kv in dictionary.items() for x in kv))
    return F.coalesce(F.element_at(table, names), names)


def token_recall(wanted: Column, found: Column) -> Column:
    """Share of distinct wanted words that were found, in percent."""
    w = F.array_distinct(wanted)
    return F.when(F.size(w) == 0, 0.0).otherwise(100.0 * F.size(F.array_intersect(w, found)) / F.size(w))
