"""n-gram tokens of streams: an inverted index of (token, stream, position).

Kinds: ``i`` and ``i5`` (3 and 5 intervals), ``c`` (3 contours), ``r`` (3 rhythm ratios in whole eighths of the base). ``seq`` keeps the order
in which postings were written, so that capped reads are the same everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strophic.functions.sequence import features
from strophic.sources.adapters import stream_order

#: Kind, column, number of values.
KINDS = [("i", "interval", 3), ("c", "c3", 3), ("r", "r8", 3), ("i5", "interval", 5)]


def ngrams(rows: DataFrame, column: str, n: int, keys: tuple[str, ...] = ("sid",)) -> Column:
    """The ``n`` values from each row on as one string; null where fewer follow."""
    w = stream_order(*keys)
    values = [F.lead(column, k).over(w) for k in range(n)]
    full = values[-1].isNotNull()
    return F.when(full, F.concat_ws(",", *(v.cast("string") for v in values)))


def tokens(notes: DataFrame) -> DataFrame:
    """(``sid``, ``pos``, ``kind``, ``token``): all kinds from one pass over the sorted streams."""
    f = features(notes)
    wide = f.select("sid", "pos", *(ngrams(f, c, n).alias(k) for k, c, n in KINDS))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("values")) for k, _, _ in KINDS)))
    out = wide.select("sid", "pos", each.alias("t")).filter("t.values IS NOT NULL")
    return out.select("sid", "pos", F.col("t.kind").alias("kind"), F.concat_ws(":", "t.kind", "t.values").alias("token"))


def for_mode(query_tokens: DataFrame, mode: str) -> DataFrame:
    kept = {"rhythm": ["r"], "contour": ["c"]}.get(mode)
    return query_tokens.filter(F.col("kind").isin(kept)) if kept else query_tokens


def frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("token").agg(F.count(F.lit(1)).alias("total"))


def rarity(query_tokens: DataFrame, totals: DataFrame, n_notes: int, robust: bool = True) -> DataFrame:
    """Query tokens with their totals, rarity ranks and row limits.

    The first and last 3-interval tokens and the rarest one of each half may read more postings than others.
    """
    q = query_tokens.join(totals, "token", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    seen = q.filter("total > 0 AND kind IN ('i', 'i5')").withColumn("rank", F.row_number().over(Window.orderBy("total", "pos", "kind")) - 1)
    short = Window.partitionBy(F.lit(0))
    split = max(0, (n_notes - 4) / 2)
    i = seen.filter("kind = 'i'").withColumn("half", (F.col("pos") > split).cast("int"))
    i = i.withColumn("edge", (F.col("pos") == F.min("pos").over(short)) | (F.col("pos") == F.max("pos").over(short)))
    i = i.withColumn("rarest", F.row_number().over(Window.partitionBy("half").orderBy("total", "pos")) == 1)
    marks = seen.select("kind", "pos", "rank").join(i.select("kind", "pos", "edge", "rarest"), ["kind", "pos"], "left")
    out = q.join(marks, ["kind", "pos"], "left").withColumn("rank", F.when(F.col("edge"), -1).when(F.col("rarest"), 0).otherwise(F.col("rank")))
    return out.withColumn("cap", row_limit(F.col("kind"), F.col("total"), F.coalesce("rank", F.lit(99)), robust)).drop("edge", "rarest")


def row_limit(kind: Column, total: Column, rank: Column, robust: bool = True) -> Column:
    """How many postings of a token are read."""
    wide = F.when(rank < 0, 100000).when(rank < 2, 50000).otherwise(16000) if robust else F.when(rank < 2, 16000).otherwise(4000)
    cap = F.when(kind == "i5", F.when(rank < 2, 18000).otherwise(6000)).when(kind == "i", wide).otherwise(3000)
    return F.least(total, cap)


#: Tasks that share the postings of one token before its cap is applied to what they keep.
SALTS = 64


def capped_postings(postings: DataFrame, limits: DataFrame) -> DataFrame:
    """Postings of the query's tokens, the first ``cap`` of each in ingest order; the query side is a few rows.

    A hot token is cut in two steps, first within shares of the streams, so that one task sorts ``SALTS`` times its cap at most.
    """
    mine = postings.join(F.broadcast(limits.select("token", "cap", F.col("pos").alias("qpos"), "kind")), ["token", "kind"])
    order = lambda *more: Window.partitionBy("token", "qpos", *more).orderBy("sid", "pos")
    shares = mine.withColumn("salt", F.pmod(F.hash("sid"), F.lit(SALTS))).withColumn("seq", F.row_number().over(order("salt"))).filter("seq <= cap")
    return shares.drop("salt").withColumn("seq", F.row_number().over(order())).filter("seq <= cap")


def overlap(query: Column, candidate: Column) -> Column:
    """Share of the query's tokens that the candidate has."""
    return F.size(F.filter(query, lambda x: F.array_contains(candidate, x))) / F.greatest(F.size(query), F.lit(1))


def overlaps(queries: DataFrame, candidates: DataFrame, least: float) -> DataFrame:
    """Pairs of a query (``q``) and a candidate (``w``) whose ``overlap`` is at least ``least`` (above 0), with the ``share``.

    Both are sets of tokens. Pairs meet in an equality join of tokens, so that only those with a common token are made.
    """
    own = candidates.withColumn("row", F.monotonically_increasing_id())
    sought = queries.withColumns({"query": F.monotonically_increasing_id(), "size": F.size("q")})
    hits = own.select("row", F.explode("w").alias("token")).join(F.broadcast(sought.select("query", F.explode("q").alias("token"))), "token").groupBy("row", "query").agg(F.count(F.lit(1)).alias("hits"))
    near = hits.join(F.broadcast(sought.drop("q")), "query").withColumn("share", F.col("hits") / F.col("size")).filter(F.col("share") >= least)
    return near.join(own.drop("w"), "row").drop("row", "query", "hits", "size")
