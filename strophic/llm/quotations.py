"""Chat formatting by quotation linking: quoting messages are joined to the messages that they quote.

A line's quote level is the number of ``>`` before its content. Consecutive lines of one level make a passage. Passages and
messages' own lines and whole texts are normalised (lower case, white space runs as one space) and hashed; a passage is linked to the
earliest earlier message of its conversation that has it as its whole own text or, failing that, has its first line. A message answers
the original of its first linked passage of the lowest level, else the message before it. Quotes and the lines that
introduce them ("... wrote:") are taken out. Links only go back, so the order of turns puts every message after its parent.

Long conversations are dealt to chunks of turns; positions and previous messages come from chunk counts, so no task holds
a whole conversation.

Defined cases: null text is an empty message; rows with equal (conversation, turn) are ordered by role and text; a null
conversation is one conversation, a null turn comes last; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, null_as_empty

CHUNK = 1024
_LEVEL = r"^(?:\s*>)+\s?"
_INTRODUCES = r"(?i)^.{0,200}\b(?:wrote|writes|said)\s*:\s*$"


def _normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def _key(conversation: Column, normal: Column) -> Column:
    return F.md5(F.concat_ws("\x01", conversation, normal))


def parse(messages: DataFrame) -> DataFrame:
    """Adds ``own`` (text without quotes) and ``passages`` (level, whole normalised text, first normalised line) to ``text``."""
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct(F.length(F.regexp_replace(F.regexp_extract(x, _LEVEL, 0), r"[^>]", "")).alias("level"), F.regexp_replace(x, _LEVEL, "").alias("line")))
    out = messages.withColumn("lines", lines)
    level = lambda k: F.when((k >= 1) & (k <= F.size("lines")), F.element_at("lines", F.greatest(k, F.lit(1)))["level"]).otherwise(0)
    own = F.filter("lines", lambda x, i: (x["level"] == 0) & ~(F.regexp_like(x["line"], F.lit(_INTRODUCES)) & (level(i + 2) > 0)))
    out = out.withColumn("own", F.trim(F.array_join(F.transform(own, lambda x: x["line"]), "\n")))
    begins = F.filter(F.transform("lines", lambda x, i: F.when((x["level"] > 0) & (x["level"] != level(i)), i + 1)), lambda i: i.isNotNull())
    ends = F.filter(F.transform("lines", lambda x, i: F.when((x["level"] > 0) & (x["level"] != level(i + 2)), i + 1)), lambda i: i.isNotNull())
    text = lambda a, b: _normal(F.array_join(F.transform(F.slice("lines", a, b - a + 1), lambda x: x["line"]), " "))
    passages = F.zip_with("begins", "ends", lambda a, b: F.struct(F.element_at("lines", a)["level"].alias("level"), a.alias("place"), text(a, b).alias("whole"), _normal(F.element_at("lines", a)["line"]).alias("first")))
    out = out.withColumn("begins", begins).withColumn("ends", ends).withColumn("passages", F.filter(passages, lambda p: p["whole"] != ""))
    return out.drop("lines", "begins", "ends")


def positions(messages: DataFrame) -> DataFrame:
    """Adds ``pos`` (0, 1, ... in a conversation) and ``before`` (turn of the message before)."""
    chunked = messages.withColumn("chunk", F.floor(F.col("order") / CHUNK))
    sums = chunked.groupBy("conversation", "chunk").agg(F.count(F.lit(1)).alias("n"), F.max("order").alias("last"))
    w = Window.partitionBy("conversation").orderBy("chunk")  # one row per CHUNK turns
    sums = sums.select("conversation", "chunk", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"), F.lag("last").over(w).alias("last_before"))
    inner = Window.partitionBy("conversation", "chunk").orderBy("order", "role", "text")
    placed = chunked.withColumn("local", F.row_number().over(inner)).withColumn("lagged", F.lag("order").over(inner))
    return placed.join(sums, ["conversation", "chunk"]).withColumn("pos", (F.col("base") + F.col("local") - 1).cast("long")).withColumn("before", F.coalesce("lagged", "last_before")).drop("chunk", "base", "local", "lagged", "last_before")


def link(messages: DataFrame) -> DataFrame:
    """One row per message (``conv_id``, ``turn``, ``role``, ``text``), with its place, its parent and its text without quotes."""
    last = (1 << 62) - 1
    rows = messages.select("conv_id", "turn", "role", null_as_empty("text").alias("text")).withColumn("conversation", F.coalesce(F.col("conv_id").cast("string"), F.lit("\x02"))).withColumn("order", F.coalesce(F.col("turn").cast("long"), F.lit(last)))
    rows = materialise(positions(parse(rows)), "messages")
    lines = F.filter(F.transform(F.split("own", "\n"), _normal), lambda x: x != "")
    whole = _normal(F.col("own"))
    # kind 0: whole text; 1: a line of it
    keys = F.array_union(F.when(whole != "", F.array(F.struct(F.lit(0).alias("kind"), whole.alias("t")))).otherwise(F.array().cast("array<struct<kind:int,t:string>>")), F.transform(lines, lambda x: F.struct(F.lit(1).alias("kind"), x.alias("t"))))
    originals = rows.select("conversation", "pos", "order", F.explode(keys).alias("k")).select(_key(F.col("conversation"), F.col("k.t")).alias("key"), F.col("k.kind").alias("kind"), "pos", "order")
    originals = originals.groupBy("key", "kind").agg(F.min(F.struct("pos", "order")).alias("at"))
    quoting = rows.select("conversation", "pos", F.explode("passages").alias("p"))
    asked = quoting.select("conversation", "pos", "p.level", "p.place", F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("p.whole").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("p.whole").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("p.first").alias("t")))).alias("k"))
    asked = asked.select("conversation", "pos", "level", "place", F.col("k.kind").alias("kind"), _key(F.col("conversation"), F.col("k.t")).alias("key"))
    found = asked.join(originals, ["key", "kind"]).filter(F.col("at.pos") < F.col("pos"))
    linked = found.groupBy("conversation", "pos").agg(F.min(F.struct("level", "place", "kind", F.col("at.order").alias("order"))).alias("best"), F.count_distinct("place").alias("n_linked"))
    out = rows.join(linked, ["conversation", "pos"], "left")
    null_last = lambda c: F.when(c < last, c)
    return out.select(
        "conv_id", "turn", "role", F.col("pos").alias("reply_pos"), null_last(F.coalesce("best.order", "before")).alias("parent_turn"),
        F.when(F.col("best").isNotNull(), "quote").when(F.col("before").isNotNull(), "previous").otherwise("first").alias("link"),
        F.size("passages").cast("long").alias("n_quoted"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("own").alias("content"),
    )


def conversations(messages: DataFrame) -> DataFrame:
    """Chat rows: one per conversation, its messages in reply order without quotes. For conversations that fit in a row."""
    own = F.sort_array(F.collect_list(F.struct("reply_pos", "role", F.col("content").alias("content"), "parent_turn")))
    return link(messages).groupBy("conv_id").agg(own.alias("messages"))
