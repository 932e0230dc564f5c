"""Canonical exact digests, with DataFrame and SQL functions only.

A text is normalised (NFKC, full case folding, NFKC again), runs of white space become one space and outer white
space goes. The fingerprint is 128 bits of xxHash64 under two seeds, as 32 hex digits. Documents with equal
fingerprints form a bucket; inside a bucket the canonical bytes are compared, so that a group has equal bytes.

Being exact, the likeness of two fingerprints is 1.0 if they are equal and 0.0 if not.

Defined cases: null text is an empty text; equal texts have equal fingerprints and one group; repeated ids are ordered
by text and each row gets its own result; a null id comes after all others in descending order; one document is its
own next document; an empty table gives no rows. Other columns are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, null_as_empty, salted_join

#: Rows in a range of ids that one window orders, and at most so many ranges (their bounds are broadcast).
ROWS_PER_RANGE, RANGES = 1000, 65536
_KNOTS = 64
_SEEDS = (0, 1)


def canonical(text: Column) -> Column:
    """NFKC, case folding and white-space folding, by the JVM's ICU library."""
    nfkc = lambda c: F.java_method(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.java_method(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    return F.lower(F.concat(*(F.lpad(F.hex(F.xxhash64(F.lit(s), canon)), 16, "0") for s in _SEEDS)))


def _ranges(docs: DataFrame) -> tuple[Column, int]:
    """The range that an id lies in; ranges ascend with ids and hold about as many rows each."""
    n, knots = docs.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", [k / _KNOTS for k in range(_KNOTS + 1)], 10000)).first()
    count = max(1, min(RANGES, -(-n // ROWS_PER_RANGE)))
    knots = sorted(set(knots or ()))
    if count == 1 or len(knots) < 2:
        return F.lit(0).cast("long"), 1
    per = -(-count // (len(knots) - 1))
    points = F.array(*(F.lit(k).cast("long") for k in knots))
    k = F.least(F.greatest(F.size(F.filter(points, lambda x: x <= F.col("doc_id"))), F.lit(1)), F.lit(len(knots) - 1))
    low, high = F.element_at(points, k), F.element_at(points, k + 1)
    inside = F.least(F.greatest(F.floor((F.col("doc_id") - low).cast("double") * per / (high - low)), F.lit(0)), F.lit(per - 1))
    return F.coalesce((k - 1) * per + inside, F.lit(0)).cast("long"), per * (len(knots) - 1)


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Each row with its next row's columns (``next_*``) in descending order of ``doc_id``; the last row's next is the first.

    Ids are dealt to ranges. The first row of a range is also sent, as a guest, to the range before it in this order,
    so one exchange is enough and no task sees more than a range.
    """
    where, _ = _ranges(docs)
    ranged = docs.withColumn("range", where)
    heads = ranged.groupBy("range").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy(F.col("range").desc())  # at most RANGES rows
    around = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = heads.select("range", "head", F.coalesce(F.lag("range").over(order), F.last("range").over(around)).alias("host"))
    both = ranged.join(F.broadcast(heads), "range").withColumn(
        "to", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("head")), F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("guest")), F.struct(F.col("host").alias("r"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("guest")))))
    )
    both = both.select("doc_id", *carried, F.col("to.r").alias("range"), F.col("to.guest").alias("guest"))
    seen = Window.partitionBy("range").orderBy("guest", F.col("doc_id").desc(), F.col(carried[0]).desc())
    return both.select("doc_id", *carried, "guest", *(F.lead(c).over(seen).alias("next_" + c) for c in carried)).filter("guest = 0").drop("guest")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(``doc_id``, ``text``, ``fingerprint``) of whole texts."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), null_as_empty(text).alias("text"))
    return rows.withColumn("fingerprint", digest(canonical(F.col("text"))))


def groups(prints: DataFrame, docs: DataFrame) -> DataFrame:
    """(``doc_id``, ``fingerprint``, ``group_id``) of rows whose fingerprint another row has too.

    ``prints`` has (``doc_id``, ``fingerprint``); ``docs`` has the texts. ``group_id`` is the smallest id with the same canonical
    bytes. Rows are compared with their bucket's smallest row; rows that differ from it (a collision of 128 bits) are
    grouped among themselves by their whole bytes.
    """
    buckets = prints.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).filter("n > 1").drop("n")
    members = prints.join(buckets, "fingerprint").select("doc_id", "fingerprint", "first").distinct()
    held = docs.select("doc_id", null_as_empty("text").alias("text")).join(members, "doc_id")
    held = held.select("doc_id", "fingerprint", "first", canonical(F.col("text")).alias("canon"))
    held = materialise(held.filter(digest(F.col("canon")) == F.col("fingerprint")), "buckets")
    firsts = held.filter("doc_id = first").groupBy("fingerprint").agg(F.first("canon").alias("first_canon"))
    compared = materialise(salted_join(held, firsts, "fingerprint").select("doc_id", "fingerprint", "first", (F.col("canon") == F.col("first_canon")).alias("same"), F.when(F.col("canon") != F.col("first_canon"), F.col("canon")).alias("canon")), "compared")
    rest = compared.filter("NOT same")
    others = rest.groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"))
    return compared.filter("same").select("doc_id", "fingerprint", F.col("first").alias("group_id")).unionByName(
        rest.join(others, ["fingerprint", "canon"]).select("doc_id", "fingerprint", "group_id")
    )


def report(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of whole texts and of edited texts, likenesses, and groups of equal canonical bytes."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = with_next(fingerprints(docs), ["text", "fingerprint"])
    half = F.floor(F.length("text") / 2).cast("int")
    own = own.withColumn("edited", F.concat(F.expr("left(text, cast(length(text) - floor(length(text) / 2) as int))"), F.expr("left(next_text, cast(floor(length(text) / 2) as int))")))
    own = own.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint",
        F.when(half == 0, F.col("fingerprint")).otherwise(digest(canonical(F.col("edited")))).alias("edited_fingerprint"), "next_fingerprint",
    )
    like = lambda other: F.when(F.col("fingerprint") == F.col(other), 1.0).otherwise(0.0)
    own = materialise(own.withColumns({"near_edited": like("edited_fingerprint"), "near_next": like("next_fingerprint")}).drop("next_fingerprint"), "fingerprints")
    equal = groups(own.select("doc_id", "fingerprint"), docs).distinct()
    return own.join(equal, ["doc_id", "fingerprint"], "left").select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", F.coalesce("group_id", "doc_id").alias("group_id")
    )
