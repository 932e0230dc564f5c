"""Reading, repairing and merging record tables; writing the index; guards as assertions over small counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """Good records and bad ones (with the raw line). Only a line feed ends a record."""
    bad = "__strophic_bad"
    lines = spark.read.option("lineSep", "\n").text(path)
    parsed = lines.select("value", F.from_json("value", f"{schema}, {bad} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
    return parsed.filter(F.col(f"r.{bad}").isNull()).select("r.*").drop(bad), parsed.filter(F.col(f"r.{bad}").isNotNull()).select(F.col("value").alias("line"))


def first_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """One row a key: the first in the given order."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def merge_first(sources: list[DataFrame], key: str, order: str) -> DataFrame:
    """Union of tables in order of precedence; later rows with a known key are dropped and counted as such by ``duplicates``."""
    out = None
    for k, s in enumerate(sources):
        own = s.withColumn("source_order", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return first_wins(out, key, "source_order", order)


def duplicates(sources: list[DataFrame], key: str) -> DataFrame:
    """How many rows of each source are dropped by ``merge_first``."""
    out = None
    for k, s in enumerate(sources):
        own = s.select(key, F.lit(k).alias("source_order"))
        out = own if out is None else out.unionByName(own)
    w = Window.partitionBy(key).orderBy("source_order")
    return out.withColumn("n", F.row_number().over(w)).groupBy("source_order").agg(F.count_if(F.col("n") > 1).alias("dropped"), F.count_if(F.col("n") == 1).alias("kept"))


def missing(extra: DataFrame, main: DataFrame, key: str) -> DataFrame:
    return extra.join(main.select(key), key, "left_anti")


def append_checked(main: DataFrame, batch: DataFrame, key: str, source: str) -> DataFrame:
    """Main with a batch that brings neither known keys nor known sources; raises otherwise."""
    for column in (key, source):
        clash = batch.select(column).distinct().join(main.select(column).distinct(), column, "left_semi").limit(1).count()
        if clash:
            raise ValueError(f"{column} is already there")
    return main.unionByName(batch)


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """New values where there are some, else the old ones."""
    new = changes.select(key, *(F.col(c).alias(f"__new_{c}") for c in columns))
    out = rows.join(new, key, "left")
    return out.withColumns({c: F.coalesce(f"__new_{c}", c) for c in columns}).drop(*(f"__new_{c}" for c in columns))


def unpadded(c: Column) -> Column:
    """A number without leading zeros, for joins that ignore padding."""
    return F.regexp_extract(c.cast("string"), "([0-9]+)", 1).try_cast("long")


def write_index(postings: DataFrame, path: str, buckets: int = 64) -> None:
    """Postings in files by a hash of their token, each sorted by token: a lookup reads one bucket's row groups."""
    out = postings.withColumn("bucket", F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int"))
    out.repartition(buckets, "bucket").sortWithinPartitions("bucket", "token", "sid", "pos").write.partitionBy("bucket").parquet(path)


def lookup(spark: SparkSession, path: str, tokens: DataFrame, buckets: int = 64) -> DataFrame:
    """Postings of a query's tokens: buckets are pruned, tokens filter row groups. A query has a few dozen tokens."""
    wanted = [r["token"] for r in tokens.select("token").distinct().collect()]
    own = [r["b"] for r in spark.createDataFrame([(t,) for t in wanted], "token string").select(F.pmod(F.xxhash64("token"), F.lit(buckets)).alias("b")).distinct().collect()]
    return spark.read.parquet(path).filter(F.col("bucket").isin(own) & F.col("token").isin(wanted)).drop("bucket")


def validate(spark: SparkSession, path: str, columns: list[str]) -> None:
    """A finished table has the columns and at least one row."""
    df = spark.read.parquet(path)
    lacking = set(columns) - set(df.columns)
    if lacking or not df.limit(1).count():
        raise ValueError(f"not a finished index: lacks {sorted(lacking)}" if lacking else "not a finished index: empty")


def as_of(events: DataFrame, states: DataFrame, key: str, at: str, value: list[str]) -> DataFrame:
    """Each event with the last state at or before it: one sorted pass over the union, no range join."""
    e = events.withColumn("is_event", F.lit(1))
    s = states.select(key, at, *value).withColumn("is_event", F.lit(0))
    w = Window.partitionBy(key).orderBy(at, "is_event").rowsBetween(Window.unboundedPreceding, 0)
    both = e.unionByName(s, allowMissingColumns=True)
    return both.withColumns({c: F.last(F.when(F.col("is_event") == 0, F.col(c)), ignorenulls=True).over(w) for c in value}).filter("is_event = 1").drop("is_event")


def changed(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Lost, added and changed keys of two runs."""
    x = before.select(key, F.col(value).alias("old"), F.lit(1).alias("a")).join(after.select(key, F.col(value).alias("new"), F.lit(1).alias("b")), key, "full_outer")
    kind = F.when(F.col("b").isNull(), "lost").when(F.col("a").isNull(), "added").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return x.withColumn("change", kind).filter("change IS NOT NULL").select(key, "old", "new", "change")
