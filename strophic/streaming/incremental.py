"""Incremental indexing: new rows become postings as they arrive, with a checkpoint that resumes where it stopped."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def index_available(spark: SparkSession, schema: str, source: str, target: str, checkpoint: str, to_postings: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Read what is new under ``source``, write its postings under ``target``, stop. A batch that is repeated overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        to_postings(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Event-time sessions of each user: the streaming counterpart of phrases between long rests."""
    return events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n")).select("user_id", "s.start", "s.end", "n")


def append_reviews(reviews: DataFrame, path: str) -> None:
    """Human reviews as an append-only log of JSON lines; rows must name a work, a target and a known status."""
    bad = reviews.filter("workId IS NULL OR target IS NULL OR status IS NULL OR status NOT IN ('accepted', 'rejected', 'uncertain')").limit(1).count()
    if bad:
        raise ValueError("a review lacks its work, target or status")
    reviews.write.mode("append").json(path)
