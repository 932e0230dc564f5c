"""Shared plumbing of the training-data operators.

Everything here is independent of any one operator: written tables in the folder that all
executors share, sizing of shards from the plan's own statistics, a join that survives hot
keys, and connected components over an edge table.
"""

from __future__ import annotations

import math
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Prefix of internal columns, so that they never clash with a caller's columns.
OWN = "__strophic_"
#: Session settings of writes: shuffle files go when the write ends, and Arrow batches are small.
_WRITES = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset (tests), a temporary one is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    own = spark.sparkContext.getCheckpointDir()
    if not own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        own = "file://" + tempfile.mkdtemp(prefix="strophic-")
        spark.sparkContext.setCheckpointDir(own)
        own = spark.sparkContext.getCheckpointDir()
    return own.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strophic/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: cuts lineage, survives lost executors.

    Shuffle files of the write go when it ends, and Arrow batches are bounded by bytes (session settings, put back afterwards).
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with _writing(spark):
        df.write.options(**({"compression": "zstd"} | options)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _writing(spark: SparkSession):
    before = {k: spark.conf.get(k, None) for k in _WRITES}
    try:
        for k, v in _WRITES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def bucketed(df: DataFrame, name: str, key: str, buckets: int, **options) -> DataFrame:
    """As :func:`materialise`, bucketed by ``key``: joins on it don't move this side. The session's catalog knows the table by its path's name."""
    spark = df.sparkSession
    path = new_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    with _writing(spark):
        df.repartition(buckets, key).write.bucketBy(buckets, key).options(**({"compression": "zstd", "path": path} | options)).format("parquet").saveAsTable(table)
    out = spark.table(table)
    out._strophic_buckets = buckets
    return out


def buckets_of(table: DataFrame) -> int:
    """The number of buckets of a table made by :func:`bucketed`."""
    return table._strophic_buckets


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`materialise` or :func:`bucketed` that no later step reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    base = shared_dir(spark) + "/strophic/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        name = folder.rpartition("/strophic/")[2]
        if name and "/" not in name:
            spark.sql(f"DROP TABLE IF EXISTS {name.replace('-', '_')}")
            path = jvm.org.apache.hadoop.fs.Path(base + name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def plan_bytes(df: DataFrame) -> int | None:
    """Size of what a plan reads: the sum over its leaves, for files their size on disk. None if a leaf's size isn't known."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return None if any(x >= 1 << 60 for x in sizes) else sum(sizes)


def conf_bytes(spark: SparkSession, key: str, default: int) -> int:
    said = str(spark.conf.get(key, str(default))).strip().lower()
    units = {"b": 0, "k": 10, "kb": 10, "m": 20, "mb": 20, "g": 30, "gb": 30}
    digits = said.rstrip("bkmg")
    return int(digits) << units.get(said[len(digits) :], 0)


def parts_for(df: DataFrame, per_part: float = 1.0, least: int = 1) -> int:
    """As many partitions as a scan of what ``df`` reads would have at ``per_part`` times the session's split size.

    Where that size isn't known, the session's number of shuffle partitions.
    """
    size = plan_bytes(df)
    if size is None:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    split = conf_bytes(df.sparkSession, "spark.sql.files.maxPartitionBytes", 128 << 20)
    return max(least, math.ceil(size / (split * per_part)))


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows_per_salt: int = 2000) -> DataFrame:
    """Join where ``right`` has one row a key and a key may hold a large part of ``left``.

    Keys with over ``rows_per_salt`` rows on the left are dealt to as many salts as they need and
    their right row is copied once per salt, so no task gets more than about that many rows of a key.
    The left keeps its columns; the right adds its own beside ``key``.
    """
    heavy = (
        left.groupBy(key).agg(F.count(F.lit(1)).alias(OWN + "rows")).filter(F.col(OWN + "rows") > rows_per_salt)
        .select(key, F.ceil(F.col(OWN + "rows") / rows_per_salt).cast("int").alias(OWN + "salts"))
    )
    spread = F.coalesce(F.col(OWN + "salts"), F.lit(1))
    # at most rows(left) / rows_per_salt keys are heavy; past that bound Spark picks a shuffled join itself
    light = left.join(heavy, key, "left").withColumn(OWN + "salt", F.pmod(F.xxhash64(*left.columns), spread.cast("long")).cast("int")).drop(OWN + "salts")
    copied = right.join(heavy, key, "left").withColumn(OWN + "salt", F.explode(F.sequence(F.lit(0), spread - 1))).drop(OWN + "salts")
    return light.join(copied, [key, OWN + "salt"], how).drop(OWN + "salt")


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components by hooking and pointer jumping: (``node``, ``root``), root the smallest node.

    Each round a node takes the smallest root among its neighbours' roots and roots are then replaced by
    their own roots. Every round is written to the shared folder and only one number comes to the driver.
    Pre-aggregated minima keep a node with very many edges from filling a task. No edges: an empty table.
    """
    both = edges.filter(F.col(a) != F.col(b)).select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = materialise(both.unionByName(both.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = materialise(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("r")), "labels")
    while True:
        near = both.join(label.select(F.col("x").alias("y"), F.col("r").alias("near")), "y").groupBy("x").agg(F.min("near").alias("near"))
        hooked = label.join(near, "x").select("x", F.col("r").alias("was"), F.least("r", "near").alias("r"))
        # the old root of a node also hears of the smaller root that the node found
        found = hooked.groupBy(F.col("was").alias("x")).agg(F.min("r").alias("up"))
        hooked = hooked.join(found, "x", "left").select("x", "was", F.least(F.col("r"), F.coalesce("up", "r")).alias("r"))
        up = hooked.select(F.col("x").alias("r"), F.col("r").alias("jump"))
        after = materialise(hooked.join(up, "r").select("x", F.least("r", "jump").alias("r"), (F.least("r", "jump") != F.col("was")).alias("moved")), "labels")
        moved = after.filter("moved").limit(1).count()
        drop_table(label)
        label = after.select("x", "r")
        if not moved:
            drop_table(both)
            return label.select(F.col("x").alias("node"), F.col("r").alias("root"))


def null_as_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
