"""Token ids as Parquet list columns that can be read by parts.

Rows are in ascending document order over all files. Small integers that grow with the rows (``doc_id``,
``start_in_part``) are delta encoded and ids are dictionary encoded, both by Parquet's second format version;
row groups and pages have set sizes and the writer adds column and offset indexes, so a reader that wants
a few documents, or only the metadata columns, skips the other pages and the id column's bytes.

Columns: ``part`` (file number), ``doc_id``, ``start_in_part``, ``n_tokens``, ``ids``. The offset of a document in the
whole collection is its part's offset plus ``start_in_part``; parts' offsets come from the metadata columns.

Defined cases: null text is an empty text and has the end id alone; equal ids are ordered by their text;
a null ``doc_id`` comes first; an empty table gives files without rows. Other columns are left out.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, null_as_empty, parts_for
from .encoding import Encoder
from .words import slices

ROW_GROUP = 16 << 20
PAGE = 128 << 10
END = 2
_SCHEMA = "part int, doc_id long, start_in_part long, n_tokens int, ids array<int>"


def _encode(tokenizer: str, end: int):
    def run(batches):
        part, at, encoder = TaskContext.get().partitionId(), 0, Encoder.of(tokenizer)
        tail = np.array([end], "<u4").tobytes()
        for batch in batches:
            for i, j, data, text_off in slices(batch.column("text")):
                ids = [x + tail for x in encoder.encode_bytes(data, text_off)]
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                off = np.concatenate([[0], np.cumsum(sizes)])
                values = pa.array(np.frombuffer(b"".join(ids), "<i4"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(j - i, part, np.int32)), batch.column("doc_id").slice(i, j - i), pa.array(at + off[:-1]), pa.array(sizes.astype(np.int32)), pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), values)],
                    names=["part", "doc_id", "start_in_part", "n_tokens", "ids"],
                )
                at += int(off[-1])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, *, end: int = END, row_group: int = ROW_GROUP, page: int = PAGE) -> None:
    """Encode whole texts and write the files. A lost task writes its own file again."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), null_as_empty("text").alias("text"))
    ordered = rows.repartitionByRange(parts_for(docs, 0.5), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_encode(tokenizer, end), _SCHEMA).write.options(
        **{
            "compression": "zstd", "parquet.writer.version": "v2", "parquet.block.size": row_group, "parquet.page.size": page, "parquet.dictionary.page.size": 1 << 20,
            "parquet.enable.dictionary": "false", "parquet.enable.dictionary#ids.list.element": "true", "parquet.page.write-checksum.enabled": "true",
        }
    ).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_SCHEMA).parquet(path)


def offsets(table: DataFrame) -> DataFrame:
    """(``part``, ``base``): ids before a part. Reads metadata columns alone; one row a file."""
    sums = table.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("base"))


def documents(spark: SparkSession, path: str, ids: list[int]) -> DataFrame:
    """The rows of some documents: the filter reaches row-group statistics and page indexes."""
    return read(spark, path).filter(F.col("doc_id").isin(ids))


def _digest(batches):
    for batch in batches:
        lists = batch.column("ids")
        off, values = np.asarray(lists.offsets), np.asarray(lists.values).astype("<i4", copy=False)
        crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(off[:-1], off[1:])]
        keep = [batch.column(c) for c in ("part", "doc_id", "start_in_part")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(np.diff(off).astype(np.int64)), pa.array(crc, pa.int64())], names=["part", "doc_id", "start_in_part", "n_tokens", "ids_crc32"])


def report(docs: DataFrame, tokenizer: str, *, end: int = END) -> DataFrame:
    """Write, read back, and describe each document from what was read."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write(docs, path, tokenizer, end=end)
    table = read(spark, path)
    seen = table.select("part", "doc_id", "start_in_part", "ids").mapInArrow(_digest, "part int, doc_id long, start_in_part long, n_tokens long, ids_crc32 long")
    base = offsets(table)  # one small row a file: bounded by the number of files
    return seen.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32", F.col("part").alias("file"))


__all__ = ["documents", "offsets", "read", "report", "write"]
