"""Token ids in Parquet list columns, made for selective reads.

File format (any Parquet reader opens it): one row for each document, in ascending
document order over all files, with columns

* ``doc_id`` (delta encoded: the column ascends), ``n_tokens`` (delta or dictionary),
* ``ids``, a list of 32-bit ids.  A vocabulary's ids repeat, so pages are dictionary
  encoded (16 bits or fewer an id); where the dictionary outgrows its page the writer
  goes on with delta encoding (Parquet 2.0 pages).

Row groups and pages are kept small and every column chunk has a page index, so a read
of a few documents (``doc_id`` between a and b) touches their pages only, and a read of
``doc_id, n_tokens`` alone never touches the ids.

Order without a second pass over the texts: the cut points are quantiles of the id
column; each range of ids is one partition, sorted, written as one or more files by
Spark's own committed writer, so that a task lost half-way leaves nothing behind.  The
first token's place of each document is a running sum within a file plus the sums of the
files before it.

A null text has no ids but the end id; null ids come first; rows that repeat are written
as often as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small_batches, worker
from .tokens import encoder

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, keep_space: bool = False, partitions: int | None = None, row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES) -> None:
    """Write the ids of ``docs(doc_id, text)`` under ``path``, in ascending id order."""
    spark = docs.sparkSession
    small_batches(spark)
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.select("doc_id").rdd.getNumPartitions())

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(tokenizer, keep_space).ids
        for batch in batches:
            each = [np.append(x := ids_of(t), np.asarray(end_id, x.dtype)) for t in batch.column(1).to_pylist()]
            sizes = np.asarray([len(x) for x in each], np.int64)
            flat = np.concatenate(each).astype(np.int32) if each else np.empty(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], sizes.cumsum()]).astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists], names=["doc_id", "n_tokens", "ids"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(partitions, "doc_id").sortWithinPartitions("doc_id")
    (ordered.mapInArrow(run, "doc_id long, n_tokens long, ids array<int>").write
        .option("parquet.writer.version", "v2")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.dictionary.page.size", str(page_bytes))
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("parquet.page.write-checksum.enabled", "true")
        .option("parquet.columnindex.truncate.length", "16")
        .option("compression", "zstd")
        .parquet(path))


def read_token_files(spark: SparkSession, path: str, columns: list[str] | None = None, lowest: int | None = None, highest: int | None = None) -> DataFrame:
    """Documents of the files, only the named columns, only ids from lowest to highest."""
    df = spark.read.parquet(path)
    if lowest is not None:
        df = df.filter(F.col("doc_id") >= lowest)
    if highest is not None:
        df = df.filter(F.col("doc_id") <= highest)
    return df.select(*columns) if columns else df


def token_starts(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, row, start: from the small columns alone.

    Only one row a file goes to a single task, for the sums of the files before it.
    """
    rows = spark.read.parquet(path).select("doc_id", "n_tokens", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"), F.count(F.lit(1)).alias("n"))
    number = F.regexp_extract("file", r"^part-(\d+)", 1).cast("long")  # names alone would put part-100000 before part-99999
    bases = files.select("file", F.coalesce(F.sum("total").over(Window.orderBy(number, "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    before = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("before", F.coalesce(before, F.lit(0))).join(bases, "file").select("doc_id", "file", "row", (F.col("base") + F.col("before")).alias("start"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, file, row, n_tokens, ids_crc32: from the ids read back."""
    small_batches(spark)

    @worker
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "file", "row", "n_tokens", "ids_crc32"])

    rows = spark.read.parquet(path).select("doc_id", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "ids")
    return rows.mapInArrow(run, "doc_id long, file string, row long, n_tokens long, ids_crc32 long")
