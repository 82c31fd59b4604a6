"""Token ids as Parquet list columns: dictionary pages, bounded row groups, page indexes, selective reads.

Documents are dealt by ranges of their key and sorted inside each range, so files, row groups and pages hold ascending
keys and the statistics of row groups and pages prune reads by key. Ids are encoded with a dictionary per row group,
the row numbers with deltas; key, row number and length can be read without touching the ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelcast.llm.common import OWN, SLICE, byte_slices, word_ids

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
#: row_no is the number of the range times 2^33 plus the row's place in it, ascending with the key.
RANGE_BITS = 33


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encodes whole texts (null: empty), appends `end_id` to each, and writes key, row_no, n_tokens, ids in key order.

    Null keys come first; rows of equal keys follow each other in text order. Every row is written, repeated ones too.
    """
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), raw.alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_tokens", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    tail = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(vocabulary)
        for batch in byte_slices(batches, "text", SLICE):
            ids = encode(batch.column(1))
            sizes = np.asarray([len(x) // 4 + 1 for x in ids], np.int32)
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(tail.join([*ids, b""]))])
            lists = pa.ListArray.from_arrays(pa.array(ends), values, type=pa.list_(pa.field("element", pa.int32(), False)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), lists], names=schema.names)

    out = rows.mapInArrow(run, schema).select("doc_id", F.monotonically_increasing_id().alias("row_no"), "n_tokens", "ids")
    (
        out.write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.page.size", PAGE_BYTES).option("parquet.dictionary.page.size", 1 << 20)
        .option("parquet.enable.dictionary", "true").option("parquet.enable.dictionary#row_no", "false").option("parquet.writer.version", "PARQUET_2_0")
        .option("compression", "zstd").parquet(path)
    )


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Key, row number and length of every document; the id pages are not read."""
    return spark.read.parquet(path).select("doc_id", "row_no", "n_tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, columns: Sequence[str] = ("doc_id", "ids")) -> DataFrame:
    """Ids of the documents with keys from `first` to `last`; row groups and pages outside are skipped by their indexes."""
    df = spark.read.parquet(path)
    if first is not None:
        df = df.filter(F.col("doc_id") >= F.lit(first))
    if last is not None:
        df = df.filter(F.col("doc_id") <= F.lit(last))
    return df.select(*columns)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32, from the files alone."""
    stored = spark.read.parquet(path).select("doc_id", "row_no", "ids")
    schema = T.StructType([stored.schema["doc_id"], T.StructField("row_no", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(ends).astype(np.int64)), pa.array(sums, pa.int64())], names=schema.names)

    rows = stored.mapInArrow(run, schema).withColumn(f"{OWN}range", F.shiftright("row_no", RANGE_BITS))
    totals = read_metadata(spark, path).groupBy(F.shiftright("row_no", RANGE_BITS).alias(f"{OWN}r")).agg(F.sum("n_tokens").alias(f"{OWN}n"))
    before = Window.orderBy(f"{OWN}r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    totals = totals.select(f"{OWN}r", F.coalesce(F.sum(f"{OWN}n").over(before), F.lit(0)).alias(f"{OWN}base"))
    inside = Window.partitionBy(f"{OWN}range").orderBy("row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(totals, F.col(f"{OWN}range") == F.col(f"{OWN}r")).select("doc_id", (F.col("start") + F.col(f"{OWN}base")).alias("start"), "n_tokens", "ids_crc32")
