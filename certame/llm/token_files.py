"""Token ids as ORC files, sorted by document, with row indexes and Bloom filters on doc_id."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from certame.llm.kernels import list_array, text_slices
from certame.llm.storage import keep_until_exit, shared_dir
from certame.llm.tokens import default_tokenizer, encoder

END = 2
#: Documents of a file, about; a session with more shuffle partitions writes as many files as those.
FILE_ROWS = 50_000
ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}
SCHEMA = "doc_id long, n_tokens long, ids array<int>"


def tokenised(docs: DataFrame, end_id: int = END, tokenizer: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids (with end_id last) of every row of docs (doc_id, text); null text counts as empty."""
    path = tokenizer or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode
        for batch, data, at in text_slices(batches):
            ids, first = encode(data, at)
            ids = np.insert(ids, first[1:], np.uint32(end_id)).astype(np.int32)
            first = first + np.arange(len(first))
            yield pa.record_batch([batch.column(0), pa.array(np.diff(first), pa.int64()), list_array(ids, first, pa.int32())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def write_token_files(docs: DataFrame, path: str, end_id: int = END, tokenizer: str | None = None, partitions: int | None = None) -> None:
    """Writes docs as ORC files that together are in ascending order of doc_id (nulls first).

    The texts, smaller than their ids, are dealt by ranges of doc_id and encoded where they
    land; each file is sorted. ORC's writer run-length encodes the integers, keeps row
    indexes of every 1000 rows and Bloom filters, so readers take stripes side by side
    and skip by doc_id. Repeated rows are kept, in either order; nothing is written for an empty table but its schema. A text of any length, null
    or empty ones too, is one row; other columns, whatever their names, are left aside. Without `partitions` there is a file for about FILE_ROWS rows.
    """
    docs = docs.select("doc_id", "text")
    # a count needs no more than the footers of the table's files
    files = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // FILE_ROWS))
    ranged = docs.repartitionByRange(files, "doc_id")
    tokenised(ranged.sortWithinPartitions("doc_id"), end_id, tokenizer).write.options(**ORC_OPTIONS).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, n_tokens, ids; a filter on doc_id is pushed to the row indexes and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path)


def token_positions(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of files written by write_token_files().

    start counts the ids of all documents before. Only the totals of each file meet in
    one place (a row for each file); the files' rows are summed within their own ranges.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(2)
            at = ids.offsets.to_numpy()
            flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(sums, pa.int64()), batch.column(3)], ["doc_id", "n_tokens", "ids_crc32", "file"])

    rows = read_token_files(spark, path).withColumn("file", F.input_file_name()).mapInArrow(digest, "doc_id long, n_tokens long, ids_crc32 long, file string")
    sizes = read_token_files(spark, path).groupBy(F.input_file_name().alias("file")).agg(F.sum("n_tokens").alias("total"), F.min("doc_id").alias("low"))
    before = Window.orderBy(F.col("low").asc_nulls_first(), "file").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each file, so the broadcast is bounded by the number of files
    starts = F.broadcast(sizes.select("file", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")))
    own = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "ids_crc32", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(starts, "file").select("doc_id", (F.col("base") + F.coalesce(F.sum("n_tokens").over(own), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")


def token_table(docs: DataFrame, end_id: int = END, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to a new folder in the shared place, which goes when the driver exits, and returns token_positions() of it."""
    spark = docs.sparkSession
    path = keep_until_exit(spark, f"{shared_dir(spark)}/certame/tokens-{uuid.uuid4().hex}")
    write_token_files(docs, path, end_id, tokenizer)
    return token_positions(spark, path)
