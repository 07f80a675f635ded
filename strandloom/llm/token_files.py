"""Token files: Parquet with a list of ids per document, in ascending order of the ids of documents.

Layout: ``row`` (place in the order), ``doc_id``, ``n_tokens`` and ``ids``.  Ids are dictionary encoded, the
other columns delta encoded; row groups are small, and pages carry an index, so a reader of some documents
skips row groups and pages, and a reader of counts reads no ids.  Files follow each other in the order, and
each holds one range.

Defined cases: null texts have the end id only; null ids come first; documents with equal ids follow each
other in the order of the input; an empty table gives files without rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.llm.bpe import encode
from strandloom.llm.mixing import running

LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(64 << 10),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#row": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}
SCHEMA = "row long, doc_id long, n_tokens int, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", table=None) -> None:
    """Encode every whole text and write the files.

    Texts are dealt by ranges of ids before they are encoded; a number of the input row parts equal ids, so
    that even one id on most rows does not meet in one task.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("uid"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("uid").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    keep = {"row": F.monotonically_increasing_id(), "doc_id": F.col("doc_id")}
    made = encode(rows, tokenizer_path, keep, "text", table, [end_id])
    made.select("row", "doc_id", F.size("ids").alias("n_tokens"), "ids").write.options(**LAYOUT).parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """All columns; select the ones needed, filters on ``doc_id`` reach the page index."""
    return spark.read.schema(SCHEMA).parquet(path)


def with_start(rows: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before.  Sums of the files' ranges first, then within each."""
    rows = rows.withColumn("_all", F.lit(0))
    return running(rows, "_all", F.shiftright("row", 33), [F.col("row")], F.col("n_tokens").cast("bigint"), "start").drop("_all")


def checksums(rows: DataFrame) -> DataFrame:
    """``row, doc_id, n_tokens, ids_crc32``: unsigned CRC-32 of the ids as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            offsets, flat = np.asarray(lists.offsets), np.asarray(lists.values).astype("<u4")
            sums = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], names=["row", "doc_id", "n_tokens", "ids_crc32"])

    return rows.select("row", "doc_id", F.col("n_tokens").cast("bigint"), "ids").mapInArrow(run, "row long, doc_id long, n_tokens long, ids_crc32 long")
