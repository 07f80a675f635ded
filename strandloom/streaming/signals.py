"""Streaming form of the single-pass steps: alignments arriving as files to indel signals.

An indel depends on its alignment alone, so this part has no state.  Breakends need all alignments of a read and run
on what a batch has landed; clustering of a stream in position order is ``streaming.merge``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from strandloom.operators.extract import indel_signals, with_indel_centromere
from strandloom.params import ExtractParams
from strandloom.sources.alignments import parse_alignments


def stream_alignments(spark: SparkSession, folder: str, p: ExtractParams = ExtractParams()) -> DataFrame:
    lines = spark.readStream.text(folder).select(F.col("value").alias("line"))
    return parse_alignments(lines, p)


def stream_indels(
    spark: SparkSession, folder: str, out: str, checkpoint: str, p: ExtractParams = ExtractParams(), cen: DataFrame | None = None
) -> StreamingQuery:
    """Append indel signals of new alignment files to a parquet folder, then stop.

    Distances to centromeres need an order of the points: they are added batch by batch, in a folder per batch.
    """
    rows = indel_signals(stream_alignments(spark, folder, p), p)
    if cen is None:
        sink = rows.writeStream.format("parquet").option("path", out)
    else:

        def add(batch: DataFrame, number: int) -> None:
            near = with_indel_centromere(batch.drop("cen_dist"), cen).select(*rows.columns)
            near.write.mode("overwrite").parquet(f"{out}/batch={number}")

        sink = rows.writeStream.foreachBatch(add)
    return sink.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
