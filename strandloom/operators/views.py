"""Normalised listing of calls and counts of long calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.operators.regions import both_ends_inside


def view(calls: DataFrame, bed: DataFrame | None = None) -> DataFrame:
    rows = calls if bed is None else both_ends_inside(calls, bed)
    return rows.select("file_id", "ctg", "pos", "ori", "ctg2", "pos2", "svtype", "svlen")


def long_counts(calls: DataFrame, bed: DataFrame | None = None, n_files: int | None = None) -> DataFrame:
    """Per file: calls between contigs, and calls at least 1M, 100k and 20k long (contig-crossing calls count in all).

    With ``n_files``, files without calls have a row of zeros.
    """
    rows = calls if bed is None else both_ends_inside(calls, bed)
    cross = F.col("ctg") != F.col("ctg2")
    at_least = lambda n: F.count_if(cross | (F.abs("svlen") >= n))
    counts = rows.groupBy("file_id").agg(
        F.count_if(cross).alias("n_cross"),
        at_least(1_000_000).alias("n_1m"),
        at_least(100_000).alias("n_100k"),
        at_least(20_000).alias("n_20k"),
    )
    if n_files is None:
        return counts
    files = calls.sparkSession.range(n_files).select(F.col("id").cast("int").alias("file_id"))
    return files.join(counts, "file_id", "left").fillna(0)
