"""Text input: any Hadoop codec by suffix, optional exact line numbers without a global sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per line, trailing white space removed, column ``line``."""
    return spark.read.text(path).select(F.regexp_replace("value", r"\s+$", "").alias("line"))


def read_numbered_lines(spark: SparkSession, path: str, file_id: int = 0) -> DataFrame:
    """``file_id, line_no, line`` with 1-based line numbers.

    A scan numbers the rows of each file split in order; the count of the splits before it gives the
    offset.  The split table has one row per split, so nothing is sorted globally.
    """
    raw = spark.read.text(path).select(
        F.regexp_replace("value", r"\s+$", "").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_mid"),
    )
    splits = raw.groupBy("_file", "_at").agg(F.min("_mid").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("_file").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return raw.join(splits, ["_file", "_at"]).select(
        F.lit(file_id).alias("file_id"),
        (F.col("_before") + F.col("_mid") - F.col("_first") + 1).cast("bigint").alias("line_no"),
        "line",
    )
