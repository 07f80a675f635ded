"""Interval files: BED regions, centromeres, tandem repeats and segmental duplications."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.sources.text import read_lines


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).select(F.split("line", r"\s+").alias("f"), "line")


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """``ctg, st, en`` half-open; rows with fewer than three columns are skipped."""
    return (
        _fields(spark, path)
        .filter(F.size("f") >= 3)
        .select(
            F.get("f", F.lit(0)).alias("ctg"),
            F.get("f", F.lit(1)).cast("bigint").alias("st"),
            F.get("f", F.lit(2)).cast("bigint").alias("en"),
        )
    )


def read_tandem_repeats(spark: SparkSession, path: str) -> DataFrame:
    """``ctg, st, en, data``: start in column 2, end in column 5, empty intervals widened by one."""
    st, en = (F.get("f", F.lit(i)).cast("bigint") for i in (1, 4))
    return _tabbed(spark, path).select(
        F.get("f", F.lit(0)).alias("ctg"),
        st.alias("st"),
        F.when(st == en, en + 1).otherwise(en).alias("en"),
        F.array_join("f", "#").alias("data"),
    )


def read_segmental_duplications(spark: SparkSession, path: str) -> DataFrame:
    """``ctg, st, en, data`` with the end made inclusive."""
    return _tabbed(spark, path).select(
        F.get("f", F.lit(0)).alias("ctg"),
        F.get("f", F.lit(1)).cast("bigint").alias("st"),
        (F.get("f", F.lit(2)).cast("bigint") + 1).alias("en"),
        F.array_join("f", "#").alias("data"),
    )


def _tabbed(spark: SparkSession, path: str) -> DataFrame:
    return read_lines(spark, path).select(F.split("line", "\t").alias("f")).filter(F.size("f") >= 3)


def padded(bed: DataFrame, window: int = 10) -> DataFrame:
    """Every interval widened by half the window on both sides."""
    return bed.withColumns({"st": F.col("st") - window // 2, "en": F.col("en") + window // 2})


def hull(bed: DataFrame) -> DataFrame:
    """One interval per contig, from the smallest start to the largest end."""
    return bed.groupBy("ctg").agg(F.min("st").alias("st"), F.max("en").alias("en"))
