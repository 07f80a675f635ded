"""Read-level signals as text: 7 columns for indels, 9 for breakends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.functions.info import info_last
from strandloom.sources.text import read_lines


def parse_signals(lines: DataFrame, keep_line: bool = False) -> DataFrame:
    """Typed signals; ``info`` keeps the annotation text without its ``source``, ``line`` on request the whole line."""
    t = lambda i: F.get("f", F.lit(i))
    rows = lines.select("line", F.split("line", "\t").alias("f")).filter(F.size("f") >= 7)
    rows = rows.withColumn("is_bp", t(2).rlike("^[><]"))
    pick = lambda bp, indel: F.when(F.col("is_bp"), t(bp)).otherwise(t(indel))
    rows = rows.withColumn("info0", pick(8, 6))
    val = lambda key: info_last(F.col("info0"), key)
    long = lambda key: val(key).try_cast("bigint")
    region = lambda i: F.regexp_extract(val("sv_region"), r"(\d+),(\d+)", i)
    return rows.select(
        t(0).alias("ctg"),
        t(1).cast("bigint").alias("pos"),
        F.when(~F.col("is_bp"), t(2)).try_cast("bigint").alias("en"),
        "is_bp",
        F.when(F.col("is_bp"), t(2)).alias("ori"),
        F.when(F.col("is_bp"), t(3)).alias("ctg2"),
        F.when(F.col("is_bp"), t(4)).try_cast("bigint").alias("pos2"),
        pick(5, 3).alias("read"),
        pick(6, 4).cast("int").alias("mapq"),
        pick(7, 5).alias("strand"),
        val("SVTYPE").alias("svtype"),
        long("SVLEN").alias("svlen"),
        long("qoff_l").alias("qoff_l"),
        long("qoff_r").alias("qoff_r"),
        long("tsd_len").alias("tsd_len"),
        long("polyA_len").alias("polya_len"),
        long("cen_dist").alias("cen_dist"),
        long("cen_overlap").alias("cen_overlap"),
        region(1).try_cast("bigint").alias("region_st"),
        region(2).try_cast("bigint").alias("region_en"),
        val("source").alias("source"),
        F.regexp_replace("info0", r"(;?)source=[^;\s=]+", "").alias("info"),
        *(["line"] if keep_line else []),
    ).filter(F.col("svtype").isNotNull())


def read_signals(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_signals(read_lines(spark, path))


def parse_merged_calls(lines: DataFrame) -> DataFrame:
    """Merged call rows (``line_no, line``) in the columns the VCF writer needs."""
    numbered = lines.select("line_no", F.split("line", r"\s+").alias("f")).filter(F.size("f") >= 7)
    t = lambda i: F.get("f", F.lit(i))
    bp = t(2).rlike("^[><]")
    pick = lambda a, b: F.when(bp, t(a)).otherwise(t(b))
    info = pick(8, 6)
    return numbered.select(
        "line_no",
        t(0).alias("ctg"),
        t(1).cast("bigint").alias("pos"),
        F.when(~bp, t(2)).try_cast("bigint").alias("en"),
        bp.alias("is_bp"),
        F.when(bp, t(2)).alias("ori"),
        F.when(bp, t(3)).alias("ctg2"),
        F.when(bp, t(4)).try_cast("bigint").alias("pos2"),
        pick(6, 4).cast("bigint").alias("n_reads"),
        info_last(info, "SVTYPE").alias("svtype"),
        info_last(info, "SVLEN").try_cast("bigint").alias("svlen"),
        info_last(info, "tsd_seq").alias("tsd_seq"),
        info_last(info, "insert").alias("insert_seq"),
    )


def parse_union_rows(lines: DataFrame) -> DataFrame:
    """Union rows (``line_no, line``) back to columns; ``asm_reads`` is the array of supporting reads, ``line`` the row itself."""
    t = lambda i: F.get("f", F.lit(i))
    val = lambda k: info_last(t(5), k)
    rows = lines.select("line_no", F.split("line", "\t").alias("f"), "line").filter(F.size("f") >= 6)
    return rows.select(
        val("file_id").cast("int").alias("file_id"),
        "line_no",
        F.col("line_no").cast("string").alias("svid"),
        t(0).alias("ctg"),
        t(1).cast("bigint").alias("pos"),
        t(2).alias("ori"),
        t(3).alias("ctg2"),
        t(4).cast("bigint").alias("pos2"),
        val("SVTYPE").alias("svtype"),
        val("SVLEN").try_cast("bigint").alias("svlen"),
        val("count").try_cast("bigint").alias("count"),
        val("group_id").cast("bigint").alias("group_id"),
        F.split(val("asm_read_ids"), ",").alias("asm_reads"),
        "line",
    )
