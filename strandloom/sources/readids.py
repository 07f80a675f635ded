"""Supporting-read tables of several callers, haplotype tags and id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.sources.text import read_lines, read_numbered_lines

READ_ID_FORMATS = ("severus", "savana", "nanomonsv", "vcf", "calls")


def parse_read_ids(lines: DataFrame, fmt: str) -> DataFrame:
    """``svid, read``: one row per supporting read, from ``line_no, line``.

    The long form keeps calls with very many reads in many rows instead of one array.
    """
    t = lambda i: F.get("f", F.lit(i))
    plain = lambda c: F.regexp_replace(c, '"', "")
    if fmt == "severus":
        rows = lines.filter(~F.col("line").startswith("#SV_ID")).withColumn("f", F.split("line", ","))
        return rows.select(t(0).alias("svid"), F.explode(F.split(plain(t(1)), "; ")).alias("read"))
    if fmt == "savana":
        rows = lines.filter(~F.col("line").startswith("VARIANT_ID")).withColumn("f", F.split("line", "\t"))
        return rows.select(t(0).alias("svid"), F.explode(F.split(plain(t(1)), ",")).alias("read"))
    if fmt == "nanomonsv":
        rows = lines.withColumn("f", F.split("line", "\t"))
        return rows.filter(F.size("f") >= 9).select(t(7).alias("svid"), t(8).alias("read"))
    if fmt == "vcf":
        rows = lines.filter(~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t"))
        names = F.regexp_extract(t(7), r"(?:^|[;\s])RNAMES[^;\s=]*=([^;\s=]+)", 1)
        return rows.select(t(2).alias("svid"), F.explode(F.split(names, ",")).alias("read")).filter("read != ''")
    if fmt == "calls":
        rows = lines.withColumn("f", F.split("line", "\t"))
        info = F.when(t(2).rlike("^[><]"), t(8)).otherwise(t(6))
        names = F.regexp_extract(info, r"(?:^|[;\s])reads[^;\s=]*=([^;\s=]+)", 1)
        return rows.select(
            F.col("line_no").cast("string").alias("svid"), F.explode(F.split(names, ",")).alias("read")
        ).filter("read != ''")
    raise ValueError(f"unknown read-id format {fmt!r}; one of {READ_ID_FORMATS}")


def detect_format(spark: SparkSession, path: str) -> str:
    """Format by what the lines of the whole file show, else by suffix."""
    line = F.col("line")
    marks = {
        "calls": line.contains("avg_mapq"),
        "severus": line.startswith("#SV_ID"),
        "savana": line.startswith("VARIANT_ID"),
        "nanomonsv": line.startswith("chr") & line.rlike("[+-]$"),
    }
    seen = read_lines(spark, path).agg(*[F.bool_or(m).alias(n) for n, m in marks.items()]).first()
    for name in marks:
        if seen[name]:
            return name
    if path.lower().endswith(("vcf", "gz")):
        return "vcf"
    raise ValueError(f"cannot tell the read-id format of {path}")


def read_read_ids(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    return parse_read_ids(read_numbered_lines(spark, path), fmt or detect_format(spark, path))


def merge_read_ids(tables: list[DataFrame]) -> DataFrame:
    """Union of read tables in which the table listed last owns an id that occurs in several."""
    tagged = [t.withColumn("_rank", F.lit(i)) for i, t in enumerate(tables)]
    both = tagged[0]
    for t in tagged[1:]:
        both = both.unionByName(t)
    owner = both.groupBy("svid").agg(F.max("_rank").alias("_rank"))
    return both.join(owner, ["svid", "_rank"]).select("svid", "read")


def read_haplotypes(spark: SparkSession, path: str) -> DataFrame:
    """``read, hp``; untagged reads are dropped and the last tag of a read wins."""
    rows = read_numbered_lines(spark, path).withColumn("f", F.split("line", r"\s+"))
    return latest_haplotypes(
        rows.select(F.get("f", F.lit(0)).alias("read"), F.get("f", F.size("f") - 1).alias("hp"), "line_no")
    )


def latest_haplotypes(tags: DataFrame, order: str = "line_no") -> DataFrame:
    return tags.filter("hp != 'NA'").groupBy("read").agg(F.max_by("hp", order).cast("int").alias("hp"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """One id per line with the pair suffix removed."""
    return read_lines(spark, path).select(F.regexp_replace("line", "_[12]", "").alias("svid")).distinct()


def asm_evidence(signals: DataFrame) -> DataFrame:
    """``read, flag, abs_len`` of assembly-alignment signals: all that support checks need."""
    from strandloom.functions.typing import type_flag

    return signals.select(
        "read",
        type_flag(F.col("svtype"), F.col("ctg"), F.coalesce("ctg2", "ctg")).alias("flag"),
        F.abs(F.coalesce("svlen", F.lit(0))).cast("bigint").alias("abs_len"),
    )


__all__ = [
    "asm_evidence", "detect_format", "latest_haplotypes", "merge_read_ids",
    "parse_read_ids", "read_haplotypes", "read_id_list", "read_read_ids",
]
