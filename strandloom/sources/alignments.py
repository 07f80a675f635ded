"""PAF/GAF alignment rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.params import ExtractParams
from strandloom.sources.text import read_lines


# Twelve leading columns with a strand in the fifth, and a primary-alignment tag.
ROW_SHAPE = r"^(?:[^\t]*\t){4}[+-]\t(?:[^\t]*\t){6}\d+\t"
PRIMARY = r"\ttp:A:P(?:\t|$)"


def parse_alignments(lines: DataFrame, params: ExtractParams = ExtractParams()) -> DataFrame:
    """Primary alignments with a CIGAR and enough mapping quality, from a ``line`` column.

    Rows are rejected on the raw text, and only the leading columns are split: the optional fields
    stay one string, because a difference string can be as long as the read.
    """
    text = lambda i: F.get("f", F.lit(i))
    long = lambda i: text(i).try_cast("bigint")
    tag = lambda t: F.regexp_extract(text(12), rf"(?:^|\t){t}:([^\t]*)", 1)
    line = F.col("line")
    rows = (
        lines.filter(line.rlike(ROW_SHAPE) & line.rlike(PRIMARY) & line.contains("\tcg:Z:"))
        .select(F.split(line, "\t", 13).alias("f"))
        .filter(long(11) >= params.min_mapq)
    )
    return rows.select(
        text(0).alias("qname"),
        long(1).alias("qlen"),
        long(2).alias("qst"),
        long(3).alias("qen"),
        text(4).alias("strand"),
        text(5).alias("path"),
        long(6).alias("tlen"),
        long(7).alias("tst"),
        long(8).alias("ten"),
        long(11).cast("int").alias("mapq"),
        tag("cg:Z").alias("cg"),
        F.nullif(tag("ds:Z"), F.lit("")).alias("ds"),
    )


def read_alignments(
    spark: SparkSession, path: str, params: ExtractParams = ExtractParams()
) -> DataFrame:
    return parse_alignments(read_lines(spark, path), params)
