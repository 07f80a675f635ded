"""Haplotype counts of the reads behind a call."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def haplotype_counts(call_reads: DataFrame, haplotypes: DataFrame, key: list[str]) -> DataFrame:
    """Reads per call without tag, on haplotype 1 and on haplotype 2; ``haplotypes`` is ``read, hp``."""
    rows = call_reads.join(haplotypes, "read", "left")
    n = lambda h: F.sum(F.when(F.coalesce("hp", F.lit(0)) == h, 1).otherwise(0)).cast("bigint")
    return rows.groupBy(*key).agg(n(0).alias("hp_none"), n(1).alias("hp1"), n(2).alias("hp2"))
