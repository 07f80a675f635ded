"""Point and interval lookups against region tables, spread by (contig, bin)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

REGION_BIN = 1_000_000


def _bin(c: Column, size: int) -> Column:
    return F.floor(c / F.lit(size)).cast("bigint")


def binned_regions(bed: DataFrame, size: int = REGION_BIN) -> DataFrame:
    """Distinct intervals, one row per bin they touch."""
    bed = bed.select("ctg", "st", "en").filter("en > st").distinct()
    return bed.withColumn(
        "bin", F.explode(F.sequence(_bin(F.col("st"), size), _bin(F.col("en") - 1, size)))
    )


def _inside(rows: DataFrame, regions: DataFrame, ctg: str, pos: str) -> DataFrame:
    r = regions.select(*[F.col(c).alias("r_" + c) for c in ("ctg", "st", "en", "bin")])
    return rows.join(
        r,
        (F.col(ctg) == F.col("r_ctg"))
        & (_bin(F.col(pos), REGION_BIN) == F.col("r_bin"))
        & (F.col(pos) >= F.col("r_st"))
        & (F.col(pos) < F.col("r_en")),
        "left_semi",
    )


def both_ends_inside(calls: DataFrame, bed: DataFrame) -> DataFrame:
    """Calls whose two end points lie in some interval of ``bed``: two semi joins."""
    regions = binned_regions(bed)
    return _inside(_inside(calls, regions, "ctg", "pos"), regions, "ctg2", "pos2")


def flag_inside(calls: DataFrame, bed: DataFrame, key: list[str]) -> DataFrame:
    """Adds ``in_bed`` instead of filtering; ``key`` identifies a call."""
    hit = both_ends_inside(calls, bed).select(*key).distinct().withColumn("in_bed", F.lit(True))
    return calls.join(hit, key, "left").withColumn("in_bed", F.coalesce("in_bed", F.lit(False)))


def annotate_near(calls: DataFrame, features: DataFrame, key: list[str], name: str, pad: int = 25) -> DataFrame:
    """Adds ``name``: the middle feature overlapping either end point widened by ``pad``.

    The distinct features near one call are ordered by end point, start, end and text; duplicates of a
    feature are removed before the join, so the list of a call holds what overlaps 50 bases of genome.
    """
    size = 100_000
    spans = features.select("ctg", "st", "en", "data").filter("en > st").distinct().withColumn(
        "bin", F.explode(F.sequence(_bin(F.col("st"), size), _bin(F.col("en") - 1, size)))
    )
    ends = reduce(
        DataFrame.unionByName,
        [
            calls.select(
                *[F.col(k).alias("c_" + k) for k in key], F.lit(e).alias("end_no"), F.col(c).alias("c_c"), F.col(p).alias("at")
            )
            for e, c, p in ((0, "ctg", "pos"), (1, "ctg2", "pos2"))
        ],
    )
    probes = ends.withColumn(
        "c_bin", F.explode(F.sequence(_bin(F.col("at") - pad, size), _bin(F.col("at") + pad - 1, size)))
    )
    hits = probes.join(
        spans,
        (F.col("c_c") == F.col("ctg"))
        & (F.col("c_bin") == F.col("bin"))
        & (F.col("st") < F.col("at") + pad)
        & (F.col("en") > F.col("at") - pad),
    )
    ck = ["c_" + c for c in key]
    # A feature reached through two bins by the same end is one hit.
    hits = hits.select(*ck, "end_no", "st", "en", "data").distinct()
    ranked = hits.groupBy(*ck).agg(F.sort_array(F.collect_list(F.struct("end_no", "st", "en", "data"))).alias("h"))
    mid = ranked.select(
        *[F.col("c_" + c).alias(c) for c in key],
        F.expr("get(h, cast(size(h) div 2 as int)).data").alias(name),
    )
    return calls.join(mid, key, "left")
