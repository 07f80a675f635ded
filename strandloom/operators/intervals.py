"""Nearest interval and covered bases at many points, against any number of intervals of a contig.

Nothing is gathered per contig.  A running value along a contig is a window inside each bin plus what the bins
before hand over; the handing over runs on one row per occupied bin.  Points and intervals are put in one
order and every point takes the last interval before it and the first one after it.  Covered bases of ``[a, b)``
are ``F(b) - F(a)``, with ``F(x)`` the bases covered before ``x``.

Defined cases: intervals that overlap or touch are merged; empty ones count as a point for distances; those that
end before their start and those with a null are left out; a null point has no values; on a contig without
intervals all values are null; repeated points and intervals are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BIN = 1 << 16
#: The largest distance a column holds; there is no other limit.
FAR = (1 << 63) - 1


def running(df: DataFrame, keys: list[str], order: list[Column], fold, value: Column, own: bool, back: bool = False) -> tuple[DataFrame, str, str]:
    """Adds ``fold`` (max, sum or last non-null) of ``value`` over the rows before, in the order of ``bin`` and ``order``.

    It comes in two columns, whose names are returned: the part inside the bin, and what earlier bins hand over.

    ``own`` counts the row itself in; ``back`` goes through the bins from the last to the first (``order`` is given to match).
    """
    upto = 0 if own else -1
    inside = Window.partitionBy(*keys, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, upto)
    rows = df.withColumn("_local", fold(value).over(inside))
    whole = Window.partitionBy(*keys, "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bins = df.withColumn("_total", fold(value).over(whole)).groupBy(*keys, "bin").agg(F.first("_total").alias("_total"))
    before = Window.partitionBy(*keys).orderBy(F.desc("bin") if back else F.asc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("_carry", fold(F.col("_total")).over(before)).drop("_total")
    return rows.join(bins, [*keys, "bin"]), "_local", "_carry"


def last_known(c: Column) -> Column:
    return F.last(c, ignorenulls=True)


def merged(bed: DataFrame) -> DataFrame:
    """``ctg, st, en, before``: disjoint intervals and the bases covered before each on its contig."""
    rows = bed.select("ctg", F.col("st").cast("bigint").alias("st"), F.col("en").cast("bigint").alias("en")).filter("st <= en and ctg is not null").distinct()
    rows = rows.withColumn("bin", F.floor(F.col("st") / BIN).cast("bigint"))
    order = [F.col("st"), F.col("en")]
    rows, local, carry = running(rows, ["ctg"], order, F.max, F.col("en"), own=False)
    reach = F.greatest(local, carry)
    rows = rows.withColumn("new", F.when(reach.isNull() | (F.col("st") > reach), F.col("st"))).drop(local, carry)
    rows, local, carry = running(rows, ["ctg"], order, last_known, F.col("new"), own=True)
    runs = rows.withColumn("st", F.coalesce(local, carry)).groupBy("ctg", "st").agg(F.max("en").alias("en"))
    runs = runs.withColumn("bin", F.floor(F.col("st") / BIN).cast("bigint"))
    runs, local, carry = running(runs, ["ctg"], [F.col("st")], F.sum, F.col("en") - F.col("st"), own=False)
    zero = F.lit(0).cast("bigint")
    return runs.select("ctg", "st", "en", (F.coalesce(local, zero) + F.coalesce(carry, zero)).alias("before"))


def located(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """``points`` (``ctg, at`` and any other columns) on contigs with ``intervals`` (from ``merged``), with ``dist`` and ``upto``.

    ``dist`` is the distance to the nearest half-open interval, 0 inside; ``upto`` the bases covered before the point.
    """
    more = [c for c in points.columns if c not in ("ctg", "at")]
    rows = points.filter("ctg is not null and at is not null").withColumn("at", F.col("at").cast("bigint"))
    rows = rows.withColumn("iv", F.lit(None).cast("struct<st: bigint, en: bigint, before: bigint>"))
    starts = intervals.select("ctg", F.col("st").alias("at"), F.struct("st", "en", "before").alias("iv"))
    both = rows.unionByName(starts, allowMissingColumns=True).withColumn("bin", F.floor(F.col("at") / BIN).cast("bigint"))
    is_point = F.col("iv").isNull()
    # An interval that starts at a point lies before it.
    both, local, carry = running(both, ["ctg"], [F.col("at"), is_point.asc()], last_known, F.col("iv"), own=True)
    both = both.withColumn("prev", F.coalesce(local, carry)).drop(local, carry)
    both, local, carry = running(both, ["ctg"], [F.desc("at"), is_point.desc()], last_known, F.col("iv"), own=True, back=True)
    at, prev, after = F.col("at"), F.col("prev"), F.coalesce(local, carry)
    left = F.greatest(at - prev["en"], F.when(prev["en"].isNotNull(), F.lit(0).cast("bigint")))
    met = both.filter(is_point).select(
        "ctg",
        "at",
        *more,
        F.least(left, after["st"] - at).alias("dist"),
        F.coalesce(prev["before"] + F.least(at, prev["en"]) - prev["st"], F.lit(0).cast("bigint")).alias("upto"),
        (prev.isNotNull() | after.isNotNull()).alias("known"),
    )
    return met.filter("known").drop("known")


def with_points(rows: DataFrame, intervals: DataFrame, points: dict[str, tuple[str, str]]) -> DataFrame:
    """Adds for every named point (contig column, position column) ``<name>_dist`` and ``<name>_upto``; null without intervals.

    Values are found for the distinct sites, so a site that a third of all rows share is one row until the last join.
    """
    cols = sorted({c for pair in points.values() for c in pair})
    sites = rows.select(*cols).distinct()
    roles = F.explode(F.array(*[F.struct(F.lit(n).alias("role"), F.col(c).alias("ctg"), F.col(p).cast("bigint").alias("at")) for n, (c, p) in points.items()]))
    found = located(sites.select(F.struct(*cols).alias("site"), roles.alias("p")).select("site", "p.*"), intervals)
    of = lambda n, c: F.max(F.when(F.col("role") == n, F.col(c))).alias(f"{n}_{c}")
    values = found.groupBy("site").agg(*[of(n, c) for n in points for c in ("dist", "upto")])
    same = F.lit(True)
    for c in cols:
        same = same & F.col(c).eqNullSafe(F.col(f"site.{c}"))
    return rows.join(values, same, "left").drop("site")
