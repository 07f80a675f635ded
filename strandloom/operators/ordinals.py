"""Dense numbers and k-th rows without sorting a whole table or group in one task."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.operators.intervals import last_known, running
from strandloom.session import written


def dense_index(
    df: DataFrame, order: list[str], chunk: dict[str, Column], name: str, partition: list[str] | None = None
) -> DataFrame:
    """Adds the 0-based rank of each row in ``order`` (within ``partition``, if given).

    ``chunk`` are coarse keys that sort like ``order``, such as (contig, position div 1M).  The rows
    of a chunk are numbered on their own and shifted by the size of the chunks before it; only the
    chunk table is ordered as a whole.  Rows are read twice, so they are written first.
    """
    part = partition or []
    keys = list(chunk)
    rows = written(df.withColumns(chunk))
    sizes = rows.groupBy(*part, *keys).agg(F.count("*").alias("_n"))
    w = (Window.partitionBy(*part) if part else Window.partitionBy(F.lit(0))).orderBy(*keys)
    sizes = sizes.withColumn(
        "_before", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("_n")
    local = Window.partitionBy(*part, *keys).orderBy(*order)
    return (
        rows.withColumn("_rn", F.row_number().over(local))
        .join(sizes, [*part, *keys])
        .withColumn(name, (F.col("_before") + F.col("_rn") - 1).cast("bigint"))
        .drop("_rn", "_before", *keys)
    )


def middle_row(df: DataFrame, group: list[str], levels: list[dict[str, Column]]) -> DataFrame:
    """The row at 0-based place ``n div 2`` of every group.

    ``levels`` refine the order step by step.  Each level counts its distinct keys per group, keeps
    the key that contains the wanted place, and passes the rest of the place on; copies collapse at
    the first level, so a group of any size is narrowed by counting and not by sorting.
    """
    want = df.groupBy(*group).agg(F.floor(F.count("*") / 2).cast("bigint").alias("_k"))
    rows = df
    for level in levels:
        keys = list(level)
        rows = rows.withColumns(level)
        w = Window.partitionBy(*group).orderBy(*keys)
        counts = rows.groupBy(*group, *keys).agg(F.count("*").alias("_n"))
        counts = counts.withColumn("_upto", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        want = (
            counts.join(want, group)
            .filter((F.col("_k") < F.col("_upto")) & (F.col("_k") >= F.col("_upto") - F.col("_n")))
            .withColumn("_k", F.col("_k") - F.col("_upto") + F.col("_n"))
            .select(*group, *keys, "_k")
        )
        rows = rows.join(want.drop("_k"), [*group, *keys]).drop(*keys)
        want = want.select(*group, "_k")
    return rows


def run_numbers(rows: DataFrame, value: str, partition: list[str], line: str = "line_no", chunk: int = 1_000_000) -> DataFrame:
    """Adds ``run``: which run of equal neighbours in ``value`` a row belongs to, from 1, in the order of ``line``.

    Equal values that others part are different runs; a null is a value like others.  Lines are compared within
    chunks of ``chunk`` numbers, and a chunk hands over its last value and its number of runs.
    """
    binned = rows.withColumns({"bin": F.floor(F.col(line) / chunk).cast("bigint"), "_v": F.struct(F.col(value).alias("x"))})
    order = [F.col(line)]
    seen, local, carry = running(binned, partition, order, last_known, F.col("_v"), own=False)
    before = F.coalesce(local, carry)
    new = (before.isNull() | ~before["x"].eqNullSafe(F.col(value))).cast("bigint")
    seen = seen.withColumn("_new", new).drop(local, carry, "_v")
    seen, local, carry = running(seen, partition, order, F.sum, F.col("_new"), own=True)
    run = F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return seen.withColumn("run", run.cast("bigint")).drop(local, carry, "_new", "bin")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
