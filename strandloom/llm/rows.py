"""Taking decisions on rows back to the table they came from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def text_key(text_col: str) -> Column:
    """A hash of the exact text; null and empty texts have keys of their own."""
    return F.when(F.col(text_col).isNull(), F.lit(-1).cast("bigint")).otherwise(F.xxhash64(F.col(text_col).cast("string")))


def without(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that ``decided`` (``doc_id, text_key, kept``, a row for each) drops.

    A row is found again by its id and text.  Where rows that repeat both are kept and dropped, one of them
    stays, the smallest by its other columns.  All columns come back as they were.
    """
    cols = docs.columns
    simple = [n for n, t in docs.dtypes if not t.startswith(("map", "variant"))]
    keys = lambda df: df.select(F.col("doc_id").alias("__id__"), F.col("text_key").alias("__key__")).distinct()
    dropped, kept = keys(decided.filter(~F.col("kept"))), keys(decided.filter("kept"))
    both = dropped.join(kept.select(F.col("__id__").alias("__k__"), F.col("__key__").alias("__t__")), F.col("__id__").eqNullSafe(F.col("__k__")) & (F.col("__key__") == F.col("__t__")), "left_semi")
    keyed = docs.withColumns({"__i__": F.col(id_col).cast("bigint"), "__x__": text_key(text_col)})
    same = F.col("__i__").eqNullSafe(F.col("__id__")) & (F.col("__x__") == F.col("__key__"))
    rest = keyed.join(dropped, same, "left_anti").select(*cols)
    once = keyed.join(both, same, "left_semi").groupBy("__i__", "__x__")
    once = once.agg(F.min_by(F.struct(*cols), F.struct(*simple)).alias("__row__")).select("__row__.*")
    return rest.unionByName(once)


#: Rates and points of a sample are parts of this.
POINTS = 1 << 20


def sample_rate(most: int, n: int) -> int:
    return int(POINTS * min(1.0, most / max(1, n)))


def sampled(rows: DataFrame, groups: DataFrame, rate: Column, seed: int) -> DataFrame:
    """``rows`` at a rate by the hash of ``doc_id``, with the columns of ``groups`` but ``n`` and ``m``.

    ``groups`` (``doc_id, n, m``, ...) tells how many rows an id has and how often each counts.  An id of one row
    is in or out; of an id that many rows share, as many are taken as the rate gives, picked by row number.
    So the sample is as large as the rate says whatever the ids are, and the picked ids are as few as its rows.
    """
    point = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(POINTS))
    most = F.floor((F.col("n").cast("double") * F.col("m") * rate + F.lit(POINTS - 1) - point) / F.lit(float(POINTS)))
    picked = groups.withColumn("_most", most).filter("_most > 0").withColumnRenamed("doc_id", "_id")
    row = F.pmod(F.xxhash64(F.monotonically_increasing_id(), F.lit(seed)), F.lit(POINTS)) / F.lit(float(POINTS))
    met = rows.withColumn("_row", row).join(F.broadcast(picked), F.col("doc_id").eqNullSafe(F.col("_id")))
    times = F.floor(F.col("_most") / F.col("n") + F.col("_row")).cast("int")
    return met.withColumn("_times", F.explode(F.array_repeat(F.lit(0), times))).drop("_id", "_most", "_row", "_times", "n", "m")
