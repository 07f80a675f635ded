"""Keep signals that recur on the same read in every other alignment: chained interval semi joins.

The join key is (read, query bin), so one read that holds much of the data is spread over its query
offsets, and the other side is reduced to distinct intervals before it is shuffled.  Base rows are
never replicated: a base row looks into the bin of its start, and the other side is replicated over
every bin from which it could be seen.  That covers base intervals up to one bin long; longer ones
are matched through their distinct intervals instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.functions.typing import FLAG_TRANSLOCATED, type_flag

BIN = 16_384


def with_evidence_class(signals: DataFrame) -> DataFrame:
    """Adds ``flag``; rows without query offsets cannot be intersected and are refused."""
    ok = (F.col("qoff_l") >= 0) & (F.col("qoff_r") >= 0) & F.col("svtype").isNotNull()
    flag = type_flag(F.col("svtype"), F.col("ctg"), F.coalesce("ctg2", "ctg"))
    return signals.withColumn(
        "flag",
        F.when(F.coalesce(ok, F.lit(False)), flag).otherwise(
            F.raise_error(F.lit("signal without type or query offsets")).cast("int")
        ),
    )


def _intervals(signals: DataFrame, prefix: str = "") -> DataFrame:
    rows = with_evidence_class(signals)
    return rows.select(
        *[F.col(c).alias(prefix + c) for c in ("read", "qoff_l", "qoff_r", "flag")]
    ).distinct()


def _compatible(window: int) -> Column:
    """Query intervals closer than ``window``, and evidence of a related type.

    Overlap is strict on both sides; an untyped base row and a translocation in the other alignment
    are compatible with everything.
    """
    near = (F.col("qoff_l") - window < F.col("a_qoff_r")) & (F.col("a_qoff_l") < F.col("qoff_r") + window)
    typed = (
        (F.col("flag") == 0)
        | (F.col("flag").bitwiseAND(F.col("a_flag")) != 0)
        | (F.col("a_flag") == FLAG_TRANSLOCATED)
    )
    return (F.col("read") == F.col("a_read")) & (F.col("bin") == F.col("a_bin")) & near & typed


def _bin(c: Column) -> Column:
    return F.floor(c / F.lit(BIN)).cast("bigint")


def intersect(base: DataFrame, others: list[DataFrame], window: int = 1000) -> DataFrame:
    """Base rows that have a compatible signal on the same read in every table of ``others``."""
    rows = with_evidence_class(base)
    # A reversed interval has its length counted as zero; its reach is still covered below.
    is_long = F.col("qoff_r") - F.col("qoff_l") > BIN
    short = rows.filter(~is_long).withColumn("bin", _bin(F.col("qoff_l")))
    for other in others:
        short = short.join(
            _intervals(other, "a_").withColumn(
                "a_bin",
                F.explode(
                    F.sequence(
                        _bin(F.col("a_qoff_l") - window - BIN),
                        F.greatest(
                            _bin(F.col("a_qoff_r") + window), _bin(F.col("a_qoff_l") - window - BIN)
                        ),
                    )
                ),
            ),
            _compatible(window),
            "left_semi",
        )
    key = ["read", "qoff_l", "qoff_r", "flag"]
    probes = rows.filter(is_long).select(*key).distinct()
    for other in others:
        spread = lambda lo, hi: F.explode(F.sequence(_bin(lo), _bin(hi)))
        probes = (
            probes.withColumn("bin", spread(F.col("qoff_l") - window, F.col("qoff_r") + window))
            .join(
                _intervals(other, "a_").withColumn(
                    "a_bin", spread(F.col("a_qoff_l"), F.greatest("a_qoff_l", "a_qoff_r"))
                ),
                _compatible(window),
                "left_semi",
            )
            .select(*key)
            .distinct()
        )
    long = rows.filter(is_long).join(probes, key, "left_semi")
    return short.drop("bin", "flag").unionByName(long.drop("flag"))
