"""Type, length and identity rules for signals and calls, each one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Evidence classes of a type, combined with bitwise AND.
FLAG_GAIN, FLAG_LOSS, FLAG_INVERTED, FLAG_TRANSLOCATED = 1, 2, 4, 8

# Size bins, both bounds inclusive, first match wins.
SIZE_BINS = [
    (50, 100, "50-100"),
    (100, 500, "100-500"),
    (500, 1000, "500-1000"),
    (1000, 10000, "1k-10k"),
    (10000, 20000, "10k-20k"),
    (20000, 100000, "20k-100k"),
    (100000, None, ">100k"),
]

# VCF-independent length classes, lower bound inclusive.
LENGTH_CLASSES = [
    (1_000_000, ">1M"),
    (100_000, "100kb-1M"),
    (20_000, "20kb-100kb"),
    (100, "100bp-20kb"),
]


def type_flag(svtype: Column, ctg: Column, ctg2: Column) -> Column:
    """Evidence class; a breakend counts only between contigs, everything else is 0."""
    return (
        F.when(svtype.isin("INS", "DUP"), FLAG_GAIN)
        .when(svtype == "DEL", FLAG_LOSS)
        .when(svtype == "INV", FLAG_INVERTED)
        .when((svtype == "BND") & (ctg != ctg2), FLAG_TRANSLOCATED)
        .otherwise(0)
        .cast("int")
    )


def length_class(abs_len: Column) -> Column:
    out = F.when(abs_len == 0, "translocation")
    for low, name in LENGTH_CLASSES:
        out = out.when(abs_len >= low, name)
    return out.otherwise("<100bp")


def size_bin(abs_len: Column, same_contig: Column) -> Column:
    """Reporting bin; calls between contigs count as the largest bin, short ones have none."""
    out = F.when(~same_contig, SIZE_BINS[-1][2])
    for low, high, name in SIZE_BINS:
        inside = abs_len >= low
        out = out.when(inside if high is None else inside & (abs_len <= high), name)
    return out


#: How an id of each style begins, what stands before the end's number, and the numbers of the ends.
PAIRED_IDS = [("^severus", "", "12"), ("^ID_", r"ID_\d+", "12"), ("^[rid]_", r"r_\d+", "01")]


def canonical_id(svid: Column) -> Column:
    """One id for both ends of a paired record, by the id style of the caller.

    The ends are ``_1`` and ``_2`` behind the number, or ``_0`` and ``_1`` in the styles of one letter, where only
    ``r_`` records are pairs.
    """
    out = svid
    for style, number, ends in reversed(PAIRED_IDS):
        out = F.when(svid.rlike(style), F.regexp_replace(svid, f"({number})_[{ends}]", "$1")).otherwise(out)
    return out


def split_read_type(
    ctg0: Column,
    pos0: Column,
    ql0: Column,
    ctg1: Column,
    pos1: Column,
    ql1: Column,
    ori: Column,
    qgap: Column,
    min_len: int,
) -> Column:
    """Type a pair of adjacent split alignments.

    Returns ``struct<svtype, svlen, region_st, region_en, tsd_len>``; untyped pairs are breakends
    with null length.  ``span`` is the inclusive reference distance, ``qgap`` the query distance.
    """
    span = pos1 - pos0 + 1
    none = F.lit(None).cast("bigint")

    def out(svtype: str, svlen=none, st=none, en=none, tsd=none) -> Column:
        return F.struct(
            F.lit(svtype).alias("svtype"),
            svlen.cast("bigint").alias("svlen"),
            st.cast("bigint").alias("region_st"),
            en.cast("bigint").alias("region_en"),
            tsd.cast("bigint").alias("tsd_len"),
        )

    # The region shrinks on the left and grows on the right by a query overlap.
    ov = F.least(qgap, F.lit(0))
    gap = F.greatest(qgap, F.lit(0))
    st_ov, en_ov = pos0 + ov, pos1 + 1 - ov
    short_side = (span < ql0) | (span < ql1)
    long_gain = qgap + span >= min_len
    return (
        F.when(ctg0 != ctg1, out("BND"))
        .when(
            (ori == ">>") & (qgap < span) & (span - qgap >= min_len),
            out("DEL", qgap - span, st_ov, en_ov, -ov),
        )
        .when(
            (ori == ">>") & (span < qgap) & (qgap - span >= min_len),
            out("INS", qgap - span, pos0, pos1 + 1),
        )
        .when(
            (ori == "<<") & (qgap > 0) & short_side & long_gain,
            out("INS", qgap + span, pos0, pos1 + 1, span),
        )
        .when(
            (ori == "<<") & long_gain,
            out("DUP", qgap + span, F.greatest(pos0 - gap, F.lit(0)), pos1 + 1 + gap),
        )
        .when(ori.isin("<>", "><") & (span >= min_len), out("INV", span - qgap, st_ov, en_ov))
        .otherwise(out("BND"))
    )


Side = Callable[[str], Column]


def lengths_agree(a: Column, b: Column, ratio: float) -> Column:
    """Absolute lengths within 1000 of each other, or each at least ``ratio`` of the other."""
    return (F.abs(a - b) <= 1000) | ((a >= b * F.lit(ratio)) & (b >= a * F.lit(ratio)))


def _near(t: Column, b: Column, w: int) -> Column:
    return (t >= b - w) & (t <= b + w)


def gain_pair(b: Side, t: Side) -> Column:
    """An insertion against a duplication: compared by the first end only."""
    return ((b("svtype") == "INS") & (t("svtype") == "DUP")) | (
        (b("svtype") == "DUP") & (t("svtype") == "INS")
    )


def types_and_lengths_agree(b: Side, t: Side, ratio: float) -> Column:
    """The part of the same-call rule that does not look at coordinates."""
    any_bnd = (b("svtype") == "BND") | (t("svtype") == "BND")
    by_type = (b("svtype") == t("svtype")) | gain_pair(b, t)
    return any_bnd | (by_type & lengths_agree(F.abs(b("svlen")), F.abs(t("svlen")), ratio))


def straight_match(b: Side, t: Side, w: int) -> Column:
    return (
        (t("ctg") == b("ctg"))
        & _near(t("pos"), b("pos"), w)
        & (t("ctg2") == b("ctg2"))
        & _near(t("pos2"), b("pos2"), w)
    )


def crossed_match(b: Side, t: Side, w: int) -> Column:
    return (
        (t("ctg") == b("ctg2"))
        & _near(t("pos"), b("pos2"), w)
        & (t("ctg2") == b("ctg"))
        & _near(t("pos2"), b("pos"), w)
    )


def same_call(b: Side, t: Side, w: int, ratio: float) -> Column:
    """Two calls describe the same event."""
    first_end = (t("ctg") == b("ctg")) & _near(t("pos"), b("pos"), w)
    any_bnd = (b("svtype") == "BND") | (t("svtype") == "BND")
    where = (
        F.when(gain_pair(b, t), first_end)
        .when(any_bnd, straight_match(b, t, w) | crossed_match(b, t, w))
        .otherwise(straight_match(b, t, w))
    )
    return types_and_lengths_agree(b, t, ratio) & where
