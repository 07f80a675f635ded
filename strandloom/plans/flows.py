"""End-to-end calling flows, composed from the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strandloom.operators.asmfilter import category_support, supported_categories
from strandloom.operators.compare import select_reportable
from strandloom.operators.intersect import intersect
from strandloom.operators.merge import merge_signals, only_sources
from strandloom.operators.union import CATEGORY, combinations_of, grouped, median_rows, rows_of
from strandloom.functions.typing import canonical_id, length_class
from strandloom.params import CompareParams, MergeParams, UnionParams
from strandloom.session import written


def germline_calls(signals: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """One linear reference: cluster and filter."""
    return merge_signals(signals, p)


def somatic_calls(
    tumor: DataFrame, tumor_filters: list[DataFrame], normal: DataFrame,
    tumor_name: str = "TUMOR", normal_name: str = "NORMAL", window: int = 1000, p: MergeParams = MergeParams(),
) -> DataFrame:
    """Tumor signals that recur in every filter, clustered with the normal, seen in the tumor only."""
    kept = intersect(tumor, tumor_filters, window)
    return only_sources(merge_signals(kept.unionByName(normal), p), tumor_name, normal_name)


def mosaic_calls(
    signals: DataFrame, filters: list[DataFrame], window: int = 1000,
    p: MergeParams = MergeParams(min_count=2, min_count_strand=0),
) -> DataFrame:
    """Signals of one sample that recur in every filter, clustered with a low read bound."""
    return merge_signals(intersect(signals, filters, window), p)


def reads_of_calls(calls: DataFrame, call_reads: DataFrame, p: CompareParams, bed: DataFrame | None = None) -> DataFrame:
    """Distinct names of the reads behind reportable calls: what has to be realigned."""
    ids = select_reportable(calls, p, bed).select("file_id", canonical_id(F.col("svid")).alias("svid"))
    return call_reads.join(ids, ["file_id", "svid"], "left_semi").select("read").distinct()


def cross_reference_filter(
    calls: DataFrame,
    call_reads: DataFrame,
    evidence: dict[str, DataFrame],
    cutoffs: range,
    compare: CompareParams = CompareParams(),
    bed: DataFrame | None = None,
    strict: bool = True,
) -> DataFrame:
    """Calls of every caller kept per evidence category and cutoff.

    Support is computed once for all categories and does not depend on the cutoff: a call is kept up to the
    smallest of its three counts.  A call whose reads are not listed is an error, or without ``strict`` unsupported.
    """
    rows = category_support(select_reportable(calls, compare, bed), call_reads, evidence, compare, strict)
    rows = rows.withColumns({"clean_id": canonical_id(F.col("svid")), "is_consensus": F.lit(True), "svlen_range": length_class(F.abs("svlen"))})
    rows = rows.withColumn("_s", F.explode("support")).drop("support").select("*", "_s.*").drop("_s")
    most = F.least("asm_support", "asm_name_support", "count")
    kept = F.filter(F.array(*[F.lit(c) for c in cutoffs]), lambda c: c <= most)
    return rows.withColumn("cutoff", F.explode(kept))


def category_unions(
    calls: DataFrame, call_reads: DataFrame, evidence: dict[str, DataFrame], cutoff: int,
    compare: CompareParams = CompareParams(), p: UnionParams = UnionParams(), bed: DataFrame | None = None,
    n_callers: int | None = None, strict: bool = True, parts: tuple[str, ...] = ("rows", "combinations", "dedup"),
) -> dict[str, dict[str, DataFrame]]:
    """Per category the union of all callers, or of the first ``n_callers``: rows, combination counts and one row
    per group.  ``l_only`` is the union of the calls with ``cutoff`` reads, without evidence.  A call is kept by its
    canonical id, whichever of its records is supported; support of all categories comes from one join.  Calls of all
    categories move together to be grouped, and only the ``parts`` asked for are made.
    """
    if n_callers is None:
        n_callers = (calls.agg(F.max("file_id")).first()[0] or 0) + 1
    enough = CompareParams(**{**compare.__dict__, "min_count": cutoff})
    kept = supported_categories(calls, call_reads, evidence, enough, bed, strict)
    plain = F.when((F.col("count") <= 0) | (F.col("count") >= cutoff), F.array(F.lit("l_only"))).otherwise(F.array().cast("array<string>"))
    kept = kept.withColumn("_categories", F.when(F.col("file_id") < n_callers, F.concat(plain, "_categories")))
    placed = grouped(written(kept.filter("size(_categories) > 0")), p, bed, categories=F.col("_categories"))
    placed = placed if parts == ("combinations",) else written(placed)
    counts = written(combinations_of(placed, n_callers, p)) if "combinations" in parts else None
    out = {}
    for name in ["l_only", *evidence]:
        mine = lambda d: d.filter(F.col(CATEGORY) == name).drop(CATEGORY)  # noqa: B023, E731
        out[name] = {} if counts is None else {"combinations": mine(counts)}
        if "rows" in parts or "dedup" in parts:
            rows = rows_of(mine(placed).drop("_categories"), p)
            out[name] |= {"rows": rows} | ({"dedup": median_rows(rows)} if "dedup" in parts else {})
    return out
