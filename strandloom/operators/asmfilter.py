"""Support of calls by the assembly alignments of their own reads.

Reads of calls are kept in long form (one row per read), so a call with very many reads is many rows
and never one array.  Only the evidence of a read, which is bounded, travels as an array to the calls of the read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions.typing import (
    FLAG_TRANSLOCATED,
    canonical_id,
    length_class,
    lengths_agree,
    type_flag,
)
from strandloom.operators.compare import SHAPE, reportable, select_reportable
from strandloom.operators.ordinals import union_all
from strandloom.operators.regions import flag_inside
from strandloom.params import CompareParams

KEY = ["file_id", "line_no", "svid", *SHAPE]


LENGTH_STEP = 0.2
MAX_BUCKET_RATIO = 0.8


def compact_evidence(evidence: DataFrame, ratio: float, *by: str) -> DataFrame:
    """Evidence per read (and ``by``) as shortest and longest length in each (flag, length bucket).

    A bucket spans a factor of about 1.2 on ``length + 1000`` and is narrower than every interval of
    lengths that ``lengths_agree`` accepts up to this ratio, so an accepted length exists in a bucket
    exactly when its shortest or its longest is accepted.  A read thus keeps a bounded number of
    rows however much evidence it has.  For stricter ratios every length is its own bucket.
    """
    size = F.col("abs_len")
    bucket = F.floor(F.log(size + 1000) / F.lit(LENGTH_STEP)) if ratio <= MAX_BUCKET_RATIO else size
    return evidence.groupBy(F.col("read").alias("e_read"), F.col("flag").alias("e_flag"), bucket.alias("e_bucket"), *by).agg(
        F.min(size).alias("e_lo"), F.max(size).alias("e_hi")
    )


def _supports(p: CompareParams, f: Column, n: Column, ef: Column, lo: Column, hi: Column) -> Column:
    """A bucket of evidence of a read (``ef, lo, hi``) backs a call with flag ``f`` and length ``n``."""
    local = f.isin(1, 2, 4)
    similar = lengths_agree(lo, n, p.min_len_ratio) | lengths_agree(hi, n, p.min_len_ratio)
    swapped = ((f == 1) & (ef == 2)) | ((f == 2) & (ef == 1))
    return (
        ((f == FLAG_TRANSLOCATED) & (ef == FLAG_TRANSLOCATED))
        | (local & (n >= 100_000) & (ef == FLAG_TRANSLOCATED))
        | ((f.bitwiseAND(ef) != 0) & similar)
        | (((f == 0) | (ef == 0)) & similar)
        | (swapped & (n + lo <= 1000))
    )


def _class() -> dict[str, Column]:
    return {"flag": type_flag(F.col("svtype"), F.col("ctg"), F.col("ctg2")), "abs_len": F.abs("svlen")}


def _with_reads(calls: DataFrame, call_reads: DataFrame) -> DataFrame:
    """Distinct (call, read) rows."""
    shared = ["file_id"] if "file_id" in call_reads.columns else []
    reads = call_reads.select(*shared, F.col("svid").alias("clean_id"), "read").distinct()
    return calls.withColumns({"clean_id": canonical_id(F.col("svid")), **_class()}).join(reads, [*shared, "clean_id"])


def _by_read(evidence: dict[str, DataFrame], ratio: float) -> DataFrame:
    """A row per read: ``e_read``, ``named`` (a bit per category that has the read) and ``ends``, its compacted evidence.

    Bits of categories with the same evidence are united.  All steps happen where the read is.
    """
    rows = [ev.select("read", "flag", "abs_len", F.lit(1 << i).cast("bigint").alias("mask")) for i, ev in enumerate(evidence.values())]
    ends = compact_evidence(union_all(rows).filter("read is not null").repartition("read"), ratio, "mask")
    if len(rows) > 1:
        ends = ends.groupBy("e_read", "e_flag", "e_lo", "e_hi").agg(F.bit_or("mask").alias("mask"))
    return ends.groupBy("e_read").agg(F.bit_or("mask").alias("named"), F.collect_list(F.struct("e_flag", "e_lo", "e_hi", "mask")).alias("ends"))


def _supported(
    calls: DataFrame, call_reads: DataFrame, evidence: dict[str, DataFrame], p: CompareParams, strict: Column | None, more: dict[str, Column] | None = None
) -> DataFrame:
    """Calls with ``clean_id`` and for category i its reads with like evidence (``_t{i}``) and its reads seen at all (``_n{i}``).

    ``more`` columns are derived where the calls of an id are together.

    Evidence meets the reads first and goes on with them to the calls, so a read moves twice and a call once; calls are
    counted where their id is.  calls that are ``strict`` are refused if their id is not in the read table, unless their key has an unknown.
    """
    shared = ["file_id"] if "file_id" in call_reads.columns else []
    reads = call_reads.select(*[F.col(c).alias("_r_" + c) for c in shared], F.col("svid").alias("_r_id"), "read")
    reads = (reads if strict is not None else reads.filter("read is not null")).repartition("read").distinct()
    met = reads.join(_by_read(evidence, p.min_len_ratio), F.col("read") == F.col("e_read"), "inner" if strict is None else "left")
    met = met.select(*["_r_" + c for c in shared], "_r_id", F.col("read").isNotNull().alias("_listed"), "named", "ends")
    # A number keeps equal rows apart; it need not be the same in another run.
    rows = calls.withColumns({"clean_id": canonical_id(F.col("svid")), "_row": F.monotonically_increasing_id()}).repartition("clean_id")
    rows = rows.withColumns({**_class(), **(more or {})})
    cond = F.col("clean_id") == F.col("_r_id")
    for c in shared:  # not as an equality: it would be a key to move all rows by, and they are in place by their id
        cond = cond & (F.col(c) <= F.col("_r_" + c)) & (F.col(c) >= F.col("_r_" + c))
    rows = rows.join(met, cond, "left")
    zero = F.lit(0).cast("bigint")
    backs = lambda e: _supports(p, F.col("flag"), F.col("abs_len"), e["e_flag"], e["e_lo"], e["e_hi"])
    bits = {"named": F.col("named"), "typed": F.aggregate("ends", zero, lambda found, e: found.bitwiseOR(F.when(backs(e), e["mask"]).otherwise(zero)))}
    if strict is not None:
        none = F.raise_error(F.concat(F.lit("no reads listed for "), F.col("svid"))).cast("bigint")
        bits = {k: F.when(F.coalesce("_listed", F.lit(False)) | ~(strict & _known_key()), v).otherwise(none) for k, v in bits.items()}
    has = lambda c, i: F.count_if(F.col(c).bitwiseAND(F.lit(1 << i)) != 0)
    counts = [has(c, i).alias(f"_{c[0]}{i}") for i in range(len(evidence)) for c in ("typed", "named")]
    own = list(dict.fromkeys([*calls.columns, "clean_id", *(more or {})]))
    return rows.withColumns(bits).groupBy(*own, "_row").agg(*counts).drop("_row")


def _known_key() -> Column:
    return reduce(Column.__and__, [F.col(c).isNotNull() for c in KEY])


def _whole_key(count: Column) -> Column:
    """The count, or 0 for a call with an unknown in its key."""
    return F.when(_known_key(), count).otherwise(0).cast("bigint")


def typed_support(
    calls: DataFrame, call_reads: DataFrame, evidence: DataFrame, p: CompareParams, strict: bool = False
) -> DataFrame:
    """Calls with ``asm_name_support`` (reads seen at all) and ``asm_support`` (reads with like evidence).

    Calls of one key count the reads of all of them.
    """
    return _typed(calls, call_reads, evidence, p, strict).select(*calls.columns, "asm_support", "asm_name_support")


def counted_support(calls: DataFrame, call_reads: DataFrame, evidence: DataFrame, p: CompareParams, strict: bool = False) -> DataFrame:
    """``typed_support`` with ``copies``, the calls of the same key, or 1 if the key has an unknown."""
    rows = _typed(calls, call_reads, evidence, p, strict).withColumn("copies", F.greatest(_whole_key(F.col("copies")), F.lit(1)).cast("bigint"))
    return rows.select(*calls.columns, "asm_support", "asm_name_support", "copies")


def _typed(calls: DataFrame, call_reads: DataFrame, evidence: DataFrame, p: CompareParams, strict: bool) -> DataFrame:
    """``typed_support`` with ``clean_id``, by which its rows lie, and ``copies``, the number of calls of the same key."""
    copies = {"copies": F.count("*").over(Window.partitionBy("clean_id", *KEY))}
    rows = _supported(calls, call_reads, {"": evidence}, p, F.lit(True) if strict else None, copies)
    counts = {n: _whole_key(F.col(c) * F.col("copies")) for n, c in (("asm_support", "_t0"), ("asm_name_support", "_n0"))}
    return rows.withColumns(counts).drop("_t0", "_n0")


def category_support(
    calls: DataFrame, call_reads: DataFrame, evidence: dict[str, DataFrame], p: CompareParams, strict: bool = False
) -> DataFrame:
    """Calls with ``support``: per category a struct of ``category, asm_support, asm_name_support``.

    All categories meet the reads in one join, as bits of the evidence that they share.
    """
    return _by_category(calls, call_reads, evidence, p, F.lit(True) if strict else None).select(*calls.columns, "support")


def _by_category(calls: DataFrame, call_reads: DataFrame, evidence: dict[str, DataFrame], p: CompareParams, strict: Column | None) -> DataFrame:
    """``category_support`` with ``clean_id``, by which its rows lie."""
    if len(evidence) > 63:
        raise ValueError("at most 63 categories")
    rows = _supported(calls, call_reads, evidence, p, strict)
    count = lambda c, i: _whole_key(F.col(f"_{c}{i}"))
    each = [F.struct(F.lit(n).alias("category"), count("t", i).alias("asm_support"), count("n", i).alias("asm_name_support")) for i, n in enumerate(evidence)]
    return rows.withColumn("support", F.array(*each))


def supported_categories(
    calls: DataFrame, call_reads: DataFrame, evidence: dict[str, DataFrame], p: CompareParams, bed: DataFrame | None = None, strict: bool = False
) -> DataFrame:
    """Calls with ``_categories``, the names of those in which a reportable call of their canonical id is supported.

    Support is that of ``category_support`` and the minimum that of ``supported_ids``; calls of an id meet where
    they were counted.
    """
    flagged = calls.withColumn("_in", F.lit(True)) if bed is None else flag_inside(calls, bed, KEY).withColumnRenamed("in_bed", "_in")
    flagged = flagged.withColumn("_rep", F.coalesce(reportable(p) & F.col("_in"), F.lit(False))).drop("_in")
    rows = _by_category(flagged, call_reads, evidence, p, F.col("_rep") if strict else None)
    enough = lambda s: F.least(s["asm_support"], s["asm_name_support"], F.col("count")) >= p.min_count
    mask = F.lit(0).cast("bigint")
    for i in range(len(evidence)):
        mask = mask.bitwiseOR(F.when(F.col("_rep") & enough(F.col("support")[i]), F.lit(1 << i)).otherwise(0).cast("bigint"))
    of_id = F.bit_or("_mask").over(Window.partitionBy("clean_id", "file_id"))
    rows = rows.withColumn("_mask", mask).withColumn("_mask", F.when(F.col("clean_id").isNotNull() & F.col("file_id").isNotNull(), of_id).otherwise(0))
    names = [F.when(F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(evidence)]
    return rows.select(*calls.columns, F.array_compact(F.array(*names)).alias("_categories"))


def read_lists(calls: DataFrame, call_reads: DataFrame, evidence: DataFrame, p: CompareParams) -> DataFrame:
    """Calls with ``orig_reads`` and ``asm_reads``, for text rows: names of all reads and of those with like evidence.

    The names of a call become one text only here, where its row is written; operators keep (call, read) rows.
    """
    reads = _with_reads(calls, call_reads).select(*KEY, "flag", "abs_len", "read")
    ev = compact_evidence(evidence, p.min_len_ratio)
    like = _supports(p, *map(F.col, ("flag", "abs_len", "e_flag", "e_lo", "e_hi")))
    backed = reads.join(ev, (F.col("read") == F.col("e_read")) & like, "left_semi")
    text = lambda d, name: d.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_set("read")), ",").alias(name))
    return calls.join(text(reads, "orig_reads"), KEY, "left").join(text(backed, "asm_reads"), KEY, "left")


def support_stats(
    calls: DataFrame,
    call_reads: DataFrame,
    evidence: DataFrame,
    p: CompareParams,
    bed: DataFrame | None = None,
    consensus_ids: DataFrame | None = None,
    strict: bool = True,
) -> DataFrame:
    """One row per reportable call: its class, place, and support numbers."""
    rows = _typed(select_reportable(calls, p, bed), call_reads, evidence, p, strict).select(*calls.columns, "asm_support", "asm_name_support", "clean_id")
    if consensus_ids is None:
        rows = rows.withColumn("is_consensus", F.lit(True))
    else:
        ids = consensus_ids.select(F.col("svid").alias("clean_id")).distinct().withColumn("is_consensus", F.lit(True))
        rows = rows.join(ids, "clean_id", "left").withColumn(
            "is_consensus", F.coalesce("is_consensus", F.lit(False))
        )
    return rows.withColumn("svlen_range", length_class(F.abs("svlen")))


def supported_ids(stats: DataFrame, p: CompareParams, names_only: bool = False) -> DataFrame:
    """Canonical ids of calls whose support and own count reach the minimum."""
    enough = (F.col("asm_name_support") >= p.min_count) & (F.col("count") >= p.min_count)
    if not names_only:
        enough = enough & (F.col("asm_support") >= p.min_count)
    keys = ["file_id", "clean_id"] if "file_id" in stats.columns else ["clean_id"]
    return stats.filter(enough).select(*keys).distinct()


def supported_calls(calls: DataFrame, stats: DataFrame, p: CompareParams, names_only: bool = False) -> DataFrame:
    """Calls, of any row of the input, whose canonical id is supported."""
    rows = calls.withColumn("clean_id", canonical_id(F.col("svid")))
    return rows.join(supported_ids(stats, p, names_only), ["file_id", "clean_id"], "left_semi").drop("clean_id")


def supported_lines(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """Header lines and the records with a supported id, untouched, with their line numbers."""
    ident = F.when(F.col("line").contains("avg_mapq"), F.col("line_no").cast("string")).otherwise(
        F.get(F.split("line", "\t"), F.lit(2))
    )
    head = lines.filter(F.col("line").startswith("#"))
    body = lines.filter(~F.col("line").startswith("#")).withColumn("clean_id", canonical_id(ident))
    keep = ids.select("clean_id").distinct()
    return head.unionByName(body.join(keep, "clean_id", "left_semi").drop("clean_id"))


def name_support(call_reads: DataFrame, asm_reads: DataFrame, key: list[str]) -> DataFrame:
    """Distinct reads per call, and how many of them occur in the assembly alignments at all."""
    reads = call_reads.select(*key, "read").distinct()
    seen = asm_reads.select("read").distinct().withColumn("_seen", F.lit(1))
    return reads.join(seen, "read", "left").groupBy(*key).agg(
        F.count("read").alias("n_names"), F.count("_seen").alias("n_asm_names")
    )


def tumor_only(rows: DataFrame, tumor: str = "tumor_dv", normal: str = "normal_dv", min_tumor: int = 1) -> DataFrame:
    """Rows with variant reads in the tumor column and none (0 or NA) in the normal column."""
    none = (F.col(normal) == "NA") | (F.col(normal).try_cast("bigint") == 0)
    return rows.filter((F.col(tumor).try_cast("bigint") >= min_tumor) & none)
