"""Command line: ``python -m strandloom.cli COMMAND ...``.

Large results are written as text folders (``-o``); a plain table is printed only for summaries whose
size does not depend on the data.  Without ``-o``, rows stream to stdout partition by partition.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession, functions as F

from strandloom.functions.info import sample_values
from strandloom.functions.typing import canonical_id, length_class
from strandloom.operators import asmfilter, compare, intervals, union as U
from strandloom.operators.chains import hull_distance
from strandloom.operators.extract import extract
from strandloom.operators.haplotypes import haplotype_counts
from strandloom.operators.intersect import intersect
from strandloom.operators.long_indels import alignment_indels, flag_overlap, merge_indels
from strandloom.operators.ordinals import run_numbers
from strandloom.operators.merge import CLUSTER_KEY, assign_clusters, cluster_reads, passes, summarise
from strandloom.operators.views import long_counts, view
from strandloom.params import (
    CallParams,
    CompareParams,
    ExtractParams,
    MergeParams,
    UnionParams,
    parse_size,
    read_level_length,
)
from strandloom.plans.flows import category_unions, cross_reference_filter, reads_of_calls
from strandloom.sources import readids, regions, signals as sig, writers
from strandloom.sources.alignments import read_alignments
from strandloom.sources.calls import read_calls
from strandloom.session import settle
from strandloom.sources.text import read_lines, read_numbered_lines


def _session() -> SparkSession:
    return SparkSession.builder.appName("strandloom").getOrCreate()


def _emit(df: DataFrame, out: str | None, header: list[str] = ()) -> None:
    """Write a ``line`` frame, or stream it."""
    if out:
        df.select("line").write.mode("errorifexists").text(out)
        return
    for h in header:
        print(h)
    for row in df.select("line").toLocalIterator():
        print(row.line)


def _table(df: DataFrame) -> DataFrame:
    """Columns by tabs; nulls are written, so that no column moves."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("NA")) for c in df.columns]
    return df.select(F.concat_ws("\t", *cols).alias("line"))


def _bed(spark: SparkSession, path: str | None) -> DataFrame | None:
    return regions.read_bed(spark, path) if path else None


def _cen(spark: SparkSession, path: str | None) -> DataFrame | None:
    return intervals.merged(regions.read_bed(spark, path)) if path else None


def _calls(spark: SparkSession, paths: list[str], a) -> DataFrame:
    p = CallParams(read_level_length(parse_size(a.l), a.r), a.c, a.F, a.G)
    return settle(read_calls(spark, paths, p))


def _compare(a) -> CompareParams:
    return CompareParams(parse_size(a.l), a.c, parse_size(a.w), a.m, a.v)


def cmd_extract(spark, a):
    p = ExtractParams(
        min_mapq=a.q, min_mapq_end=a.x, min_len=parse_size(a.l), min_frac=a.f, max_indels_per_10kb=a.c,
        polya_penalty=a.a, min_aln_len_end=parse_size(a.e), min_aln_len_mid=parse_size(a.m), source=a.n,
    )
    _emit(writers.signal_lines(extract(read_alignments(spark, a.input, p), p, _cen(spark, a.b))), a.o)


def cmd_isec(spark, a):
    rows = sig.parse_signals(read_lines(spark, a.base), keep_line=True)
    _emit(intersect(rows, [sig.read_signals(spark, f) for f in a.filters], parse_size(a.w)), a.o)


def cmd_merge(spark, a):
    p = MergeParams(a.c, a.s, a.C, a.r, parse_size(a.w), a.d, parse_size(a.e), a.A)
    rows = sig.read_signals(spark, a.input)
    calls = summarise(assign_clusters(rows, p)).filter(passes(p))
    named = cluster_reads(rows, p).join(calls.select(*CLUSTER_KEY), CLUSTER_KEY, "left_semi")
    names = named.groupBy(*CLUSTER_KEY).agg(F.array_join(F.sort_array(F.collect_list("read")), ",").alias("reads"))
    calls = calls.join(names, CLUSTER_KEY).withColumn(
        "foldback",
        (F.col("count_fr") + F.col("count_rf") > 0) & (F.col("count_fr") * F.col("count_rf") == 0)
        & F.coalesce(F.col("ctg") == F.col("ctg2"), F.lit(False)),
    )
    _emit(writers.call_lines(calls), a.o)


def cmd_eval(spark, a):
    p, bed, calls = _compare(a), _bed(spark, a.b), _calls(spark, a.inputs, a)
    of = lambda i: calls.filter(F.col("file_id") == i).drop("file_id").withColumn("file_id", F.lit(i))
    if len(a.inputs) == 2:
        _emit(_table(compare.recall_precision(of(0), of(1), p, bed)), None)
        if a.s:
            _emit(_table(compare.by_size(of(0), of(1), p, bed)), None)
        if a.a or a.e:
            rows = compare.reported_rows(of(0), of(1), p, bed)
            place = ["ctg", "pos", "ori", "ctg2", "pos2", "svtype"]
            at = lambda part: f"{a.o}/{part}" if a.o and a.a and a.e else a.o
            if a.e:
                _emit(_table(rows.filter("n_match = 0").select("label", *place, "svid", "svlen", "n_match")), at("errors"))
            if a.a:
                _emit(_table(rows.select(*place, "svlen", "svid", "n_match")), at("all"))
    elif a.M:
        for i in range(len(a.inputs)):
            _emit(_table(compare.against_consensus(calls, i, p, bed)), None)
    else:
        _emit(_table(compare.shared_matrix(calls, p, bed, len(a.inputs)).orderBy("file_i", "file_j")), None)


def cmd_annot(spark, a):
    p = _compare(a)
    rows = compare.annotate_first(_calls(spark, a.inputs, a), p, _bed(spark, a.b))
    _emit(_table(rows.select("ctg", "pos", "ori", "ctg2", "pos2", "svtype", "svlen", "svid", "n_match")), a.o)


def cmd_view(spark, a):
    # A listing takes the length as given; only comparisons read shorter calls than they report.
    calls = read_calls(spark, a.inputs, CallParams(parse_size(a.l), a.c, a.F, a.G))
    bed = _bed(spark, a.b)
    _emit(_table(long_counts(calls, bed, len(a.inputs)) if a.C else view(calls, bed)), a.o)


def cmd_filterasm(spark, a):
    p, calls = _compare(a), _calls(spark, [a.calls], a)
    ids = readids.read_id_list(spark, a.ids) if a.ids else None
    ev = readids.asm_evidence(sig.read_signals(spark, a.signals))
    stats = asmfilter.support_stats(
        calls, readids.read_read_ids(spark, a.readids), ev, p, _bed(spark, a.b), ids
    )
    if a.a:
        cols = ["svlen", "svlen_range", "svid", "is_consensus", "svtype", "ctg", "pos", "ori", "ctg2", "pos2",
                "asm_support", "asm_name_support", "count"]
        _emit(_table(stats.select(*cols)), a.stat)
    kept = asmfilter.supported_ids(stats, p, a.names_only)
    _emit(asmfilter.supported_lines(read_numbered_lines(spark, a.calls), kept).orderBy("line_no"), a.o)


def _name_filter(spark, a, fmt: str):
    """Name-only support of one call file, without typing.

    Every call gets a stat row, one without listed reads with counts of 0; of paired break ends the first one does.
    """
    lines = read_numbered_lines(spark, a.calls)
    names = readids.read_read_ids(spark, a.readids) if fmt == "severus" else readids.parse_read_ids(lines, fmt)
    names = names.withColumn("svid", canonical_id(F.col("svid")))
    support = asmfilter.name_support(names, sig.read_signals(spark, a.signals), ["svid"])
    body = lines.filter(~F.col("line").startswith("#")).withColumn("f", F.split("line", r"\s+"))
    own = F.col("line_no").cast("string") if fmt == "calls" else F.get("f", F.lit(2))
    body = body.withColumns({"own": own, "svid": canonical_id(own)})
    if fmt == "vcf":
        dv = sample_values(F.col("f"), "DV")
        body = body.withColumns({"tumor_dv": F.get(dv, F.lit(0)), "normal_dv": F.get(dv, F.lit(1))})
        body = asmfilter.tumor_only(body, min_tumor=a.c)
    rows = body.join(support, "svid", "left").fillna(0, ["n_names", "n_asm_names"])
    size = F.coalesce(F.regexp_extract("line", r"\bSVLEN=(-?\d+)", 1).try_cast("bigint"), F.lit(0))
    last = lambda i, k: F.get(F.reverse(F.split(F.get(F.reverse("f"), F.lit(i)), ":")), F.lit(k))
    stat = {"svlen": size, "range": length_class(F.abs(size))}
    counts = {"n_names": F.col("n_names"), "n_asm_names": F.col("n_asm_names")}
    if fmt == "severus":
        known = F.lit("False")
        if a.consensus:
            ids = readids.read_id_list(spark, a.consensus).select(F.col("svid").alias("_id"))
            rows = rows.join(ids, F.col("svid") == F.col("_id"), "left")
            known = F.when(F.col("_id").isNull(), "False").otherwise("True")
        stat |= {"svid": F.col("svid"), "is_consensus": known, "dv": last(0, 0), **counts}
    elif fmt == "vcf":
        reads = F.nullif(F.regexp_extract("line", r"\bSUPPORT=([^;\s]+)", 1), F.lit(""))
        stat |= {"support": F.coalesce(reads, F.lit("0")), "svid": F.col("own"), "n_names": F.col("n_names"), "dv": last(1, 1), "n_asm_names": F.col("n_asm_names")}
    else:
        stat |= counts
    shown = rows.filter(~F.col("own").endswith("_2")) if fmt == "severus" else rows
    shown = shown.select(*[c.alias(n) for n, c in stat.items()]).filter("range != '<100bp'")
    _emit(_table(shown), a.stat)
    head = lines.filter(F.col("line").startswith("#")).select("line_no", "line")
    kept = rows.filter(F.col("n_asm_names") >= a.c).select("line_no", "line")
    _emit(head.unionByName(kept).orderBy("line_no"), a.o)


def cmd_snfpair(spark, a):
    lines = read_numbered_lines(spark, a.calls)
    body = lines.filter(~F.col("line").startswith("#")).withColumn("f", F.split("line", "\t"))
    dv = sample_values(F.col("f"), "DV")
    body = body.withColumns({"tumor_dv": F.get(dv, F.lit(a.t - 1)), "normal_dv": F.get(dv, F.lit(a.n - 1))})
    kept = asmfilter.tumor_only(body).select("line_no", "line")
    head = lines.filter(F.col("line").startswith("#")).select("line_no", "line")
    _emit(head.unionByName(kept).orderBy("line_no"), a.o)


def cmd_vcf(spark, a):
    _emit(writers.patched_vcf(read_numbered_lines(spark, a.input)).orderBy("line_no", "part"), a.o)


def cmd_genvcf(spark, a):
    rows = writers.vcf_records(sig.parse_merged_calls(read_numbered_lines(spark, a.input)))
    head = spark.createDataFrame([("\n".join(writers.VCF_HEADER), 0)], "line string, part int")
    place = F.struct(F.split("line", "\t")[0], F.split("line", "\t")[1].cast("bigint"))
    both = head.select("line", "part", F.lit(None).cast(rows.select(place).schema[0].dataType).alias("at")).unionByName(
        rows.select("line", F.lit(1).alias("part"), place.alias("at"))
    )
    # Files of the folder follow each other: the header first, then records by contig and position.
    ordered = both.repartitionByRange(1, "part", "at") if a.one_file else both.repartitionByRange("part", "at")
    _emit(ordered.sortWithinPartitions("part", "at", "line"), a.o)


def cmd_annotatehp(spark, a):
    lines = read_numbered_lines(spark, a.calls)
    reads = readids.parse_read_ids(lines, "calls").withColumnRenamed("svid", "line_id")
    hp = haplotype_counts(reads, readids.read_haplotypes(spark, a.tags), ["line_id"])
    rows = lines.withColumn("line_id", F.col("line_no").cast("string")).join(hp, "line_id", "left").orderBy("line_no")
    counts = [F.coalesce(F.col(c), F.lit(0)).cast("string") for c in ("hp_none", "hp1", "hp2")]
    _emit(rows.select(F.concat("line", F.lit("\t"), F.concat_ws(",", *counts)).alias("line")), a.o)


def _union_params(a) -> UnionParams:
    return UnionParams(parse_size(a.l), a.g, parse_size(a.w), a.m, getattr(a, "u", False))


def cmd_union(spark, a):
    calls, bed, p = _calls(spark, a.inputs, a), _bed(spark, a.b), _union_params(a)
    if a.p:
        _emit(writers.union_lines(U.union_rows(calls, p, bed)), a.o)
    else:
        _emit(_table(U.combination_counts(calls, len(a.inputs), p, bed, a.unseen).orderBy(F.reverse("label"))), a.o)


def cmd_advunion(spark, a):
    calls = _calls(spark, a.calls, a)
    reads = None
    for i, path in enumerate(a.readids):
        t = readids.read_read_ids(spark, path).withColumn("file_id", F.lit(i))
        reads = t if reads is None else reads.unionByName(t)
    ev = readids.asm_evidence(sig.read_signals(spark, a.signals))
    p = _union_params(a)
    rows = U.supported_union(calls, reads, ev, p, _bed(spark, a.b), strict=True)
    _emit(writers.union_lines(asmfilter.read_lists(rows, reads, ev, CompareParams(min_len_ratio=p.min_len_ratio))), a.o)


def cmd_union_tr(spark, a):
    calls = _calls(spark, a.inputs, a)
    rows = U.union_with_repeats(
        calls, len(a.inputs), regions.read_tandem_repeats(spark, a.repeats),
        regions.read_segmental_duplications(spark, a.segdups), _union_params(a), _bed(spark, a.b),
    )
    _emit(writers.union_lines(rows), a.o)


def cmd_ensembleunion(spark, a):
    rows = sig.parse_union_rows(read_numbered_lines(spark, a.input)).select("file_id", "line_no", "svid", "pos", "pos2", "svtype", "svlen", "group_id", "line")
    rows = run_numbers(rows, "group_id", []).drop("group_id").withColumnRenamed("run", "group_id")
    _emit(U.median_rows(rows, a.drop_last).select(F.concat_ws("\t", "line", "file_ids").alias("line")), a.o)


def cmd_doublestrandbreak(spark, a):
    rows = sig.parse_union_rows(read_numbered_lines(spark, a.input))
    calls, reads = rows.drop("asm_reads", "line"), rows.select("file_id", "line_no", "svid", F.explode("asm_reads").alias("read"))
    cols = ["ctg0", "pos0", "ori0", "ctg1", "pos1", "ori1", "svtype0", "svtype1", "dsb_type"]
    _emit(_table(U.strand_break_pairs(calls, reads).select(*cols)), a.o)
    _emit(_table(U.strand_break_stats(calls, reads)), None)


def cmd_getindel(spark, a):
    files = [(a.input, "tumor_" if a.normal else "")] + ([(a.normal, "normal_")] if a.normal else [])
    rows = None
    for path, tag in files:
        t = alignment_indels(read_alignments(spark, path, ExtractParams(min_mapq=a.m)), a.l, a.max_indels, min_mapq=a.m)
        t = t.withColumn("read", F.concat(F.lit(tag), "read"))
        rows = t if rows is None else rows.unionByName(t)
    merged = merge_indels(rows, a.r, a.m)
    if a.vntr:
        merged = flag_overlap(merged, regions.padded(regions.read_bed(spark, a.vntr)), "in_vntr")
    if a.cent:
        bed = regions.read_bed(spark, a.cent)
        merged = flag_overlap(merged, regions.padded(bed), "in_centromere")
        hulls = regions.hull(bed)
        merged = hull_distance(hull_distance(merged, hulls, "ctg", "st", "cen_dist_st"), hulls, "ctg", "en", "cen_dist_en")
    _emit(_table(merged), a.o)


def cmd_cross_ref(spark, a):
    """The relational part: read names to realign, or categories and unions once signals exist."""
    calls = _calls(spark, a.vcf, a)
    reads = None
    for i, path in enumerate(a.readids):
        t = readids.read_read_ids(spark, path).withColumn("file_id", F.lit(i))
        reads = t if reads is None else reads.unionByName(t)
    p, bed = _compare(a), _bed(spark, a.b)
    if not a.self_signals:
        names = reads_of_calls(calls, reads.withColumn("svid", canonical_id(F.col("svid"))), p, bed)
        _emit(names.select(F.col("read").alias("line")), f"{a.o}/read_names")
        return
    own, graph = sig.read_signals(spark, a.self_signals), sig.read_signals(spark, a.graph_signals)
    both = intersect(graph, [own], parse_size(a.w))
    ev = {n: readids.asm_evidence(d) for n, d in (("l+s", own), ("l+g", graph), ("l+g+s", both))}
    cross_reference_filter(calls, reads, ev, range(a.c, a.uc + 1), p, bed).write.partitionBy("category", "cutoff").parquet(f"{a.o}/kept")
    for name, parts in category_unions(calls, reads, ev, a.uc, p, _union_params(a), bed).items():
        _emit(writers.union_lines(parts["rows"]), f"{a.o}/{name}_union")
        _emit(_table(parts["combinations"].select("label", "n")), f"{a.o}/{name}_union_stat")
        _emit(writers.union_lines(parts["dedup"]), f"{a.o}/{name}_union_dedup")


def _call_options(p, count: int = 0) -> None:
    p.add_argument("-l", default="100", help="minimum length")
    p.add_argument("-c", type=int, default=count, help="minimum read count")
    p.add_argument("-r", type=float, default=0.8, help="read calls longer than length * ratio")
    p.add_argument("-w", default="500", help="window")
    p.add_argument("-m", type=float, default=0.6, help="length ratio")
    p.add_argument("-v", type=float, default=0.0, help="minimum VAF")
    p.add_argument("-b", help="BED of regions")
    p.add_argument("-F", action="store_true", help="ignore FILTER")
    p.add_argument("-G", action="store_true", help="check genotype")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="strandloom")
    subs = top.add_subparsers(dest="command", required=True)

    def command(name, fn, *positional, many=None):
        p = subs.add_parser(name)
        for arg in positional:
            p.add_argument(arg)
        if many:
            p.add_argument(many, nargs="+")
        p.add_argument("-o", help="output folder")
        p.set_defaults(run=fn)
        return p

    for name in ("extract", "getsv"):
        p = command(name, cmd_extract, "input")
        for flag, kind, value in (("-q", int, 5), ("-x", int, 30), ("-l", str, "100"), ("-f", float, 0.7), ("-c", int, 3),
                                  ("-a", int, 5), ("-e", str, "2000"), ("-m", str, "50"), ("-n", str, "foo"), ("-b", str, None)):
            p.add_argument(flag, type=kind, default=value)
    command("isec", cmd_isec, "base", many="filters").add_argument("-w", default="1000")
    p = command("merge", cmd_merge, "input")
    for flag, kind, value in (("-c", int, 4), ("-s", int, 2), ("-C", int, 1), ("-r", int, 0), ("-w", str, "100"),
                              ("-d", float, 0.05), ("-e", str, "500k"), ("-A", int, None)):
        p.add_argument(flag, type=kind, default=value)
    p = command("eval", cmd_eval, many="inputs")
    _call_options(p)
    for flag in ("-M", "-s", "-a", "-e"):
        p.add_argument(flag, action="store_true")
    _call_options(command("annot", cmd_annot, many="inputs"))
    p = command("view", cmd_view, many="inputs")
    _call_options(p)
    p.add_argument("-C", action="store_true")
    p = command("filterasm", cmd_filterasm, "readids", "signals", "stat", "calls")
    _call_options(p)
    p.add_argument("-a", action="store_true")
    p.add_argument("--ids")
    p.add_argument("--names-only", action="store_true")
    for name, fmt in (("filterseverus", "severus"), ("filtersnf", "vcf"), ("filtercalls", "calls")):
        extra = ["readids"] if fmt == "severus" else []
        p = command(name, lambda s, a, f=fmt: _name_filter(s, a, f), "calls", *extra, "signals", "stat")
        p.add_argument("-c", type=int, default=2)
        if fmt == "severus":
            p.add_argument("--consensus", help="ids of consensus calls")
    p = command("snfpair", cmd_snfpair, "calls")
    p.add_argument("-t", type=int, default=1)
    p.add_argument("-n", type=int, default=2)
    command("vcf", cmd_vcf, "input")
    command("genvcf", cmd_genvcf, "input").add_argument("--one-file", action="store_true")
    command("annotatehp", cmd_annotatehp, "tags", "calls")
    p = command("union", cmd_union, many="inputs")
    _call_options(p, 5)
    p.add_argument("-g", type=int, default=5)
    p.add_argument("-p", action="store_true")
    p.add_argument("--unseen", action="store_true", help="list combinations without a group too")
    p = command("advunion", cmd_advunion, "signals")
    _call_options(p, 2)
    p.add_argument("--readids", action="append", required=True)
    p.add_argument("--calls", action="append", required=True)
    p.add_argument("-g", type=int, default=5)
    p.add_argument("-u", action="store_true")
    p = command("union-tr", cmd_union_tr, "repeats", "segdups", many="inputs")
    _call_options(p, 2)
    p.add_argument("-g", type=int, default=5)
    command("ensembleunion", cmd_ensembleunion, "input").add_argument("--drop-last", action="store_true")
    command("doublestrandbreak", cmd_doublestrandbreak, "input")
    p = command("getindel", cmd_getindel, "input")
    for flag, kind, value in (("-r", int, 1), ("-m", int, 5), ("-l", int, 100)):
        p.add_argument(flag, type=kind, default=value)
    p.add_argument("--max-indels", type=int, help="leave out alignments with more long indels")
    for flag in ("--normal", "--vntr", "--cent"):
        p.add_argument(flag)
    p = command("sv-cross-ref-filter", cmd_cross_ref)
    _call_options(p, 3)
    p.add_argument("--vcf", nargs=4, required=True)
    p.add_argument("--readids", nargs=4, required=True)
    p.add_argument("--self-signals")
    p.add_argument("--graph-signals")
    p.add_argument("--uc", type=int, default=5)
    p.add_argument("-g", type=int, default=5)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.run(_session(), args)


if __name__ == "__main__":
    main(sys.argv[1:])
