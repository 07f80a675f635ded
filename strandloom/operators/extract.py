"""Alignments to read-level signals: long CIGAR indels and breakends between split alignments.

Indels are a pure projection and ``explode``: no shuffle.  Breakends need the alignments of one read
in query order: one shuffle on the read name, shared by every window below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.functions import sequence as S
from strandloom.functions.coords import (
    on_contig,
    path_segments,
    segment_index,
)
from strandloom.functions.typing import split_read_type
from strandloom.operators.intervals import merged, with_points
from strandloom.params import ExtractParams

SIGNAL_COLUMNS = [
    "ctg", "pos", "en", "is_bp", "ori", "ctg2", "pos2", "read", "mapq", "strand", "svtype", "svlen",
    "qoff_l", "qoff_r", "tsd_len", "polya_len", "cen_dist", "cen_overlap", "region_st", "region_en",
    "qgap", "mapq_l", "mapq_r", "aln_len_l", "aln_len_r", "tsd_seq", "insert_seq", "source",
]


def _null(t: str) -> Column:
    return F.lit(None).cast(t)


def aligned_indels(alns: DataFrame, p: ExtractParams = ExtractParams()) -> DataFrame:
    """Adds ``indels`` to alignments that cover enough of the read and are not indel-dense."""
    rows = alns.filter((F.col("qen") - F.col("qst")) >= F.col("qlen") * F.lit(p.min_frac))
    rows = rows.withColumn(
        "indels", S.cigar_indels("cg", "tst", "qst", "qen", "strand", p.min_len)
    ).drop("cg")
    # Emptied, not filtered: a predicate on the array would be pushed down and walk the CIGAR again.
    few = F.size("indels") <= F.col("qlen") * F.lit(1e-4) * F.lit(p.max_indels_per_10kb)
    return rows.withColumn("indels", F.when(few & (F.size("indels") > 0), F.col("indels")))


def with_inserted_sequence(rows: DataFrame, p: ExtractParams = ExtractParams()) -> DataFrame:
    """A row per indel, ``d``: the k-th CIGAR indel with the k-th long difference, whose duplicated flanks are split off.

    The two encodings describe the same alignment; a disagreement is an error in the input.  ``stl`` to ``enr`` are the
    furthest offsets up to the indel, see ``placed_indels``.
    """
    wanted = F.when(F.col("indels").isNotNull(), F.col("ds"))
    rows = rows.withColumn("diffs", S.diff_indels(wanted, "tst", p.min_len, p.polya_penalty, p.polya_drop)).drop("ds")
    others = [c for c in rows.columns if c not in ("indels", "diffs")]
    both = F.when(F.col("indels").isNotNull(), F.arrays_zip(F.col("indels").alias("a"), F.coalesce("diffs", F.array()).alias("b")))
    rows = rows.select(*others, F.col("diffs").isNull().alias("_plain"), F.explode_outer(both).alias("x")).filter("x is not null")
    # One comparison and one struct per row: the walk of an alignment is not repeated for its indels.
    text = lambda n: f"coalesce(x.b.{n}, '')"
    spots = ", ".join(f"'{n}', coalesce(x.b.{n}, x.a.{n[:2]})" for n in ("stl", "enl", "str", "enr"))
    d = F.expr(
        f"""
        if(_plain or (x.a.st <=> x.b.st and x.a.en <=> x.b.en and x.a.len <=> x.b.len),
          named_struct(
            'len', x.a.len, 'st', x.a.st, 'en', x.a.en, 'qoff_l', x.a.qoff_l, 'qoff_r', x.a.qoff_r,
            'l', {text("l")}, 'mid', {text("mid")}, 'r', {text("r")}, 'polya', coalesce(x.b.polya, 0L), {spots}),
          raise_error(concat('CIGAR and difference string disagree on read ', qname)))
        """
    )
    return rows.select(*others, F.explode(F.array(d)).alias("d"))


def placed_indels(rows: DataFrame, p: ExtractParams = ExtractParams()) -> DataFrame:
    """Puts indels on the contig of their path segment; indels crossing segments are dropped.

    The segment of an indel never lies before that of an earlier indel of the alignment; since the
    lookup grows with the offset, that is the lookup of the largest offset so far.
    """
    rows = rows.filter((F.col("strand") == "+") | ~F.col("path").rlike("^[><]"))
    rows = rows.withColumn("segs", path_segments("path", "tlen"))
    spots = {"stl": ("d.st - length(d.r)", False), "enl": ("d.en - length(d.r)", True),
             "str": ("d.st + length(d.l)", False), "enr": ("d.en + length(d.l)", True)}
    within = " and ".join(f"{off} {'<=' if is_end else '<'} segs[0].p_en" for off, is_end in spots.values())
    lookup = ", ".join(f"'{n}', {segment_index('segs', 'd.' + n, is_end)}" for n, (_, is_end) in spots.items())
    at = f"if(size(segs) = 1 and {within}, named_struct('stl', 0, 'enl', 0, 'str', 0, 'enr', 0), named_struct({lookup}))"
    rows = rows.select("qname", "mapq", "strand", "segs", "d", F.explode(F.array(F.expr(at))).alias("s"))
    segment = F.expr(
        """
        case when greatest(s.stl, s.enl, s.str, s.enr) >= size(segs)
             then cast(raise_error(concat('indel past the end of the path of ', qname)) as int)
             when s.stl = s.enl and s.stl = s.str and s.stl = s.enr then s.stl end
        """
    )
    # Decided in a generator: a filter would be pushed down with the lookup copied into it.
    rows = rows.select("qname", "mapq", "strand", "segs", "d", F.explode_outer(F.array(segment)).alias("k")).filter("k is not null")
    rows = rows.select("qname", "mapq", "strand", "d", F.expr("get(segs, k)").alias("g"))
    at = lambda n: F.expr(on_contig("g", f"({spots[n][0]})"))
    fwd = F.col("g.fwd")
    tsd = F.concat("d.r", "d.l")
    polya = F.col("d.polya")
    seq_or_dot = lambda c: F.when(c == "", ".").otherwise(c)
    rev = F.col("strand") == "-"
    return rows.select(
        F.col("g.ctg").alias("ctg"),
        F.when(fwd, at("stl")).otherwise(at("enr")).alias("pos"),
        F.when(fwd, at("enl")).otherwise(at("str")).alias("en"),
        F.col("qname").alias("read"),
        "mapq",
        F.when(fwd, F.col("strand")).otherwise(F.when(rev, "+").otherwise("-")).alias("strand"),
        F.when(F.col("d.len") > 0, "INS").otherwise("DEL").alias("svtype"),
        F.col("d.len").alias("svlen"),
        (F.col("d.qoff_l") - F.length(F.when(rev, F.col("d.l")).otherwise(F.col("d.r")))).alias("qoff_l"),
        (F.col("d.qoff_r") + F.length(F.when(rev, F.col("d.r")).otherwise(F.col("d.l")))).alias("qoff_r"),
        F.length(tsd).cast("bigint").alias("tsd_len"),
        F.when(fwd, polya).otherwise(-polya).alias("polya_len"),
        seq_or_dot(F.when(fwd, tsd).otherwise(S.reverse_complement(tsd))).alias("tsd_seq"),
        seq_or_dot(F.when(fwd, F.col("d.mid")).otherwise(S.reverse_complement(F.col("d.mid")))).alias("insert_seq"),
    )


def with_alignment_ends(alns: DataFrame) -> DataFrame:
    """Adds ``head`` and ``tail``: contig, orientation and position where the query enters and leaves."""
    rows = alns.withColumn("segs", path_segments("path", "tlen"))
    on_path = F.col("path").rlike("^[><]")
    mark = lambda fwd: F.when(fwd, ">").otherwise("<")
    point = lambda ctg, ori, pos: F.struct(
        ctg.alias("ctg"), ori.alias("ori"), pos.cast("bigint").alias("pos")
    )
    g_in = F.expr("get(filter(segs, g -> tst >= g.p_st and tst < g.p_en), 0)")
    g_out = F.expr("get(filter(segs, g -> ten > g.p_st and ten <= g.p_en), 0)")
    rows = rows.withColumns({"g_in": g_in, "g_out": g_out})
    fwd = F.col("strand") == "+"
    path_head = point(
        F.col("g_in.ctg"),
        mark(F.col("g_in.fwd")),
        F.when(F.col("g_in.fwd"), F.col("g_in.st") + F.col("tst") - F.col("g_in.p_st")).otherwise(
            F.col("g_in.st") + F.col("g_in.p_en") - F.col("tst") - 1
        ),
    )
    path_tail = point(
        F.col("g_out.ctg"),
        mark(F.col("g_out.fwd")),
        F.when(F.col("g_out.fwd"), F.col("g_out.st") + F.col("ten") - F.col("g_out.p_st") - 1).otherwise(
            F.col("g_out.st") + F.col("g_out.p_en") - F.col("ten")
        ),
    )
    first, last = F.col("tst"), F.col("ten") - 1
    return rows.withColumns(
        {
            "head": F.when(on_path, path_head).otherwise(
                point(F.col("path"), mark(fwd), F.when(fwd, first).otherwise(last))
            ),
            "tail": F.when(on_path, path_tail).otherwise(
                point(F.col("path"), mark(fwd), F.when(fwd, last).otherwise(first))
            ),
        }
    ).drop("segs", "g_in", "g_out")


def trimmed_chain(alns: DataFrame, p: ExtractParams = ExtractParams()) -> DataFrame:
    """Alignments of each read between its first and last good one, long enough in the middle.

    Good: at least ``min_aln_len_end`` query bases and ``min_mapq_end``.  Adds ``aln_len``; ties in
    query start are ordered by the whole row, so the result does not depend on partitioning.
    """
    w = Window.partitionBy("qname")
    chain = w.orderBy(*chain_order())
    good = (F.col("aln_len") >= p.min_aln_len_end) & (F.col("mapq") >= p.min_mapq_end)
    rows = alns.withColumn("aln_len", F.col("qen") - F.col("qst")).withColumn(
        "rn", F.row_number().over(chain)
    )
    rows = rows.withColumns(
        {
            "first_good": F.min(F.when(good, F.col("rn"))).over(w),
            "last_good": F.max(F.when(good, F.col("rn"))).over(w),
        }
    )
    return rows.filter(
        F.col("rn").between(F.col("first_good"), F.col("last_good"))
        & (F.col("aln_len") >= p.min_aln_len_mid)
    ).drop("rn", "first_good", "last_good")


def chain_order() -> list[str]:
    return ["qst", "qen", "path", "tst", "ten", "strand", "mapq"]


def breakends(alns: DataFrame, p: ExtractParams = ExtractParams()) -> DataFrame:
    """One signal per pair of neighbouring alignments of a read, typed and put in canonical order."""
    keep = ["qname", "mapq", "qst", "qen", "strand", "path", "tlen", "tst", "ten"]
    chain = with_alignment_ends(trimmed_chain(alns.select(*keep), p))
    w = Window.partitionBy("qname").orderBy(*chain_order())
    prev = F.lag(F.struct("tail", "qst", "qen", "mapq", "aln_len")).over(w)
    pairs = chain.withColumn("p", prev).filter("p is not null")
    return typed_pairs(
        pairs.select(
            F.col("qname").alias("read"),
            F.col("p.tail").alias("a"),
            F.col("head").alias("b"),
            F.col("p.aln_len").alias("ql_a"),
            F.col("aln_len").alias("ql_b"),
            F.col("p.qen").alias("q_leave"),
            F.col("qst").alias("q_enter"),
            F.col("p.mapq").alias("mapq_l"),
            F.col("mapq").alias("mapq_r"),
        ),
        p,
    )


def typed_pairs(pairs: DataFrame, p: ExtractParams = ExtractParams()) -> DataFrame:
    """Orders the two ends of each pair by (contig, position) and infers type, length and region."""
    c = F.col
    in_order = (c("a.ctg") < c("b.ctg")) | ((c("a.ctg") == c("b.ctg")) & (c("a.pos") < c("b.pos")))
    either = lambda x, y: F.when(in_order, x).otherwise(y)
    flip = lambda o: F.when(o == ">", "<").otherwise(">")
    rows = pairs.withColumns(
        {
            "ctg": either(c("a.ctg"), c("b.ctg")),
            "pos": either(c("a.pos"), c("b.pos")),
            "ctg2": either(c("b.ctg"), c("a.ctg")),
            "pos2": either(c("b.pos"), c("a.pos")),
            "ori": either(F.concat("a.ori", "b.ori"), F.concat(flip(c("b.ori")), flip(c("a.ori")))),
            "strand": either(F.lit("+"), F.lit("-")),
            "qgap": c("q_enter") - c("q_leave"),
            "ql0": either(c("ql_a"), c("ql_b")),
            "ql1": either(c("ql_b"), c("ql_a")),
        }
    )
    rows = rows.withColumn(
        "t",
        split_read_type(
            c("ctg"), c("pos"), c("ql0"), c("ctg2"), c("pos2"), c("ql1"), c("ori"), c("qgap"), p.min_len
        ),
    )
    return rows.select(
        "ctg", "pos", "ori", "ctg2", "pos2", "read",
        F.least("mapq_l", "mapq_r").alias("mapq"),
        "strand",
        "t.*",
        F.least("q_leave", "q_enter").alias("qoff_l"),
        F.greatest("q_leave", "q_enter").alias("qoff_r"),
        "qgap", "mapq_l", "mapq_r",
        c("ql_a").alias("aln_len_l"),
        c("ql_b").alias("aln_len_r"),
    )


def _disjoint(cen: DataFrame) -> DataFrame:
    """Centromeres as ``intervals.merged`` gives them; those listed per contig (``ctg, cen``) are merged here."""
    return merged(cen.select("ctg", F.inline("cen"))) if "cen" in cen.columns else cen


def with_indel_centromere(signals: DataFrame, cen: DataFrame | None) -> DataFrame:
    """``cen_dist`` of an indel: the nearer of its two ends; null on contigs without centromere."""
    if cen is None:
        return signals.withColumn("cen_dist", _null("bigint"))
    rows = with_points(signals, _disjoint(cen), {"a": ("ctg", "pos"), "b": ("ctg", "en")})
    return rows.withColumn("cen_dist", F.least("a_dist", "b_dist")).drop("a_dist", "a_upto", "b_dist", "b_upto")


def with_breakend_centromere(signals: DataFrame, cen: DataFrame | None) -> DataFrame:
    """``cen_dist`` over both ends and ``cen_overlap`` of the typed region, counted on the first contig."""
    if cen is None:
        return signals.withColumns({"cen_dist": _null("bigint"), "cen_overlap": _null("bigint")})
    points = {"a": ("ctg", "pos"), "b": ("ctg2", "pos2"), "s": ("ctg", "region_st"), "e": ("ctg", "region_en")}
    rows = with_points(signals, _disjoint(cen), points)
    near = F.least("a_dist", "b_dist")
    has_region = (F.col("region_st") >= 0) & (F.col("region_en") >= F.col("region_st"))
    cover = F.coalesce(F.col("e_upto") - F.col("s_upto"), F.lit(0).cast("bigint"))
    rows = rows.withColumns({"cen_dist": near, "cen_overlap": F.when(near.isNotNull() & has_region, cover)})
    return rows.drop(*[f"{n}_{c}" for n in points for c in ("dist", "upto")])


def _as_signals(rows: DataFrame, is_bp: bool, source: str) -> DataFrame:
    types = {"ori": "string", "ctg2": "string", "tsd_seq": "string", "insert_seq": "string",
             "mapq_l": "int", "mapq_r": "int"}
    rows = rows.withColumns({"is_bp": F.lit(is_bp), "source": F.lit(source)})
    return rows.select(
        *[F.col(c) if c in rows.columns else _null(types.get(c, "bigint")).alias(c) for c in SIGNAL_COLUMNS]
    )


def indel_signals(alns: DataFrame, p: ExtractParams = ExtractParams(), cen: DataFrame | None = None) -> DataFrame:
    rows = placed_indels(with_inserted_sequence(aligned_indels(alns, p), p), p)
    return _as_signals(with_indel_centromere(rows, cen), False, p.source)


def breakend_signals(alns: DataFrame, p: ExtractParams = ExtractParams(), cen: DataFrame | None = None) -> DataFrame:
    return _as_signals(with_breakend_centromere(breakends(alns, p), cen), True, p.source)


def extract(alns: DataFrame, p: ExtractParams = ExtractParams(), cen: DataFrame | None = None) -> DataFrame:
    """All signals of a set of alignments; ``cen`` comes from ``intervals.merged``, or lists the intervals of each contig."""
    return indel_signals(alns, p, cen).unionByName(breakend_signals(alns, p, cen))
