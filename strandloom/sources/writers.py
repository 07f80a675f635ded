"""Text forms of signals, calls and union rows; every writer is a projection to one ``line`` column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strandloom.operators.ordinals import dense_index

# Header of the VCF writer and of the header patcher.
VCF_HEADER = [
    "##fileformat=VCFv4.3",
    '##INFO=<ID=SVTYPE,Number=1,Type=String,Description="Type of structural variant">',
    '##INFO=<ID=SVLEN,Number=.,Type=Integer,Description="Difference in length between REF and ALT alleles">',
    '##INFO=<ID=END,Number=1,Type=Integer,Description="End position of the variant described in this record">',
    '##INFO=<ID=MATEID,Number=.,Type=String,Description="ID of mate breakends">',
    '##INFO=<ID=SEQ,Number=1,Type=String,Description="INDEL sequence">',
    '##ALT=<ID=DEL,Description="Deletion">',
    '##ALT=<ID=INS,Description="Insertion">',
    '##ALT=<ID=DUP,Description="Duplication">',
    '##ALT=<ID=INV,Description="Inversion">',
    '##ALT=<ID=BND,Description="Breakend">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tsample",
]
FORMAT_HEADER = [
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
    '##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="Genotyping quality">',
    '##FORMAT=<ID=DR,Number=1,Type=Integer,Description="Number of reference reads">',
    '##FORMAT=<ID=DV,Number=1,Type=Integer,Description="Number of variant reads">',
    '##FORMAT=<ID=VAF,Number=1,Type=Float,Description="Variant allele frequency">',
]


def _pairs(*items: tuple[str, Column]) -> Column:
    """``;``-joined ``key=value`` entries; entries with a null value are left out."""
    return F.concat_ws(";", *[F.concat(F.lit(k + "="), v.cast("string")) for k, v in items])


def _comma(a: Column, b: Column) -> Column:
    return F.concat(a.cast("string"), F.lit(","), b.cast("string"))


def _tabs(*cols: Column | str) -> Column:
    """Columns by tabs; a null is written as ``NA``, so that no column moves."""
    text = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in cols]
    return F.concat_ws("\t", *[F.coalesce(t, F.lit("NA")) for t in text])


def signal_lines(signals: DataFrame) -> DataFrame:
    c = F.col
    indel = _pairs(
        ("SVTYPE", c("svtype")), ("SVLEN", c("svlen")), ("qoff_l", c("qoff_l")), ("qoff_r", c("qoff_r")),
        ("tsd_len", c("tsd_len")), ("polyA_len", c("polya_len")), ("cen_dist", c("cen_dist")),
        ("source", c("source")), ("tsd_seq", c("tsd_seq")), ("insert", c("insert_seq")),
    )
    bp = _pairs(
        ("SVTYPE", c("svtype")), ("SVLEN", c("svlen")), ("sv_region", _comma(c("region_st"), c("region_en"))),
        ("tsd_len", c("tsd_len")), ("qoff_l", c("qoff_l")), ("qoff_r", c("qoff_r")), ("qgap", c("qgap")),
        ("mapq", _comma(c("mapq_l"), c("mapq_r"))), ("aln_len", _comma(c("aln_len_l"), c("aln_len_r"))),
        ("cen_dist", c("cen_dist")), ("cen_overlap", c("cen_overlap")), ("source", c("source")),
    )
    return signals.select(
        F.when(c("is_bp"), _tabs("ctg", "pos", "ori", "ctg2", "pos2", "read", "mapq", "strand", bp))
        .otherwise(_tabs("ctg", "pos", "en", "read", "mapq", "strand", indel))
        .alias("line")
    )


def call_info(calls: DataFrame) -> Column:
    """Annotation of a call: summary, the representative's own annotation, orientation counts."""
    c = F.col
    own = _pairs(("SVTYPE", c("svtype")), ("SVLEN", c("svlen")))
    if "info" in calls.columns:
        own = F.coalesce(c("info"), own)
    seen = c("count_fr") + c("count_rf") > 0
    parts = [
        _pairs(("avg_mapq", c("avg_mapq")), ("count", c("count")), ("rt_len", c("rt_len"))),
        own,
        F.when(seen, _pairs(("count_fr", c("count_fr")), ("count_rf", c("count_rf")))),
        F.when(c("foldback"), "foldback"),
    ]
    if "reads" in calls.columns:
        parts.append(F.concat(F.lit("reads="), c("reads")))
    return F.concat_ws(";", *parts)


def call_lines(calls: DataFrame) -> DataFrame:
    """Call rows of ``merge_signals``; add a ``reads`` column to list supporting reads."""
    info = call_info(calls)
    return calls.select(
        F.when(F.col("is_bp"), _tabs("ctg", "pos", "ori", "ctg2", "pos2", F.lit("."), "n_reads", "strand", info))
        .otherwise(_tabs("ctg", "pos", "en", F.lit("."), "n_reads", "strand", info))
        .alias("line")
    )


def _bracket(ori: Column, ctg: Column, pos: Column, mate: bool) -> Column:
    at = F.concat(ctg, F.lit(":"), (pos + 1).cast("string"))
    wrap = lambda pre, a, post: F.concat(F.lit(pre), a, F.lit(post))
    out, into = wrap("N[", at, "["), wrap("]", at, "]N")
    first, second = (into, out) if mate else (out, into)
    return (
        F.when(ori == ">>", first).when(ori == "<<", second).when(ori == "><", wrap("N]", at, "]")).otherwise(wrap("[", at, "[N"))
    )


def vcf_records(calls: DataFrame) -> DataFrame:
    """VCF record lines with running ids per type; a breakend becomes two mated records.

    ``tsd_seq`` and ``insert_seq``, where present, are written as the sequence of the event.
    """
    c = F.col
    if "line_no" in calls.columns:
        order, chunk = ["line_no"], {"_c_at": F.floor(c("line_no") / 1_000_000)}
    else:
        order = ["ctg", "pos", "is_bp", "en", "ori", "ctg2", "pos2", "svlen", "n_reads", "count", "avg_mapq"]
        chunk = {"_c_ctg": c("ctg"), "_c_at": F.floor(c("pos") / 1_000_000)}
    rows = dense_index(calls, order, chunk, "no", ["svtype"])
    seq = F.lit(None).cast("string")
    if {"tsd_seq", "insert_seq"} <= set(rows.columns):
        seq = F.concat(F.when(c("tsd_seq") == ".", "").otherwise(c("tsd_seq")), c("insert_seq"))
    info = _pairs(
        ("SVTYPE", c("svtype")), ("SVLEN", c("svlen")), ("END", F.when(c("is_bp"), c("pos2")).otherwise(c("en"))), ("SEQ", seq)
    )
    rows = rows.withColumns({"rec_id": F.concat(F.lower("svtype"), F.lit("_"), (c("no") + 1).cast("string")), "rec_info": info})

    def record(ctg: str, pos: str, ident: Column, alt: Column, text: Column) -> Column:
        return _tabs(ctg, c(pos) + 1, ident, F.lit("N"), alt, "n_reads", F.lit("PASS"), text, F.lit("GT"), F.lit("1/1"))

    end = lambda i: F.concat("rec_id", F.lit(f"_{i}"))
    mate = lambda i: F.concat("rec_info", F.lit(";MATEID="), end(i))
    single = record("ctg", "pos", c("rec_id"), F.concat(F.lit("<"), "svtype", F.lit(">")), c("rec_info"))
    first = record("ctg", "pos", end(1), _bracket(c("ori"), c("ctg2"), c("pos2"), False), mate(2))
    second = record("ctg2", "pos2", end(2), _bracket(c("ori"), c("ctg"), c("pos"), True), mate(1))
    return rows.select(
        F.explode(F.when(c("svtype") == "BND", F.array(first, second)).otherwise(F.array(single))).alias("line")
    )


def break_records(chains: DataFrame) -> DataFrame:
    """Two mated breakend records of every chain of break points, numbered along contigs: ``line_no, line``.

    ``chains`` has ``ctg, pos, ori, ctg2, pos2, qual, n_reads``, and ``reads`` (names, joined by commas) if they are to
    be listed.  Ends that both face left are written like ``<>``.
    """
    c = F.col
    order = ["ctg", "pos", "ctg2", "pos2", "ori", "qual", "n_reads"]
    rows = dense_index(chains, order, {"_c_ctg": c("ctg"), "_c_at": F.floor(c("pos") / 1_000_000)}, "no")
    ori = F.when(c("ori") == "<<", "<>").otherwise(c("ori"))
    listed = c("reads") if "reads" in chains.columns else F.lit(None).cast("string")
    ident = lambda i: F.concat(F.lit("bnd_"), (2 * c("no") + i).cast("string"))

    def record(i: int, ctg: str, pos: str, other: str, at: str) -> Column:
        alt = _bracket(ori, c(other), c(at) - 1, i == 1)
        text = _pairs(("SVTYPE", F.lit("BND")), ("MATEID", ident(1 - i)), ("READ_COUNTS", c("n_reads")), ("READ_IDS", listed))
        return F.struct((2 * c("no") + i).alias("line_no"), _tabs(ctg, pos, ident(i), F.lit("N"), alt, "qual", F.lit("."), text).alias("line"))

    both = F.array(record(0, "ctg", "pos", "ctg2", "pos2"), record(1, "ctg2", "pos2", "ctg", "pos"))
    return rows.select(F.explode(both).alias("r")).select("r.*")


def union_lines(rows: DataFrame) -> DataFrame:
    """Union rows: place and one annotation column; optional columns are written when present."""
    c = F.col
    items = [(k, c(col)) for k, col in (
        ("SVTYPE", "svtype"), ("SVLEN", "svlen"), ("count", "count"), ("group_id", "group_id"), ("file_id", "file_id"),
        ("orig_read_ids", "orig_reads"), ("asm_read_ids", "asm_reads"),
    ) if col in rows.columns]
    items += [(k, F.coalesce(c(k), F.lit("")) if k in rows.columns else F.lit("")) for k in ("tr_info", "segdup_info")]
    extra = [k for k in ("lens", "counts", "file_ids") if k in rows.columns]
    return rows.select(_tabs("ctg", "pos", "ori", "ctg2", "pos2", _pairs(*items), *extra).alias("line"))


def patched_vcf(lines: DataFrame) -> DataFrame:
    """``line_no, line`` with FORMAT headers before the column header and every record set to PASS."""
    f = F.split(F.regexp_replace("line", r"\s+", "\t"), "\t")
    passed = F.array_join(
        F.transform(f, lambda x, i: F.when(i == 6, F.lit("PASS")).otherwise(x)), "\t"
    )
    out = (
        F.when(F.col("line").startswith("#CHROM"), F.array(*[F.lit(h) for h in FORMAT_HEADER], F.col("line")))
        .when(F.col("line").startswith("#"), F.array(F.col("line")))
        .otherwise(F.array(passed))
    )
    return lines.select("line_no", F.posexplode(out).alias("part", "line"))
