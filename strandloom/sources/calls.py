"""Universal call reader: VCF of several callers and merged call rows to one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from strandloom.functions.info import info_first, info_long, strand_count_total, vcf_support
from strandloom.params import CallParams
from strandloom.session import written
from strandloom.sources.mates import staying_lines
from strandloom.sources.text import read_numbered_lines

CALL_COLUMNS = [
    "file_id", "line_no", "svid", "ctg", "pos", "ori", "ctg2", "pos2",
    "svtype", "svlen", "inv", "count", "vaf",
]


def _field(i: int) -> Column:
    return F.get("f", F.lit(i))


def kept_rows(df: DataFrame, keep: Column, *cols: Column | str) -> DataFrame:
    """Select ``cols`` of the rows with ``keep``, evaluating both once.

    A plain filter on derived columns is pushed below the projections that define them, with every
    definition copied into it.  Deciding inside a generator leaves nothing to push.
    """
    row = F.struct(*[F.col(c) if isinstance(c, str) else c for c in cols])
    return (
        df.select(F.explode_outer(F.array(F.when(keep, row))).alias("_r"))
        .filter("_r is not null")
        .select("_r.*")
    )


def _supported(lines: DataFrame, p: CallParams) -> DataFrame:
    """Data rows with record kind, read count and ids that pass the filters not needing coordinates.

    A row with a numeric position that is no known record is an error.
    """
    c = F.col
    kind = (
        F.when(_field(2).rlike("^[><][><]$"), "breakend")
        .when((F.size("f") >= 8) & _field(7).contains(";"), "vcf")
        .when(_field(2).rlike(r"^\d+$") & _field(6).contains(";"), "indel")
        .otherwise(F.raise_error(F.concat(F.lit("unknown call record at line "), c("line_no"))).cast("string"))
    )
    raw = lines.filter(~c("line").startswith("#") & c("line").rlike(r"^[^\t]*\t\d"))
    rows = _steps(
        raw.select("file_id", "line_no", F.split("line", "\t").alias("f")),
        {"kind": kind},
        {"info": F.when(c("kind") == "indel", _field(6)).when(c("kind") == "vcf", _field(7)).otherwise(_field(8))},
    )
    is_vcf = c("kind") == "vcf"
    merged = F.coalesce(strand_count_total(info_first(c("info"), "count")), F.lit(-1).cast("bigint"))
    spelled = is_vcf & _field(4).rlike(r"^[A-Z,\*]+$") & ~_field(4).isin("SV", "CSV")
    mate = F.nullif(F.regexp_extract("info", r"\b(?:MATE_ID|MATEID)=([^\s;]+)", 1), F.lit(""))
    rows = _steps(
        rows,
        {
            "count": F.when(is_vcf, vcf_support(c("f"))).otherwise(merged),
            "spelled": spelled,
            "symbolic": is_vcf & ~spelled,
            "svid": F.when(is_vcf, _field(2)).otherwise(c("line_no").cast("string")),
            "mate": F.when(is_vcf, mate),
        },
    )
    keep = (c("count") <= 0) | (c("count") >= p.min_count)
    if not p.ignore_filter:
        keep = keep & (~is_vcf | _field(6).isin("PASS", "."))
    if p.check_gt:
        keep = keep & (~is_vcf | ~F.coalesce(_field(9), F.lit("")).rlike(r"^0[/|]0"))
    return kept_rows(rows, keep, *rows.columns)


def _without_later_mates(rows: DataFrame) -> DataFrame:
    """Drop a symbolic record whose id an earlier record that stays has used or named as its mate.

    A dropped record claims nothing, so along a chain of mates kept and dropped records alternate.  Of records
    that share an id only the first can stay; whether it does is settled by ``mates.staying_lines`` on the ids that
    are claimed.  ``rows`` are read several times; only the lines that go are joined to them.
    """
    claims = rows.filter("symbolic").select("file_id", "line_no", "svid", "mate")
    if claims.isEmpty():
        return rows
    key = ["file_id", "line_no", "svid"]
    met = claims.filter("svid != '.'").join(staying_lines(claims), ["file_id", "svid"])
    lost = met.filter("stays is null or stays != line_no").select(*key).distinct()
    named = F.col("symbolic") & F.coalesce(F.col("svid") != ".", F.lit(False))
    return rows.filter(~named).unionByName(rows.filter(named).join(lost, key, "left_anti").select(*rows.columns))


def _steps(rows: DataFrame, *steps: dict[str, Column]) -> DataFrame:
    """Ordered rewrites: a later step sees what an earlier step wrote."""
    return reduce(lambda d, s: d.withColumns(s), steps, rows)


def parse_calls(lines: DataFrame, params: CallParams = CallParams()) -> DataFrame:
    """``file_id, line_no, line`` to calls; positions are 0-based, VCF mate/END positions stay 1-based.

    Each step sees what the steps before it wrote.  Conditions to drop a row are collected in
    ``keep`` and applied once at the end.  Lines are parsed once and written; which records are later mates is
    then decided on the narrow rows, so what is wrong with a record (``fault``) counts only if it stays.
    """
    c, min_len = F.col, params.min_read_len
    is_vcf, is_bp, is_indel = c("kind") == "vcf", c("kind") == "breakend", c("kind") == "indel"
    sym, spelled = c("symbolic"), c("spelled")
    rows = _supported(lines, params)

    # Alleles spelled out as bases: one row per allele that is long enough.
    ref_len = F.length(_field(3)).cast("bigint")
    gains = F.filter(
        F.transform(F.split(_field(4), ","), lambda a: F.length(a).cast("bigint") - ref_len),
        lambda n: F.abs(n) >= min_len,
    )
    rows = rows.withColumn("allele", F.explode_outer(F.when(spelled, gains)))

    bracket = lambda pat, i: F.regexp_extract("alt", pat, i)
    fwd, rev = r"^[A-Z]+\[([^\s:]+):(\d+)\[$", r"^\]([^\s:]+):(\d+)\][A-Z]+$"
    left, right = r"^\[([^\s:]+):(\d+)\[[A-Z]+$", r"^[A-Z]+\]([^\s:]+):(\d+)\]$"
    mate_of = lambda i: (
        F.when(c("alt_ori") == ">>", bracket(fwd, i))
        .when(c("alt_ori") == "<<", bracket(rev, i))
        .when(c("alt_ori") == "<>", bracket(left, i))
        .when(c("alt_ori") == "><", bracket(right, i))
    )
    one_base = c("end_key").isNull() & (c("rlen") == 1)
    same = c("ctg") == c("ctg2")
    flipped = c("ori").isin("><", "<>")
    bnd = c("svtype") == "BND"
    untyped = sym & c("svtype").isNull()
    rows = _steps(
        rows,
        {
            "ctg": _field(0),
            "vpos": _field(1).try_cast("bigint"),
            "rlen": ref_len,
            "alt": _field(4),
            "svtype": info_first(c("info"), "SVTYPE"),
            "svlen": F.coalesce(info_long(c("info"), "SVLEN"), F.lit(0).cast("bigint")),
            "end_key": F.regexp_extract("info", r"\bEND=(\d+)", 1).try_cast("bigint"),
        },
        {
            "inv": F.coalesce(c("svtype") == "INV", F.lit(False)),
            "svtype": F.when(spelled, F.when(c("allele") < 0, "DEL").otherwise("INS"))
            .otherwise(c("svtype")),
            "fault": F.when(untyped, "call without SVTYPE"),
            "svlen": F.when(spelled, c("allele"))
            .when(
                sym & (c("svtype") == "INS"),
                F.coalesce(info_first(c("info"), "SVINSLEN", False).try_cast("bigint"), c("svlen")),
            )
            .otherwise(c("svlen")),
            # The bracket at an end of the text tells which one pattern can match.
            "alt_ori": F.when(sym & c("alt").endswith("[") & c("alt").rlike(fwd), ">>")
            .when(sym & c("alt").startswith("]") & c("alt").rlike(rev), "<<")
            .when(sym & c("alt").startswith("[") & c("alt").rlike(left), "<>")
            .when(sym & c("alt").endswith("]") & c("alt").rlike(right), "><"),
            "pos": F.when(is_vcf, c("vpos") - 1).otherwise(c("vpos")),
        },
        # Length bounds look at the annotated length, before break ends are retyped.
        {
            "keep": F.when(spelled, c("allele").isNotNull())
            .when(is_indel, F.abs("svlen") >= min_len)
            .when(is_bp, (c("ctg") != _field(3)) | (F.abs("svlen") >= min_len))
            .otherwise((bnd | (F.abs("svlen") >= min_len)) & ~(one_base & bnd & (F.length("alt") < 6))),
            "svlen": F.when(sym & (c("svtype") == "DEL"), -F.abs("svlen")).otherwise(c("svlen")),
        },
        {
            "ctg2": F.when(is_bp, _field(3)).when(sym, F.coalesce(mate_of(1), c("ctg"))).otherwise(c("ctg")),
            "pos2": F.when(is_indel, _field(2).try_cast("bigint"))
            .when(is_bp, _field(4).try_cast("bigint"))
            .when(
                sym,
                F.coalesce(
                    mate_of(2).try_cast("bigint"),
                    c("end_key"),
                    F.when(one_base & c("svtype").isin("DEL", "DUP", "INV"), c("pos") + F.abs("svlen")),
                    c("vpos") + c("rlen") - 1,
                ),
            )
            .otherwise(c("vpos") + c("rlen") - 1),
            "ori": F.when(is_bp, _field(2)).when(sym, F.coalesce(c("alt_ori"), F.lit(">>"))).otherwise(">>"),
        },
        {
            "inv": c("inv") | (~is_indel & ~spelled & same & flipped),
            "pos2": F.when(
                c("keep") & is_indel & (c("pos") > c("pos2")),
                F.raise_error(F.lit("interval end before its start")).cast("bigint"),
            ).otherwise(c("pos2")),
        },
        {
            "svlen": F.when(sym & c("inv") & bnd, F.abs(c("pos2") - c("pos"))).otherwise(c("svlen")),
            "svtype": F.when(sym & c("inv") & bnd, "INV").otherwise(c("svtype")),
        },
        {
            "ori": F.when(sym & (c("svtype") == "DUP") & (c("ori") == ">>"), "<<")
            .when(sym & same & ~flipped & (c("svtype") == "INV"), "><")
            .otherwise(c("ori"))
        },
        {
            "svtype": F.when(
                sym & same & bnd & (c("ori") == ">>") & info_first(c("info"), "DETAILED_TYPE", False).isNull(), "DEL"
            )
            .when(sym & same & bnd & (c("ori") == "<<"), "DUP")
            .otherwise(c("svtype")),
            "fault": F.coalesce(c("fault"), F.when(c("keep") & sym & ~same & ~bnd, "only breakends may join two contigs")),
        },
        {"svlen": F.when(sym & (c("svtype") == "DEL") & (c("svlen") > 0), -c("svlen")).otherwise(c("svlen"))},
    )
    reach = F.when(c("svlen") == 0, F.abs(c("pos2") - c("pos"))).otherwise(F.abs("svlen"))
    swap = sym & same & (c("pos") > c("pos2"))
    keep = F.coalesce(c("keep") & (~(sym & same & bnd) | (reach >= min_len)), F.lit(False))
    rows = kept_rows(
        rows,
        keep | sym,
        "file_id",
        "line_no",
        "svid",
        "ctg",
        F.when(swap, c("pos2")).otherwise(c("pos")).alias("pos"),
        "ori",
        "ctg2",
        F.when(swap, c("pos")).otherwise(c("pos2")).alias("pos2"),
        "svtype",
        "svlen",
        "inv",
        "count",
        "symbolic",
        "mate",
        "fault",
        keep.alias("keep"),
    )
    sound = F.when(c("fault").isNull(), c("keep")).otherwise(F.raise_error(c("fault")).cast("boolean"))
    return kept_rows(_without_later_mates(written(rows)), sound, *CALL_COLUMNS[:-1], F.lit(1.0).alias("vaf"))


def read_calls(
    spark: SparkSession, paths: list[str], params: CallParams = CallParams()
) -> DataFrame:
    """Calls of several files in one table, told apart by ``file_id`` (position in ``paths``)."""
    lines = [read_numbered_lines(spark, p, i) for i, p in enumerate(paths)]
    return parse_calls(reduce(DataFrame.unionByName, lines), params)
