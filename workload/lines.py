"""VCF and merged-call text lines built from the view rows, in SQL both engines accept."""

from workload.views import VIEWS

_T = "'\t'"  # a real tab between the quotes


def _line(*cols: str) -> str:
    return "concat(" + f", {_T}, ".join(cols) + ")"


def _alt(c: str, p: str, flip: bool) -> str:
    """Break-end ALT of one of four orientations; the mate of a straight one is written flipped."""
    out, into = f"concat('N[', {c}, ':', {p}, '[')", f"concat(']', {c}, ':', {p}, ']N')"
    first, second = (into, out) if flip else (out, into)
    return (
        f"case bk when 0 then {first} when 1 then {second} "
        f"when 2 then concat('[', {c}, ':', {p}, '[N') else concat('N]', {c}, ':', {p}, ']') end"
    )



_S = "cast({} as string)".format
_fmt = "'GT:DR:DV'"
_smp = f"concat(case when sup = 0 then '0/0' else '0/1' end, ':3:', {_S('sup')})"
_support = f"concat(';SUPPORT=', {_S('sup')})"

_STYLES = {
    # spelled-out insertion and deletion
    0: ("concat('s', oid)", "'N'", "concat('N', repeat('A', cast(len as int)))", "'SVTYPE=INS;X=1'"),
    1: ("concat('s', oid)", "concat('N', repeat('C', cast(len as int)))", "'N'", "'SVTYPE=INS;X=1'"),
    # symbolic records
    2: ("concat('d', oid)", "'N'", "'<DEL>'", f"concat('PRECISE;SVTYPE=DEL;SVLEN=', {_S('len')}, ';END=', {_S('vpos + len')})"),
    3: ("concat('d', oid)", "'N'", "'<DUP>'", f"concat('SVTYPE=DUP;SVLEN=', {_S('len')}, {_support})"),
    4: ("concat('i', oid)", "'N'", "'<INV>'", f"concat('SVTYPE=INV;SVLEN=', {_S('len')}, ';END=', {_S('vpos + len')})"),
    5: ("concat('i', oid)", "'N'", "'<INS>'", f"concat('SVTYPE=INS;SVLEN=10;SVINSLEN=', {_S('len')})"),
    # single break ends: within a contig with and without detail, and one-sided
    6: ("concat('b', oid)", "'N'", _alt("chrom", _S("vpos2"), False), "'SVTYPE=BND;X=1'"),
    7: ("concat('b', oid)", "'N'", _alt("chrom", _S("vpos2"), False), f"concat('SVTYPE=BND;DETAILED_TYPE=Templated_ins;SVLEN=', {_S('len')})"),
    8: ("concat('b', oid)", "'N'", "'N.'", "'SVTYPE=BND;X=1'"),
}


def vcf_lines() -> str:
    """``file_id, line_no, line``; styles 9 and 10 are written as two mated records."""
    rows = VIEWS["vcf_rows"]
    parts = []
    for style, (ident, ref, alt, info) in _STYLES.items():
        line = _line("chrom", _S("vpos"), ident, ref, alt, "'.'", "flt", info, _fmt, _smp)
        parts.append(f"select line_no, {line} as line from vr where style = {style}")
    pair = "concat('SVTYPE=BND;MATEID=m', oid, {})".format
    for end, (c, p, oc, op) in enumerate([("chrom", "vpos", "chrom2", "vpos2"), ("chrom2", "vpos2", "chrom", "vpos")], 1):
        alt = _alt(oc, _S(op), end == 2)
        line = _line(c, _S(p), f"concat('m', oid, '_{end}')", "'N'", alt, "'.'", "flt", pair(f"'_{3 - end}'"), _fmt, _smp)
        parts.append(f"select line_no + {end - 1} as line_no, {line} as line from vr where style >= 9")
    body = " union all ".join(parts)
    return f"with vr as ({rows}) select 0 as file_id, line_no, max(line) as line from ({body}) group by line_no"


def mate_lines() -> str:
    """``file_id, line_no, line``: records of a locus name each other in chains of up to its number of rows.

    Most name the next record, some the one after it, the one before or themselves; some have no id, some repeat one.
    """
    rows = """
      select *, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_extendedprice, l_suppkey, l_quantity) as j
      from lineitem"""
    ident = (
        "case when l_suppkey % 41 = 3 then '.' when l_suppkey % 37 = 5 then concat('c', cast(l_partkey as string), '_', cast(j - 1 as string)) "
        "else concat('c', cast(l_partkey as string), '_', cast(j as string)) end"
    )
    step = "case when l_suppkey % 13 = 0 then 2 when l_suppkey % 17 = 0 then -1 when l_suppkey % 19 = 0 then 0 else 1 end"
    info = f"concat('SVTYPE=BND;MATEID=c', cast(l_partkey as string), '_', cast(j + {step} as string))"
    fields = [_S("100 + j"), ident, "'N'", "concat('N[chr7:', cast(5000 + j as string), '[')", "'.'", "'PASS'", info]
    line = _line("'chr1'", *fields)
    return f"select 0 as file_id, cast(l_partkey * 100000 + j as bigint) as line_no, {line} as line from ({rows})"
