"""SV-shaped views of the driver tables, written once in SQL that Spark and DuckDB both accept.

Every view covers its whole table.  Text views spell records out so that the parsers do real work.
"""

from __future__ import annotations

# Locus-level derivations of a lineitem row.  Parts are loci, orders are reads.
_CTG = "concat('chr', cast(l_suppkey % 5 + 1 as string))"
_NEXT_CTG = "concat('chr', cast((l_suppkey % 5 + 1) % 5 + 1 as string))"
_BASES = "cast(l_quantity as bigint)"

VIEWS: dict[str, str] = {}

VIEWS["sig"] = f"""
select
  {_CTG} as ctg,
  l_partkey * 50000 + {_BASES} * 4 as pos,
  case when k = 1 then l_partkey * 50000 + {_BASES} * 4
       when k = 2 then l_partkey * 50000 + {_BASES} * 4 + len end as en,
  k not in (1, 2) as is_bp,
  case when k in (1, 2) then null when k = 3 then '<<' when k = 4 then case when l_suppkey % 2 = 0 then '><' else '<>' end
       else '>>' end as ori,
  case when k in (1, 2) then null when k = 0 then {_NEXT_CTG} else {_CTG} end as ctg2,
  case when k in (1, 2) then null when k = 0 then l_partkey * 30000 + {_BASES} * 3
       else l_partkey * 50000 + {_BASES} * 4 + len end as pos2,
  concat('r', cast(l_orderkey as string)) as read,
  cast(20 + l_orderkey % 41 as int) as mapq,
  case when l_linestatus = 'O' then '+' else '-' end as strand,
  case k when 0 then 'BND' when 1 then 'INS' when 2 then 'DEL' when 3 then 'DUP' else 'INV' end as svtype,
  case k when 0 then null when 2 then -len else len end as svlen,
  cast(l_linenumber * 700 + l_partkey % 50 as bigint) as qoff_l,
  cast(l_linenumber * 700 + l_partkey % 50 + case when k = 1 then len else 0 end as bigint) as qoff_r,
  case when k in (1, 2) then cast(l_suppkey % 20 as bigint) end as tsd_len,
  case when k in (1, 2) then cast(l_orderkey % 31 - 15 as bigint) end as polya_len,
  case when l_partkey % 7 = 0 then l_partkey * 700 end as cen_dist,
  case when l_partkey % 11 = 0 and k not in (1, 2) then cast(l_partkey % 2 as bigint) end as cen_overlap,
  case when l_returnflag = 'N' then 'NORMAL' when l_returnflag = 'A' then 'TUMOR' else 'TUMOR2' end as source
from (
  select *, l_partkey % 5 as k,
    cast(case when l_partkey % 97 = 1 then 20000 else 200 end + l_partkey % 40 + l_linenumber % 3 * 8 as bigint) as len
  from lineitem)
"""

for _i, (_keep, _shift) in enumerate(
    [("l_suppkey % 3 <> 0", "l_partkey % 9 * 250"), ("l_suppkey % 4 <> 1", "l_partkey % 7 * 270"),
     ("l_linenumber <> 7", "l_orderkey % 5 * 300")], 1
):
    VIEWS[f"alt{_i}"] = (
        VIEWS["sig"]
        .replace("cast(l_linenumber * 700 +", f"cast({_shift} + l_linenumber * 700 +")
        .rstrip().removesuffix("from lineitem)") + f"from lineitem where {_keep})\n"
    )

# Calls: one per row, three files.
VIEWS["calls"] = f"""
select
  cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as int) as file_id,
  l_orderkey * 8 + l_linenumber as line_no,
  concat('sv_', cast(l_orderkey as string), '_', cast(l_linenumber as string), '_', cast(cast(round(l_extendedprice * 100) as bigint) as string)) as svid,
  {_CTG} as ctg,
  l_partkey * 20000 + {_BASES} * 11 as pos,
  case when k = 3 then '<<' when k = 4 then '><' when k = 0 and l_linenumber % 2 = 0 then '<>' else '>>' end as ori,
  case when k = 0 and l_linenumber <> 3 then {_NEXT_CTG} else {_CTG} end as ctg2,
  case when k = 0 and l_linenumber <> 3 then l_partkey * 20000 + {_BASES} * 9
       when k = 1 then l_partkey * 20000 + {_BASES} * 11
       else l_partkey * 20000 + {_BASES} * 11 + len end as pos2,
  case when k = 0 then 'BND' when k = 1 then case when l_linenumber = 2 then 'DUP' else 'INS' end when k = 2 then 'DEL'
       when k = 3 then case when l_linenumber = 5 then 'BND' else 'DUP' end else 'INV' end as svtype,
  case when k = 0 and l_linenumber <> 3 then cast(0 as bigint) when k = 2 then -len else len end as svlen,
  k = 4 as inv,
  cast(l_quantity as bigint) % 12 - 1 as count,
  cast(1.0 as double) as vaf
from (
  select *, l_partkey % 5 as k,
    cast(case l_partkey % 6 when 0 then 90 when 1 then 400 when 2 then 3000 when 3 then 15000 when 4 then 60000 else 1500000 end
         + {_BASES} * (l_partkey % 30) as bigint) as len
  from lineitem)
"""

# Calls of the reads at one locus, and those reads in long form.
_LOCUS = "concat('sv_', cast(l_partkey as string), '_', cast(l_suppkey % 5 as string), case when l_partkey % 3 = 0 then '_x' else '_y' end)"
VIEWS["locus_calls"] = f"""
select
  cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as int) as file_id,
  l_partkey * 5 + l_suppkey % 5 as line_no,
  {_LOCUS} as svid,
  {_CTG} as ctg,
  l_partkey * 50000 + min({_BASES}) * 4 as pos,
  case l_partkey % 5 when 3 then '<<' when 4 then '><' else '>>' end as ori,
  case when l_partkey % 5 = 0 then {_NEXT_CTG} else {_CTG} end as ctg2,
  case when l_partkey % 5 = 1 then l_partkey * 50000 + min({_BASES}) * 4 else l_partkey * 50000 + 250 end as pos2,
  case l_partkey % 5 when 0 then 'BND' when 1 then 'INS' when 2 then 'DEL' when 3 then 'DUP' else 'INV' end as svtype,
  cast(case l_partkey % 5 when 0 then 0 when 2 then -1 else 1 end * (150 + l_partkey % 400 * 9 + case when l_partkey % 50 = 3 then 100000 else 0 end) as bigint) as svlen,
  l_partkey % 5 = 4 as inv,
  cast(count(*) as bigint) as count,
  cast(1.0 as double) as vaf
from lineitem
group by l_returnflag, l_partkey, l_suppkey % 5
"""
VIEWS["locus_reads"] = f"""
select
  cast(case l_returnflag when 'A' then 0 when 'N' then 1 else 2 end as int) as file_id,
  {_LOCUS} as svid,
  concat('r', cast(l_orderkey as string)) as read
from lineitem
"""

VIEWS["bed"] = """
select concat('chr', cast(n_nationkey % 5 + 1 as string)) as ctg,
  cast(n_nationkey * 1600000 + n_regionkey * 1000 as bigint) as st,
  cast(n_nationkey * 1600000 + 1300000 as bigint) as en
from nation
"""
VIEWS["cen"] = """
select concat('chr', cast(n_nationkey % 4 + 1 as string)) as ctg,
  cast(n_nationkey * 4000000 + 1000000 as bigint) as st,
  cast(n_nationkey * 4000000 + 1000000 + (n_regionkey + 1) * 1400000 as bigint) as en
from nation
"""
VIEWS["haps"] = """
select concat('r', cast(o_orderkey as string)) as read,
  case o_orderpriority when '1-URGENT' then '1' when '2-HIGH' then '2' else 'NA' end as hp,
  o_orderkey as line_no
from orders
"""
VIEWS["repeats"] = """
select concat('chr', cast(s_suppkey % 5 + 1 as string)) as ctg,
  cast(s_suppkey * 41000 as bigint) as st, cast(s_suppkey * 41000 + 30000 as bigint) as en,
  concat('tr', cast(s_suppkey as string)) as data
from supplier
"""
VIEWS["segdups"] = """
select concat('chr', cast(s_suppkey % 5 + 1 as string)) as ctg,
  cast(s_suppkey * 67000 as bigint) as st, cast(s_suppkey * 67000 + 25001 as bigint) as en,
  concat('sd', cast(s_suppkey as string)) as data
from supplier
"""

# Alignments: every row is one alignment of its order's read, in line order along the read.
_QST = "(l_linenumber * 9000 + l_partkey % 40 * 10)"
_ALN = f"""
  select
    concat('r', cast(l_orderkey as string)) as qname,
    cast(90000 as bigint) as qlen,
    cast({_QST} as bigint) as qst,
    cast({_QST} + case when l_quantity < 5 then 900 when l_quantity < 8 then 40 else 8800 end as bigint) as qen,
    case when l_linestatus = 'O' then '+' else '-' end as strand,
    {_CTG} as path,
    cast(2000000000 as bigint) as tlen,
    cast(l_partkey % 300 * 7000 + l_suppkey * 10 as bigint) as tst,
    cast(l_partkey % 300 * 7000 + l_suppkey * 10 + 9000 as bigint) as ten,
    cast(case when l_discount > 0.08 then 20 else 60 end as int) as mapq
  from lineitem"""
VIEWS["chain_alns"] = _ALN
VIEWS["aln_lines"] = """
select 0 as file_id, line_no, max(line) as line from (select row_no as line_no, concat(
  'r', cast(row_no as string), '\t', cast(qlen as string), '\t', cast(qst as string), '\t', cast(qen as string), '\t', strand, '\t', path,
  '\t', cast(tlen as string), '\t', cast(tst as string), '\t', cast(ten as string), '\t9000\t9000\t', cast(mapq as string),
  '\ttp:A:', tp, '\tcg:Z:', cg, case when ds is null then '' else concat('\tds:Z:', ds) end) as line
from ({rows})) group by line_no
"""
# One alignment with a long insertion (i), a long deletion (d) and a short one, per row.
VIEWS["indel_alns"] = """
select
  (l_orderkey * 8 + l_linenumber) * 100000000 + cast(round(l_extendedprice * 100) as bigint) as row_no,
  cast(20000 as bigint) as qlen, cast(l_linenumber * 10 as bigint) as qst, cast(l_linenumber * 10 + a + i + b + c as bigint) as qen,
  case when graph then '+' when l_linestatus = 'O' then '+' else '-' end as strand,
  case when graph then concat('>chr1:', cast(1000 + l_partkey as string), '-', cast(1000 + l_partkey + 7000 as string),
                              '<chr2:', cast(2000 + l_suppkey as string), '-', cast(2000 + l_suppkey + 30000 as string))
       else concat('chr', cast(l_suppkey % 5 + 1 as string)) end as path,
  cast(case when graph then 37000 else 900000000 end as bigint) as tlen,
  cast(case when graph then 500 + l_partkey % 100 else l_partkey * 100 end as bigint) as tst,
  cast(case when graph then 500 + l_partkey % 100 else l_partkey * 100 end + a + b + d + c as bigint) as ten,
  case when l_discount > 0.09 then 3 else 60 end as mapq,
  case when l_tax > 0.07 then 'S' else 'P' end as tp,
  a, b, c, i, d, l, r, graph, body,
  concat(cast(a as string), 'M', cast(i as string), 'I', cast(b as string), 'M', cast(d as string), 'D', '20X', cast(c - 20 as string), '=') as cg,
  case when l_linenumber = 7 then null else concat(':', cast(a as string), '+',
    case when l > 0 then concat('[', repeat('g', cast(l as int)), ']') else '' end, body,
    case when r > 0 then concat('[', repeat('t', cast(r as int)), ']') else '' end,
    ':', cast(b as string), '-', repeat('c', cast(d as int)), repeat('*ag', 20), ':', cast(c - 20 as string)) end as ds
from (
  select *, concat(repeat('c', cast(i - l - r - l_partkey % 60 as int)), case when l_suppkey % 2 = 0 then repeat('a', cast(l_partkey % 60 as int)) else repeat('g', cast(l_partkey % 60 as int)) end) as body
  from (
    select *, l_linenumber % 3 = 0 as graph,
      cast(4000 + l_partkey % 4000 as bigint) as a, cast(3000 + cast(l_quantity as bigint) * 60 as bigint) as b,
      cast(9000 as bigint) as c, cast(90 + l_suppkey % 50 as bigint) as i, cast(80 + cast(l_quantity as bigint) as bigint) as d,
      cast(l_suppkey % 4 * 3 as bigint) as l, cast(l_orderkey % 3 * 4 as bigint) as r
    from lineitem))
"""
VIEWS["aln_lines"] = VIEWS["aln_lines"].replace("{rows}", VIEWS["indel_alns"])

# VCF lines of all record styles, mates in pairs.
VIEWS["vcf_rows"] = f"""
select
  (l_orderkey * 8 + l_linenumber) * 200000000 + cast(round(l_extendedprice * 100) as bigint) * 2 as line_no, 0 as mate_no, style, {_CTG} as chrom, p as vpos, p2 as vpos2, len,
  case when style = 9 then {_CTG} else {_NEXT_CTG} end as chrom2, x as bk, flt, sup, oid
from (
  select *, cast(l_partkey * 100 + l_linenumber + 1 as bigint) as p, cast(l_partkey * 100 + 5000 + l_suppkey as bigint) as p2,
    cast(60 + l_partkey % 900 as bigint) as len, cast((l_orderkey + l_linenumber) % 11 as int) as style,
    l_suppkey % 4 as x, case when l_discount > 0.09 then 'LOWQ' when l_tax > 0.06 then '.' else 'PASS' end as flt,
    cast(l_quantity as bigint) % 9 as sup,
    concat(cast(l_orderkey as string), 'l', cast(l_linenumber as string), 'p', cast(cast(round(l_extendedprice * 100) as bigint) as string)) as oid
  from lineitem)
"""
