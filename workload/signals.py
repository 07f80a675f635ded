"""Signal queries: extraction, typing, intersection, clustering of reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import coords, sequence
from strandloom.functions.typing import canonical_id, length_class, split_read_type, type_flag
from strandloom.operators import extract as X
from strandloom.operators import long_indels as LI
from strandloom.operators.intersect import intersect
from strandloom.operators.intervals import merged
from strandloom.operators.merge import cluster_reads, clusters, merge_signals, only_sources
from strandloom.params import ExtractParams, MergeParams
from strandloom.plans.flows import mosaic_calls
from strandloom.sources.alignments import parse_alignments
from strandloom.sources.calls import kept_rows
from strandloom.sources.writers import call_lines, signal_lines, vcf_records
from workload.registry import query, with_views
from workload.views import VIEWS

SIG = "ctg, pos, en, is_bp, ori, ctg2, pos2, svtype, svlen"
SIG_COLS = "ctg pos en is_bp ori ctg2 pos2 read mapq strand svtype svlen qoff_l qoff_r source".split()
FLAG = (
    "case when {0}svtype in ('INS','DUP') then 1 when {0}svtype = 'DEL' then 2 when {0}svtype = 'INV' then 4 "
    "when {0}svtype = 'BND' and {0}ctg <> coalesce({0}ctg2, {0}ctg) then 8 else 0 end"
)


def exists_sql(alt: str, w: int) -> str:
    f, g = FLAG.format("b."), FLAG.format("a.")
    return (
        f"exists (select 1 from {alt} a where a.read = b.read and b.qoff_l - {w} < a.qoff_r and a.qoff_l < b.qoff_r + {w} "
        f"and (({f}) = 0 or ({g}) = 8 or ((({f}) & ({g})) <> 0)))"
    )


@query("isec_one", with_views(f"select {', '.join(SIG_COLS)} from sig b where {exists_sql('alt1', 1000)}", "sig", "alt1"))
def isec_one(s):
    return intersect(s.view("sig"), [s.view("alt1")], 1000).select(*SIG_COLS)


@query(
    "isec_all",
    with_views(
        f"select {', '.join(SIG_COLS)} from sig b where "
        + " and ".join(exists_sql(a, 500) for a in ("alt1", "alt2", "alt3")),
        "sig", "alt1", "alt2", "alt3",
    ),
)
def isec_all(s):
    return intersect(s.view("sig"), [s.view("alt1"), s.view("alt2"), s.view("alt3")], 500).select(*SIG_COLS)


# Clustering ---------------------------------------------------------------------------------------

SAME_SIGNAL = """
  u.x.is_bp = n.is_bp and u.x.svtype = n.svtype and abs(u.x.pos - n.pos) <= 100
  and case when n.is_bp
        then (u.x.ori = n.ori or (u.x.ori in ('><','<>') and n.ori in ('><','<>'))) and u.x.ctg2 = n.ctg2 and abs(u.x.pos2 - n.pos2) <= 100
        else abs(u.x.en - n.en) <= 100 end
  and (u.x.svlen is null or n.svlen is null
       or (u.x.svlen * n.svlen > 0 and abs(abs(u.x.svlen) - abs(n.svlen)) <= 0.025 * (abs(u.x.svlen) + abs(n.svlen))))
"""


def merge_ctes(src: str) -> str:
    """Recursive clustering over ``src``: every row with its cluster seed ``cid`` and arrival rank."""
    nf = " nulls first, "
    order = nf.join(
        "pos is_bp en ori ctg2 pos2 svtype svlen cen_dist cen_overlap mapq polya_len qoff_l qoff_r source strand tsd_len read".split()
    ) + " nulls first"
    return f"""
    m_gap as (select *, case when pos - lag(pos) over (partition by ctg order by pos) <= 100 then 0 else 1 end as brk from {src}),
    m_isl as (select *, sum(brk) over (partition by ctg order by pos range unbounded preceding) as isl from m_gap),
    n as (select *, row_number() over (partition by ctg, isl order by {order}) as rn from m_isl),
    r(ctg, isl, rn, cid, st) as (
      select ctg, isl, rn, rn, [{{'cid': rn, 'pos': pos, 'en': en, 'is_bp': is_bp, 'ori': ori, 'ctg2': ctg2, 'pos2': pos2, 'svtype': svtype, 'svlen': svlen}}]
      from n where rn = 1
      union all
      select n.ctg, n.isl, n.rn, coalesce(m.hit, n.rn),
        list_append(r.st, {{'cid': coalesce(m.hit, n.rn), 'pos': n.pos, 'en': n.en, 'is_bp': n.is_bp, 'ori': n.ori, 'ctg2': n.ctg2, 'pos2': n.pos2, 'svtype': n.svtype, 'svlen': n.svlen}})
      from r join n on n.ctg = r.ctg and n.isl = r.isl and n.rn = r.rn + 1,
        lateral (select arg_max(cid, k * 1000000 - cid) as hit
                 from (select u.x.cid as cid, count(*) as k from (select unnest(r.st) as x) u where {SAME_SIGNAL} group by 1) z) m),
    placed as (select n.*, r.cid, row_number() over (partition by n.ctg, n.isl, r.cid order by n.rn) - 1 as rk,
                 count(*) over (partition by n.ctg, n.isl, r.cid) as cn
               from n join r on n.ctg = r.ctg and n.isl = r.isl and n.rn = r.rn),
    by_src as (select ctg, isl, cid, source, min(rn) as f, count(*) filter (strand = '+') as p, count(*) filter (strand <> '+') as q
               from placed group by all),
    cnt as (select ctg, isl, cid, string_agg(concat(source, ':', p, ',', q), '|' order by f) as count, string_agg(source, ',' order by source) as sources
            from by_src group by all),
    rts as (select ctg, isl, cid, least(tsd_len, abs(polya_len)) as rt, row_number() over (partition by ctg, isl, cid order by rn) - 1 as rk,
              count(*) over (partition by ctg, isl, cid) as cn
            from placed where tsd_len is not null and polya_len is not null),
    sums as (select ctg, isl, cid, count(*) as n_reads, count(*) filter (strand = '+') as n_fwd, sum(mapq) as mq,
               count(*) filter (ori = '><') as count_fr, count(*) filter (ori = '<>') as count_rf
             from placed group by all),
    clusters as (
      select s.ctg, p.pos, p.en, p.is_bp, p.ori, p.ctg2, p.pos2, p.strand, p.svtype, p.svlen, p.qoff_l, p.qoff_r, p.cen_dist, p.cen_overlap,
        cast(s.n_reads as bigint) as n_reads, cast(s.n_fwd as bigint) as n_fwd, cast(floor(s.mq / s.n_reads + 0.5) as bigint) as avg_mapq,
        c.count, c.sources, cast(coalesce(t.rt, 0) as bigint) as rt_len, cast(s.count_fr as bigint) as count_fr, cast(s.count_rf as bigint) as count_rf,
        (s.count_fr + s.count_rf > 0 and s.count_fr * s.count_rf = 0 and coalesce(s.ctg = p.ctg2, false)) as foldback
      from sums s join cnt c on s.ctg = c.ctg and s.isl = c.isl and s.cid = c.cid
        join placed p on s.ctg = p.ctg and s.isl = p.isl and s.cid = p.cid and p.rk = p.cn // 2
        left join rts t on s.ctg = t.ctg and s.isl = t.isl and s.cid = t.cid and t.rk = t.cn // 2)
    """


NEAR_CEN = "(coalesce(cen_overlap > 0, false) or coalesce(cen_dist <= 500000, false))"
CALL_COLS = (
    "ctg pos en is_bp ori ctg2 pos2 strand svtype svlen qoff_l qoff_r n_reads n_fwd avg_mapq count rt_len count_fr count_rf foldback"
).split()
_CC = ", ".join(CALL_COLS)


def merged_sql(src: str, where: str, cols: str = _CC) -> str:
    return f"with recursive {merge_ctes(src)} select {cols} from clusters where {where}"


@query("merge_calls", with_views(merged_sql("sig", f"n_reads >= 4 and n_fwd >= 2 and n_reads - n_fwd >= 2 and not {NEAR_CEN}"), "sig"))
def merge_calls(s):
    return merge_signals(s.view("sig")).select(*CALL_COLS)


RELAXED = MergeParams(min_count=2, min_count_strand=0, min_rt_len=10, min_cen_dist=0)


@query("merge_rescued", with_views(merged_sql("sig", "rt_len >= 10 or n_reads >= 2"), "sig"))
def merge_rescued(s):
    return merge_signals(s.view("sig"), RELAXED).select(*CALL_COLS)


@query(
    "merge_reads",
    with_views(
        f"""with recursive {merge_ctes('sig')},
      pk as (select *, concat_ws('|', cast(is_bp as varchar), coalesce(svtype, ''), coalesce(ctg2, '')) as kind from placed),
      pg as (select *, case when pos - lag(pos) over (partition by ctg, kind order by pos) <= 100 then 0 else 1 end as kb from pk),
      pi as (select *, sum(kb) over (partition by ctg, kind order by pos range unbounded preceding) as ki from pg)
      select ctg, cast(min(pos) over (partition by ctg, kind, ki) as bigint) as island,
        cast(dense_rank() over (partition by ctg, kind, ki order by isl, cid) - 1 as bigint) as cluster, read, pos, svtype, svlen from pi""",
        "sig",
    ),
)
def merge_reads(s):
    rows = cluster_reads(s.view("sig"), RELAXED, whole=True)
    return rows.select("ctg", "island", "cluster", "read", "pos", "svtype", "svlen")


@query(
    "somatic_only",
    with_views(
        merged_sql("sig", "n_reads >= 2 and list_contains(string_split(sources, ','), 'TUMOR') and not list_contains(string_split(sources, ','), 'NORMAL')"),
        "sig",
    ),
)
def somatic_only(s):
    p = MergeParams(min_count=2, min_count_strand=0, min_cen_dist=0)
    return only_sources(merge_signals(s.view("sig"), p), "TUMOR", "NORMAL").select(*CALL_COLS)


@query(
    "flagship_mosaic_calls",
    with_views(
        "with recursive kept as (select * from sig b where " + exists_sql("alt1", 1000) + " and " + exists_sql("alt3", 1000) + "), "
        + merged_sql("kept", f"n_reads >= 2 and not {NEAR_CEN}")[len("with recursive"):],
        "sig", "alt1", "alt3",
    ),
)
def flagship_mosaic_calls(s):
    return mosaic_calls(s.view("sig"), [s.view("alt1"), s.view("alt3")]).select(*CALL_COLS)


_INFO_SQL = (
    "concat('avg_mapq=', avg_mapq, ';count=', count, ';rt_len=', rt_len, ';SVTYPE=', svtype, case when svlen is not null then concat(';SVLEN=', svlen) else '' end, "
    "case when count_fr + count_rf > 0 then concat(';count_fr=', count_fr, ';count_rf=', count_rf, case when foldback then ';foldback' else '' end) else '' end)"
)


@query(
    "call_text",
    with_views(
        merged_sql(
            "sig", f"n_reads >= 4 and n_fwd >= 2 and n_reads - n_fwd >= 2 and not {NEAR_CEN}",
            f"case when is_bp then concat_ws(chr(9), ctg, pos, ori, ctg2, pos2, '.', n_reads, strand, {_INFO_SQL}) "
            f"else concat_ws(chr(9), ctg, pos, en, '.', n_reads, strand, {_INFO_SQL}) end as line",
        ),
        "sig",
    ),
)
def call_text(s):
    return call_lines(merge_signals(s.view("sig")))


@query(
    "genvcf_records",
    with_views(
        "with recursive " + merge_ctes("sig") + f""",
        c as (select *, row_number() over (partition by svtype order by ctg, pos, is_bp, en nulls first, ori nulls first, ctg2 nulls first, pos2 nulls first, svlen nulls first, n_reads, count, avg_mapq) as no
              from clusters where n_reads >= 4 and n_fwd >= 2 and n_reads - n_fwd >= 2 and not {NEAR_CEN}),
        v as (select *, concat(lower(svtype), '_', no) as id, concat('SVTYPE=', svtype, case when svlen is not null then concat(';SVLEN=', svlen) else '' end,
                ';END=', case when is_bp then pos2 else en end) as info from c)
        select concat_ws(chr(9), ctg, pos + 1, id, 'N', concat('<', svtype, '>'), n_reads, 'PASS', info, 'GT', '1/1') as line from v where svtype <> 'BND'
        union all
        select concat_ws(chr(9), ctg, pos + 1, concat(id, '_1'), 'N',
          case ori when '>>' then concat('N[', ctg2, ':', pos2 + 1, '[') when '<<' then concat(']', ctg2, ':', pos2 + 1, ']N') when '><' then concat('N]', ctg2, ':', pos2 + 1, ']') else concat('[', ctg2, ':', pos2 + 1, '[N') end,
          n_reads, 'PASS', concat(info, ';MATEID=', id, '_2'), 'GT', '1/1') from v where svtype = 'BND'
        union all
        select concat_ws(chr(9), ctg2, pos2 + 1, concat(id, '_2'), 'N',
          case ori when '>>' then concat(']', ctg, ':', pos + 1, ']N') when '<<' then concat('N[', ctg, ':', pos + 1, '[') when '><' then concat('N]', ctg, ':', pos + 1, ']') else concat('[', ctg, ':', pos + 1, '[N') end,
          n_reads, 'PASS', concat(info, ';MATEID=', id, '_1'), 'GT', '1/1') from v where svtype = 'BND'""",
        "sig",
    ),
)
def genvcf_records(s):
    return vcf_records(merge_signals(s.view("sig")))


# Extraction ---------------------------------------------------------------------------------------

_OP = "unnest(regexp_extract_all(cg, '(\\d+)([=XIDM])', {})) as {}"
CIGAR_SQL = f"""
  ops as (select row_no, {_OP.format(1, 'nn')}, {_OP.format(2, 'op')}, generate_subscripts(regexp_extract_all(cg, '(\\d+)([=XIDM])', 1), 1) as o from a0),
  cur as (select row_no, o, op, cast(nn as bigint) as nn,
    coalesce(sum(case when op = 'I' then 0 else cast(nn as bigint) end) over (partition by row_no order by o rows between unbounded preceding and 1 preceding), 0) as x,
    coalesce(sum(case when op = 'D' then 0 else cast(nn as bigint) end) over (partition by row_no order by o rows between unbounded preceding and 1 preceding), 0) as q
    from ops),
  ind as (select a0.*, op, nn, cast(tst + x as bigint) as ist, cast(tst + x + case when op = 'D' then nn else 0 end as bigint) as ien,
    cast(case when op = 'D' then -nn else nn end as bigint) as ilen,
    cast(case when strand = '-' then qen - q - case when op = 'I' then nn else 0 end else qst + q end as bigint) as ql,
    cast(case when strand = '-' then qen - q else qst + q + case when op = 'I' then nn else 0 end end as bigint) as qr
    from cur join a0 using (row_no) where op in ('I', 'D') and nn >= 100),
  ok as (select * from (select *, count(*) over (partition by row_no) as n_ind from ind) where n_ind <= qlen * 1e-4 * 3)
"""
_A0 = (
    "a0 as (select *, row_number() over () as row_key from indel_alns where mapq >= 5 and tp = 'P' and qen - qst >= qlen * 0.7)"
).replace("select *, row_number() over () as row_key", "select * replace (row_number() over () as row_no), row_no as src_no")


def typed_alignments(s):
    rows = s.spread("indel_alns").filter("mapq >= 5 and tp = 'P'")
    return rows.select(
        F.concat(F.lit("r"), "row_no").alias("qname"), "qlen", "qst", "qen", "strand", "path", "tlen", "tst", "ten", "mapq", "cg", "ds"
    )


# A line for every row of ``indel_alns``: rows may share a number, so lines are not told apart by it.
ALN_TEXT = VIEWS["aln_lines"].replace(VIEWS["indel_alns"], "select * from indel_alns").replace("max(line) as line", "line").replace(") group by line_no", ")")


@query(
    "parse_alignments",
    with_views(
        "select concat('r', row_no) as qname, qlen, qst, qen, strand, path, tlen, tst, ten, cast(mapq as int) as mapq, cg, ds from indel_alns where mapq >= 5 and tp = 'P'",
        "indel_alns",
    ),
)
def parsed_alignments(s):
    return parse_alignments(kept_rows(s.sql(ALN_TEXT, "indel_alns"), F.lit(True), "line"))


@query(
    "cigar_indels",
    with_views(
        f"with {_A0}, {CIGAR_SQL} select concat('r', src_no) as qname, ist as st, ien as en, ilen as len, ql as qoff_l, qr as qoff_r from ok",
        "indel_alns",
    ),
)
def cigar_indels(s):
    rows = X.aligned_indels(typed_alignments(s))
    return rows.select("qname", F.explode_outer("indels").alias("d")).filter("d is not null").select("qname", "d.*")


_FLANKS = """
  fl as (select *, case when ds is null or op = 'D' then 0 else l end as fl_l, case when ds is null or op = 'D' then 0 else r end as fl_r from ok),
  seg as (select *, case when graph then case when ist < 7000 then 1 else 2 end else 0 end as sg,
    case when graph and ist - fl_r < 7000 and ien - fl_r <= 7000 and ist + fl_l < 7000 and ien + fl_l <= 7000 then 1
         when graph and ist - fl_r >= 7000 and ien - fl_r > 7000 then 2 when graph then -1 else 0 end as one from fl)
"""


@query(
    "extract_indels",
    with_views(
        f"""with {_A0}, {CIGAR_SQL}, {_FLANKS}
        select concat('r', src_no) as read, cast(mapq as int) as mapq,
          case one when 0 then path when 1 then 'chr1' else 'chr2' end as ctg,
          case one when 0 then ist - fl_r when 1 then 1000 + p1 + ist - fl_r else 2000 + p2 + 30000 - (ien + fl_l - 7000) end as pos,
          case one when 0 then ien - fl_r when 1 then 1000 + p1 + ien - fl_r else 2000 + p2 + 30000 - (ist + fl_l - 7000) end as en,
          case when one = 2 then '-' else strand end as strand,
          case when op = 'I' then 'INS' else 'DEL' end as svtype, ilen as svlen,
          ql - case when strand = '-' then fl_l else fl_r end as qoff_l, qr + case when strand = '-' then fl_r else fl_l end as qoff_r,
          fl_l + fl_r as tsd_len,
          cast(case when op = 'D' or ds is null then 0 else (case when one = 2 then -1 else 1 end) * coalesce(length(regexp_extract(body, 'a+$')), 0) end as bigint) as polya_len,
          case when fl_l + fl_r = 0 then '.' when one = 2 then concat(repeat('c', fl_l), repeat('a', fl_r)) else concat(repeat('t', fl_r), repeat('g', fl_l)) end as tsd_seq,
          case when ds is null then '.' else (case when one = 2 then translate(reverse(case when op = 'D' then repeat('c', d) else body end), 'acgt', 'tgca') else case when op = 'D' then repeat('c', d) else body end end) end as insert_seq
        from (select *, case when graph then cast(regexp_extract(path, 'chr1:(\\d+)', 1) as bigint) - 1000 end as p1,
                     case when graph then cast(regexp_extract(path, 'chr2:(\\d+)', 1) as bigint) - 2000 end as p2 from seg) where one >= 0""",
        "indel_alns",
    ),
)
def extract_indels(s):
    return X.indel_signals(typed_alignments(s)).select(
        "read", "mapq", "ctg", "pos", "en", "strand", "svtype", "svlen", "qoff_l", "qoff_r", "tsd_len", "polya_len",
        "tsd_seq", "insert_seq",
    )


@query(
    "path_segments",
    with_views(
        """with p as (select distinct path from indel_alns where graph),
        e as (select path, unnest(regexp_extract_all(path, '([><])([^><:\\s]+):(\\d+)-(\\d+)', 2)) as ctg,
          cast(unnest(regexp_extract_all(path, '([><])([^><:\\s]+):(\\d+)-(\\d+)', 3)) as bigint) as st,
          cast(unnest(regexp_extract_all(path, '([><])([^><:\\s]+):(\\d+)-(\\d+)', 4)) as bigint) as en,
          unnest(regexp_extract_all(path, '([><])([^><:\\s]+):(\\d+)-(\\d+)', 1)) = '>' as fwd,
          generate_subscripts(regexp_extract_all(path, '([><])([^><:\\s]+):(\\d+)-(\\d+)', 1), 1) as k from p)
        select path, ctg, st, en, fwd, cast(coalesce(sum(en - st) over (partition by path order by k rows between unbounded preceding and 1 preceding), 0) as bigint) as p_st,
          cast(sum(en - st) over (partition by path order by k) as bigint) as p_en from e""",
        "indel_alns",
    ),
)
def path_segments(s):
    rows = s.view("indel_alns").filter("graph").select("path", "tlen").dropDuplicates(["path"])
    return rows.select("path", F.explode(coords.path_segments("path", "tlen")).alias("g")).select("path", "g.*")


_CHAIN = """
  o as (select *, qen - qst as aln_len, row_number() over (partition by qname order by qst, qen, path, tst, ten, strand, mapq) as rn from chain_alns),
  g as (select *, min(case when aln_len >= 2000 and mapq >= 30 then rn end) over (partition by qname) as lo,
          max(case when aln_len >= 2000 and mapq >= 30 then rn end) over (partition by qname) as hi from o),
  kept as (select * from g where rn between lo and hi and aln_len >= 50)
"""


@query("end_trim", with_views(f"with {_CHAIN} select qname, qst, qen, path, tst, mapq, aln_len from kept", "chain_alns"))
def end_trim(s):
    return X.trimmed_chain(s.view("chain_alns")).select("qname", "qst", "qen", "path", "tst", "mapq", "aln_len")


_PAIRS = (
    "with " + _CHAIN + """,
  e as (select *, case strand when '+' then '>' else '<' end as ori, case strand when '+' then tst else ten - 1 end as h, case strand when '+' then ten - 1 else tst end as t from kept),
  l as (select *, lag(path) over w as path0, lag(ori) over w as ori0, lag(t) over w as t0, lag(qen) over w as qen0, lag(mapq) over w as mapq0, lag(aln_len) over w as len0
        from e window w as (partition by qname order by qst, qen, path, tst, ten, strand, mapq)),
  pr as (select qname as read, qst - qen0 as qgap, least(qen0, qst) as qoff_l, greatest(qen0, qst) as qoff_r, least(mapq, mapq0) as mapq, mapq0 as mapq_l, mapq as mapq_r,
    len0 as aln_len_l, aln_len as aln_len_r, (path0 < path or (path0 = path and t0 < h)) as fw, path0, path, t0, h, ori0, ori, len0, aln_len from l where path0 is not null),
  cn as (select *, case when fw then path0 else path end as ctg, case when fw then t0 else h end as pos, case when fw then path else path0 end as ctg2, case when fw then h else t0 end as pos2,
    case when fw then concat(ori0, ori) else translate(concat(ori, ori0), '<>', '><') end as ori2, case when fw then '+' else '-' end as strand,
    case when fw then len0 else aln_len end as ql0, case when fw then aln_len else len0 end as ql1 from pr),
  ty as (select *, pos2 - pos + 1 as sp from cn),
  kd as (select *, case when ctg <> ctg2 then 7 when ori2 = '>>' and qgap < sp and sp - qgap >= 100 then 2 when ori2 = '>>' and sp < qgap and qgap - sp >= 100 then 3
    when ori2 = '<<' and qgap > 0 and (sp < ql0 or sp < ql1) and qgap + sp >= 100 then 4 when ori2 = '<<' and qgap + sp >= 100 then 5
    when ori2 in ('<>', '><') and sp >= 100 then 6 else 7 end as k from ty)
"""
)
_TYPED = """
  case k when 2 then 'DEL' when 3 then 'INS' when 4 then 'INS' when 5 then 'DUP' when 6 then 'INV' else 'BND' end as svtype,
  cast(case k when 2 then qgap - sp when 3 then qgap - sp when 4 then qgap + sp when 5 then qgap + sp when 6 then sp - qgap end as bigint) as svlen,
  cast(case when k in (2, 6) then pos + least(qgap, 0) when k in (3, 4) then pos when k = 5 then greatest(pos - greatest(qgap, 0), 0) end as bigint) as region_st,
  cast(case when k in (2, 6) then pos2 + 1 - least(qgap, 0) when k in (3, 4) then pos2 + 1 when k = 5 then pos2 + 1 + greatest(qgap, 0) end as bigint) as region_en,
  cast(case k when 2 then -least(qgap, 0) when 4 then sp end as bigint) as tsd_len
"""


@query(
    "breakends",
    with_views(
        _PAIRS + f" select ctg, pos, ori2 as ori, ctg2, pos2, read, mapq, strand, {_TYPED}, qoff_l, qoff_r, qgap, mapq_l, mapq_r, aln_len_l, aln_len_r from kd",
        "chain_alns",
    ),
)
def breakends(s):
    return X.breakends(s.view("chain_alns"))


_DIST = "case when {p} < c.st then c.st - {p} when {p} < c.en then 0 else {p} - c.en end"
_CEN_SQL = (
    _PAIRS + f""", sv as (select *, row_number() over () as i, {_TYPED} from kd),
  d as (select i, min(d) as dist from (
      select i, {_DIST.format(p='pos')} as d from sv join cen c on c.ctg = sv.ctg union all select i, {_DIST.format(p='pos2')} from sv join cen c on c.ctg = sv.ctg2) group by i),
  cl as (select i, greatest(c.st, region_st) as a, least(c.en, region_en) as b from sv join cen c on c.ctg = sv.ctg where c.st < region_en and c.en > region_st),
  cm as (select i, a, b, max(b) over (partition by i order by a, b rows between unbounded preceding and 1 preceding) as upto from cl),
  ov as (select i, sum(greatest(0, b - greatest(a, coalesce(upto, a)))) as cov from cm group by i)
  select read, sv.ctg, pos, ctg2, pos2, cast(dist as bigint) as cen_dist, cast(case when dist is not null and region_st >= 0 and region_en >= region_st then coalesce(cov, 0) end as bigint) as cen_overlap
  from sv left join d using (i) left join ov using (i)"""
)


@query("cen_breakends", with_views(_CEN_SQL, "chain_alns", "cen"))
def cen_breakends(s):
    rows = X.breakend_signals(s.view("chain_alns"), cen=merged(s.view("cen")))
    return rows.select("read", "ctg", "pos", "ctg2", "pos2", "cen_dist", "cen_overlap")


# Indels near any of many overlapping and touching regions, on both ends.
_IV = "select concat('chr', cast(s_suppkey % 5 + 1 as string)) as ctg, cast(s_suppkey % 97 * 9100 as bigint) as st, cast(s_suppkey % 97 * 9100 + s_suppkey % 11 * 1700 as bigint) as en from supplier"


@query(
    "cen_indels",
    with_views(
        f"""iv as ({_IV}), s as (select distinct ctg, pos, en from sig where not is_bp),
        d as (select s.ctg, s.pos, s.en, min(least({_DIST.format(p='s.pos').replace('c.', 'iv.')}, {_DIST.format(p='s.en').replace('c.', 'iv.')})) as dist from s join iv on s.ctg = iv.ctg group by all)
        select sig.ctg, sig.pos, sig.en, read, cast(dist as bigint) as cen_dist from sig left join d on sig.ctg = d.ctg and sig.pos = d.pos and sig.en = d.en where not is_bp""".replace("iv as (", "with iv as (", 1),
        "sig",
    ),
)
def cen_indels(s):
    s.table("supplier").createOrReplaceTempView("supplier")
    regions = s.spark.sql(_IV)
    rows = s.view("sig").filter("not is_bp").select("ctg", "pos", "en", "read")
    return X.with_indel_centromere(rows, merged(regions))


@query(
    "signal_text",
    with_views(
        _PAIRS + f""", sv as (select *, {_TYPED} from kd)
        select concat_ws(chr(9), ctg, pos, ori2, ctg2, pos2, read, mapq, strand, concat('SVTYPE=', svtype, case when svlen is not null then concat(';SVLEN=', svlen, ';sv_region=', region_st, ',', region_en) else '' end,
          case when tsd_len is not null then concat(';tsd_len=', tsd_len) else '' end, ';qoff_l=', qoff_l, ';qoff_r=', qoff_r, ';qgap=', qgap, ';mapq=', mapq_l, ',', mapq_r, ';aln_len=', aln_len_l, ',', aln_len_r, ';source=foo')) as line from sv""",
        "chain_alns",
    ),
)
def signal_text(s):
    return signal_lines(X.breakend_signals(s.view("chain_alns")))


# Scalar rules -------------------------------------------------------------------------------------


@query(
    "infer_svtype",
    """with t as (select l_orderkey, l_linenumber, l_extendedprice, concat('chr', l_suppkey % 3) as ctg0, concat('chr', l_suppkey % 3 + case when l_tax > 0.07 then 1 else 0 end) as ctg1,
        l_partkey as p0, l_partkey + l_suppkey * 7 as p1, cast(l_quantity * 40 as bigint) as ql0, cast(l_linenumber * 90 as bigint) as ql1,
        case l_orderkey % 4 when 0 then '>>' when 1 then '<<' when 2 then '<>' else '><' end as ori, cast(l_linenumber * 130 - 400 as bigint) as qgap from lineitem),
      u as (select *, p1 - p0 + 1 as sp from t),
      k as (select *, case when ctg0 <> ctg1 then 7 when ori = '>>' and qgap < sp and sp - qgap >= 100 then 2 when ori = '>>' and sp < qgap and qgap - sp >= 100 then 3
        when ori = '<<' and qgap > 0 and (sp < ql0 or sp < ql1) and qgap + sp >= 100 then 4 when ori = '<<' and qgap + sp >= 100 then 5 when ori in ('<>','><') and sp >= 100 then 6 else 7 end as k, p0 as pos, p1 as pos2 from u)
      select l_orderkey, l_linenumber, l_extendedprice, """ + _TYPED + " from k",
)
def infer_svtype(s):
    rows = s.table("lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice", "concat('chr', l_suppkey % 3) ctg0",
        "concat('chr', l_suppkey % 3 + if(l_tax > 0.07, 1, 0)) ctg1", "l_partkey p0", "l_partkey + l_suppkey * 7 p1",
        "cast(l_quantity * 40 as bigint) ql0", "cast(l_linenumber * 90 as bigint) ql1",
        "case l_orderkey % 4 when 0 then '>>' when 1 then '<<' when 2 then '<>' else '><' end ori",
        "cast(l_linenumber * 130 - 400 as bigint) qgap",
    )
    c = F.col
    t = split_read_type(c("ctg0"), c("p0"), c("ql0"), c("ctg1"), c("p1"), c("ql1"), c("ori"), c("qgap"), 100)
    return rows.select("l_orderkey", "l_linenumber", "l_extendedprice", t.alias("t")).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "t.*"
    )


@query(
    "type_and_length_classes",
    with_views(
        f"""select flag, len_class, cast(count(*) as bigint) as n from (select cast({FLAG.format('')} as int) as flag,
        case when abs(svlen) = 0 then 'translocation' when abs(svlen) >= 1000000 then '>1M' when abs(svlen) >= 100000 then '100kb-1M'
        when abs(svlen) >= 20000 then '20kb-100kb' when abs(svlen) >= 100 then '100bp-20kb' else '<100bp' end as len_class from calls) group by all""",
        "calls",
    ),
)
def type_and_length_classes(s):
    return s.view("calls").groupBy(
        type_flag(F.col("svtype"), F.col("ctg"), F.col("ctg2")).alias("flag"), length_class(F.abs("svlen")).alias("len_class")
    ).agg(F.count("*").alias("n"))


_ID = """select l_orderkey, l_linenumber, l_extendedprice, case l_linenumber % 5 when 0 then concat('severus_BND', l_partkey, '_', l_suppkey % 3)
  when 1 then concat('ID_', l_partkey, '_', l_suppkey % 4) when 2 then concat('r_', l_partkey, '_', l_suppkey % 3) when 3 then concat('d_', l_partkey, '_', l_suppkey % 2)
  else concat('Sniffles2.DEL.', l_partkey, '_1') end as svid from lineitem"""


@query(
    "svid_canon",
    f"""select *, case when starts_with(svid, 'severus') then regexp_replace(svid, '_[12]', '', 'g') when starts_with(svid, 'ID_') then regexp_replace(svid, '(ID_\\d+)_[12]', '\\1', 'g')
      when svid[1:2] in ('r_', 'd_', 'i_') then regexp_replace(svid, '(r_\\d+)_[01]', '\\1', 'g') else svid end as clean_id from ({_ID})""",
)
def svid_canon(s):
    s.table("lineitem").createOrReplaceTempView("lineitem")
    return s.spark.sql(_ID).withColumn("clean_id", canonical_id(F.col("svid")))


_SEQ = """select l_orderkey, l_linenumber, l_extendedprice, concat(repeat('t', cast(l_suppkey % 40 as int)), repeat('ac', cast(l_quantity as int)), repeat('A', cast(l_partkey % 50 as int)),
  case when l_tax > 0.05 then 'g' else '' end, repeat('a', cast(l_orderkey % 30 as int))) as seq from lineitem"""


@query(
    "polya_len",
    f"""with s as (select *, row_number() over () as i from ({_SEQ})),
    ch as (select i, unnest(string_split(reverse(seq), '')) as ra, unnest(string_split(seq, '')) as ft, generate_subscripts(string_split(seq, ''), 1) as j from s),
    sc as (select i, j, sum(case when upper(ra) = 'A' then 1 else -5 end) over (partition by i order by j) as a, sum(case when upper(ft) = 'T' then 1 else -5 end) over (partition by i order by j) as t from ch),
    mx as (select *, max(a) over (partition by i order by j rows between unbounded preceding and 1 preceding) as ma, max(t) over (partition by i order by j rows between unbounded preceding and 1 preceding) as mt from sc),
    st as (select i, min(case when greatest(coalesce(ma, 0), 0) - a > 100 then j end) as sa, min(case when greatest(coalesce(mt, 0), 0) - t > 100 then j end) as s_t from mx group by i),
    best as (select m.i, max(case when (sa is null or j <= sa) and a > 0 then a end) as ba, max(case when (s_t is null or j <= s_t) and t > 0 then t end) as bt from mx m join st using (i) group by m.i),
    ats as (select m.i, min(case when a = ba and (sa is null or j <= sa) then j end) as la, min(case when t = bt and (s_t is null or j <= s_t) then j end) as lt, any_value(ba) as ba, any_value(bt) as bt
           from mx m join st using (i) join best using (i) group by m.i)
    select l_orderkey, l_linenumber, l_extendedprice, cast(case when coalesce(ba, 0) >= coalesce(bt, 0) then coalesce(la, 0) else -lt end as bigint) as polya_len from s join ats using (i)""",
)
def polya_len(s):
    s.table("lineitem").createOrReplaceTempView("lineitem")
    return s.spark.sql(_SEQ).select(
        "l_orderkey", "l_linenumber", "l_extendedprice", sequence.poly_a_length("seq").cast("bigint").alias("polya_len")
    )


@query("merge_cluster_sizes", with_views(
    f"with recursive {merge_ctes('sig')} select n_reads, svtype, cast(count(*) as bigint) as n from clusters group by all", "sig"))
def merge_cluster_sizes(s):
    return clusters(s.view("sig")).groupBy("n_reads", "svtype").agg(F.count("*").alias("n"))


PARAMS = ExtractParams()


@query("indel_alignment_rows", with_views(
    f"""with {_A0}, {CIGAR_SQL}, z as (select *, case when op = 'I' then ist - 1 else ist end as s0, case when op = 'I' then ien + 1 else ien end as e0,
      cast(regexp_extract(path, 'chr1:(\\d+)', 1) as bigint) as a1, cast(regexp_extract(path, 'chr2:(\\d+)', 1) as bigint) as a2 from
      (select * from (select *, count(*) over (partition by row_no) as n_all from ind) where n_all <= 5)),
      y as (select *, case when not graph then 0 when e0 < 7000 then 1 when s0 >= 7000 then 2 else 3 end as w from z)
    select case w when 0 then path when 1 then 'chr1' when 2 then 'chr2' else path end as ctg,
      case w when 0 then s0 when 1 then a1 + s0 when 2 then a2 + 30000 - (e0 - 7000) else s0 end as st,
      case w when 0 then e0 when 1 then a1 + e0 when 2 then a2 + 30000 - (s0 - 7000) else e0 end as en,
      concat('r', src_no) as read, cast(mapq as int) as mapq, case when w = 2 then '-' when w = 3 then '+' else strand end as strand, ilen as len from y""".replace(
          "cast(regexp_extract(path, 'chr1:(\\d+)', 1) as bigint)", "try_cast(regexp_extract(path, 'chr1:(\\d+)', 1) as bigint)").replace(
          "cast(regexp_extract(path, 'chr2:(\\d+)', 1) as bigint)", "try_cast(regexp_extract(path, 'chr2:(\\d+)', 1) as bigint)"),
    "indel_alns"))
def indel_alignment_rows(s):
    return LI.alignment_indels(typed_alignments(s)).select("ctg", "st", "en", "read", "mapq", "strand", "len")


@query("indel_merge")
def indel_merge(s):
    return LI.merge_indels(LI.alignment_indels(typed_alignments(s)), min_count=2)


_SIG_TEXT = """select concat_ws('\t', ctg, cast(pos as string), case when is_bp then ori else cast(en as string) end, case when is_bp then ctg2 end, case when is_bp then cast(pos2 as string) end,
  read, cast(mapq as string), strand, concat('SVTYPE=', svtype, case when svlen is null then '' else concat(';SVLEN=', cast(svlen as string)) end, ';qoff_l=', cast(qoff_l as string), ';qoff_r=', cast(qoff_r as string),
  case when tsd_len is null then '' else concat(';tsd_len=', cast(tsd_len as string)) end, ';source=', source)) as line, * from sig"""


@query("parse_signals", with_views("select ctg, pos, en, is_bp, ori, ctg2, pos2, read, mapq, strand, svtype, svlen, qoff_l, qoff_r, tsd_len, source from sig", "sig"))
def parsed_signals(s):
    from strandloom.sources.signals import parse_signals

    lines = s.sql(_SIG_TEXT, "sig").select("line")
    return parse_signals(lines).select(
        "ctg", "pos", "en", "is_bp", "ori", "ctg2", "pos2", "read", "mapq", "strand", "svtype", "svlen", "qoff_l", "qoff_r", "tsd_len", "source"
    )


@query("indel_region_flags", with_views(
    """select ctg, st, en, coalesce(any_value(h), false) as in_region from (select distinct 'chr' || (l_suppkey % 5 + 1) as ctg, l_partkey * 9000 as st, l_partkey * 9000 + cast(l_quantity as bigint) * 100000 as en from lineitem) q
      left join (select ctg as c, st - 5 as s, en + 5 as e, true as h from bed) b on b.c = q.ctg and b.s < q.en and b.e > q.st group by all""", "bed"))
def indel_region_flags(s):
    from strandloom.sources.regions import padded

    s.table("lineitem").createOrReplaceTempView("lineitem")
    rows = s.spark.sql(
        "select distinct concat('chr', cast(l_suppkey % 5 + 1 as string)) as ctg, l_partkey * 9000 as st, "
        "l_partkey * 9000 + cast(l_quantity as bigint) * 100000 as en from lineitem"
    )
    return LI.flag_overlap(rows, padded(s.view("bed")), "in_region")
