"""Older indel path: indels per alignment with path contigs, merged by overlap and length.

Differs from ``extract``: insertions span one base on both sides, alignments with more than ``max_indels``
are left out only on request, flanks do not move coordinates, and an indel crossing path segments is kept on the
concatenated path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from strandloom.functions import sequence as S
from strandloom.functions.coords import on_contig, path_segments, segment_index
from strandloom.operators.extract import with_inserted_sequence
from strandloom.operators.islands import scan_islands, with_island
from strandloom.operators.regions import REGION_BIN, binned_regions
from strandloom.params import ExtractParams
from strandloom.session import settle


def alignment_indels(
    alns: DataFrame, min_len: int = 100, max_indels: int | None = None, min_frac: float = 0.7, min_mapq: int = 5
) -> DataFrame:
    """``ctg, st, en, read, mapq, strand, len, tsd_len, polya_len, seq`` per long indel."""
    rows = alns.filter(
        (F.col("mapq") >= min_mapq) & (F.col("qen") - F.col("qst") >= F.col("qlen") * F.lit(min_frac))
    )
    rows = rows.withColumn("indels", S.cigar_indels("cg", "tst", "qst", "qen", "strand", min_len)).drop("cg")
    few = F.size("indels") >= 1
    if max_indels is not None:
        few = few & (F.size("indels") <= max_indels)
    rows = rows.withColumn("indels", F.when(few, F.col("indels")))
    rows = with_inserted_sequence(rows, ExtractParams(min_len=min_len))
    rows = rows.withColumn("segs", path_segments("path", "tlen"))
    st, en = "if(d.len > 0, d.st - 1, d.st)", "if(d.len > 0, d.en + 1, d.en)"
    inside = lambda off: f"if(size(segs) = 1, if(segs[0].p_en <= {off}, 1, 0), {segment_index('segs', off, False)})"
    place = F.expr(f"named_struct('d', d, 'st', {st}, 'en', {en}, 'k0', {inside(st)}, 'k1', {inside(en)})")
    rows = rows.select("qname", "mapq", "strand", "segs", F.explode(F.array(place)).alias("x"))
    past = F.col("x.k1") >= F.size("segs")
    rows = rows.withColumn(
        "k",
        F.when(past, F.raise_error(F.concat(F.lit("indel past the end of the path of "), F.col("qname"))).cast("int"))
        .otherwise(F.col("x.k0")),
    ).withColumn("g", F.expr("get(segs, k)"))
    one = F.col("x.k0") == F.col("x.k1")
    a, b = F.expr(on_contig("g", "x.st")), F.expr(on_contig("g", "x.en"))
    crossed = F.expr(
        "array_join(transform(slice(segs, x.k0 + 1, x.k1 - x.k0 + 1), "
        "s -> concat(if(s.fwd, '>', '<'), s.ctg, ':', s.st, '-', s.en)), '')"
    )
    rev = F.col("strand") == "-"
    mid = F.col("x.d.mid")
    return rows.select(
        F.when(one, F.col("g.ctg")).otherwise(crossed).alias("ctg"),
        F.when(one, F.least(a, b)).otherwise(F.col("x.st") - F.col("g.p_st")).alias("st"),
        F.when(one, F.greatest(a, b)).otherwise(F.col("x.en") - F.col("g.p_st")).alias("en"),
        F.col("qname").alias("read"),
        "mapq",
        F.when(~one, "+").when(F.col("g.fwd"), F.col("strand")).otherwise(F.when(rev, "+").otherwise("-")).alias("strand"),
        F.col("x.d.len").alias("len"),
        (F.length("x.d.l") + F.length("x.d.r")).cast("bigint").alias("tsd_len"),
        F.col("x.d.polya").alias("polya_len"),
        F.when(mid == "", ".").otherwise(mid).alias("seq"),
    )


class OverlapScan:
    """Newest open indel first; a row joins one of the same sign whose closest length is within 5 %."""

    def __init__(self, emit, window: int, max_diff: float):
        self.emit, self.window, self.max_diff = emit, window, max_diff
        self.open: list[dict] = []
        self.made = 0

    def row(self, batch, i: int, v: tuple) -> None:
        st, en, n = v
        while self.open and st - self.open[0]["en"] > self.window:
            self.open.pop(0)
        size = abs(n)
        for c in reversed(self.open):
            if c["len"] * n <= 0:
                continue
            if size in c["sizes"] or min(abs(size - x) for x in c["sizes"]) <= max(*c["sizes"], size) * self.max_diff:
                break
        else:
            c = {"id": self.made, "len": n, "en": en, "sizes": set()}
            self.made += 1
            self.open.append(c)
        c["sizes"].add(size)
        c["en"] = max(c["en"], en)
        self.emit(batch, i, c["id"])

    def close(self) -> None:
        self.open.clear()


def merge_indels(
    indels: DataFrame, min_count: int = 1, min_mapq: int = 5, window: int = 100, max_diff: float = 0.05
) -> DataFrame:
    """Merged indels with mean lengths, strand counts and the sequence of the first member.

    Rows with the same interval and length always merge, so they are summed before the scan.
    """
    first = F.struct("strand", "read", "seq")
    shapes = indels.groupBy("ctg", "st", "en", "len").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("strand") == "+").alias("n_fwd"),
        *[F.sum(F.col(c).cast("bigint")).alias(c + "_sum") for c in ("mapq", "tsd_len", "polya_len")],
        F.min_by("seq", first).alias("seq"),
    )
    # Islands and rows are read from it: the alignments are parsed once.
    rows = with_island(settle(shapes), ["ctg"], "st", window, end="en")
    placed = scan_islands(
        rows, ["ctg"], ["st", "en", "len"], ["st", "en", "len"], [("cluster", T.LongType())],
        lambda emit: OverlapScan(emit, window, max_diff),
    )
    mean = lambda c: F.floor(F.sum(c) / F.sum("n") + 0.499).cast("bigint")
    merged = placed.groupBy("ctg", "island", "cluster").agg(
        F.min("st").alias("m_st"),
        F.max("en").alias("m_en"),
        mean(F.col("len") * F.col("n")).alias("m_len"),
        mean(F.col("tsd_len_sum")).alias("tsd_len"),
        mean(F.col("polya_len_sum")).alias("polya_len"),
        F.min_by("seq", F.struct("st", "en", "len")).alias("seq"),
        F.sum("n").alias("n_reads"),
        mean(F.col("mapq_sum")).alias("mapq"),
        F.sum("n_fwd").alias("n_fwd"),
    )
    return (
        merged.withColumnsRenamed({"m_st": "st", "m_en": "en", "m_len": "len"})
        .filter((F.col("n_reads") >= min_count) & (F.col("mapq") >= min_mapq))
        .drop("island", "cluster")
    )


def flag_overlap(rows: DataFrame, regions: DataFrame, name: str) -> DataFrame:
    """Adds ``name``: whether ``[st, en)`` overlaps an interval of ``regions``; null on other contigs."""
    r = binned_regions(regions).select(*[F.col(c).alias("r_" + c) for c in ("ctg", "st", "en", "bin")])
    at = lambda c: F.floor(c / F.lit(REGION_BIN)).cast("bigint")
    first, last = at(F.col("st")), at(F.col("en") - 1)
    spans = rows.select("ctg", "st", "en").distinct()
    hit = (
        spans.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, last))))
        .join(
            r,
            (F.col("ctg") == F.col("r_ctg"))
            & (F.col("bin") == F.col("r_bin"))
            & (F.col("st") < F.col("r_en"))
            & (F.col("en") > F.col("r_st")),
            "left_semi",
        )
        .select("ctg", "st", "en")
        .distinct()
        .withColumn("_hit", F.lit(True))
    )
    known = regions.select("ctg").distinct().withColumn("_known", F.lit(True))
    return (
        rows.join(hit, ["ctg", "st", "en"], "left")
        .join(known, "ctg", "left")
        .withColumn(name, F.when(F.col("_known"), F.coalesce("_hit", F.lit(False))))
        .drop("_hit", "_known")
    )
