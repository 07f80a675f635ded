"""Break-point chains: the older call path from adjacent alignments by single linkage.

No order-dependent step remains here, so everything is gaps and islands plus aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.operators.islands import with_island


def _path_point(alns: DataFrame) -> DataFrame:
    """Adds where a read leaves (``out_*``) and enters (``in_*``) each alignment on its contig.

    A path of one segment, or none, is taken as is; the last segment counts from its own start.
    """
    pat = r"([><])([^><:\s]+):(\d+)-(\d+)".replace("\\", "\\\\")
    g = lambda i: F.expr(f"regexp_extract_all(path, '{pat}', {i})")
    rows = alns.withColumn("segs", F.arrays_zip(g(1).alias("o"), g(2).alias("c"), g(3).alias("a"), g(4).alias("b")))
    before = F.expr(
        "aggregate(slice(segs, 1, greatest(size(segs) - 1, 0)), 0L, (s, e) -> s + abs(cast(e.b as bigint) - cast(e.a as bigint)))"
    )
    plus = F.col("strand") == "+"

    def point(last: bool) -> Column:
        seg = F.get("segs", F.size("segs") - 1 if last else F.lit(0))
        at = F.col("ten") - before if last else None
        end = F.col("ten") if last else F.col("tst")
        rel = at if last else end
        on_seg = F.when(seg["o"] == ">", seg["a"].cast("bigint") + rel).otherwise(seg["b"].cast("bigint") - rel)
        linear = F.size("segs") == 0
        return F.struct(
            F.when(linear, F.col("path")).otherwise(seg["c"]).alias("ctg"),
            F.when(linear, end).otherwise(on_seg).alias("pos"),
            F.when(linear, F.when(plus, ">").otherwise("<")).otherwise(seg["o"]).alias("ori"),
        )

    tail, head = point(True), point(False)
    return rows.withColumns(
        {"out_p": F.when(plus, tail).otherwise(head), "in_p": F.when(plus, head).otherwise(tail)}
    ).drop("segs")


def adjacent_breaks(alns: DataFrame, min_mapq: int = 5, min_map_len: int = 2000) -> DataFrame:
    """One break per neighbouring pair of a read's alignments in query order, ends made symmetric."""
    rows = _path_point(alns.filter((F.col("mapq") >= min_mapq) & (F.col("ten") - F.col("tst") >= min_map_len)))
    w = Window.partitionBy("qname").orderBy("qst", "qen", "path", "tst", "ten", "strand", "mapq")
    rows = rows.withColumn("p", F.lag(F.struct("out_p", "mapq")).over(w)).filter("p is not null")
    a, b = F.col("p.out_p"), F.col("in_p")
    ori = F.concat(a["ori"], b["ori"])
    swap = (ori == "<<") | (ori.isin("<>", "><") & (a["ctg"] > b["ctg"]))
    return rows.select(
        F.when(swap, b["ctg"]).otherwise(a["ctg"]).alias("ctg"),
        F.when(swap, b["pos"]).otherwise(a["pos"]).alias("pos"),
        F.when(ori == "<<", ">>").otherwise(ori).alias("ori"),
        F.when(swap, a["ctg"]).otherwise(b["ctg"]).alias("ctg2"),
        F.when(swap, a["pos"]).otherwise(b["pos"]).alias("pos2"),
        F.least("p.mapq", "mapq").alias("mapq"),
        F.col("qname").alias("read"),
    )


def _median(c: str) -> Column:
    """Median with ties to even; exact, aggregated over distinct values."""
    return F.bround(F.percentile(c, F.lit(0.5))).cast("bigint")


def chain_breaks(breaks: DataFrame, margin: int = 100, support: int = 2) -> DataFrame:
    """Single linkage on the first position within (contig, contig), then on the second."""
    rows = with_island(breaks, ["ctg", "ctg2"], "pos", margin).withColumnRenamed("island", "chain")
    rows = with_island(rows, ["ctg", "ctg2", "chain"], "pos2", margin)
    return (
        rows.groupBy("ctg", "ctg2", "chain", "island")
        .agg(
            _median("pos").alias("pos"),
            F.min_by("ori", F.struct("pos2", "pos", "read", "ori", "mapq")).alias("ori"),
            _median("pos2").alias("pos2"),
            F.bround(F.avg("mapq")).cast("bigint").alias("qual"),
            F.count("*").alias("n_reads"),
        )
        .filter(F.col("n_reads") >= support)
        .drop("chain", "island")
    )


def chain_tumor_normal(breaks: DataFrame, margin: int = 100, support: int = 5) -> DataFrame:
    """Chains of rows, in (pos, pos2) order, whose neighbours agree within ``margin`` at both ends.

    ``sample`` is ``t`` or ``n``.  Copies of a coordinate pair always link, so distinct pairs are
    counted first and ordered only within the gap islands of the first position.
    """
    pts = breaks.groupBy("ctg", "ctg2", "pos", "pos2").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("sample") == "n").alias("n_normal"),
        F.sum(F.col("mapq").cast("bigint")).alias("mapq_sum"),
        F.min_by("ori", F.struct("sample", "read", "ori", "mapq")).alias("ori"),
    )
    pts = with_island(pts, ["ctg", "ctg2"], "pos", margin)
    w = Window.partitionBy("ctg", "ctg2", "island").orderBy("pos", "pos2")
    apart = (F.col("pos") - F.lag("pos").over(w) > margin) | (F.abs(F.col("pos2") - F.lag("pos2").over(w)) > margin)
    pts = pts.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int"))
    pts = pts.withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    med = lambda c: F.bround(F.percentile(c, F.lit(0.5), F.col("n"))).cast("bigint")
    return (
        pts.groupBy("ctg", "ctg2", "island", "chain")
        .agg(
            med("pos").alias("pos"),
            F.min_by("ori", F.struct("pos", "pos2")).alias("ori"),
            med("pos2").alias("pos2"),
            F.bround(F.sum("mapq_sum") / F.sum("n")).cast("bigint").alias("qual"),
            F.sum("n_normal").cast("bigint").alias("n_normal"),
            (F.sum("n") - F.sum("n_normal")).cast("bigint").alias("n_tumor"),
        )
        .filter(F.col("n_normal") + F.col("n_tumor") >= support)
        .drop("chain", "island")
    )


def hull_distance(rows: DataFrame, hulls: DataFrame, ctg: str, pos: str, name: str) -> DataFrame:
    """Distance to the one interval of the contig, 0 inside, null if the contig has none.

    ``hulls`` has one row per contig.
    """
    h = hulls.select(F.col("ctg").alias("_h_ctg"), F.col("st").alias("_h_st"), F.col("en").alias("_h_en"))
    d = F.greatest(F.col("_h_st") - F.col(pos), F.col(pos) - F.col("_h_en"), F.lit(0)).cast("bigint")
    return rows.join(h, F.col(ctg) == F.col("_h_ctg"), "left").withColumn(
        name, F.when(F.col("_h_ctg").isNotNull(), d)
    ).drop("_h_ctg", "_h_st", "_h_en")
