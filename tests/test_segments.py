"""Islands found by the scan itself: summaries, segments and pieces against the ones cut beforehand."""

import random

import pytest
from pyspark.sql import functions as F

from strandloom.operators import islands, merge
from strandloom.operators.merge import assign_clusters, clusters, summarise
from strandloom.operators.compare import ARRIVAL
from strandloom.operators.union import GroupScan, grouped
from strandloom.params import MergeParams, UnionParams
from strandloom.plans import flows
from strandloom.sources.readids import asm_evidence
from tests.test_greedy import CALL, SIGNAL, random_signals


def texts(df):
    cols = [c for c in sorted(df.columns) if c not in ("kind", "island", "cluster")]
    return sorted(str(tuple(r)) for r in df.select(cols).collect())


@pytest.mark.parametrize("max_alleles, deep", [(None, islands.DEEP), (None, 20), (2, islands.DEEP)])
def test_summaries_of_the_scan_equal_those_of_placed_rows(spark, monkeypatch, max_alleles, deep):
    monkeypatch.setattr(islands, "CELLS", 3)  # several islands in a cell, several cells in an island
    p = MergeParams(max_alleles=max_alleles)
    df = spark.createDataFrame(random_signals(11, 40), SIGNAL).repartition(3)
    df = df.withColumn("source", F.expr("nullif(source, 'B')")).withColumn("mapq", F.expr("nullif(mapq, 20)"))
    assert texts(clusters(df, p, deep)) == texts(summarise(assign_clusters(df, p)))


def test_long_islands_come_in_pieces(spark, monkeypatch):
    p = MergeParams()
    df = spark.createDataFrame(random_signals(5, 30), SIGNAL)
    scan = islands.scan_segments
    monkeypatch.setattr(merge, "scan_segments", lambda *a: scan(*a, most=3))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        assert texts(clusters(df, p)) == texts(summarise(assign_clusters(df, p)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_segments_hold_whole_islands_and_are_many(spark):
    rows = spark.range(20_000).selectExpr("'c' ctg", "(id div 4) * 1000 + id % 4 * 90 pos").withColumn("k", F.lit(None).cast("string"))
    light, dense = islands.with_segment(rows, ["ctg", "k"], "pos", 100)
    assert dense is None and light.count() == 20_000
    per = light.groupBy(F.floor(F.col("pos") / 1000)).agg(F.count_distinct("segment").alias("n"))
    assert per.filter("n > 1").isEmpty() and light.select("segment").distinct().count() > 1000


def test_plain_islands_need_no_votes(spark, monkeypatch):
    """Three rows of one event and three of another far away: settled without a scan by rows."""
    monkeypatch.setattr(merge, "_votable", None)
    rows = [("c", 1000 * k + i, 1000 * k + i, False, None, None, None, "INS", 100, 60, "+-"[i % 2], "A", 5, 9, f"r{k}{i}") for k in (1, 9) for i in range(3)]
    got = clusters(spark.createDataFrame(rows, SIGNAL), MergeParams()).orderBy("pos").collect()
    assert [(r["pos"], r["n_reads"], r["count"], r["rt_len"]) for r in got] == [(1001, 3, "A:2,1", 5), (9001, 3, "A:2,1", 5)]


def random_calls(seed, n=600):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        pos, kind, n_ = rnd.randrange(0, 60_000, 20), rnd.choice(["INS", "DUP", "DEL", "BND"]), rnd.choice([90, 150, 400, 3000])
        out.append((i % 3, i, f"v{i}", rnd.choice("ab"), pos, ">>", rnd.choice("ab"), pos + rnd.choice([0, 300, 900]), kind, -n_ if kind == "DEL" else n_, False, rnd.randint(0, 9), 1.0))
    return out


@pytest.mark.parametrize("deep", [islands.DEEP, 50])
def test_groups_of_segments_equal_one_scan_by_rows(spark, monkeypatch, deep):
    monkeypatch.setattr(islands, "CELLS", 5)
    rows, p = random_calls(2), UnionParams()
    names = [x.split()[0] for x in CALL.split(", ")]
    at = {c: i for i, c in enumerate(names)}
    want = {}
    for pair in {(r[at["ctg"]], r[at["ctg2"]]) for r in rows}:
        mine = sorted((r for r in rows if (r[at["ctg"]], r[at["ctg2"]]) == pair), key=lambda r: [r[at[c]] for c in ARRIVAL])
        scan = GroupScan(lambda _, i, grp, *seed: want.__setitem__(mine[i][at["svid"]], seed), p)  # noqa: B023
        for i, r in enumerate(mine):
            scan.row(None, i, tuple(r[at[c]] for c in ("ctg", "pos", "ctg2", "pos2", "svtype", "svlen", "file_id", "line_no")))
    got = {r["svid"]: [r["seed_pos"], r["seed_file"], r["seed_line"]] for r in grouped(spark.createDataFrame(rows, CALL).repartition(4), p, deep=deep).collect()}
    assert got == {k: list(v) for k, v in want.items()}


def test_middles_of_large_and_small_groups_agree(spark, monkeypatch):
    from strandloom.operators import union

    df = union.union_rows(spark.createDataFrame(random_calls(4), CALL), UnionParams(group_min_count=0))
    small = texts(union.median_rows(df))
    monkeypatch.setattr(union, "LARGE", 2)
    assert small == texts(union.median_rows(df)) and len(small) > 50


def test_only_the_parts_asked_for_are_made(spark, monkeypatch):
    monkeypatch.setattr(flows, "rows_of", None)
    calls = spark.createDataFrame(random_calls(6, 60), CALL)
    reads = calls.selectExpr("file_id", "svid", "svid read")
    evidence = {"l+s": asm_evidence(spark.createDataFrame(random_signals(1, 5), SIGNAL))}
    out = flows.category_unions(calls, reads, evidence, 2, n_callers=3, parts=("combinations",))
    assert list(out["l_only"]) == ["combinations"] and not out["l_only"]["combinations"].isEmpty()
