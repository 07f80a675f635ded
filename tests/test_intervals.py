"""Distances and covered bases against a look at every interval."""

import random

import pytest

from strandloom.operators import intervals as I
from strandloom.operators.extract import with_breakend_centromere, with_indel_centromere


def bed_of(spark, rows):
    return spark.createDataFrame(rows, "ctg string, st long, en long")


def near(bed, ctg, at):
    gaps = [b[1] - at if at < b[1] else 0 if at < b[2] else at - b[2] for b in bed if b[0] == ctg]
    return min([*gaps, I.FAR]) if gaps else None


def covered(bed, ctg, st, en):
    return len({x for c, a, b in bed if c == ctg for x in range(max(a, st), min(b, en))})


def test_merged_intervals_overlap_touch_and_repeat(spark):
    far = 5 * I.BIN
    rows = [("a", 0, 5), ("a", 3, 8), ("a", 8, 9), ("a", 20, 21), ("a", 0, 5), ("a", 7, 7), ("a", 50, 40), ("b", 1, far), ("b", far - 1, far + 2), ("b", far + 9, far + 9), (None, 1, 2)]
    got = sorted(tuple(r) for r in I.merged(bed_of(spark, rows)).collect())
    assert got == [("a", 0, 9, 0), ("a", 20, 21, 9), ("b", 1, far + 2, 0), ("b", far + 9, far + 9, far + 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_points_against_every_interval(spark, seed, monkeypatch):
    monkeypatch.setattr(I, "BIN", 16)
    r = random.Random(seed)
    bed = [(r.choice("ab"), st, st + r.randrange(0, 30)) for st in (r.randrange(0, 900) for _ in range(25))]
    points = [(r.choice("abc"), r.randrange(-50, 1000)) for _ in range(150)] + [("a", None), (None, 5)]
    got = I.located(spark.createDataFrame(points, "ctg string, at long"), I.merged(bed_of(spark, bed))).collect()
    want = [(c, at, near(bed, c, at), covered(bed, c, -100, at)) for c, at in points if None not in (c, at) and c != "c"]
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_signals_near_intervals(spark):
    bed = [("a", 10, 20), ("a", 15, 40), ("b", 100, 200)]
    cen = I.merged(bed_of(spark, bed))
    indels = spark.createDataFrame([("a", 2, 5, 1), ("a", 2, 12, 2), ("c", 1, 2, 3), ("b", 250, 260, 4)], "ctg string, pos long, en long, id int")
    assert {x["id"]: x["cen_dist"] for x in with_indel_centromere(indels, cen).collect()} == {1: 5, 2: 0, 3: None, 4: 50}
    rows = [("a", 1, "a", 50, 1, 51, 1), ("a", 1, "b", 150, None, None, 2), ("c", 1, "b", 90, 0, 5, 3), ("c", 1, "d", 5, 2, 3, 4), ("a", 5, "a", 3, 5, 3, 5), ("a", 60, "a", 70, 60, 70, 6)]
    ends = spark.createDataFrame(rows, "ctg string, pos long, ctg2 string, pos2 long, region_st long, region_en long, id int")
    got = {x["id"]: (x["cen_dist"], x["cen_overlap"]) for x in with_breakend_centromere(ends, cen).collect()}
    assert got == {1: (9, 30), 2: (0, None), 3: (10, 0), 4: (None, None), 5: (5, None), 6: (20, 0)}


def test_without_points_or_intervals(spark):
    none = I.merged(bed_of(spark, []))
    assert none.collect() == []
    points = spark.createDataFrame([("a", 1)], "ctg string, at long")
    assert I.located(points, none).collect() == [] and I.located(points.limit(0), I.merged(bed_of(spark, [("a", 1, 2)]))).collect() == []


def test_many_intervals_of_one_contig(spark):
    """A third of a million intervals of one contig: bins share the work, nothing is gathered."""
    bed = spark.range(300_000).selectExpr("'x' as ctg", "id * 10 as st", "id * 10 + 5 as en")
    points = spark.range(1000).selectExpr("'x' as ctg", "id * 3001 as at")
    got = {r["at"]: (r["dist"], r["upto"]) for r in I.located(points, I.merged(bed)).collect()}
    for at, (dist, upto) in got.items():
        k, off = divmod(at, 10)
        if k < 300_000:
            assert upto == k * 5 + min(off, 5)
            assert dist == (0 if off < 5 else min(off - 5, 10 - off) if k + 1 < 300_000 else off - 5)
    assert len(got) == 1000


def test_distances_beyond_a_billion(spark):
    rows = spark.createDataFrame([("a", 6_000_000_000, 6_000_000_100, 1)], "ctg string, pos long, en long, id int")
    out = with_indel_centromere(rows, I.merged(bed_of(spark, [("a", 10, 20)]))).collect()
    assert [r["cen_dist"] for r in out] == [6_000_000_000 - 20]
