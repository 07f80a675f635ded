"""Pairs of break points against a look at every pair of points."""

import random
from collections import Counter

import pytest

from strandloom.operators.union import strand_break_pairs, strand_break_stats

CALL = "file_id int, line_no long, svid string, ctg string, pos long, ori string, ctg2 string, pos2 long, svtype string"


def by_pairs(calls, reads):
    listed = {}
    for f, n, i, r in reads:
        listed.setdefault((f, n, i), []).append(r)
    pts = []
    for c in calls:
        pts += [(c[3], c[4], c[5][0], c[8], c[:3]), (c[6], c[7], c[5][1], c[8], c[:3])]
    out = []
    for a in pts:
        for b in pts:
            if a is b or a[0] != b[0] or not 50 <= b[1] - a[1] < 25_000:
                continue
            own, other = listed.get(a[4], []), listed.get(b[4], [])
            shared, types, bnd = len(set(own) & set(other)), (a[3], b[3]), "BND" in (a[3], b[3])
            if bnd and shared and shared == len(own):
                kind = "Insertions_case3"
            elif types == ("DUP", "DUP"):
                kind = "case2"
            elif shared and (types == ("INV", "INV") or bnd and a[2] == b[2]):
                kind = "Parallel_Breakpoints_case4"
            elif shared and types == ("DEL", "DEL"):
                kind = "case1"
            else:
                continue
            out.append((a[4][2], b[4][2], a[1], b[1], kind))
    return sorted(out)


def frames(spark, calls, reads):
    return spark.createDataFrame(calls, CALL), spark.createDataFrame(reads, "file_id int, line_no long, svid string, read string")


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_and_counts(spark, seed):
    r = random.Random(seed)
    calls, reads = [], []
    for n in range(70):
        pos = r.choice([1000, 1000, r.randrange(0, 60_000)])
        key = (n % 2, n, f"s{n}")
        calls.append((*key, r.choice("ab"), pos, r.choice([">>", "<<", "><", "<>"]), r.choice("ab"), pos + r.choice([10, 49, 50, 300, 24_999, 25_000]), r.choice(["BND", "DUP", "DEL", "INV", "INS"])))
        # One call has many of the reads, some list a read twice, some none.
        reads += [(*key, f"r{k}") for k in (range(30) if n == 7 else r.choices(range(30), k=r.choice([0, 1, 2, 4])))]
    c, rd = frames(spark, calls, reads)
    got = strand_break_pairs(c, rd).select("svid0", "svid1", "pos0", "pos1", "dsb_type").collect()
    want = by_pairs(calls, reads)
    assert sorted(tuple(x) for x in got) == want
    stats = {x["dsb_type"]: x["n"] for x in strand_break_stats(c, rd).collect()}
    assert stats == Counter(x[4] for x in want) and len(stats) == 4


def test_many_duplications_of_one_place_are_counted_without_pairs(spark):
    """A hundred thousand points within a gap: five thousand million pairs."""
    calls = spark.range(50_000).selectExpr("0 as file_id", "id as line_no", "'x' as svid", "'c' as ctg", "100 as pos", "'>>' as ori", "'c' as ctg2", "200 as pos2", "'DUP' as svtype")
    reads = spark.createDataFrame([], "file_id int, line_no long, svid string, read string")
    assert [tuple(r) for r in strand_break_stats(calls, reads).collect()] == [("case2", 50_000 * 50_000)]


def test_without_calls(spark):
    c, rd = frames(spark, [], [])
    assert strand_break_pairs(c, rd).collect() == [] and strand_break_stats(c, rd).collect() == []
