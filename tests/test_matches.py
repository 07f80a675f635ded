"""Counts of matches from the pass over cells, and from joined cells, against a look at every pair of calls."""

import random

import pytest
from pyspark.sql.types import StructType

from strandloom.operators import compare, matches
from strandloom.operators.compare import by_size, counted, matched_files, reported_rows, same_shape, with_match_count
from strandloom.params import CompareParams

CALL = (
    "file_id int, line_no long, svid string, ctg string, pos long, ori string, ctg2 string, pos2 long, svtype string, "
    "svlen long, inv boolean, count long, vaf double"
)
CELL = matches.LEAST


def some_calls(seed, n):
    """Calls about a few places, some at the borders of cells, some without a length or a second end, some copies."""
    r, out = random.Random(seed), []
    for i in range(n):
        pos = r.choice([-300, 0, 200, 5000, CELL - 400, CELL, 3 * CELL + 100]) + r.choice([0, 0, 90, 499, 500, 501, 600])
        kind = r.choice(["INS", "DEL", "DUP", "INV", "BND", "BND"])
        ln = 0 if kind == "BND" else r.choice([400, 700, 3000, 2 * CELL]) * (-1 if kind == "DEL" else 1)
        pos2 = pos + abs(ln) if kind != "BND" else r.choice([pos, 5000, CELL, 3 * CELL]) + r.choice([0, 300, 500])
        ctg2 = r.choice("ab") if kind == "BND" else "a"
        if r.random() < 0.1:
            ln = None
        if r.random() < 0.05:
            pos2 = None
        out.append((r.randrange(4), i, f"s{i}", r.choice("aab") if kind == "BND" else "a", pos, ">>", ctg2, pos2, kind, ln, False, r.choice([-1, 1, 9]), 1.0))
    return out + out[: n // 4]


def same(b, t, p):
    b, t = (tuple(x[k] for k in (3, 4, 6, 7, 8, 9)) for x in (b, t))
    if None in (b[5], t[5]) and "BND" not in (b[4], t[4]):
        return False
    if None in (b[3], t[3]) and {b[4], t[4]} != {"INS", "DUP"}:
        return False
    return same_shape(b, t, p.window, p.min_len_ratio)


def times(b, t, p):
    ends = lambda x: [(x[3], x[4]), (x[6], x[7])]
    near = lambda x, y: x[0] == y[0] and None not in (x[1], y[1]) and max(x[1] - p.window, 0) <= y[1] < x[1] + p.window
    return sum(near(x, y) for x in ends(t) for y in ends(b)) if same(b, t, p) else 0


def sides(spark, rows, p):
    a, b = (spark.createDataFrame([r for r in rows if (r[0] == 0) == k], CALL) for k in (True, False))
    return a, b, compare._asked(a, 0, p, None).unionByName(compare._asked(b, 1, p, None))


@pytest.mark.parametrize("deep", [matches.DEEP, 20, 0])
def test_counts_of_both_sides(spark, deep):
    rows, p = some_calls(1, 240), CompareParams()
    got = counted(sides(spark, rows, p)[2], p, ["line_no", "_side"], deep)
    asked = [t for t in rows if (t[8] == "BND" and t[3] != t[6]) or (t[9] is not None and abs(t[9]) >= 100)]
    want = [(t[1], int(t[0] != 0), sum(times(b, t, p) for b in rows if (b[0] == 0) != (t[0] == 0))) for t in asked]
    assert sorted(map(tuple, got.collect())) == sorted(want) and sum(w[2] > 0 for w in want) > 50


@pytest.mark.parametrize("deep", [matches.DEEP, 20, 0])
def test_files(spark, deep):
    rows, p = some_calls(2, 240), CompareParams()
    got = matched_files(compare._asked(spark.createDataFrame(rows, CALL), 0, p, None), p, deep)
    asked = [t for t in rows if (t[8] == "BND" and t[3] != t[6]) or (t[9] is not None and abs(t[9]) >= 100)]
    want = {(i, j): sum(any(b[0] == i and times(b, t, p) for b in rows) for t in asked if t[0] == j) for i in range(4) for j in range(4)}
    assert {(r.file_i, r.file_id): r.matched for r in got.collect()} == {k: v for k, v in want.items() if v}


def test_a_breakend_without_length_is_counted(spark):
    row = (0, 1, "s", "a", 1000, ">>", "b", 2000, "BND", None, False, 9, 1.0)
    one = spark.createDataFrame([row], CALL)
    assert [r.n_match for r in with_match_count(one, one, CompareParams()).collect()] == [2]


def test_small_pieces_make_no_difference(spark, monkeypatch):
    rows, p = some_calls(3, 200), CompareParams()
    a, b, asked = sides(spark, rows, p)
    want = sorted(map(tuple, counted(asked, p, ["line_no", "_side"]).collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        light, _ = matches.parted(matches.in_cells(asked.select(*matches.SHAPE, "_side", "_test", "_base", "line_no"), p, "_side"))
        fields = "line_no long, _side int, n_match long"
        monkeypatch.setattr(matches, "PAIRS", 5)
        out = matches.scan_cells(light, StructType.fromDDL(fields), matches.counting(p), 10)
        assert sorted(map(tuple, out.collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_both_sides_come_from_one_shuffle(spark):
    a, b, _ = sides(spark, some_calls(4, 40), CompareParams())
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    errors = plan(reported_rows(a, b, CompareParams()))
    assert errors.count("Join") == 0 and errors.count("RepartitionByExpression") == 1
    assert plan(by_size(a, b, CompareParams())).count("Join") == 1
