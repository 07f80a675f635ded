"""Assembly support against brute force, and the reported rows of unions."""

import random

import pytest

from strandloom.operators.asmfilter import typed_support
from strandloom.operators.ordinals import dense_index, middle_row
from strandloom.operators.union import combination_counts, union_rows
from strandloom.params import CompareParams, UnionParams
from tests.test_greedy import CALL, random_calls
from pyspark.sql import functions as F

FLAG = {"INS": 1, "DUP": 1, "DEL": 2, "INV": 4}


def backs(f, n, ef, en, ratio):
    similar = abs(en - n) <= 1000 or (en >= n * ratio and n >= en * ratio)
    return (
        (f == 8 and ef == 8)
        or (f in (1, 2, 4) and n >= 100_000 and ef == 8)
        or ((f & ef or f == 0 or ef == 0) and similar)
        or ({f, ef} == {1, 2} and n + en <= 1000)
    )


@pytest.mark.parametrize("ratio", [0.6, 0.8, 0.95])
def test_support_equals_brute_force(spark, ratio):
    rnd = random.Random(int(ratio * 100))
    size = lambda: int(10 ** rnd.uniform(1.5, 6))
    reads = [f"r{i}" for i in range(30)]
    evidence = [(rnd.choice(reads[:24]), rnd.choice([0, 1, 2, 4, 8]), size()) for _ in range(40)]
    # One read carries most of the evidence.
    evidence += [("r0", rnd.choice([1, 2, 4]), size()) for _ in range(400)]
    calls, names = [], []
    for i in range(300):
        kind = rnd.choice(["INS", "DUP", "DEL", "INV", "BND"])
        ctg2 = rnd.choice(["c", "d"]) if kind == "BND" else "c"
        calls.append((0, i, f"s{i}", "c", 10, ">>", ctg2, 20, kind, size() * (-1 if kind == "DEL" else 1), False, 5, 1.0))
        names += [(0, f"s{i}", r) for r in {"r0", *rnd.sample(reads, 3)}]
    out = typed_support(
        spark.createDataFrame(calls, CALL),
        spark.createDataFrame(names, "file_id int, svid string, read string"),
        spark.createDataFrame(evidence, "read string, flag int, abs_len long"),
        CompareParams(min_len_ratio=ratio),
    )
    got = {r.svid: (r.asm_name_support, r.asm_support) for r in out.collect()}
    for c in calls:
        f = FLAG.get(c[8], 8 if c[6] != "c" else 0)
        mine = [r for _, s, r in names if s == c[2]]
        seen = [r for r in mine if any(e[0] == r for e in evidence)]
        typed = [r for r in seen if any(e[0] == r and backs(f, abs(c[9]), e[1], e[2], ratio) for e in evidence)]
        assert got[c[2]] == (len(seen), len(typed)), c


def test_combinations_add_up_to_the_groups(spark):
    calls = spark.createDataFrame(random_calls(21), CALL)
    p = UnionParams(group_min_count=1)
    counts = combination_counts(calls, 3, p).collect()
    assert [r.label for r in sorted(counts, key=lambda r: r.label[::-1])] == ["100", "010", "110", "001", "101", "011", "111"]
    assert sum(r.n for r in counts) == union_rows(calls, p).select("group_id").distinct().count()


def test_dense_index_and_middle_row(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), rnd.randint(0, 30), i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x long, i long").repartition(4)
    numbered = dense_index(df, ["x", "i"], {"_c": F.floor(F.col("x") / 10)}, "no").collect()
    assert [(r.x, r.i) for r in sorted(numbered, key=lambda r: r.no)] == sorted((x, i) for _, x, i in rows)
    assert sorted(r.no for r in numbered) == list(range(200))
    got = {r.g: (r.x, r.i) for r in middle_row(df, ["g"], [{"_a": F.col("x")}, {"_b": F.col("i")}]).collect()}
    for g in "ab":
        mine = sorted((x, i) for h, x, i in rows if h == g)
        assert got[g] == mine[len(mine) >> 1]
