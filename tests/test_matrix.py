"""The matrix of shared calls against a look at every pair of calls, with many files."""

import random
from collections import Counter

from pyspark.sql import functions as F

from strandloom.operators.compare import matched_counts, match_counts, select_reportable, shared_matrix, SHAPE
from strandloom.params import CompareParams

CALL = (
    "file_id int, line_no long, svid string, ctg string, pos long, ori string, ctg2 string, pos2 long, svtype string, "
    "svlen long, inv boolean, count long, vaf double"
)


def some_calls(seed, n_files, n):
    r, out = random.Random(seed), []
    for i in range(n):
        pos = r.choice([1000, 1400, 5000, 20_000]) + r.choice([0, 0, 0, 90, 600])
        kind = r.choice(["INS", "DEL", "DUP", "INV", "BND"])
        ln = {"DEL": -400, "BND": 0}.get(kind, 400) if r.random() < 0.8 else 90
        out.append((r.randrange(n_files), i, f"s{i}", "a", pos, r.choice([">>", "<<"]), "b" if kind == "BND" else "a", pos + abs(ln), kind, ln, kind == "INV", r.choice([-1, 1, 9]), 1.0))
    return out


def test_sets_of_files_give_what_file_by_file_matching_gives(spark):
    rows = spark.createDataFrame(some_calls(1, 12, 300), CALL)
    p = CompareParams()
    test = select_reportable(rows, p)
    one_by_one = match_counts(rows, test, p, ["file_id"], ["file_id"])
    n = test.groupBy("file_id", *SHAPE).agg(F.count("*").alias("n"))
    keys = [F.col("t_" + c).alias(c) for c in SHAPE]
    want = one_by_one.select(F.col("b_file_id").alias("file_i"), F.col("t_file_id").alias("file_id"), *keys).join(n, ["file_id", *SHAPE])
    want = {(r.file_i, r.file_id): r.m for r in want.groupBy("file_i", "file_id").agg(F.sum("n").alias("m")).collect()}
    got = {(r.file_i, r.file_id): r.matched for r in matched_counts(rows, test, p).collect()}
    assert got == want and len(got) > 100


def test_a_hundred_files(spark):
    rows = spark.createDataFrame(some_calls(2, 100, 1500), CALL)
    got = shared_matrix(rows, CompareParams(), n_files=101).collect()
    assert len(got) == 101 * 101
    totals = Counter(r.file_id for r in select_reportable(rows, CompareParams()).select("file_id").collect())
    assert all(r.total == totals[r.file_j] and (r.file_i != r.file_j or r.value == r.total) for r in got)
    assert all(r.matched <= r.total for r in got)


def test_without_calls(spark):
    rows = spark.createDataFrame([], CALL)
    assert [tuple(r)[:4] for r in shared_matrix(rows, CompareParams(), n_files=1).collect()] == [(0, 0, 0, 0)]
