"""Runs of equal neighbours against going through the lines."""

import itertools
import random

import pytest

from strandloom.operators.ordinals import run_numbers
from strandloom.sources.text import read_numbered_lines


@pytest.mark.parametrize("chunk", [1, 7, 1000])
def test_runs(spark, chunk):
    r = random.Random(chunk)
    rows = [(f, n, r.choice(["a", "a", "b", None])) for f in (0, 1) for n in sorted(r.sample(range(300), 120))]
    got = run_numbers(spark.createDataFrame(rows, "file_id int, line_no long, g string"), "g", ["file_id"], chunk=chunk)
    want = [(f, n, g, i) for f in (0, 1) for i, (_, run) in enumerate(itertools.groupby([x for x in rows if x[0] == f], key=lambda x: x[2]), 1) for _, n, g in run]
    assert sorted((x.file_id, x.line_no, str(x.g), x.run) for x in got.collect()) == sorted((f, n, str(g), i) for f, n, g, i in want)


def test_runs_over_splits_of_a_few_bytes(spark, tmp_path):
    text = [random.Random(3).choice("xxyz") for _ in range(200)]
    path = tmp_path / "lines"
    path.write_text("".join(f"{i}{t}\n" for i, t in enumerate(text)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "23b")
    try:
        rows = read_numbered_lines(spark, str(path)).selectExpr("line_no", "substring(line, -1) as g")
        got = [x.run for x in run_numbers(rows, "g", [], chunk=11).orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [i for i, (_, run) in enumerate(itertools.groupby(text), 1) for _ in run]


def test_without_rows(spark):
    assert run_numbers(spark.createDataFrame([], "line_no long, g string"), "g", []).collect() == []
