"""Mates that name each other, against reading the lines one by one."""

import random

import pytest

from strandloom.params import CallParams
from strandloom.sources.calls import parse_calls
from strandloom.sources.mates import staying_lines

SCHEMA = "file_id int, line_no long, svid string, mate string"


def by_line(rows):
    taken, kept = set(), []
    for f, n, i, mate in sorted(rows, key=lambda r: (r[0], r[1])):
        if i not in (None, "."):
            if (f, i) in taken:
                continue
            taken.add((f, i))
            kept.append((f, n))
        if mate is not None:
            taken.add((f, mate))
    return sorted(kept)


def staying(spark, rows):
    got = staying_lines(spark.createDataFrame(rows, SCHEMA)).filter("stays is not null")
    return sorted((r.file_id, r.stays) for r in got.collect())


@pytest.mark.parametrize("n", [2, 3, 50])
def test_a_chain_keeps_every_other_record(spark, n):
    rows = [(0, i, f"m{i}", f"m{i + 1}") for i in range(n)]
    assert staying(spark, rows) == [(0, i) for i in range(0, n, 2)] == by_line(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_claims(spark, seed):
    r = random.Random(seed)
    ids = [f"i{k}" for k in range(60)] + [".", None]
    rows = [(f, n, r.choice(ids), r.choice([None, ".", *ids[:60]])) for f in (0, 1) for n in range(90)]
    rows += [(2, n, f"t{n}", f"t{min(r.randrange(n + 1, n + 4), 39)}") for n in range(40)]
    assert staying(spark, rows) == by_line(rows)


def test_without_rows_or_mates(spark):
    assert staying(spark, []) == []
    assert staying(spark, [(0, 1, "a", None), (0, 2, "a", None), (0, 3, "b", "b")]) == [(0, 1), (0, 3)]


def test_calls_keep_what_a_dropped_record_names(lines):
    row = "chr1\t{}\t{}\tN\tN[chr2:{}[\t.\tPASS\tSVTYPE=BND;MATEID={}".format
    text = [row(100 + i, a, 500 + i, b) for i, (a, b) in enumerate(["AB", "BC", "CD", "DE", ".F", "FG"])]
    assert sorted(r.svid for r in parse_calls(lines(text), CallParams()).collect()) == [".", "A", "C"]
