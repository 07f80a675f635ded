"""Token walks: compared with serial restatements, and done once per alignment."""

import random
import re

from pyspark.sql import functions as F

from strandloom.functions import sequence as S
from strandloom.operators.extract import indel_signals
from strandloom.operators.long_indels import merge_indels

ALN = "qname string, qlen long, qst long, qen long, strand string, path string, tlen long, tst long, ten long, mapq int, cg string, ds string"


def test_walks_are_not_interpreted(spark):
    rows = spark.createDataFrame([], ALN)
    plan = indel_signals(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all(cg" not in plan and "regexp_extract_all(ds" not in plan


def test_diff_walk(spark):
    rnd = random.Random(3)
    rows = []
    for _ in range(60):
        ds = ""
        for _ in range(rnd.randint(0, 9)):
            flank = lambda: "[" + "g" * rnd.randint(1, 4) + "]" if rnd.random() < 0.4 else ""
            ds += rnd.choice([f":{rnd.randint(1, 50)}", "*ag", f"+{flank()}{'acgT' * rnd.randint(1, 6)}{flank()}", f"-{'c' * rnd.randint(1, 20)}"])
        rows.append((ds, rnd.randint(0, 1000)))
    df = spark.createDataFrame(rows, "ds string, tst long")
    for r in df.select("ds", "tst", S.diff_indels("ds", "tst", 10).alias("d")).collect():
        x, want, far = r.tst, [], None
        for op, seq in re.findall(r"([+\-*:])([A-Za-z\[\]0-9]+)", r.ds):
            n = int(seq) if op == ":" else 1 if op == "*" else len(seq.replace("[", "").replace("]", ""))
            en = x if op == "+" else x + n
            if op in "+-" and n >= 10:
                left, _, right = re.search(r"(?:\[(\w+)\])?(\w+)(?:\[(\w+)\])?", seq).groups(default="")
                at = [x - len(right), en - len(right), x + len(left), en + len(left)]
                far = at if far is None else [max(a, b) for a, b in zip(far, at)]
                want.append((x, en, n if op == "+" else -n, left, right, *far))
            x = en
        assert [(d.st, d.en, d.len, d.l, d.r, d.stl, d.enl, d.str, d.enr) for d in r.d] == want


def test_poly_a_of_runs(spark):
    for seq, want in [("", 0), ("gaaa", 3), ("TTTTTTg", -6), ("a" * 30 + "c" + "a" * 10, 41), ("a" * 60 + "c" * 21 + "a" * 4, 4), ("gg", 0)]:
        assert spark.createDataFrame([(seq,)], "s string").select(S.poly_a_length("s")).first()[0] == want


def test_indels_are_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = [("c1", 10 * i, 10 * i + 1, f"r{i}", 60, "+", 100 + i, 0, 0, "a") for i in range(20)]
    df = spark.createDataFrame(rows, "ctg string, st long, en long, read string, mapq int, strand string, len long, tsd_len long, polya_len long, seq string")
    merged = merge_indels(df.withColumn("st", F.udf(count, "long")("st")))
    assert sum(r.n_reads for r in merged.collect()) == 20
    assert seen.value == 20
