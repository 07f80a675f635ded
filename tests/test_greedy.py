"""Ordered scans against serial restatements; every contig is one random case."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandloom.functions.typing import same_call
from strandloom.operators.compare import SHAPE, consensus, same_shape
from strandloom.operators.long_indels import merge_indels
from strandloom.operators.merge import assign_clusters, cluster_reads, merge_signals
from strandloom.operators.union import grouped
from strandloom.params import CompareParams, MergeParams, UnionParams

SIGNAL = (
    "ctg string, pos long, en long, is_bp boolean, ori string, ctg2 string, pos2 long, svtype string, svlen long, "
    "mapq int, strand string, source string, tsd_len long, polya_len long, read string"
)
CALL = (
    "file_id int, line_no long, svid string, ctg string, pos long, ori string, ctg2 string, pos2 long, svtype string, "
    "svlen long, inv boolean, count long, vaf double"
)


def random_signals(seed, n_cases=60):
    rnd = random.Random(seed)
    out = []
    for case in range(n_cases):
        ctg, pos = f"c{case:03d}", 0
        for i in range(rnd.randint(1, 40)):
            pos += rnd.choice([0, 0, 3, 20, 60, 101, 150])
            bp = rnd.random() < 0.4
            kind = rnd.choice(["BND", "DUP", "INV", "INS"] if bp else ["INS", "DEL"])
            n = rnd.choice([None, 0, 200, 205, 230]) if bp else rnd.choice([100, 104, 109, 130])
            row = (
                ctg, pos, None if bp else pos + rnd.choice([0, 90, 180]), bp,
                rnd.choice(["><", "<>", ">>"]) if bp else None, rnd.choice([ctg, "d"]) if bp else None,
                rnd.choice([500, 590, 700]) if bp else None, kind, -n if kind == "DEL" else n,
                rnd.choice([20, 60]), rnd.choice("+-"), rnd.choice("AB"),
                None if bp else rnd.choice([None, 5, 12]), None if bp else 9, f"r{i}",
            )
            out += [row[:-1] + (f"{row[-1]}.{k}",) for k in range(rnd.choice([1, 1, 1, 3]))]
    return out


def arrival(row):
    none_first = lambda x: (x is not None, x if x is not None else 0)
    ctg, pos, en, bp, ori, ctg2, pos2, kind, n, mapq, strand, source, tsd, polya, read = row
    text = lambda x: (x is not None, x or "")
    return (
        ctg, pos, bp, none_first(en), text(ori), text(ctg2), none_first(pos2), kind, none_first(n),
        mapq, none_first(polya), source, strand, none_first(tsd), read,
    )


def alike(a, b, w=100):
    if a[3] != b[3] or a[7] != b[7] or abs(a[1] - b[1]) > w:
        return False
    if a[3]:
        if a[4] != b[4] and sorted([a[4], b[4]]) != ["<>", "><"]:
            return False
        if a[5] != b[5] or abs(a[6] - b[6]) > w:
            return False
    elif abs(a[2] - b[2]) > w:
        return False
    if a[8] is not None and b[8] is not None:
        if a[8] * b[8] <= 0 or abs(abs(a[8]) - abs(b[8])) > 0.5 * (abs(a[8]) + abs(b[8])) * 0.05:
            return False
    return True


def serial_clusters(rows, max_alleles):
    done, live, ctg = [], [], None
    for v in sorted(rows, key=arrival):
        while live and (
            ctg != v[0] or v[1] - max(m[1] for m in live[0]) > 100 or (max_alleles is not None and len(live) > max_alleles)
        ):
            done.append(live.pop(0))
        ctg = v[0]
        votes = [sum(alike(m, v) for m in c) for c in live]
        if votes and max(votes) > 0:
            live[votes.index(max(votes))].append(v)
        else:
            live.append([v])
    return done + live


@pytest.mark.parametrize("max_alleles", [100, 2, None])
def test_merge_equals_serial_scan(spark, max_alleles):
    rows = random_signals(7 + (max_alleles or 0))
    p = MergeParams(max_alleles=max_alleles)
    df = spark.createDataFrame(rows, SIGNAL).repartition(5)
    placed = assign_clusters(df, p)
    got = defaultdict(list)
    for r in placed.collect():
        got[(r.ctg, r.kind, r.island, r.cluster)].append((r.n, r.pos, r.svtype, r.svlen, r.strand, r.source, r.is_mid))
    want = serial_clusters(rows, max_alleles)
    sizes = lambda groups: sorted(groups)
    assert sizes((k[0], sum(x[0] for x in v)) for k, v in got.items()) == sizes((c[0][0], len(c)) for c in want)
    expand = sorted(sorted(str(x[1:6]) for x in v for _ in range(x[0])) for v in got.values())
    assert expand == sorted(sorted(str((m[1], m[7], m[8], m[10], m[11])) for m in c) for c in want)
    mids = sorted(str((k[0], *x[1:6])) for k, v in got.items() for x in v if x[6])
    assert mids == sorted(str((c[0][0], *(lambda m: (m[1], m[7], m[8], m[10], m[11]))(c[len(c) >> 1]))) for c in want)
    if max_alleles != 2:
        reads = cluster_reads(df, p).groupBy("ctg", "kind", "island", "cluster").agg(F.sort_array(F.collect_list("read")).alias("r"))
        assert sorted((r.ctg, tuple(r.r)) for r in reads.collect()) == sorted(
            (c[0][0], tuple(sorted(m[14] for m in c))) for c in want
        )


def test_merge_does_not_depend_on_partitions(spark):
    rows = random_signals(3, 20)
    p = MergeParams(min_count=2, min_count_strand=0)
    a = merge_signals(spark.createDataFrame(rows, SIGNAL).coalesce(1), p)
    b = merge_signals(spark.createDataFrame(list(reversed(rows)), SIGNAL).repartition(7, "read"), p)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_merge_of_one_hot_locus(spark):
    """A third of all rows at one place: counted before the scan, exact votes without sampling."""
    hot = spark.range(30_000).selectExpr(
        "'c' ctg", "100L pos", "100L en", "false is_bp", "cast(null as string) ori", "cast(null as string) ctg2",
        "cast(null as long) pos2", "'INS' svtype", "120L + id % 3 svlen", "60 mapq", "if(id % 2 = 0, '+', '-') strand",
        "'A' source", "5L tsd_len", "9L polya_len", "concat('r', id) read",
    )
    (r,) = merge_signals(hot, MergeParams()).collect()
    assert (r["n_reads"], r["count"], r["avg_mapq"]) == (30_000, "A:15000,15000", 60)
    assert assign_clusters(hot).count() == 6


def test_worked_merge(spark):
    def rows(strands):
        return [("chr1", 9000, 9000, False, None, None, None, "INS", 120, 60, s, "foo", 0, 0, f"r{i}") for i, s in enumerate(strands)]

    (r,) = merge_signals(spark.createDataFrame(rows("++--"), SIGNAL)).collect()
    assert (r["pos"], r["n_reads"], r["count"], r["rt_len"], r["avg_mapq"]) == (9000, 4, "foo:2,2", 0, 60)
    assert merge_signals(spark.createDataFrame(rows("+++-"), SIGNAL)).count() == 0
    assert merge_signals(spark.createDataFrame(rows("+--"), SIGNAL)).count() == 0


def random_calls(seed, n_cases=60):
    rnd = random.Random(seed)
    out = []
    for case in range(n_cases):
        ctg = f"c{case:03d}"
        for i in range(rnd.randint(1, 25)):
            kind = rnd.choice(["INS", "DEL", "DUP", "INV", "BND"])
            pos = rnd.randint(0, 12) * 130
            ctg2 = rnd.choice([ctg, "x"]) if kind == "BND" else ctg
            n = 0 if kind == "BND" else rnd.choice([100, 900, 2600, 9000]) * (-1 if kind == "DEL" else 1)
            out.append((rnd.randint(0, 2), i, f"s{i}", ctg, pos, ">>", ctg2, pos + rnd.choice([0, 100, 450, 1500]), kind, n, False, 5, 1.0))
    return out


def shape(r):
    return (r[3], r[4], r[6], r[7], r[8], r[9])


def order(r):
    return (r[3], r[4], r[0], r[1], r[6], r[7], r[8], r[9], r[2])


def test_consensus_equals_serial_scan(spark):
    rows = random_calls(5)
    seeds = []
    for r in sorted(rows, key=order):
        near = [s for s in seeds if s[0][3] == r[3] and r[4] - s[0][4] <= 500]
        hit = [s for s in near if same_shape(shape(s[0]), shape(r), 500, 0.6)]
        if hit:
            hit[-1][1] += 1
        else:
            seeds.append([r, 1])
    got = consensus(spark.createDataFrame(rows, CALL).repartition(3), CompareParams()).collect()
    key = lambda file, line, sh, n: str((file, line, sh, n))
    assert sorted(key(r.file_id, r.line_no, tuple(r[c] for c in SHAPE), r.support) for r in got) == sorted(
        key(s[0][0], s[0][1], shape(s[0]), s[1]) for s in seeds
    )


def test_union_equals_serial_scan(spark):
    rows = random_calls(11)
    groups = []
    for r in sorted(rows, key=order):
        near = [g for g in groups if g[0][3] == r[3] and r[4] - g[0][4] <= 500]
        hit = [g for g in near if any(same_shape(shape(m), shape(r), 500, 0.6) for m in g)]
        if hit:
            hit[-1].append(r)
        else:
            groups.append([r])
    got = defaultdict(list)
    for r in grouped(spark.createDataFrame(rows, CALL).repartition(3), UnionParams()).collect():
        got[(r.ctg, r.ctg2, r.island, r.grp)].append((r.ctg, r.file_id, r.line_no))
    assert sorted(sorted(v) for v in got.values()) == sorted(sorted((m[3], m[0], m[1]) for m in g) for g in groups)


def test_row_and_column_forms_of_the_match_rule_agree(spark):
    rows = [(shape(a), shape(b)) for a, b in zip(random_calls(1, 40), random_calls(2, 40))]
    flat = [(*a, a[0], b[1], a[2] if i % 3 else b[2], *b[3:]) for i, (a, b) in enumerate(rows)]
    names = ["b_" + c for c in SHAPE] + ["t_" + c for c in SHAPE]
    df = spark.createDataFrame(flat, ", ".join(f"{n} {'long' if 'pos' in n or 'len' in n else 'string'}" for n in names))
    rule = same_call(lambda c: F.col("b_" + c), lambda c: F.col("t_" + c), 500, 0.6)
    for r in df.select(*names, rule.alias("same")).collect():
        assert r.same == same_shape(tuple(r[:6]), tuple(r[6:12]), 500, 0.6), r


def test_indel_merge_equals_serial_scan(spark):
    rnd = random.Random(4)
    rows = []
    for case in range(60):
        st = 0
        for i in range(rnd.randint(1, 25)):
            st += rnd.choice([0, 0, 10, 60, 130, 400])
            n = rnd.choice([100, 103, 110, 300]) * rnd.choice([1, -1])
            rows.append((f"c{case:03d}", st, st + (2 if n > 0 else -n), f"r{i}", 60, rnd.choice("+-"), n, rnd.randint(0, 9), rnd.randint(-9, 9), f"s{i}"))
    want = []
    for ctg in sorted({r[0] for r in rows}):
        live, done = [], []
        for r in sorted((r for r in rows if r[0] == ctg), key=lambda r: (r[1], r[2], r[6], r[5], r[3])):
            while live and r[1] - max(m[2] for m in live[0]) > 100:
                done.append(live.pop(0))
            for c in reversed(live):
                near = min(abs(abs(r[6]) - abs(m[6])) for m in c)
                if c[0][6] * r[6] > 0 and near <= 0.05 * max(abs(m[6]) for m in [*c, r]):
                    c.append(r)
                    break
            else:
                live.append([r])
        want += done + live
    df = spark.createDataFrame(rows, "ctg string, st long, en long, read string, mapq int, strand string, len long, tsd_len long, polya_len long, seq string")
    got = merge_indels(df.repartition(3)).collect()
    mean = lambda c, i: int((sum(m[i] for m in c) / len(c) + 0.499) // 1)
    assert sorted((r.ctg, r.st, r.en, r.len, r.tsd_len, r.polya_len, r.n_reads, r.n_fwd, r.seq) for r in got) == sorted(
        (c[0][0], c[0][1], max(m[2] for m in c), mean(c, 6), mean(c, 7), mean(c, 8), len(c), sum(m[5] == "+" for m in c), c[0][9])
        for c in want
    )


def test_copies_of_a_zero_length_take_linear_time():
    """They match nothing of their kind, so each is a cluster; a row without length joins the oldest."""
    import time

    from strandloom.operators.merge import VoteScan

    def took(n):
        out = []
        scan = VoteScan(lambda batch, i, *v: out.append((i, *v)), MergeParams())
        sig = (100, True, None, ">>", "d", 500, "INV", 0)
        t = time.perf_counter()
        for k in range(5):
            scan.row(None, k, (100 + k, *sig[1:], n, False))
        for k in (5, 6):
            scan.row(None, k, (110, True, None, ">>", "d", 500, "INV", None, 2, False))
        scan.close()
        return time.perf_counter() - t, out

    took(10)
    (_, few), (long, many) = took(3), took(100_000)
    assert len(few) == 5 * 3 + 2 and sorted({r[1] for r in few}) == list(range(15))
    assert [r for r in few if r[0] >= 5] == [(5, 0, 2, True, False), (6, 0, 2, False, False)]
    assert [r for r in few if r[1] == 0][0] == (0, 0, 1, False, False)
    assert len(many) == 500_002 and long < 20


def test_a_contig_long_island_falls_apart_at_its_other_ends(spark):
    rows = spark.range(20_000).selectExpr(
        "'c' as ctg", "id * 50 as pos", "cast(null as bigint) as en", "true as is_bp", "'>>' as ori", "'d' as ctg2", "id % 97 * 1000 + id div 9700 as pos2", "'BND' as svtype",
        "cast(null as bigint) as svlen", "30 as mapq", "'+' as strand", "'A' as source", "cast(null as bigint) as tsd_len", "cast(null as bigint) as polya_len", "concat('r', id) as read",
    )
    placed = assign_clusters(rows, MergeParams())
    assert placed.select("kind", "island").distinct().count() == 97 and placed.agg(F.sum("n")).first()[0] == 20_000


def test_reads_are_placed_without_joining_them_back(spark):
    """Island numbers are joined to the rows, nothing else is; copies of a zero length take their clusters in read order."""
    rows = [("c", 100 + k, None, True, ">>", "d", 500, "INV", 0, 60, "+", "A", None, None, f"r{k}{j}") for k in range(2) for j in range(3)]
    rows += [("c", 110, None, True, ">>", "d", 500, "INV", None, 60, "+", "A", None, None, f"s{j}") for j in range(2)]
    out = cluster_reads(spark.createDataFrame(rows, SIGNAL).repartition(3), MergeParams())
    assert {r.read: r.cluster for r in out.collect()} == {**{f"r{k}{j}": 3 * k + j for k in range(2) for j in range(3)}, "s0": 0, "s1": 0}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 3  # the second island numbers are found on the rows with the first ones
