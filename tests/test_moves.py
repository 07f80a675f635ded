"""Steps that move their rows once: against the forms that move them often, and by their plans."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandloom.operators import islands, union
from strandloom.operators.asmfilter import category_support, supported_calls, typed_support
from strandloom.operators.compare import select_reportable
from strandloom.operators.merge import cluster_reads
from strandloom.params import CompareParams, MergeParams, UnionParams
from strandloom.plans import flows
from tests.test_breaks import CALL as CALLS
from tests.test_greedy import CALL, SIGNAL, random_signals
from tests.test_segments import random_calls as grouped_calls
from tests.test_support import backs


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("max_alleles", [None, 2])
def test_reads_of_whole_islands_move_once(spark, monkeypatch, max_alleles):
    monkeypatch.setattr(islands, "CELLS", 3)  # several islands in a cell, several cells in an island
    p = MergeParams(max_alleles=max_alleles)
    rows = [(*r[:-1], f"{r[0]}{r[-1]}") for r in random_signals(7, 30)]
    # Copies of a zero length sit in clusters of their own, in read order.
    rows += [("c001", 40, None, True, ">>", "d", 500, "INV", 0, 60, "+", "A", None, None, f"z{j}") for j in range(4)]
    df = spark.createDataFrame(rows, SIGNAL).repartition(3)
    one = cluster_reads(df, p, whole=True)
    assert optimized(one).count("RepartitionByExpression") == 1 and "Window" not in optimized(one)
    names = lambda d: sorted(map(str, d.select("ctg", "kind", "island", "cluster", "read").collect()))
    assert names(one) == names(cluster_reads(df, p, whole=True, deep=0)) and len(names(one)) == len(rows)
    # Islands that are cut at the other ends too hold the same clusters.
    held = lambda d: sorted(sorted(x.r) for x in d.groupBy("ctg", "kind", "island", "cluster").agg(F.collect_list("read").alias("r")).collect())
    if max_alleles is None:
        assert held(one) == held(cluster_reads(df, p))


@pytest.mark.parametrize("min_gap, pieces", [(50, 100_000), (50, 3), (1, 3), (0, 100_000)])
def test_points_of_a_read_are_paired_across_stretches_and_pieces(spark, monkeypatch, min_gap, pieces):
    monkeypatch.setattr(union, "STRETCH", 2)  # a stretch of 400 positions
    monkeypatch.setattr(union, "scan_segments", lambda *a: islands.scan_segments(*a, most=pieces))
    rnd, calls, reads = random.Random(min_gap), [], []
    for n in range(120):
        key, pos = (n % 2, n, f"s{n}"), rnd.choice([800, 900, rnd.randrange(-500, 3000)])
        ori, types = rnd.choice([">>", "<<", "><", None]), ["BND", "DUP", "DEL", "INV", "INS", None]
        calls.append((*key, rnd.choice("aab"), pos, ori, rnd.choice(["a", "b", None]), pos + rnd.choice([1, 60, 199, 200, 700]), rnd.choice(types)))
        reads += [(*key, rnd.choice(["r0", "r1", "r2", "r3", None])) for _ in range(rnd.choice([0, 1, 2, 4]))]
    c, rd = spark.createDataFrame(calls, CALLS), spark.createDataFrame(reads, "file_id int, line_no long, svid string, read string")
    pairs = union.strand_break_pairs(c, rd, max_gap=200, min_gap=min_gap)
    pts = union._break_points(c, ["file_id", "line_no", "svid"]).join(rd.distinct().toDF("_k_file_id", "_k_line_no", "_k_svid", "read"), ["_k_file_id", "_k_line_no", "_k_svid"])
    pts = [tuple(x) for x in pts.select("_k_file_id", "_k_line_no", "_k_svid", "end", "ctg", "pos", "ori", "svtype", "read").collect()]
    shared, listed = Counter(), Counter(x[:3] for x in reads)
    for a in pts:
        for b in pts:
            if a[8] is not None and (a[4], a[8]) == (b[4], b[8]) and a[4] is not None and min_gap <= b[5] - a[5] < 200:
                shared[a[:8], b[:8]] += 1
    want = []
    for (a, b), n in shared.items():
        bnd, types = "BND" in (a[7], b[7]), (a[7], b[7])
        kind = "case1" if types == ("DEL", "DEL") else None
        kind = "Parallel_Breakpoints_case4" if types == ("INV", "INV") or bnd and a[6] == b[6] is not None else kind
        kind = "Insertions_case3" if bnd and n == listed[a[:3]] else kind
        want += [str((a[2], b[2], a[5], b[5], kind))] if kind else []
    got = pairs.filter("dsb_type != 'case2'").select("svid0", "svid1", "pos0", "pos1", "dsb_type").collect()
    assert sorted(str(tuple(x)) for x in got) == sorted(want) and len(want) > 30
    # Points move once, and once more as pairs: the only joins are those of calls with reads and of duplications.
    if min_gap:
        assert optimized(pairs).count("Join ") == 2


def test_support_of_copies_unknowns_and_files_in_one_move(spark):
    """Categories together give what each gives alone and a look at every read gives; ids recur in files, rows and keys recur."""
    rnd = random.Random(3)
    size = lambda: int(10 ** rnd.uniform(1.5, 6))
    pick = lambda n: [(rnd.choice([f"r{i}" for i in range(15)] + [None]), rnd.choice([0, 1, 2, 4, 8]), size()) for _ in range(n)]
    found = {"x": pick(60), "y": pick(25), "z": []}
    found["y"] += found["x"][:10]
    calls = []
    for i in range(80):
        kind = rnd.choice(["INS", "DUP", "DEL", "INV", "BND"])
        calls.append((i % 3, i // 8, f"severus_x{i // 8}_{i % 2 + 1}", "c", rnd.choice([10, 20, None]), ">>", rnd.choice("cd"), 20, kind, size() * rnd.choice([1, -1]), False, i % 4, 1.0))
    calls += [(*c[:11], 9, 0.5) for c in calls[:20]] + calls[:7] + [(0, 1, None, "c", 10, ">>", "c", 20, "DEL", -90, False, 3, 1.0)]
    reads = [(f, f"severus_x{i}", rnd.choice([f"r{k}" for k in range(20)] + [None])) for f in (0, 1, 2) for i in range(9) for _ in range(6)]
    c, ev = spark.createDataFrame(calls, CALL).repartition(4), {n: spark.createDataFrame(rows, "read string, flag int, abs_len long") for n, rows in found.items()}
    flag = lambda x: {"INS": 1, "DUP": 1, "DEL": 2, "INV": 4}.get(x[8], 8 if x[6] != "c" else 0)
    key = [0, 1, 2, 3, 4, 6, 7, 8, 9]
    for shared in (True, False):
        rd = spark.createDataFrame(reads, "file_id int, svid string, read string").drop(*([] if shared else ["file_id"]))
        want = {}
        for x in calls:
            mine = {r for f, s, r in reads if r is not None and x[2] is not None and s == x[2][:-2] and (not shared or f == x[0])}
            alike = sum([x[k] for k in key] == [y[k] for k in key] for y in calls) if None not in [x[k] for k in key] else 0
            want[x] = [(n, sum(any(e[0] == r and backs(flag(x), abs(x[9]), e[1], e[2], 0.6) for e in rows) for r in mine), sum(any(e[0] == r for e in rows) for r in mine), alike) for n, rows in found.items()]
        got = category_support(c, rd, ev, CompareParams()).collect()
        once = lambda x, n: [(k, a * bool(m), b * bool(m)) for k, a, b, m in want[x] if k in n]
        assert Counter(str((tuple(r)[:-1], [tuple(x) for x in r["support"]])) for r in got) == Counter(str((x, once(x, found))) for x in calls)
        for i, n in enumerate(found):
            one = typed_support(c, rd, ev[n], CompareParams())
            assert Counter(str(tuple(r)) for r in one.collect()) == Counter(str((*x, want[x][i][1] * want[x][i][3], want[x][i][2] * want[x][i][3])) for x in calls)
        assert optimized(one).count("Join ") == 2 and optimized(one).count("RepartitionByExpression") == 3
    with pytest.raises(Exception, match="no reads listed for"):
        typed_support(c.filter("svid is not null"), rd, ev["x"], CompareParams(), strict=True).collect()
    listed = [(f, f"severus_x{i}", "r1") for f in (0, 1, 2) for i in range(11)]
    strict = typed_support(c, spark.createDataFrame(listed, "file_id int, svid string, read string"), ev["z"], CompareParams(), strict=True)
    assert strict.filter("asm_name_support = 0").count() == len(calls)  # a call without id is not refused


@pytest.mark.parametrize("deep, with_bed", [(islands.DEEP, False), (20, True)])
def test_categories_are_grouped_together_as_each_alone(spark, monkeypatch, deep, with_bed):
    rnd = random.Random(5)
    rows = [(*c[:2], f"severus_x{c[1] // 2}_{c[1] % 2 + 1}", *c[3:]) for c in grouped_calls(9, 250)] + [(0, 900, None, "a", 5, ">>", "a", 9, "DEL", -400, False, 3, 1.0)]
    calls = spark.createDataFrame(rows, CALL).repartition(3)
    reads = calls.filter("svid is not null").selectExpr("file_id", "substring(svid, 1, length(svid) - 2) svid", "explode(array('r0', concat('r', line_no % 7), concat('q', line_no))) read")
    pick = lambda n: [(rnd.choice([f"r{i}" for i in range(7)]), rnd.choice([1, 2, 8]), rnd.choice([90, 400, 3000])) for _ in range(n)]
    ev = {n: spark.createDataFrame(pick(k), "read string, flag int, abs_len long") for n, k in (("x", 60), ("y", 25))}
    bed = spark.createDataFrame([("a", 0, 40_000), ("b", 1000, 50_000)], "ctg string, st long, en long") if with_bed else None
    p, times = UnionParams(group_min_count=2), []
    monkeypatch.setattr(flows, "grouped", lambda *a, **k: times.append(1) or union.grouped(*a, **k, deep=deep))
    out = flows.category_unions(calls, reads, ev, 2, p=p, bed=bed, n_callers=2)
    assert len(times) == 1 and list(out) == ["l_only", "x", "y"]
    enough = CompareParams(min_count=2)
    stats = category_support(select_reportable(calls, enough, bed), reads, ev, enough).selectExpr("file_id", "regexp_replace(svid, '_[12]$', '') clean_id", "count", "inline(support)")
    text = lambda d: sorted(str(sorted(r.asDict().items())) for r in d.collect())
    for name in out:
        mine = calls.filter("count <= 0 or count >= 2") if name == "l_only" else supported_calls(calls, stats.filter(F.col("category") == name), enough)
        mine = mine.filter("file_id < 2")
        want = union.union_rows(mine, p, bed)
        assert text(out[name]["rows"]) == text(want) and not want.isEmpty()
        assert text(out[name]["combinations"]) == text(union.combination_counts(mine, 2, p, bed))
        assert text(out[name]["dedup"]) == text(union.median_rows(want))
    gone = reads.filter(~F.col("svid").isin("severus_x100", "severus_x121"))
    with pytest.raises(Exception, match="no reads listed for"):
        flows.category_unions(calls, gone, ev, 2, p=p, n_callers=1)


@pytest.mark.parametrize("collapsed", [True, False])
def test_support_stays_with_the_calls_of_a_union(spark, collapsed):
    rnd = random.Random(8)
    rows = grouped_calls(10, 200)
    rows += rows[:15] + [(*r[:11], 9, 0.5) for r in rows[10:30]] + [(*r[:2], None, *r[3:]) for r in rows[:5]]
    calls = spark.createDataFrame(rows, CALL).repartition(3)
    reads = calls.filter("svid is not null").selectExpr("file_id", "svid", "explode(array('r0', concat('r', line_no % 7), concat('r', line_no % 5))) read")
    found = [(rnd.choice([f"r{i}" for i in range(7)]), rnd.choice([1, 2, 8]), rnd.choice([90, 400, 3000])) for _ in range(40)]
    ev = spark.createDataFrame(found, "read string, flag int, abs_len long")
    p = UnionParams(group_min_count=2, collapsed=collapsed)
    cols = [x.split()[0] for x in CALL.split(", ")]
    support = typed_support(calls, reads, ev, CompareParams(min_len_ratio=p.min_len_ratio)).selectExpr(*union.CALL_KEY, "asm_support n_asm")
    want = [r.asDict() for r in union.union_rows(calls, p).join(support, union.CALL_KEY, "left").fillna(0, ["n_asm"]).collect()]
    if collapsed:
        rest = [*union.CALL_KEY, *[c for c in cols if c not in union.CALL_KEY]]
        rank = lambda r: [r["n_asm"], -r["pos"], -r["file_id"], -r["line_no"], *[(r[c] is not None, r[c]) for c in rest]]
        best = {}
        for r in want:
            if r["group_id"] not in best or rank(r) > rank(best[r["group_id"]]):
                best[r["group_id"]] = r
        want = [*best.values()]
    want = [r for r in want if r["n_asm"] >= 2]
    text = lambda d: sorted(str(sorted(r.items())) for r in d)
    out = union.supported_union(calls, reads, ev, p)
    assert text(r.asDict() for r in out.collect()) == text(want) and len(want) > 20
    if collapsed:  # the groups are numbered by chunks; nothing else is joined
        assert optimized(out).count("Join ") <= 1
