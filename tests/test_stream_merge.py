"""A stream of signals in files against the batch over all of them."""

import random


from strandloom.operators.merge import assign_clusters
from strandloom.params import MergeParams
from strandloom.streaming.merge import clustered

SCHEMA = (
    "ctg string, pos long, en long, is_bp boolean, ori string, ctg2 string, pos2 long, svtype string, svlen long, "
    "mapq int, strand string, source string, tsd_len long, polya_len long, read string"
)


def some_signals(seed, n):
    r, pos, rows = random.Random(seed), 0, []
    for i in range(n):
        pos += r.choice([0, 0, 10, 60, 90, 150, 400])
        bp = r.random() < 0.4
        kind = r.choice(["BND", "INV"] if bp else ["INS", "DEL"])
        size = r.choice([None, 0, 200]) if bp else r.choice([100, 104, 130]) * (-1 if kind == "DEL" else 1)
        rows.append((r.choice("ab"), pos, None if bp else pos + 50, bp, r.choice([">>", "<>"]) if bp else None, "d" if bp else None, 500 if bp else None, kind, size,
                     r.choice([20, 60]), "+", r.choice("AB"), None if bp else r.choice([None, 5]), None if bp else 9, f"r{i}"))
    return rows


def run(spark, tmp_path, files, **kw):
    """Each file is a run of its own that goes on from the state of the one before."""
    src, rows = tmp_path / "in", []
    src.mkdir()
    for part in files:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(SCHEMA).parquet(str(src))
        query = (
            clustered(stream, MergeParams(), **kw).writeStream.outputMode("append").trigger(availableNow=True)
            .foreachBatch(lambda df, _: rows.extend(df.collect())).option("checkpointLocation", str(tmp_path / "cp")).start()
        )
        try:
            assert query.awaitTermination(60)
        finally:
            query.stop()
    return rows


def clusters(rows, late=False):
    """Contents of every cluster, whatever its number."""
    out = {}
    for r in rows:
        d = r.asDict()
        if late or not d.get("late"):
            out.setdefault((d["ctg"], d["kind"], d["island"], d["cluster"]), []).append((d["pos"], d["en"], d["pos2"], d["svlen"], d["mapq"], d["source"], d["n"], d["is_mid"], d["is_rt"]))
    return sorted(str(sorted(v, key=str)) for v in out.values())


def test_files_in_order_equal_the_batch_and_late_rows_are_put_out(spark, tmp_path):
    rows = some_signals(1, 150)
    files = [rows[i : i + 30] for i in range(0, 150, 30)]
    # Files overlap by less than the lateness.
    files[1][0], files[0][-1] = files[0][-1], files[1][0]
    first = next(r for r in rows if not r[3])
    late = [(*first[:14], f"late{k}") for k in (1, 2)]
    kinds = {(r[0], r[3], r[7], r[5]): r for r in rows}
    end = [(r[0], 10_000_000, *r[2:14], "end") for r in kinds.values()]
    got = run(spark, tmp_path, [*files, [*end, *late]], lateness=1000)
    lost = [r for r in got if r["late"]]
    assert len(lost) == 2 and {(r["ctg"], r["pos"]) for r in lost} == {first[:2]}
    batch = assign_clusters(spark.createDataFrame(rows, SCHEMA), MergeParams()).collect()
    assert clusters(got) == clusters(batch)
    assert sum(r["n"] for r in got if not r["late"]) == 150


def test_settled_islands_leave_and_open_ones_stay():
    from collections import Counter

    from strandloom.streaming.merge import settled_islands

    rows = Counter({(0,): 2, (90,): 1, (300,): 1, (350,): 1, (700,): 3})
    done, rest = settled_islands(rows, 0, 451, 100)
    assert done == [[(0,), (90,)], [(300,), (350,)]] and rest == {(700,): 3}
    assert settled_islands(rows, 0, 450, 100)[0] == [[(0,), (90,)]]
    assert settled_islands(Counter(), 0, 5, 100) == ([], Counter())
