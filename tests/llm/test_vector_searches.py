"""Exact searches against brute force, with nulls, copies, ties, hot groups, huge numbers and several lengths."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import exact_topk, hard_negatives
from strandloom.llm.exact_topk import TopkParams
from strandloom.llm.hard_negatives import NegativeParams, spanning_tree, window
from strandloom.llm.vectors import LEAST, MOST, best_rows, products, whole

SCHEMA = "vec_id long, embedding array<double>, label int, block string, v int, dims string, tree int"
NAN, INF = float("nan"), float("inf")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, "b", 1, "d", 2) for i, v, label in rows], SCHEMA)


def taking_part(rows, with_label=False):
    """One row per id, as the docstrings say, with whole numbers."""
    out = {}
    for i, v, label in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or with_label and label is None:
            continue
        if i not in out or (v, label) < out[i]:
            out[i] = (v, label)
    return out


def inner(a, b, scale):
    total = sum(math.floor(Fraction(x) * scale) * math.floor(Fraction(y) * scale) for x, y in zip(a, b))
    return min(MOST, max(LEAST, total))


def topk_by_hand(rows, every, k, scale):
    of, out = taking_part(rows), []
    for q, (x, _) in of.items():
        if q % every == 0:
            near = sorted((-inner(x, y, scale), i) for i, (y, _) in of.items() if i != q and len(x) == len(y))
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(near[:k], 1)]
    return sorted(out)


def negatives_by_hand(rows, every, p):
    of, out = taking_part(rows, True), []
    for q, (x, label) in of.items():
        if q % every:
            continue
        all_of = sorted((-inner(x, y, p.scale), i, other) for i, (y, other) in of.items() if i != q and len(x) == len(y))
        for ps, positive, _ in [r for r in all_of if r[2] == label][: p.n_positives]:
            met = [(s, i) for s, i, other in all_of if other != label and p.low * -ps <= p.per * -s <= p.high * -ps]
            out += [(q, positive, rank, i, -ps, -s) for rank, (s, i) in enumerate(met[: p.n_negatives], 1)]
    return sorted(out)


def made_up(seed, n, dims=6, hot=False):
    r = random.Random(seed)
    unit = [[r.gauss(0, 1) for _ in range(dims)] for _ in range(5)]
    rows = []
    for i in range(n):
        v = [x + r.gauss(0, 0.3) for x in r.choice(unit)]
        if hot and i % 3 == 0:
            v = unit[0]
        rows.append((i, v, r.randrange(3) if not hot or i % 3 else 1))
    return rows


ODD = [
    (None, [1.0] * 6, 1),
    (1000, None, 1),
    (1005, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1),
    (1010, [NAN] * 6, 1),
    (1015, [1.0, INF, 1.0, 1.0, 1.0, 1.0], 1),
    (1020, [0.0] * 6, 0),
    (1025, [1.0, 2.0], 1),
    (1030, [1.5, -2.0], 1),
    (1031, [0.5, 2.0], 2),
    (1035, [], 1),
    (1040, [], 1),
    (1045, [0.25] * 6, None),
    (-5, [0.5] * 6, 2),
    (5, [0.1] * 6, 2),
    (5, [0.1] * 6, 2),
]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("block_rows", [16, 10_000])
def test_topk(spark, hot, block_rows):
    rows = made_up(3, 150, hot=hot) + ODD
    p = TopkParams(k=4, block_rows=block_rows, n_pivots=6, sample_rows=40, first_chunk=3, query_rows=9, blocks_per_group=3)
    got = exact_topk.search(frame(spark, rows), F.col("vec_id") % 5 == 0, p)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(tuple(r) for r in got.collect()) == topk_by_hand(rows, 5, 4, 1024)


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("block_rows", [16, 10_000])
def test_hard_negatives(spark, hot, block_rows):
    rows = made_up(4, 150, hot=hot) + ODD
    p = NegativeParams(n_positives=3, n_negatives=4, block_rows=block_rows, tree_rows=7, chunk=2)
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 5 == 0, F.col("label"), p)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(tuple(r) for r in got.collect()) == negatives_by_hand(rows, 5, p)


@pytest.mark.parametrize("size", [1e7, 1e18, 1e307])
def test_numbers_that_doubles_cannot_multiply(spark, size):
    r = random.Random(5)
    rows = [(i, [r.uniform(-size, size) for _ in range(3)], i % 2) for i in range(30)] + [(99, [1.7e308, 0.0, 1e-320], 1)]
    got = exact_topk.search(frame(spark, rows), F.col("vec_id") % 3 == 0, TopkParams(k=5, block_rows=8, n_pivots=4))
    assert sorted(tuple(x) for x in got.collect()) == topk_by_hand(rows, 3, 5, 1024)
    p = NegativeParams(block_rows=8, tree_rows=4)
    got = hard_negatives.mine(frame(spark, rows), F.col("vec_id") % 3 == 0, F.col("label"), p)
    assert sorted(tuple(x) for x in got.collect()) == negatives_by_hand(rows, 3, p)


def test_empty_tables_and_no_queries(spark):
    for rows, which in (([], F.lit(True)), (made_up(1, 20), F.lit(False)), (made_up(1, 20), F.lit(None).cast("boolean"))):
        assert exact_topk.search(frame(spark, rows), which).collect() == []
        assert hard_negatives.mine(frame(spark, rows), which, F.col("label")).collect() == []


def test_pivots_spare_rows_of_far_clusters():
    """Clusters far apart: a query's block is answered from its own cluster."""
    r = np.random.default_rng(1)
    x = np.concatenate([r.normal(0, 0.01, (500, 8)) + c for c in np.eye(8)[:4] * 3])
    p = TopkParams(k=5)
    rows = np.floor(x * p.scale)
    pivots = exact_topk.farthest_first(list(rows), 16, float((rows * rows).sum(axis=1).max()), 1)
    block = exact_topk.PivotBlock(np.arange(len(x)), x, pivots.of_rows(rows), pivots, p)
    scores, ids = block.search(3, x[3], pivots.of_queries(rows[3:4])[0], None)
    all_scores = (rows @ rows[3]).astype(np.int64)
    all_scores[3] = -1
    want = best_rows(all_scores, np.arange(len(x)), 5)
    assert ids.tolist() == want.tolist() and scores.tolist() == all_scores[want].tolist()
    assert block.evaluated <= 1000


def test_spanning_tree_is_minimal_and_ends_with_the_heaviest():
    x = np.random.default_rng(2).normal(size=(60, 4))
    order, up, edges, last = spanning_tree(x)
    assert sorted(order.tolist()) == list(range(60)) and up[0] == -1 and all(up[1:] < np.arange(1, 60))
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    joined, total = {0}, 0.0
    while len(joined) < 60:
        d, j = min((far[i, j], j) for i in joined for j in range(60) if j not in joined)
        joined.add(j)
        total += d
    assert edges.sum() == pytest.approx(total, rel=1e-9)
    open_now, most = set(), 0
    for i in range(60):
        if up[i] >= 0 and last[up[i]] == i:
            open_now.discard(up[i])
        if last[i] >= 0:
            open_now.add(i)
        most = max(most, len(open_now))
    assert most <= 7


def test_tree_bounds_spare_rows():
    """Anchors beside each other: after the root few rows are scored."""
    r = np.random.default_rng(3)
    x, p = r.normal(size=(2000, 8)), NegativeParams()
    labels = np.zeros(2000, np.int64)
    block = hard_negatives.Block(np.arange(2000), labels, x, p)
    root, child = whole(x[0], p.scale), whole(x[0] + 0.005, p.scale)
    lo, hi = np.empty(2000), np.empty(2000)
    block.bounds(7, -1, 0.0)
    block.exact(root, None, lo, hi)
    block.leave(0, -1, 1, lo, hi)
    lo, hi = block.bounds(7, 0, float(np.sqrt(((root - child) ** 2).sum())) + 1e-6)
    scores, ids = block.positives(0, 0, child, lo, hi)
    want = products(block.rows, child)
    want[0] = LEAST
    assert ids.tolist() == best_rows(want, np.arange(2000), 5).tolist() and block.rescored < 2000 + 500


def test_windows_are_whole_numbers():
    p = NegativeParams()
    for positive in (-7, -1, 0, 1, 3, 10, 11, MOST, LEAST):
        lo, hi = window(positive, p)
        for s in {lo - 1, lo, lo + 1, hi - 1, hi, hi + 1}:
            assert (lo <= s <= hi) == (30 * positive <= 100 * s <= 90 * positive)


@pytest.mark.parametrize("noise", [0.0, 1e-4, 1e-2])
def test_near_copies_leave_room_for_the_others(noise):
    """A third of the rows around one vector: the other queries still find their nearest."""
    from strandloom.llm.ann import AnnParams, BlockIndex

    r, p = np.random.default_rng(11), AnnParams()
    v = r.normal(size=(2000, 64))
    v[:666] = v[0] + r.normal(size=(666, 64)) * noise
    unit, index = v / np.linalg.norm(v, axis=1, keepdims=True), BlockIndex(np.arange(2000), v, p)
    hit = 0
    for q in range(700, 2000, 50):
        s = unit @ unit[q]
        s[q] = -2
        hit += sum(x >= np.sort(s)[-p.k] - 1e-12 for x, _ in index.nearest(q, v[q]))
    assert hit >= 0.95 * p.k * 26
