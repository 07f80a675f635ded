"""Hard negatives by bounds along spanning trees of the anchors.

Scores are exact inner products.  Two anchors that lie ``e`` apart have scores with a row ``c`` that differ by
``e * |c|`` at most.  So anchors are joined to trees of short edges (minimum spanning trees of bounded groups of
neighbours), and a block of rows is scored in full only with each tree's root.  A child's scores are bounded by its
parent's, exact or bounds themselves, plus and minus edge times norm, and only rows are rescored whose bounds meet
what is sought:

* first the positives, rows of the anchor's label, in the order of their upper bounds until the next bound is below
  the last of the best;
* then, when the positives of the whole table are known, the negatives: rows of other labels whose bounds meet a
  window ``low * positive <= per * score <= high * positive``.

Rows are dealt to blocks by a hash of their id, so a label with a third of all rows is spread over all of them.  A
row is shuffled to its block and never copied; anchors, a stated set, visit every block in the order of their tree.
Trees are walked with the heaviest child last, so few parents' bounds are held at a time.

Defined cases: rows with a null id, label or vector, or a null or non-finite component, take no part; of rows that
repeat an id the smallest vector counts, then the smallest label; vectors of different lengths are not compared; ties
go to the smaller id; an anchor without positives, and a positive without rows in its window (any below 0), give no
rows; scores beyond 64 bits count as the nearest 64-bit number; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.scratch import written
from strandloom.llm.vectors import best_rows, matrix, products, ranked, sections, usable, whole


@dataclass(frozen=True)
class NegativeParams:
    n_positives: int = 5
    n_negatives: int = 10
    low: int = 30
    high: int = 90
    per: int = 100
    scale: int = 256
    block_rows: int = 16_384
    tree_rows: int = 512
    planes: int = 16
    chunk: int = 64
    seed: int = 13


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimum spanning tree of the rows of ``x``, parents first and the heaviest child last.

    Returns the order of the rows, and for each place in it the place of the parent (-1: root), the length of the
    edge to it, and the place of the last child (-1: none).
    """
    n = len(x)
    norms = (x * x).sum(axis=1)
    parent, edge2 = np.full(n, -1), np.full(n, np.inf)
    out, now = np.zeros(n, bool), 0
    taken = []
    while True:
        out[now] = True
        taken.append(now)
        if len(taken) == n:
            break
        with np.errstate(over="ignore", invalid="ignore"):
            d2 = np.maximum(norms + norms[now] - 2 * x @ x[now], 0.0)
        nearer = ~out & ~(d2 >= edge2)
        parent[nearer], edge2[nearer] = now, d2[nearer]
        left = np.flatnonzero(~out)
        now = int(left[np.nan_to_num(edge2[left], nan=np.inf).argmin()])
    weight = np.ones(n, np.int64)
    children: list[list[int]] = [[] for _ in range(n)]
    for i in reversed(taken[1:]):
        weight[parent[i]] += weight[i]
        children[parent[i]].append(i)
    order, stack = [], [taken[0]]
    while stack:
        i = stack.pop()
        order.append(i)
        stack += sorted(children[i], key=lambda c: (-weight[c], c))  # the lightest is next, the heaviest last
    order = np.array(order)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    up = np.where(parent[order] < 0, -1, place[parent[order]])
    with np.errstate(over="ignore", invalid="ignore"):
        # Rounding of d2 is relative to the norms, and a root turns it into more for short edges.
        slack = 8 * (x.shape[1] + 8) * np.finfo(float).eps * (norms[order] + norms[parent[order]])
        edges = np.where(up < 0, 0.0, np.sqrt(edge2[order] + slack))
    last = np.full(n, -1)
    for i in range(1, n):
        last[up[i]] = i
    return order, up, edges, last


def trees(anchors: DataFrame, n: int, p: NegativeParams) -> DataFrame:
    """``tree, at, up, edge, last, dims, anchor_id, label, v`` of all anchors, neighbours in one tree of bounded size."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            code = []
            for v in batch.column(1):
                x = np.asarray(v.as_py(), dtype=float)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(p.seed).standard_normal((len(x), p.planes))
                with np.errstate(over="ignore", invalid="ignore"):
                    code.append(int(np.packbits(x @ planes[len(x)] > 0).view(">u2")[0]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(code, pa.int32())], names=[*batch.schema.names, "code"])

    near = anchors.select("vec_id", "v", "label", F.size("v").alias("dims")).mapInArrow(coded, "vec_id long, v array<double>, label long, dims int, code int")
    ranged = near.repartitionByRange(max(1, -(-n // p.tree_rows)), "dims", "code", "vec_id")
    groups = written(ranged.select(F.spark_partition_id().alias("g"), "dims", "vec_id", "v", "label"), "anchors")

    def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def tree(key: tuple[int, int], number: int, rows: pa.Table) -> pa.RecordBatch:
            rows = rows.combine_chunks()
            v = matrix(rows.column(3).chunk(0))
            with np.errstate(over="ignore"):
                order, up, edges, last = spanning_tree(np.floor(v * p.scale))
            one = rows.take(pa.array(order)).combine_chunks()
            m = len(order)
            own = [pa.array(np.full(m, (key[0] << 32) + number)), *[pa.array(c.astype(np.int32)) for c in (np.arange(m), up)], pa.array(edges), pa.array(last.astype(np.int32))]
            return pa.RecordBatch.from_arrays([*own, *[one.column(i).combine_chunks() for i in (1, 2, 4, 3)]], names=["tree", "at", "up", "edge", "last", "dims", "anchor_id", "label", "v"])

        key, parts, size, number = None, [], 0, 0
        for now, part in sections(batches, 2):
            if parts and now != key:
                yield tree(key, number, pa.Table.from_batches(parts))
                parts, size = [], 0
            if key is None or now[0] != key[0]:
                number = -1
            if not parts:
                number += 1
            key = now
            while part.num_rows:
                more = part.slice(0, p.tree_rows - size)
                parts.append(more)
                size, part = size + more.num_rows, part.slice(more.num_rows)
                if size == p.tree_rows:
                    yield tree(key, number, pa.Table.from_batches(parts))
                    parts, size, number = [], 0, number + 1

        if parts:
            yield tree(key, number, pa.Table.from_batches(parts))

    lined_up = groups.repartition("g").sortWithinPartitions("g", "dims", "vec_id")
    return lined_up.mapInArrow(grown, "tree long, at int, up int, edge double, last int, dims int, anchor_id long, label long, v array<double>")


class Block:
    """Rows of one length; bounds of open parents' scores with them."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, p: NegativeParams):
        self.ids, self.labels, self.p, self.rows = ids, labels, p, whole(vectors, p.scale)
        floats = np.floor(vectors * p.scale) if self.rows.dtype == object else self.rows
        with np.errstate(over="ignore"):
            self.norms = np.sqrt((floats * floats).sum(axis=1)) * (1 + 1e-12)
        self.tree, self.open, self.rescored = None, {}, 0

    def bounds(self, tree: int, up: int, edge: float) -> tuple[np.ndarray, np.ndarray] | None:
        """Bounds of a child's scores, or nothing for a root."""
        if tree != self.tree:
            self.tree, self.open = tree, {}
        if up < 0:
            return None
        lo, hi, _ = self.open[up]
        with np.errstate(over="ignore", invalid="ignore"):
            reach = edge * self.norms
            return lo - reach, hi + reach

    def leave(self, at: int, up: int, last: int, lo: np.ndarray, hi: np.ndarray) -> None:
        """Keep an anchor's bounds for its children, and drop its parent's after the last child."""
        if up >= 0 and self.open[up][2] == at:
            del self.open[up]
        if last >= 0:
            self.open[at] = (lo, hi, last)

    def exact(self, query: np.ndarray, at: np.ndarray | None, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Scores of the rows ``at`` (all: None), entered into the bounds."""
        rows = self.rows if at is None else self.rows[at]
        self.rescored += len(rows)
        scores = products(rows, query)
        at = slice(None) if at is None else at
        lo[at] = hi[at] = scores
        if self.rows.dtype == object or query.dtype == object:
            lo[at], hi[at] = -np.inf, np.inf  # such numbers are no bounds for others
        return scores

    def positives(self, anchor: int, label: int, query: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the block's best rows of the anchor's label."""
        k = self.p.n_positives
        own = np.flatnonzero((self.labels == label) & (self.ids != anchor))
        own = own[np.argsort(-np.nan_to_num(hi[own], nan=np.inf), kind="stable")]
        scores, ids, i, size = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, self.p.chunk
        while i < len(own) and not (len(scores) == k and hi[own[i]] < scores[-1]):
            at = own[i : i + size]
            i, size = i + size, size * 2
            scores, ids = np.concatenate((scores, self.exact(query, at, lo, hi))), np.concatenate((ids, self.ids[at]))
            best = best_rows(scores, ids, k)
            scores, ids = scores[best], ids[best]
        return scores, ids

    def negatives(self, label: int, query: np.ndarray, windows: list[tuple[int, int]], lo: np.ndarray, hi: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each window of scores, scores and ids of the block's best rows of other labels in it."""
        meets = np.zeros(len(self.ids), bool)
        for least, most in windows:
            if least <= most:
                meets |= ~(hi < least) & ~(lo > most)
        at = np.flatnonzero(meets & (self.labels != label))
        scores = self.exact(query, None if len(at) == len(self.ids) else at, lo, hi) if len(at) else np.zeros(0, np.int64)
        out = []
        for least, most in windows:
            inside = np.flatnonzero((scores >= least) & (scores <= most)) if least <= most else at[:0]
            best = inside[best_rows(scores[inside], self.ids[at[inside]], self.p.n_negatives)]
            out.append((scores[best], self.ids[at[best]]))
        return out


def window(positive: int, p: NegativeParams) -> tuple[int, int]:
    """Whole scores ``s`` with ``low * positive <= per * s <= high * positive``."""
    return -(-p.low * positive // p.per), p.high * positive // p.per


def over_blocks(table: DataFrame, anchors: DataFrame, blocks: int, p: NegativeParams, schema: str, answer: Callable) -> DataFrame:
    """``answer`` of every anchor in every block, tree by tree.

    ``anchors`` has the columns of ``trees`` and ``positives`` (ids) and ``scores``.
    """
    names = ["block", "dims", "kind", "tree", "at", "id", "label", "v", "up", "edge", "last", "positives", "scores"]
    nothing = {"tree": "bigint", "at": "int", "up": "int", "edge": "double", "last": "int", "positives": "array<bigint>", "scores": "array<bigint>"}
    rows = table.select("block", "dims", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "v", *[F.lit(None).cast(t).alias(c) for c, t in nothing.items()])
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    asked = anchors.select(every, "dims", F.lit(1).alias("kind"), F.col("anchor_id").alias("id"), "label", "v", *nothing)
    out = [c.split() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for (b, dims, kind), part in sections(batches, 3):
            if (b, dims) != key:
                key, parts, block = (b, dims), [], None
            if kind == 0:
                parts.append(part)
                continue
            if not parts and block is None:
                continue  # no rows of this length here
            if block is None:
                t = pa.Table.from_batches(parts).combine_chunks()
                block = Block(*[np.asarray(t.column(i).chunk(0)) for i in (5, 6)], matrix(t.column(7).chunk(0)), p)
                parts = []
            got = []
            cols = [part.column(i).to_pylist() for i in (3, 4, 5, 6, 8, 9, 10, 11, 12)]
            for v, (tree, at, i, label, up, edge, last, positives, scores) in zip(matrix(part.column(7)), zip(*cols)):
                query, bounds = whole(v, p.scale), block.bounds(tree, up, edge)
                if bounds is None:
                    lo, hi = np.empty(len(block.ids)), np.empty(len(block.ids))
                    block.exact(query, None, lo, hi)
                else:
                    lo, hi = bounds
                got += answer(block, i, label, query, positives, scores, lo, hi)
                block.leave(at, up, last, lo, hi)
            cols = list(zip(*got)) or [[]] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if len(c) else np.zeros(0, np.int64), pa.int64()) for c in cols], names=[n for n, _ in out])

    sent = rows.select(*names).unionByName(asked.select(*names)).repartition("block")
    return sent.sortWithinPartitions("block", "dims", "kind", "tree", "at").mapInArrow(run, schema)


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    label: Column,
    p: NegativeParams = NegativeParams(),
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``is_anchor`` is a condition on the id (``vec_id``), ``label`` an expression on the columns of ``vectors``.
    """
    labelled = usable(vectors.filter(label.isNotNull()), id_col, vector_col, label=label.cast("bigint"))
    rows = written(labelled.withColumn("dims", F.size("v")), "vectors")
    n, n_anchors = rows.agg(F.count("*"), F.count_if(is_anchor)).first()
    blocks = max(1, -(-n // p.block_rows))
    table = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(p.seed)), F.lit(blocks)).cast("int"))
    tree = written(trees(rows.filter(is_anchor), n_anchors, p), "trees")

    def best_of_label(block: Block, i, label, query, positives, scores, lo, hi):
        s, ids = block.positives(i, label, query, lo, hi)
        return [(np.full(len(ids), i), ids, s)]

    none = [F.lit(None).cast("array<bigint>").alias(c) for c in ("positives", "scores")]
    near = over_blocks(table, tree.select("*", *none), blocks, p, "anchor_id long, positive_id long, score long", best_of_label)
    near = ranked(near, ["anchor_id"], "score", "positive_id", p.n_positives)
    lists = F.array_sort(F.collect_list(F.struct("rank", "positive_id", "score")))  # n_positives at most
    near = near.groupBy(F.col("anchor_id").alias("of")).agg(lists.alias("best"))
    known = tree.join(near, F.col("of") == F.col("anchor_id"), "left")
    known = written(known.select(*tree.columns, F.col("best.positive_id").alias("positives"), F.col("best.score").alias("scores")), "positives")

    def in_windows(block: Block, i, label, query, positives, scores, lo, hi):
        got = block.negatives(label, query, [window(s, p) for s in scores or []], lo, hi)
        out = []
        for positive, score, (s, ids) in zip(positives or [], scores or [], got):
            m = len(ids)
            out.append((np.full(m, i), np.full(m, positive), ids, np.full(m, score), s))
        return out

    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = over_blocks(table, known, blocks, p, schema, in_windows)
    best = ranked(found, ["anchor_id", "positive_id"], "negative_score", "negative_id", p.n_negatives)
    return best.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
