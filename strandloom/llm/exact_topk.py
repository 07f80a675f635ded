"""Exact search for the largest inner products by pivot-table elimination.

One more component makes all rows equally long (the missing length up to the longest row; a query gets 0), so
the largest inner product is the smallest distance and the triangle inequality holds: the distances of query
and row to one pivot differ by no more than their own distance.  The table holds every row's distances to many
pivots; the largest difference over all pivots is a lower bound on a query's distance to the row.

* Pivots are picked far from each other out of a bounded sample (``sample_rows``); any pivots give right results.
* Rows are ranged by nearest pivot and distance to it into blocks of about ``block_rows``, so a block also has
  bounds: the smallest and largest distance to each pivot.
* A query is answered in its own block first.  With its k-th score from there it goes only to blocks whose
  bound allows something as near.  In a block rows are evaluated in the order of their bounds, exactly, until
  the next bound exceeds the k-th distance.  Equal bounds go on, so ties are decided by id.

A row is shuffled to its block and is never copied; a query is copied to the blocks it must visit.  On vectors
without any structure bounds tell little and all rows are evaluated: results are exact all the same.

Defined cases: vectors that are null or hold a null or non-finite component take no part; null ids neither; of
rows that repeat an id the smallest vector counts; vectors of different lengths are not compared; empty vectors
score 0 with each other; a row is no candidate of its own; ties go to the smaller id; with fewer than ``k``
candidates all are returned; scores beyond 64 bits count as the nearest 64-bit number; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.scratch import written
from strandloom.llm.vectors import best_rows, matrix, products, ranked, sections, usable, whole


@dataclass(frozen=True)
class TopkParams:
    k: int = 10
    scale: int = 1024
    n_pivots: int = 32
    sample_rows: int = 4096
    block_rows: int = 16_384
    query_rows: int = 4096
    blocks_per_group: int = 1024
    first_chunk: int = 256
    seed: int = 12


@dataclass(frozen=True)
class Pivots:
    """Pivots, the length that completes each, and the square of the longest row."""

    rows: np.ndarray
    rest: np.ndarray
    longest2: float

    def _dot(self, x: np.ndarray) -> np.ndarray:
        d = min(x.shape[1], self.rows.shape[1])
        return x[:, :d] @ self.rows[:, :d].T

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of completed rows to every pivot."""
        with np.errstate(over="ignore", invalid="ignore"):
            rest = np.sqrt(np.maximum(self.longest2 - (x * x).sum(axis=1), 0.0))
            return np.sqrt(np.maximum(2 * self.longest2 - 2 * self._dot(x) - 2 * rest[:, None] * self.rest, 0.0))

    def of_queries(self, x: np.ndarray) -> np.ndarray:
        """Distances of queries, whose added component is 0, to every pivot."""
        with np.errstate(over="ignore", invalid="ignore"):
            return np.sqrt(np.maximum(((x * x).sum(axis=1) + self.longest2)[:, None] - 2 * self._dot(x), 0.0))

    def reach(self, x: np.ndarray, score: np.ndarray) -> np.ndarray:
        """The distance that a score stands for, and what rounding may add; not finite: anything may be near."""
        with np.errstate(over="ignore", invalid="ignore"):
            length2 = (x * x).sum(axis=1)
            far = np.sqrt(np.maximum(length2 + self.longest2 - 2 * score, 0.0))
            return far + (1e-6 + 4 * np.sqrt((x.shape[1] + 8) * np.finfo(float).eps)) * (np.sqrt(length2) + np.sqrt(self.longest2))


def farthest_first(sample: list[np.ndarray], n: int, longest2: float, seed: int) -> Pivots:
    """Up to ``n`` rows of the sample, each the one farthest from those before; shorter ones are filled with zeros."""
    dims = max((len(x) for x in sample), default=0)
    x = np.zeros((max(1, len(sample)), dims))
    for row, v in zip(x, sample):
        row[: len(v)] = v
    with np.errstate(over="ignore", invalid="ignore"):
        rest = np.sqrt(np.maximum(longest2 - (x * x).sum(axis=1), 0.0))
        at, nearest = [int(np.random.default_rng(seed).integers(len(x)))], np.full(len(x), np.inf)
        while len(at) < n:
            d2 = np.nan_to_num(2 * longest2 - 2 * x @ x[at[-1]] - 2 * rest * rest[at[-1]], nan=0.0)
            nearest = np.minimum(nearest, d2)
            if nearest.max() <= 1e-9 * longest2:
                break
            at.append(int(nearest.argmax()))
    return Pivots(x[at], rest[at], longest2)


def _floored(lists: pa.Array, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.floor(matrix(lists) * scale)


def _by_dims(batch: pa.RecordBatch, vector: int) -> Iterator[tuple[np.ndarray, pa.RecordBatch]]:
    dims = np.asarray(batch.column(vector).value_lengths())
    for d in np.unique(dims):
        at = np.flatnonzero(dims == d)
        yield at, batch.take(pa.array(at))


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), kind))


def pick_pivots(rows: DataFrame, p: TopkParams) -> tuple[Pivots, int]:
    """Pivots for ``rows`` and their number; no more than ``sample_rows`` vectors reach the driver."""

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most, n = 0.0, 0
        for batch in batches:
            n += batch.num_rows
            for _, part in _by_dims(batch, 0):
                x = _floored(part.column(0), p.scale)
                with np.errstate(over="ignore"):
                    most = max(most, float((x * x).sum(axis=1).max()))
        yield pa.RecordBatch.from_arrays([pa.array([most]), pa.array([n], pa.int64())], names=["most", "n"])

    longest2, n = rows.select("v").mapInArrow(lengths, "most double, n long").agg(F.coalesce(F.max("most"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    picked = rows.orderBy(F.xxhash64("vec_id", F.lit(p.seed)), "vec_id").limit(p.sample_rows).select("v").toArrow().column(0)
    with np.errstate(over="ignore"):
        sample = [np.floor(np.asarray(v.as_py(), dtype=float) * p.scale) for v in picked]
    return farthest_first(sample, p.n_pivots, longest2, p.seed), n


def pivot_table(rows: DataFrame, pivots: Pivots, n: int, p: TopkParams) -> DataFrame:
    """``block, dims, vec_id, v, asked, dist``: every row with its distances to the pivots, ranged into blocks."""
    more = [f for f in rows.schema.fields if f.name not in ("vec_id", "v")]

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, part in _by_dims(batch, 1):
                d = pivots.of_rows(_floored(part.column(1), p.scale))
                near = np.nan_to_num(d, nan=0.0).argmin(axis=1)
                dist = d[np.arange(len(d)), near]
                own = [pa.array(near.astype(np.int32)), pa.array(np.nan_to_num(dist, nan=0.0, posinf=0.0)), _lists(d.astype(np.float32), pa.float32())]
                yield pa.RecordBatch.from_arrays([*part.columns, *own], names=[*part.schema.names, "near", "far", "dist"])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in more)
    schema = f"vec_id long, v array<double>, {kept + ', ' if kept else ''}near int, far double, dist array<float>"
    ranged = rows.mapInArrow(measured, schema).repartitionByRange(max(1, -(-n // p.block_rows)), "near", "far", "vec_id")
    return ranged.select(F.spark_partition_id().alias("block"), F.size("v").alias("dims"), "vec_id", "v", *[f.name for f in more], "dist")


class PivotBlock:
    """Rows of one length with their distances to the pivots."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, dist: np.ndarray, pivots: Pivots, p: TopkParams):
        self.ids, self.rows, self.dist, self.pivots, self.p = ids, whole(vectors, p.scale), dist, pivots, p
        self.evaluated = 0

    def search(self, query_id: int, query: np.ndarray, to_pivots: np.ndarray, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the block's ``k`` best rows that are not below ``least``."""
        p = self.p
        with np.errstate(invalid="ignore"):
            apart = np.abs(self.dist - to_pivots)
        bound = np.where(np.isfinite(apart), apart, 0.0).max(axis=1, initial=0.0)
        order = np.argsort(bound, kind="stable")
        exact, floats = whole(query, p.scale), np.floor(query * p.scale)[None, :]
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo, size = 0, p.first_chunk
        while lo < len(order):
            kth = int(scores[-1]) if len(scores) >= p.k else None
            kth = least if kth is None else kth if least is None else max(kth, least)
            if kth is not None and bound[order[lo]] > self.pivots.reach(floats, np.array([float(kth)]))[0]:
                break
            at = order[lo : lo + size]
            lo, size = lo + size, size * 2
            self.evaluated += len(at)
            new, own = products(self.rows[at], exact), self.ids[at]
            good = own != query_id
            if kth is not None:
                good &= new >= kth
            scores, ids = np.concatenate((scores, new[good])), np.concatenate((ids, own[good]))
            best = best_rows(scores, ids, p.k)
            scores, ids = scores[best], ids[best]
        return scores, ids


def search(
    vectors: DataFrame, is_query: Column, p: TopkParams = TopkParams(), id_col: str = "vec_id", vector_col: str = "embedding"
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of every row that ``is_query`` picks.

    ``is_query`` is a condition on the id column (``vec_id``).
    """
    rows = written(usable(vectors, id_col, vector_col).withColumn("asked", F.coalesce(is_query, F.lit(False))), "vectors")
    pivots, n = pick_pivots(rows, p)
    table = written(pivot_table(rows, pivots, n, p), "pivot_table")

    def block_of(parts: list[pa.RecordBatch], ids: int, v: int, dist: int) -> PivotBlock:
        t = pa.Table.from_batches(parts).combine_chunks()
        one = lambda i: t.column(i).chunk(0)
        return PivotBlock(np.asarray(one(ids)), matrix(one(v)), matrix(one(dist)), pivots, p)

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answered(block: int, dims: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = block_of(parts, 2, 3, 5)
            asked = pa.Table.from_batches(parts).combine_chunks().column(4).to_numpy(zero_copy_only=False).astype(bool)
            all_v = matrix(pa.Table.from_batches(parts).combine_chunks().column(3).chunk(0))
            with np.errstate(over="ignore"):
                x = np.floor(all_v[asked] * p.scale)
            far = pivots.of_queries(x)
            got = [own.search(int(i), v, d, None) for i, v, d in zip(own.ids[asked], all_v[asked], far)]
            kth = [int(s[-1]) if len(s) >= p.k else None for s, _ in got]
            reach = [float(pivots.reach(x[i : i + 1], np.array([float(s)]))[0]) if s is not None else float("inf") for i, s in enumerate(kth)]
            m = len(got)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(m, block), pa.int32()),
                    pa.array(np.full(m, dims), pa.int32()),
                    pa.array(own.ids[asked]),
                    _lists(all_v[asked], pa.float64()),
                    _lists(far, pa.float64()),
                    pa.array(kth, pa.int64()),
                    pa.array(reach, pa.float64()),
                    pa.array([i.tolist() for _, i in got], pa.list_(pa.int64())),
                    pa.array([s.tolist() for s, _ in got], pa.list_(pa.int64())),
                    pa.nulls(m, pa.list_(pa.float32())),
                    pa.nulls(m, pa.list_(pa.float32())),
                ],
                schema=schema,
            )
            none = [pa.nulls(1, t) for t in schema.types[2:9]]
            ends = [_lists(f(own.dist, axis=0)[None, :].astype(np.float32), pa.float32()) for f in (np.min, np.max)]
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([dims], pa.int32()), *none, *ends], schema=schema)

        key, parts = None, []
        for now, part in sections(batches, 2):
            if now != key and parts:
                yield from answered(*key, parts)
                parts = []
            key = now
            parts.append(part)
        if parts:
            yield from answered(*key, parts)

    long, double, single = pa.int64(), pa.float64(), pa.list_(pa.float32())
    kinds = [pa.int32(), pa.int32(), long, pa.list_(double), pa.list_(double), long, double, pa.list_(long), pa.list_(long), single, single]
    names = ["block", "dims", "query_id", "v", "far", "kth", "reach", "ids", "scores", "lo", "hi"]
    schema = pa.schema(list(zip(names, kinds)))
    home = table.repartition("block").sortWithinPartitions("block", "dims").mapInArrow(
        at_home,
        "block int, dims int, query_id long, v array<double>, far array<double>, kth long, reach double, ids array<long>, scores array<long>, lo array<float>, hi array<float>",
    )
    home = written(home, "home")
    queries, ends = home.filter("query_id is not null"), home.filter("query_id is null")
    n_queries = queries.count()

    # Which blocks a query must visit: bounded groups of blocks meet bounded shares of the queries.
    groups, shares = -(-max(1, -(-n // p.block_rows)) // p.blocks_per_group), max(1, -(-n_queries // p.query_rows))
    up_to = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    # The number of blocks is that of the table; more blocks than planned fall to the last group.
    group = F.least(F.floor(F.col("block") / p.blocks_per_group).cast("int"), F.lit(groups - 1))
    share = F.pmod(F.xxhash64("query_id", F.lit(p.seed)), F.lit(shares)).cast("int")
    cols = ["block", "dims", "query_id", "v", "far", "kth", "reach", "lo", "hi"]
    meet = ends.select(group.alias("g"), up_to(shares).alias("q"), F.lit(0).alias("kind"), *cols)
    meet = meet.unionByName(queries.select(up_to(groups).alias("g"), share.alias("q"), F.lit(1).alias("kind"), *cols))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for (g, q, kind), part in sections(batches, 3):
            if held.get("key") != (g, q):
                held = {"key": (g, q), "parts": []}
            if kind == 0:
                held["parts"].append(part)
                continue
            for at, asked in _by_dims(part, 6):
                own = [x.filter(pa.array(np.asarray(x.column(4)) == len(asked.column(6)[0]))) for x in held["parts"]]
                own = [x for x in own if x.num_rows]
                if not own:
                    continue
                t = pa.Table.from_batches(own).combine_chunks()
                blocks = np.asarray(t.column(3).chunk(0))
                lo, hi = (matrix(t.column(i).chunk(0)) for i in (10, 11))
                far, reach, mine = matrix(asked.column(7)), np.asarray(asked.column(9)), np.asarray(asked.column(3))
                for i in range(asked.num_rows):
                    with np.errstate(invalid="ignore"):
                        apart = np.maximum(far[i] - hi, lo - far[i])
                    bound = np.where(np.isfinite(apart), apart, 0.0).max(axis=1, initial=0.0)
                    to = blocks[~(bound > reach[i]) & (blocks != mine[i])]
                    if len(to):
                        many = asked.take(pa.array(np.full(len(to), i)))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(to.astype(np.int32)), *[many.column(c) for c in (4, 5, 6, 7, 8)]], names=["block", "dims", "id", "v", "far", "kth"]
                        )

    dealt = meet.repartition("g", "q").sortWithinPartitions("g", "q", "kind")
    visits = dealt.mapInArrow(routed, "block int, dims int, id long, v array<double>, far array<double>, kth long")
    data = table.select("block", "dims", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "v", F.col("dist").cast("array<double>").alias("far"), F.lit(None).cast("bigint").alias("kth"))
    visits = data.unionByName(visits.select("block", "dims", F.lit(1).alias("kind"), "id", "v", "far", "kth"))

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, block = None, [], None
        for (b, dims, kind), part in sections(batches, 3):
            if (b, dims) != key:
                key, parts, block = (b, dims), [], None
            if kind == 0:
                parts.append(part)
                continue
            if block is None:
                block = block_of(parts, 3, 4, 5)
                parts = []
            out = []
            for i, v, far, kth in zip(part.column(3).to_pylist(), matrix(part.column(4)), matrix(part.column(5)), part.column(6).to_pylist()):
                scores, ids = block.search(i, v, far, kth)
                out.append((np.full(len(ids), i), ids, scores))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["query_id", "vec_id", "score"])

    sent = visits.repartition("block").sortWithinPartitions("block", "dims", "kind")
    found = sent.mapInArrow(away, "query_id long, vec_id long, score long")
    near = queries.select("query_id", F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    return ranked(near.unionByName(found), ["query_id"], "score", "vec_id", p.k).select("query_id", "rank", "vec_id", "score")
