"""Approximate nearest neighbours by counting collisions in query-centred windows.

Vectors are scaled to length 1, so the largest cosine is the smallest distance.  Rows are dealt to blocks of
bounded size, and every block is indexed: each of ``n_projections`` random directions has its own array of
the block's projected values, sorted.  A query puts a window around its own projected value in each array and
widens all windows by ``growth`` per round (virtual rehashing: a wider window is a coarser bucket, no second
index is built).  A vector that lies in ``threshold`` of the windows is verified on the original vectors.  A
block is done when its k best are nearer than the windows vouch for, or when as many coarse cells of directions as
``verify_share`` of its rows, and some more, are verified: copies and near copies of a vector count once.

Queries are a stated set, dealt to blocks too; each pair of blocks is one group of bounded size, so neither
side is ever held whole.  All rows take part, none is capped.  Rows of one direction are one entry of the index, so
copies of a vector do not use up what may be verified; of equal vectors a block needs the k + 1 smallest ids only.

Defined cases: vectors that are null, all zero, or hold a null or non-finite component take no part, as query
or candidate; vectors of different lengths are not compared; a query's own id is no candidate; ties go to the
smaller id; null ids take no part; with fewer than k candidates all are returned.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm.scratch import written


@dataclass(frozen=True)
class AnnParams:
    k: int = 5
    n_projections: int = 64
    threshold: int = 44
    width: float = 0.7
    growth: float = 1.2
    verify_share: float = 0.15
    verify_least: int = 100
    cell_axes: int = 6
    cell_width: float = 0.2
    vouch: float = 0.6
    block_rows: int = 16_384
    query_rows: int = 1024
    seed: int = 5


def smallest_of_equal(ids: np.ndarray, vectors: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows without those that repeat a vector and have ``most`` smaller ids beside them: none can be among the best."""
    vectors = np.ascontiguousarray(vectors) + 0.0
    same = np.unique(vectors.view(np.dtype((np.void, vectors.strides[0]))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    i, g = ids[order], same[order]
    new = np.ones(len(i), bool)
    new[1:] = (i[1:] != i[:-1]) | (g[1:] != g[:-1])
    order, g = order[new], g[new]
    rank = np.arange(len(g)) - np.searchsorted(g, g)
    kept = np.sort(order[rank < most])
    return ids[kept], vectors[kept]


class BlockIndex:
    """Sorted projections of a block of vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, p: AnnParams):
        self.n_rows = len(ids)
        ids, vectors = smallest_of_equal(ids, vectors, p.k + 1)
        norms = np.sqrt((vectors * vectors).sum(axis=1))
        # Vectors of one direction are one entry; its rows lie side by side.
        unit, entry = np.unique(np.round(vectors / norms[:, None], 12) + 0.0, axis=0, return_inverse=True)
        by_entry = np.argsort(entry.ravel(), kind="stable")
        self.p, self.ids, self.vectors, self.norms = p, ids[by_entry], vectors[by_entry], norms[by_entry]
        self.sizes = np.bincount(entry.ravel(), minlength=len(unit))
        # Near copies share a coarse cell of a few projections, and count once towards what may be verified.
        coarse = np.floor(unit @ np.random.default_rng(p.seed + 1).standard_normal((vectors.shape[1], p.cell_axes)) / p.cell_width)
        self.cell = np.unique(coarse, axis=0, return_inverse=True)[1].ravel()
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.axes = np.random.default_rng(p.seed).standard_normal((vectors.shape[1], p.n_projections))
        at = unit @ self.axes
        self.order = np.ascontiguousarray(np.argsort(at, axis=0, kind="stable").T)
        self.values = np.take_along_axis(at.T, self.order, axis=1)

    def nearest(self, query_id: int, query: np.ndarray) -> list[tuple[float, int]]:
        """Best ``k`` of the block as ``(cosine, id)``; how far it looks depends on the rows alone."""
        p, n = self.p, len(self.sizes)
        norm = float(np.sqrt((query * query).sum()))
        center = (query / norm) @ self.axes
        lo = hi = np.array([np.searchsorted(v, c) for v, c in zip(self.values, center)])
        counts, done, cells = np.zeros(n, np.int32), np.zeros(n, bool), np.zeros(int(self.cell.max(initial=-1)) + 1, bool)
        scores, found = np.zeros(0), np.zeros(0, np.int64)
        enough, reach = p.verify_least + int(p.verify_share * self.n_rows), p.width
        while True:
            new_lo = np.array([np.searchsorted(v, c - reach, "left") for v, c in zip(self.values, center)])
            new_hi = np.array([np.searchsorted(v, c + reach, "right") for v, c in zip(self.values, center)])
            parts = [self.order[j, a:b] for j in range(p.n_projections) for a, b in ((new_lo[j], lo[j]), (hi[j], new_hi[j]))]
            counts += np.bincount(np.concatenate(parts), minlength=n).astype(np.int32)
            lo, hi = new_lo, new_hi
            fresh = np.flatnonzero((counts >= p.threshold) & ~done)
            if len(fresh):
                done[fresh] = cells[self.cell[fresh]] = True
                sizes = self.sizes[fresh]
                rows = np.repeat(self.starts[fresh] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
                rows = rows[self.ids[rows] != query_id]
                scores = np.concatenate((scores, (self.vectors[rows] * query).sum(axis=1) / (self.norms[rows] * norm)))
                found = np.concatenate((found, self.ids[rows]))
            if cells.sum() >= enough and len(found) >= p.k or done.all():
                break
            if len(found) >= p.k:
                kth = np.sqrt(max(0.0, 2.0 - 2.0 * np.partition(scores, -p.k)[-p.k]))
                if kth <= p.vouch * reach:
                    break
            reach *= p.growth
        best = np.lexsort((found, -scores))[: p.k]
        return list(zip(scores[best].tolist(), found[best].tolist()))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that can take part."""
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    some = F.exists("v", lambda x: x != 0.0)
    return rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False)))


def search(vectors: DataFrame, is_query: Column, p: AnnParams = AnnParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the nearest found of every row that ``is_query`` (on ``vec_id``) picks."""
    rows = written(usable(vectors, id_col, vector_col), "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks, query_blocks = max(1, -(-n // p.block_rows)), max(1, -(-n_queries // p.query_rows))
    dealt = lambda seed, parts: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(parts))
    every = lambda parts: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint")))
    size = F.size("v").alias("dims")
    data = rows.select("vec_id", "v", size, dealt(1, blocks).alias("b"), every(query_blocks).alias("q"))
    asked = rows.filter(is_query).select("vec_id", "v", size, every(blocks).alias("b"), dealt(2, query_blocks).alias("q"))

    def near(block: pa.Table, queries: pa.Table) -> pa.Table:
        kinds = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        if not block.num_rows or not queries.num_rows:
            return kinds.empty_table()

        def both(t: pa.Table):
            lists = t.column("v").combine_chunks()
            return t.column("vec_id").to_numpy(), np.asarray(lists.flatten()).reshape(t.num_rows, -1)

        index, out = BlockIndex(*both(block), p), []
        for q, v in zip(*both(queries)):
            out += [(int(q), i, s) for s, i in index.nearest(int(q), v)]
        cols = list(zip(*out)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds.types)], schema=kinds)

    keys = ["b", "q", "dims"]
    got = data.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(near, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return got.distinct().withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
