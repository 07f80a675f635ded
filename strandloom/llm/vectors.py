"""Vectors of whole numbers, for searches whose scores are exact inner products.

A component ``x`` becomes ``floor(scale * x)``.  As long as every partial sum stays below 2**53 the numbers
are held as doubles, whose products and sums are then exact; larger ones are held as Python integers.  Scores
beyond 64 bits count as the nearest 64-bit number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def usable(vectors: DataFrame, id_col: str, vector_col: str, **more: Column) -> DataFrame:
    """``vec_id, v`` (doubles) and ``more`` of the rows that can take part, one for each id.

    Rows without id, without vector or with a null or non-finite component are left out.  Of rows that repeat
    an id the one with the smallest vector counts (then the smallest of ``more``).
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), *[c.alias(n) for n, c in more.items()])
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))
    return rows.groupBy("vec_id").agg(F.min(F.struct("v", *more)).alias("_row")).select("vec_id", "_row.*")


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    n = len(lists)
    flat = np.asarray(lists.flatten(), dtype=np.float64)
    return flat.reshape(n, len(flat) // n if n else 0)


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """``floor(scale * x)`` of every component; Python integers where doubles may not hold the products."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * scale)
    most = float(np.abs(out).max(initial=0.0))
    if most * most * max(1, vectors.shape[-1]) < EXACT:
        return out
    exact = lambda x: scale * int(x) if abs(x) >= EXACT else math.floor(scale * x)  # noqa: E731  such large doubles are whole
    return np.frompyfunc(exact, 1, 1)(vectors)


def products(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Exact inner products of ``rows`` with ``query`` as 64-bit numbers."""
    if rows.dtype != object and query.dtype != object:
        most = float(np.abs(rows).max(initial=0.0)) if rows.size else 0.0
        if most * float(np.abs(query).max(initial=0.0)) * max(1, len(query)) < EXACT:
            return (rows @ query).astype(np.int64)
    q = [int(x) for x in query]
    return np.array([min(MOST, max(LEAST, sum(int(a) * b for a, b in zip(row, q)))) for row in rows], np.int64)


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the ``k`` highest scores are, ties by smaller id."""
    if len(scores) > k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return at[np.lexsort((ids[at], -scores[at].astype(object) if (scores[at] == LEAST).any() else -scores[at]))][:k]
    return np.lexsort((ids, -scores.astype(object) if (scores == LEAST).any() else -scores))


def sections(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Rows that come sorted by their first ``keys`` columns, in slices of one key each; a long run comes in several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(batch.column(i)) for i in range(keys)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = np.append(np.flatnonzero(new), batch.num_rows)
        for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
            yield tuple(int(c[lo]) for c in cols), batch.slice(lo, hi - lo)


def ranked(found: DataFrame, keys: list[str], score: str, vec_id: str, k: int) -> DataFrame:
    """The first ``k`` rows of each key by score descending and id, with their ``rank`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc(score), vec_id)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
