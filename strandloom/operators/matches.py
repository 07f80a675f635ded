"""Matches of calls found in one pass: rows are dealt by cells of the genome and met there.

A row is sent to the cell of its first end, and as a base row to every cell in which one of its ends can be reached.  A
test row is met in the cell of its first end alone, so it comes out of the pass once, with its whole count: nothing is
joined back or summed up afterwards.  Rows that agree in their shape are met once.  Inside a cell candidates come from
sorted positions of the first end within bins of the second, and every pair is decided by the same-call rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from strandloom.operators.islands import codes, known, numbers
from strandloom.params import CompareParams
from strandloom.session import written

#: Windows in a cell, and bases at least; rows of a cell beyond which it is not met in one task; pairs looked at together.
WINDOWS, LEAST, DEEP, PAIRS = 2048, 1 << 20, 1 << 18, 1 << 20

SHAPE = ["ctg", "pos", "ctg2", "pos2", "svtype", "svlen"]


def in_cells(rows: DataFrame, p: CompareParams, mark: str) -> DataFrame:
    """``rows`` with ``_cell``, once per cell they are needed in; ``_test`` stays true in the cell of the first end.

    Rows have ``_test`` and ``_base``: whether they are looked at, and whether they can be a match.  Base rows keep
    their shape and the column ``mark``; the other columns are for test rows.
    """
    size = max(WINDOWS * p.window, LEAST)
    at = lambda c, x: F.xxhash64(c, F.floor(x / F.lit(size)).cast("bigint"))
    c, w = F.col, p.window
    home = at(c("ctg"), c("pos"))
    reach = [at(c(a), c(b) + s) for a, b in (("ctg", "pos"), ("ctg2", "pos2")) for s in (-w, w)]
    cells = F.when(c("_base"), F.array_distinct(F.array(home, *reach))).otherwise(F.array(home))
    kept = ["_base", mark, *SHAPE]
    rest = [x for x in rows.columns if x not in ("_test", *kept)]
    placed = rows.select("*", home.alias("_home"), F.explode(cells).alias("_cell"))
    placed = placed.select("_cell", (c("_test") & (c("_cell") == c("_home"))).alias("_test"), *kept, *rest)
    return placed.select("_cell", "_test", *kept, *[F.when(c("_test"), c(x)).alias(x) for x in rest])


def parted(cells: DataFrame, deep: int = DEEP) -> tuple[DataFrame, DataFrame | None]:
    """The rows of cells for one task each, and those of cells with more than ``deep`` rows, if there are any."""
    many = written(cells.groupBy("_cell").agg(F.count("*").alias("_n")).filter(F.col("_n") > deep).select("_cell"))
    if many.isEmpty():
        return cells, None
    return cells.join(many, "_cell", "left_anti"), cells.join(many, "_cell", "left_semi")


def scan_cells(cells: DataFrame, out: T.StructType, scan: Callable[[pa.Table], Iterator[pa.Table]], most: int = 20_000) -> DataFrame:
    """Runs ``scan`` over tables of whole cells, of at least ``most`` rows where there are as many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            cell = batch.column(batch.schema.get_field_index("_cell")).to_numpy()
            if rows >= most:  # what is held ends with its last cell, of which more may come
                last = held[-1].column(held[-1].schema.get_field_index("_cell"))[-1].as_py()
                new = np.flatnonzero(cell != last)
                if len(new):
                    held.append(batch.slice(0, new[0]))
                    yield from results(held)
                    batch, held, rows = batch.slice(new[0]), [], 0
            held.append(batch)
            rows += batch.num_rows
        if held:
            yield from results(held)

    def results(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in scan(pa.Table.from_batches(held)):
            yield from table.select(out.names).combine_chunks().to_batches(max_chunksize=20_000)

    return cells.repartition("_cell").sortWithinPartitions("_cell").mapInArrow(run, out)


def _mixed(*columns: np.ndarray) -> np.ndarray:
    """A number per row for the values; rows of equal numbers are compared afterwards."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _spread(first: np.ndarray, n: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(i, first[i] + k)`` for every k below ``n[i]``, about ``most`` together."""
    ends = np.cumsum(n)
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        i = np.repeat(np.arange(lo, hi), n[lo:hi])
        before = np.repeat(ends[lo:hi] - n[lo:hi], n[lo:hi])
        k = np.arange(len(i)) + (ends[lo - 1] if lo else 0) - before
        if len(i):
            yield i, first[i] + k
        lo = hi


class CellShapes:
    """The distinct shapes of a table of whole cells, in order, and the pairs of them that are the same call."""

    def __init__(self, t: pa.Table, p: CompareParams):
        self.w, self.ratio, n = p.window, p.min_len_ratio, t.num_rows
        cell = t["_cell"].combine_chunks().to_numpy(zero_copy_only=False)
        both = codes(pa.chunked_array([*t["ctg"].chunks, *t["ctg2"].chunks])).astype(np.int64)
        kinds = t["svtype"].combine_chunks().dictionary_encode()
        words, kind = kinds.dictionary.to_pylist(), kinds.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        values = [both[:n], both[n:], kind] + [numbers(t[c]) for c in ("pos", "pos2", "svlen")] + [known(t[c]) for c in ("pos", "pos2", "svlen")]
        small = ((values[0] + 1) * (both.max(initial=0) + 2) + values[1] + 1) * (len(words) + 1) + kind + 1
        small = small * 8 + values[6] * 4 + values[7] * 2 + values[8]
        keys = (values[5], values[4], small, values[3], cell)
        order = np.lexsort(keys)
        new = np.ones(n, bool)
        new[1:] = False
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        one = order[new]
        #: Number of the shape of each row.
        self.of = np.empty(n, np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.n = len(one)
        self.cell = cell[one]
        self.c1, self.c2, self.kind, self.pos, self.pos2, size, self.at1, self.at2, self.sized = (v[one] for v in values)
        self.size = np.abs(size)
        self.at1, self.at2 = self.at1 & (self.c1 >= 0), self.at2 & (self.c2 >= 0)
        self.bnd, self.ins, self.dup = (self.kind == (words.index(x) if x in words else -2) for x in ("BND", "INS", "DUP"))

    def _candidates(self, tests, test_keys, test_at, bases, base_keys, base_at) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of equal key whose positions are within a window: (index into ``tests``, base shape)."""
        if not len(tests) or not len(bases):
            return
        places, rank = np.unique(base_at, return_inverse=True)
        names, name = np.unique(base_keys, return_inverse=True)
        long = name.astype(np.int64) * (len(places) + 1) + rank
        order = np.argsort(long, kind="stable")
        long = long[order]
        at = np.searchsorted(names, test_keys)
        found = np.flatnonzero(names[np.minimum(at, len(names) - 1)] == test_keys)
        head = at[found].astype(np.int64) * (len(places) + 1)
        lo = np.searchsorted(long, head + np.searchsorted(places, test_at[found] - self.w, "left"), "left")
        hi = np.searchsorted(long, head + np.searchsorted(places, test_at[found] + self.w, "right"), "left")
        for i, j in _spread(lo, hi - lo, PAIRS):
            yield found[i], order[j]

    def _near(self, p1, p2) -> np.ndarray:
        return np.abs(p1 - p2) <= self.w

    def _straight(self, t, b) -> np.ndarray:
        ends = self.at1[t] & self.at2[t] & self.at1[b] & self.at2[b] & (self.c1[t] == self.c1[b]) & (self.c2[t] == self.c2[b])
        return ends & self._near(self.pos[t], self.pos[b]) & self._near(self.pos2[t], self.pos2[b])

    def _alike(self, t, b) -> np.ndarray:
        x, y = self.size[t], self.size[b]
        return self.sized[t] & self.sized[b] & ((np.abs(x - y) <= 1000) | ((x >= y * self.ratio) & (y >= x * self.ratio)))

    def _times(self, t, b) -> np.ndarray:
        """Pairs of end points in the half-open window."""
        sides = [(self.c1, self.pos, self.at1), (self.c2, self.pos2, self.at2)]
        n = np.zeros(len(t), np.int64)
        for ct, pt, at in sides:
            for cb, pb, ab in sides:
                x, y = pt[t], pb[b]
                n += at[t] & ab[b] & (ct[t] == cb[b]) & (y >= np.maximum(x - self.w, 0)) & (y < x + self.w)
        return n

    def pairs(self, tests: np.ndarray, bases: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``(test shape, base shape, times)`` of every pair that is the same call, each pair once."""
        for t, b in self._met(tests, bases):
            n = self._times(t, b)
            some = n > 0
            if some.any():
                yield t[some], b[some], n[some]

    def _met(self, tests, bases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        width = max(4 * self.w, 1)
        whole_t, whole_b = tests[(self.at1 & self.at2)[tests]], bases[(self.at1 & self.at2)[bases]]

        def by_bins(t, b, c1, c2, a1, a2, *more):
            """``t`` against ``b`` with ends ``c1, a1`` and ``c2, a2``; ``more`` are values the keys have besides."""
            first, last = (self.pos2[t] - self.w) // width, (self.pos2[t] + self.w) // width
            twice = np.flatnonzero(first != last)
            rows, bin_t = np.concatenate([np.arange(len(t)), twice]), np.concatenate([first, last[twice]])
            t, bin_b = t[rows], a2[b] // width
            keys_t = _mixed(self.cell[t], self.c1[t], self.c2[t], bin_t, *[np.full(len(t), v) for v, _ in more])
            keys_b = _mixed(self.cell[b], c1[b], c2[b], bin_b, *[v[b] for _, v in more])
            for i, j in self._candidates(t, keys_t, self.pos[t], b, keys_b, a1[b]):
                same = (bin_t[i] == bin_b[j]) & (self.cell[t[i]] == self.cell[b[j]])
                yield t[i[same]], b[j[same]]

        for t, b in by_bins(whole_t, whole_b, self.c1, self.c2, self.pos, self.pos2):
            same = (self.kind[t] == self.kind[b]) & (self.kind[t] >= 0)
            gain = (self.ins[t] & self.dup[b]) | (self.dup[t] & self.ins[b])
            fits = self.bnd[t] | self.bnd[b] | (same & self._alike(t, b))
            ok = fits & ~gain & self._straight(t, b)
            yield t[ok], b[ok]

        # Crossed ends: a breakend on either side.
        for bnd in (True, False):
            t = whole_t if bnd else whole_t[self.bnd[whole_t]]
            b = whole_b[self.bnd[whole_b] == bnd]
            for x, y in by_bins(t, b, self.c2, self.c1, self.pos2, self.pos):
                ok = (self.c1[x] == self.c2[y]) & (self.c2[x] == self.c1[y]) & ~self._straight(x, y)
                ok &= self._near(self.pos[x], self.pos2[y]) & self._near(self.pos2[x], self.pos[y])
                yield x[ok], y[ok]

        # An insertion against a duplication: the first ends only.
        for mine, other in ((self.ins, self.dup), (self.dup, self.ins)):
            t, b = tests[(mine & self.at1)[tests]], bases[(other & self.at1)[bases]]
            keys = [_mixed(self.cell[x], self.c1[x]) for x in (t, b)]
            for i, j in self._candidates(t, keys[0], self.pos[t], b, keys[1], self.pos[b]):
                x, y = t[i], b[j]
                ok = (self.cell[x] == self.cell[y]) & (self.c1[x] == self.c1[y]) & self._near(self.pos[x], self.pos[y]) & self._alike(x, y)
                yield x[ok], y[ok]


def counting(p: CompareParams) -> Callable[[pa.Table], Iterator[pa.Table]]:
    """Test rows with ``n_match``: the matching base rows of the other ``_side``, each as often as its ends meet."""

    def scan(t: pa.Table) -> Iterator[pa.Table]:
        test, base, side = (numbers(t[c]) for c in ("_test", "_base", "_side"))
        if not test.any():
            return
        s = CellShapes(t, p)
        weight = [np.bincount(s.of[base & (side == k)], minlength=s.n) for k in (0, 1)]
        looked = [np.bincount(s.of[test & (side == k)], minlength=s.n) > 0 for k in (0, 1)]
        counts = [np.zeros(s.n, np.int64), np.zeros(s.n, np.int64)]
        tests, bases = np.flatnonzero(looked[0] | looked[1]), np.flatnonzero(weight[0] + weight[1])
        if not looked[0].any() or not looked[1].any():  # one side asks: only the other can answer
            bases = np.flatnonzero(weight[1 if looked[0].any() else 0])
        for a, b, times in s.pairs(tests, bases):
            for k in (0, 1):
                counts[k] += np.bincount(a, times * weight[1 - k][b], s.n).astype(np.int64)
        rows = np.flatnonzero(test)
        yield t.take(pa.array(rows)).append_column("n_match", pa.array(np.where(side[rows] == 0, counts[0][s.of[rows]], counts[1][s.of[rows]])))

    return scan


def by_file(p: CompareParams) -> Callable[[pa.Table], Iterator[pa.Table]]:
    """``file_i, file_id, matched``: test rows of a file with a match among the base rows of another, or of the same."""

    def scan(t: pa.Table) -> Iterator[pa.Table]:
        test, base = (numbers(t[c]) for c in ("_test", "_base"))
        if not test.any():
            return
        s = CellShapes(t, p)
        files, file = np.unique(numbers(t["file_id"]).astype(np.int64), return_inverse=True)
        own, n_own = np.unique(s.of[test] * len(files) + file[test], return_counts=True)
        held = np.unique(s.of[base] * len(files) + file[base])
        edge = lambda keys: np.searchsorted(keys, np.arange(s.n + 1) * len(files))
        own_at, held_at = edge(own), edge(held)
        met = np.empty(0, np.int64)
        for a, b, _ in s.pairs(np.flatnonzero(np.diff(own_at)), np.flatnonzero(np.diff(held_at))):
            for i, j in _spread(held_at[b], np.diff(held_at)[b], PAIRS):
                met = np.union1d(met, a[i] * len(files) + held[j] % len(files))
        shape, file_i = met // len(files), met % len(files)
        cells = np.empty(0, np.int64)
        sums = np.empty(0, np.int64)
        for i, j in _spread(own_at[shape], np.diff(own_at)[shape], PAIRS):
            cells, at = np.unique(np.concatenate([cells, file_i[i] * len(files) + own[j] % len(files)]), return_inverse=True)
            sums = np.bincount(at, np.concatenate([sums, n_own[j]]), len(cells)).astype(np.int64)
        yield pa.table({"file_i": files[cells // len(files)], "file_id": files[cells % len(files)], "matched": sums})

    return scan
