"""Gap islands and the ordered scan over them.

Greedy clustering never joins rows that are more than one window apart, so rows split at larger gaps
can be clustered independently and exactly.  Islands are found on a table of occupied position bins,
which is bounded by contig length over window and not by the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

import strandloom
from strandloom.session import written

# Scans travel with the plan, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(strandloom)


def with_island(df: DataFrame, keys: list[str], pos: str, window: int, end: str | None = None) -> DataFrame:
    """Adds ``island``: the first position of a run of rows with gaps of at most ``window``.

    With ``end``, a gap is measured from the largest end so far (rows are intervals).  Rows of one
    bin start within a window of each other, so a bin is never cut.
    """
    size = max(window, 1)
    at = F.floor(F.col(pos) / F.lit(size)).cast("bigint")
    bins = df.groupBy(*keys, at.alias("_bin")).agg(
        F.min(pos).alias("_lo"), F.max(end or pos).alias("_hi")
    )
    w = Window.partitionBy(*keys).orderBy("_bin")
    reach = F.max("_hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    bins = bins.withColumn(
        "_start", F.when(F.coalesce(F.col("_lo") - reach > window, F.lit(True)), F.col("_lo"))
    )
    bins = bins.withColumn(
        "island", F.last("_start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    ).select(*[F.col(k).alias("_k_" + k) for k in keys], "_bin", "island")
    cond = at == F.col("_bin")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("_k_" + k))
    return df.join(bins, cond).drop("_bin", *["_k_" + k for k in keys])


class Emitter:
    """Collects (row, extra values) results and turns them back into Arrow batches.

    Rows are referred to by (batch, index); a batch stays alive only while rows of it are pending.
    """

    def __init__(self, extra: list[tuple[str, pa.DataType]], flush_rows: int = 20_000):
        self.extra, self.flush_rows = extra, flush_rows
        self.batches: list[pa.RecordBatch] = []
        self.rows: list[tuple] = []

    def add(self, batch: pa.RecordBatch, i: int, *values) -> None:
        self.rows.append((batch, i, values))

    def drain(self, force: bool = False) -> Iterator[pa.RecordBatch]:
        if not self.rows or (len(self.rows) < self.flush_rows and not force):
            return
        by_batch: dict[int, list] = {}
        for r in self.rows:
            by_batch.setdefault(id(r[0]), []).append(r)
        self.rows = []
        for group in by_batch.values():
            picked = group[0][0].take(pa.array([g[1] for g in group], pa.int32()))
            cols, names = list(picked.columns), list(picked.schema.names)
            for j, (name, t) in enumerate(self.extra):
                cols.append(pa.array([g[2][j] for g in group], t))
                names.append(name)
            yield pa.RecordBatch.from_arrays(cols, names=names)


def scan_islands(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    needed: list[str],
    extra: list[tuple[str, T.DataType]],
    new_scan: Callable[[Callable], object],
) -> DataFrame:
    """Streams each island in order through a scan object and appends the columns it decides.

    Rows are spread by (keys, island) and sorted by Spark, which spills; the scan keeps only its open
    clusters.  ``new_scan(emit)`` is called per island and must offer ``row(batch, i, values)`` and
    ``close()``; it calls ``emit(batch, i, *extra)`` once a row's columns are settled.
    """
    group = [*keys, "island"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string()}
    extra_arrow = [(n, arrow[t.simpleString()]) for n, t in extra]
    out = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in extra]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink = Emitter(extra_arrow)
        scan, current = None, None
        for batch in batches:
            ids = list(zip(*[batch.column(batch.schema.get_field_index(g)).to_pylist() for g in group]))
            vals = zip(*[batch.column(batch.schema.get_field_index(c)).to_pylist() for c in needed])
            for i, (key, v) in enumerate(zip(ids, vals)):
                if key != current:
                    if scan is not None:
                        scan.close()
                    scan, current = new_scan(sink.add), key
                scan.row(batch, i, v)
            yield from sink.drain()
        if scan is not None:
            scan.close()
        yield from sink.drain(force=True)

    spread = df.repartition(*group).sortWithinPartitions(*group, *order)
    return spread.mapInArrow(run, out)


#: Cells a table is cut into, about; rows of linked cells beyond which their islands are spread on their own.
CELLS, DEEP = 1 << 16, 1 << 20


def with_segment(rows: DataFrame, keys: list[str], pos: str, window: int, deep: int = DEEP) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with ``segment``, which holds whole islands, and the rows of chains of cells with more than ``deep`` rows.

    ``rows`` are read several times, so they should be a table.  Positions are cut into about ``CELLS`` cells; a
    segment begins at the first gap of a cell and ends at that of a later one, so it is as long as a cell unless
    an island is longer.  The table of cells is small, so rows find their segment without being shuffled.  Cells that
    islands link form a chain; a chain that is too much for one task comes back without ``segment``.
    """
    size = max(window, 1)
    at = F.floor(F.col(pos) / F.lit(size)).cast("bigint")
    spans = rows.filter(F.col(pos).isNotNull()).groupBy(*keys).agg((F.max(at) - F.min(at) + 1).alias("n"))
    wide = max(16, (spans.agg(F.sum("n")).first()[0] or 0) // CELLS + 1)
    cell = F.floor(at / F.lit(wide)).cast("bigint")
    bins = rows.filter(F.col(pos).isNotNull()).groupBy(*keys, cell.alias("_cell"), at.alias("_bin"))
    bins = bins.agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"), F.count("*").alias("_n"))
    gap = F.col("_lo") - F.lag("_hi").over(Window.partitionBy(*keys, "_cell").orderBy("_bin")) > window
    cells = bins.withColumn("_gap", F.when(gap, F.col("_lo"))).groupBy(*keys, "_cell")
    cells = cells.agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"), F.min("_gap").alias("_gap"), F.sum("_n").alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_cell")
    free = F.coalesce(F.col("_lo") - F.lag("_hi").over(w) > window, F.lit(True))
    cells = cells.withColumn("_free", free).withColumn("_cut", F.when(F.col("_free"), F.col("_lo")).otherwise(F.col("_gap")))
    begun = F.last(F.when(F.col("_cut").isNotNull(), F.col("_cell")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    chain = F.last(F.when(F.col("_free"), F.col("_cell")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumns({"_head": begun, "_chain": chain})
    cells = cells.withColumn("_deep", F.sum("_n").over(Window.partitionBy(*keys, "_chain")) > deep)
    cells = written(cells.select(*[F.col(k).alias("_k_" + k) for k in keys], "_cell", "_cut", "_head", "_deep"))
    cond = cell == F.col("_cell")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col("_k_" + k))
    # There are about as many cells as said, unless there are still more keys: wide rows need not move to meet them.
    met = rows.join(F.broadcast(cells) if cells.count() <= 4 * CELLS else cells, cond)
    own = F.coalesce(F.col(pos) >= F.col("_cut"), F.lit(False))
    light = met.filter("not _deep").withColumn("segment", F.when(own, F.col("_cell")).otherwise(F.col("_head")))
    is_deep = not cells.filter("_deep").isEmpty()
    return light.select(*rows.columns, "segment"), met.filter("_deep").select(*rows.columns) if is_deep else None


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Numbers that are equal where the values are; -1 for null."""
    return column.combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def numbers(column: pa.ChunkedArray) -> np.ndarray:
    """The values, 0 or false for null."""
    return column.combine_chunks().fill_null(False if pa.types.is_boolean(column.type) else 0).to_numpy(zero_copy_only=False)


def known(column: pa.ChunkedArray) -> np.ndarray:
    return ~column.combine_chunks().is_null().to_numpy(zero_copy_only=False)


def gathered(picks: list[tuple[pa.Table, int]]) -> pa.Table:
    """The rows (table, index) in the order given."""
    by: dict[int, tuple[pa.Table, list[int], list[int]]] = {}
    for at, (table, i) in enumerate(picks):
        _, rows, places = by.setdefault(id(table), (table, [], []))
        rows.append(i)
        places.append(at)
    back = np.empty(len(picks), np.int64)
    back[np.concatenate([np.array(x[2]) for x in by.values()])] = np.arange(len(picks))
    return pa.concat_tables([t.take(pa.array(rows)) for t, rows, _ in by.values()]).take(pa.array(back))


def scan_segments(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    pos: str,
    window: int,
    out: T.StructType,
    new_scan: Callable[[], object],
    most: int = 100_000,
    each: tuple[str, Column] | None = None,
) -> DataFrame:
    """Streams rows with ``segment`` in order and cuts them into islands as they come.

    ``each`` (name, generator) copies a row once it has moved; the copies of each name have islands of their own.
    The scan gets tables of whole islands: ``whole(table, starts)``, with the indices where islands start.  An island of
    more than ``most`` rows comes piece by piece: ``part(table, last)``.  Both yield tables with the columns of ``out``.
    """
    group = [*keys, "segment"] if each is None else [*keys, "segment", each[0]]
    names = [f.name for f in out.fields]

    def starts_of(t: pa.Table) -> np.ndarray:
        new = np.ones(t.num_rows, bool)
        at = numbers(t[pos])
        new[1:] = at[1:] - at[:-1] > window
        for g in group:
            c = codes(t[g])
            new[1:] |= c[1:] != c[:-1]
        return np.flatnonzero(new)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        scan, held, passed = new_scan(), None, 0  # held: the island not yet ended; of a very long one the last row, which was passed on
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t]).combine_chunks()
            if t.num_rows == 0:
                continue
            starts = starts_of(t)
            if passed and len(starts) > 1:
                yield from scan.part(t.slice(passed, starts[1] - passed), True)
                t, starts, passed = t.slice(starts[1]), starts[1:] - starts[1], 0
            if not passed and len(starts) > 1:
                yield from scan.whole(t.slice(0, starts[-1]), starts[:-1])
            held = t.slice(starts[-1])
            if passed or held.num_rows > most:
                yield from scan.part(held.slice(passed), False)
                held, passed = held.slice(held.num_rows - 1), 1
        if passed:
            yield from scan.part(held.slice(passed), True)
        elif held is not None:
            yield from scan.whole(held, np.zeros(1, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in pieces(batches):
            yield from table.select(names).combine_chunks().to_batches()

    # A number for the group in front: most rows are told apart by it alone when they are sorted.
    spread = df.repartition(*keys, "segment")
    spread = spread if each is None else spread.withColumn(*each)
    return spread.sortWithinPartitions(F.xxhash64(*group), *group, *order).mapInArrow(run, out)


class IslandTables:
    """Tables of whole islands for a scan that goes row by row, with a way around it.

    ``plain(table, island, starts)`` tells the islands that need no scan, ``settled(table, starts)`` gives their rows;
    ``scan(emit)`` places the rows of the others, which come back with the values emitted in the columns ``extra``
    and, as ``island``, the position the island starts at.
    """

    def __init__(self, scan: Callable, needed: list[str], pos: str, extra: list[tuple[str, pa.DataType]], plain: Callable, settled: Callable):
        self.scan, self.needed, self.pos, self.extra, self.plain, self.settled = scan, needed, pos, extra, plain, settled
        self.found: list[tuple] = []
        self.open, self.at = None, 0

    def _emit(self, table, i: int, *values) -> None:
        self.found.append((table, i, self.at, *values))

    def whole(self, t: pa.Table, starts: np.ndarray) -> Iterator[pa.Table]:
        island = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))
        plain = self.plain(t, island, starts)
        rows = np.flatnonzero(plain[island])
        if len(rows):
            own = island[rows]
            yield self.settled(t.take(pa.array(rows)), np.flatnonzero(np.append(True, own[1:] != own[:-1])))
        rows = np.flatnonzero(~plain[island])
        if len(rows):
            part, own, last, scan = t.take(pa.array(rows)), island[rows], None, None
            first = numbers(t[self.pos])[starts]
            for i, v in enumerate(zip(*[part[c].to_pylist() for c in self.needed])):
                if own[i] != last:
                    if scan is not None:
                        scan.close()
                    last, scan, self.at = own[i], self.scan(self._emit), first[own[i]]
                scan.row(part, i, v)
            scan.close()
            yield from self._placed()

    def part(self, t: pa.Table, last: bool) -> Iterator[pa.Table]:
        if self.open is None:
            self.open, self.at = self.scan(self._emit), t[self.pos][0].as_py()
        t = t.combine_chunks()
        for i, v in enumerate(zip(*[t[c].to_pylist() for c in self.needed])):
            self.open.row(t, i, v)
        if last:
            self.open.close()
            self.open = None
        yield from self._placed()

    def _placed(self) -> Iterator[pa.Table]:
        if self.found:
            rows = gathered([f[:2] for f in self.found])
            for k, (name, t) in enumerate([("island", pa.int64()), *self.extra], 2):
                rows = rows.append_column(name, pa.array([f[k] for f in self.found], t))
            self.found = []
            yield rows
