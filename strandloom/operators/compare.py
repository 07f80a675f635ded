"""Comparison of call sets: matching within a window, error rates, consensus.

Calls are dealt by cells of the genome and matched in one pass (``operators/matches.py``).  Cells with too many rows
for one task are reduced to distinct shapes with counts, so copies cost one row, and matched by an equi-join on the
hash of binned end points: bins are four windows wide and one side is copied to the one or two bins it can reach, in
one dimension per compared end.  A pair matches in exactly one class and meets in one bin of it, so counts need no
deduplication.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from strandloom.functions.typing import (
    SIZE_BINS,
    crossed_match,
    gain_pair,
    size_bin,
    straight_match,
    types_and_lengths_agree,
)
from strandloom.operators.islands import DEEP, codes, known, numbers, scan_islands, scan_segments, with_island, with_segment
from strandloom.operators.matches import DEEP as CELL_DEEP, SHAPE, by_file, counting, in_cells, parted, scan_cells
from strandloom.operators.regions import both_ends_inside
from strandloom.params import CompareParams
from strandloom.session import settle, written

ARRIVAL = ["pos", "file_id", "line_no", *[c for c in SHAPE if c != "pos"], "svid"]


def reportable(p: CompareParams) -> Column:
    """The call filter shared by evaluation and assembly filtering."""
    c = F.col
    local = (c("svtype") != "BND") | (c("ctg") == c("ctg2"))
    return (
        (~local | (F.abs("svlen") >= p.min_len))
        & ((c("count") <= 0) | (c("count") >= p.min_count))
        & (c("vaf").isNull() | (c("vaf") >= p.min_vaf))
    )


def select_reportable(calls: DataFrame, p: CompareParams, bed: DataFrame | None = None) -> DataFrame:
    rows = calls.filter(reportable(p))
    return rows if bed is None else both_ends_inside(rows, bed)


def _keyed(df: DataFrame, w: int, spread: bool) -> DataFrame:
    """Rows with ``cls``, the match class, and ``h``, the hash of the class and its bins.

    ``spread`` marks the base side, which is copied to the bins it can reach.  Classes: ``s``
    straight ends; ``f`` first ends of an insertion and a duplication; ``b`` and ``t`` crossed ends
    with a breakend on the base side or only on the test side.
    """
    size = max(4 * w, 1)
    at = lambda x: F.floor(x / F.lit(size)).cast("bigint")
    bins = (lambda x: F.array_distinct(F.array(at(x - w), at(x + w)))) if spread else lambda x: F.array(at(x))
    bnd = F.col("svtype") == "BND"
    one, two = (F.col("ctg"), bins(F.col("pos"))), (F.col("ctg2"), bins(F.col("pos2")))
    nowhere = (F.lit(None).cast("string"), F.array(F.lit(0).cast("bigint")))
    crossed = (two, one) if spread else (one, two)

    def cls(name: Column, first, second) -> Column:
        return F.struct(
            name.alias("cls"), first[0].alias("c1"), first[1].alias("b1"), second[0].alias("c2"), second[1].alias("b2")
        )

    # The two types of a gain pair look for each other, so the key names the type of the base side.
    gain = F.when(F.col("svtype") == ("INS" if spread else "DUP"), "fI").when(
        F.col("svtype") == ("DUP" if spread else "INS"), "fD"
    )
    turned = [F.when(bnd, "b").otherwise("t")] if spread else [F.lit("b"), F.when(bnd, "t")]
    options = [cls(F.lit("s"), one, two), F.when(gain.isNotNull(), cls(gain, one, nowhere))]
    options += [F.when(t.isNotNull(), cls(t, *crossed)) for t in turned]
    return (
        df.select("*", F.explode(F.filter(F.array(*options), lambda x: x.isNotNull())).alias("_k"))
        .select("*", F.explode("_k.b1").alias("_b1"))
        .select("*", F.explode("_k.b2").alias("_b2"))
        .select(
            *df.columns,
            F.substring("_k.cls", 1, 1).alias("cls"),
            F.xxhash64("_k.cls", "_k.c1", "_b1", "_k.c2", "_b2").alias("h"),
            F.col("_b1").alias("b1"),
            F.col("_b2").alias("b2"),
        )
    )


def _rule(p: CompareParams) -> Column:
    """Join condition of ``b_`` rows and ``t_`` rows.

    The hash brings candidates together and everything else is checked on the pair, so a collision
    adds nothing.
    """
    b, t, w = (lambda c: F.col("b_" + c)), (lambda c: F.col("t_" + c)), p.window
    straight = straight_match(b, t, w)
    where = (
        F.when(t("cls") == "s", straight & ~gain_pair(b, t))
        .when(t("cls") == "f", gain_pair(b, t) & (t("ctg") == b("ctg")) & (F.abs(t("pos") - b("pos")) <= w))
        .otherwise(~straight & crossed_match(b, t, w) & ((b("svtype") == "BND") | (t("svtype") == "BND")))
    )
    met = (b("h") == t("h")) & (b("cls") == t("cls")) & (b("b1") == t("b1") + 0) & (b("b2") == t("b2") + 0)
    return met & types_and_lengths_agree(b, t, p.min_len_ratio) & where


def _multiplicity(p: CompareParams) -> Column:
    """A matching call counts once per pair of end points that lies in the half-open window."""
    b, t, w = (lambda c: F.col("b_" + c)), (lambda c: F.col("t_" + c)), p.window
    seen = lambda tc, tp, bc, bp: F.when(
        (t(tc) == b(bc)) & (b(bp) >= F.greatest(t(tp) - w, F.lit(0))) & (b(bp) < t(tp) + w), 1
    ).otherwise(0)
    ends = [("ctg", "pos"), ("ctg2", "pos2")]
    return reduce(lambda x, y: x + y, [seen(*te, *be) for te in ends for be in ends])


def _side(df: DataFrame, prefix: str, p: CompareParams, group: list[str]) -> DataFrame:
    shapes = df.groupBy(*group, *SHAPE).agg(F.count("*").alias("n"))
    keyed = _keyed(shapes, p.window, spread=prefix == "b_")
    return keyed.select(*[F.col(c).alias(prefix + c) for c in keyed.columns])


def match_counts(
    base: DataFrame, test: DataFrame, p: CompareParams,
    base_group: list[str] | None = None, test_group: list[str] | None = None, also: Column | None = None,
) -> DataFrame:
    """``n_match`` per distinct test shape that matches something (per base group, if given)."""
    bg, tg = base_group or [], test_group or []
    rule = _rule(p) if also is None else _rule(p) & also
    pairs = _side(base, "b_", p, bg).join(_side(test, "t_", p, tg), rule)
    key = [F.col("b_" + c) for c in bg] + [F.col("t_" + c) for c in (*tg, *SHAPE)]
    n = F.sum(_multiplicity(p).cast("bigint") * F.col("b_n")).cast("bigint")
    return pairs.groupBy(*key).agg(n.alias("n_match")).filter("n_match > 0")


def _roles(rows: DataFrame, side: int, test: Column, base: bool = True) -> DataFrame:
    return rows.select("*", F.lit(side).alias("_side"), F.coalesce(test, F.lit(False)).alias("_test"), F.lit(base).alias("_base"))


def _asked(calls: DataFrame, side: int, p: CompareParams, bed: DataFrame | None, also: str = "true") -> DataFrame:
    """All calls of a side as base rows, and those to be reported as test rows."""
    if bed is None:
        return _roles(calls, side, reportable(p) & F.expr(also))
    inside = _roles(select_reportable(calls.filter(also), p, bed), side, F.lit(True), False)
    return inside.unionByName(_roles(calls, side, F.lit(False)))


def counted(rows: DataFrame, p: CompareParams, out: list[str], deep: int = CELL_DEEP) -> DataFrame:
    """``out`` and ``n_match`` of the test rows: matches among the base rows of the other ``_side``."""
    needed = dict.fromkeys([*SHAPE, "_side", "_test", "_base", *out])
    light, dense = parted(in_cells(rows.select(*needed), p, "_side"), deep)
    fields = [light.schema[c] for c in out]
    found = scan_cells(light, T.StructType([*fields, T.StructField("n_match", T.LongType())]), counting(p))
    if dense is None:
        return found
    # Cells that are too much for one task: copies collapse, and Spark joins what is left by bins of both ends.
    own = ["_cell", "_side"]
    other = (F.col("b__cell") == F.col("t__cell")) & (F.col("b__side") != F.col("t__side"))
    tests = dense.filter("_test")
    hits = match_counts(dense.filter("_base"), tests, p, own, own, other).drop(*["b_" + c for c in own])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col("t_" + c)) for c in (*own, *SHAPE)])
    n = F.coalesce("n_match", F.lit(0)).cast("bigint").alias("n_match")
    return found.unionByName(tests.join(hits, same, "left").select(*out, n))


def with_match_count(base: DataFrame, test: DataFrame, p: CompareParams) -> DataFrame:
    """Every test call with ``n_match``, 0 when nothing in ``base`` matches."""
    asked = _roles(test, 0, F.lit(True), False)
    rows = asked.unionByName(_roles(base.select(*SHAPE), 1, F.lit(False)), allowMissingColumns=True)
    return counted(rows, p, test.columns)


def reported_rows(truth: DataFrame, test: DataFrame, p: CompareParams, bed: DataFrame | None = None) -> DataFrame:
    """Reportable calls of both sides with ``n_match``: ``FN`` are those of the truth, ``FP`` those of the test set."""
    rows = _asked(truth, 0, p, bed).unionByName(_asked(test, 1, p, bed))
    label = F.when(F.col("_side") == 0, F.lit("FN")).otherwise(F.lit("FP")).alias("label")
    return counted(rows, p, [*truth.columns, "_side"]).select(*truth.columns, "n_match", label)


def _errors(rows: DataFrame, p: CompareParams, labels: list[tuple[str, int]]) -> DataFrame:
    """Per label the reportable calls of its side, how many match nothing on the other, and the rate."""
    rows = counted(rows, p, ["_side"])
    mine = lambda side, also=F.lit(True): F.count(F.when((F.col("_side") == side) & also, 1))
    sums = [c for name, side in labels for c in (mine(side).alias(name + "_n"), mine(side, F.col("n_match") == 0).alias(name + "_e"))]
    parts = [F.struct(F.lit(x).alias("label"), F.col(x + "_n").alias("total"), F.col(x + "_e").alias("errors")) for x, _ in labels]
    each = rows.agg(*sums).select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return each.withColumn("rate", _rate(F.col("errors"), F.col("total")))


def _rate(part: Column, whole: Column) -> Column:
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), 4)


def recall_precision(truth: DataFrame, test: DataFrame, p: CompareParams, bed: DataFrame | None = None) -> DataFrame:
    """Two rows: RN counts truth calls missed by the test set, RP test calls not in the truth set."""
    return _errors(_asked(truth, 0, p, bed).unionByName(_asked(test, 1, p, bed)), p, [("RN", 0), ("RP", 1)])


def by_size(truth: DataFrame, test: DataFrame, p: CompareParams, bed: DataFrame | None = None) -> DataFrame:
    """Recall and precision of every size bin; a bin without calls scores 1."""
    size = size_bin(F.abs("svlen"), F.col("ctg") == F.col("ctg2"))
    asked = _asked(truth, 0, p, bed).unionByName(_asked(test, 1, p, bed)).withColumn("size_bin", size)
    of = lambda side, also=F.lit(True): F.count(F.when((F.col("_side") == side) & also, 1))
    missed = F.col("n_match") == 0
    sums = counted(asked, p, ["_side", "size_bin"]).filter("size_bin is not null").groupBy("size_bin").agg(
        of(0).alias("fn_total"), of(0, missed).alias("fn_errors"), of(1).alias("fp_total"), of(1, missed).alias("fp_errors")
    )
    bins = truth.sparkSession.createDataFrame([(name,) for name in dict.fromkeys(b[2] for b in SIZE_BINS)], "size_bin string")
    rows = bins.join(sums, "size_bin", "left")
    cnt = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    score = lambda e, t: F.round(1 - F.coalesce(F.try_divide(cnt(e), cnt(t)), F.lit(0.0)), 4)
    return rows.select(
        "size_bin",
        cnt("fn_total").alias("fn_total"), cnt("fn_errors").alias("fn_errors"),
        score("fn_errors", "fn_total").alias("recall"),
        cnt("fp_total").alias("fp_total"), cnt("fp_errors").alias("fp_errors"),
        score("fp_errors", "fp_total").alias("precision"),
    )


def _with_files(calls: DataFrame) -> DataFrame:
    """Distinct shapes of each cell with the files they occur in (``files``, sorted) and how often in each (``counts``)."""
    per_file = calls.groupBy("_cell", *SHAPE, "file_id").agg(F.count("*").alias("n"))
    lists = F.array_sort(F.collect_list(F.struct("file_id", "n")))  # an entry per input file at most
    return per_file.groupBy("_cell", *SHAPE).agg(lists.alias("_f")).select("_cell", *SHAPE, F.col("_f.file_id").alias("files"), F.col("_f.n").alias("counts"))


def matched_counts(calls: DataFrame, test: DataFrame, p: CompareParams) -> DataFrame:
    """``file_i, file_id, matched``: calls of ``test`` in one file that match a call of ``calls`` in another."""
    cols = [*SHAPE, "file_id"]
    asked = _roles(test.select(*cols), 0, F.lit(True), False)
    return matched_files(asked.unionByName(_roles(calls.select(*cols), 0, F.lit(False))), p)


def matched_files(rows: DataFrame, p: CompareParams, deep: int = CELL_DEEP) -> DataFrame:
    """``file_i, file_id, matched``: test rows in one file that match a base row in another.

    Cells are counted up in the scan.  In cells that are too much for one task a shape is joined once whatever files
    it is in: its matches' sets of files are united first, the files without the shape's own copies are unfolded last,
    on shapes of equal sets together.
    """
    rows = rows.filter("file_id is not null").select(*SHAPE, "file_id", "_test", "_base")
    light, dense = parted(in_cells(rows, p, "file_id"), deep)
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("file_i", "file_id", "matched")])
    found = scan_cells(light, out, by_file(p))
    if dense is not None:
        found = found.unionByName(_dense_files(dense, p))
    return found.groupBy("file_i", "file_id").agg(F.sum("matched").alias("matched"))


def _dense_files(cells: DataFrame, p: CompareParams) -> DataFrame:
    sides = [_keyed(_with_files(cells.filter(role)), p.window, spread=x == "b_") for x, role in (("b_", "_base"), ("t_", "_test"))]
    b, t = (df.select(*[F.col(c).alias(x + c) for c in df.columns]) for x, df in zip(("b_", "t_"), sides))
    pairs = b.join(t, _rule(p) & (F.col("b__cell") == F.col("t__cell")) & (_multiplicity(p) > 0))
    own = [F.col("t_" + c).alias(c) for c in SHAPE]
    # One row per file a shape meets, not per shape it meets there.
    met = pairs.select(*own, F.col("t_files").alias("files"), F.col("t_counts").alias("counts"), F.explode("b_files").alias("file_i"))
    met = met.groupBy(*SHAPE, "files", "counts").agg(F.sort_array(F.collect_set("file_i")).alias("met"))
    same = met.groupBy("met", "files", "counts").agg(F.count("*").alias("times"))
    each = same.select("met", "times", F.explode(F.arrays_zip("files", "counts")).alias("x"))
    each = each.groupBy("met", F.col("x.files").alias("file_id")).agg(F.sum(F.col("x.counts") * F.col("times")).alias("matched"))
    each = each.select(F.explode("met").alias("file_i"), "file_id", "matched")
    return each.select(*[F.col(c).cast("bigint").alias(c) for c in each.columns])


def shared_matrix(calls: DataFrame, p: CompareParams, bed: DataFrame | None = None, n_files: int | None = None) -> DataFrame:
    """Per file pair (i, j): reportable calls of j, and the share of them matched in i.

    On the diagonal the value is the count itself.  Files without reportable calls have a total of 0 and null rates;
    with ``n_files`` that includes files without any call.
    """
    matched = matched_files(_asked(calls, 0, p, bed), p)
    every = calls.select("file_id").distinct()
    totals = select_reportable(calls, p, bed).groupBy("file_id").agg(F.count("*").alias("total"))
    if bed is None and n_files is None:
        totals = calls.groupBy("file_id").agg(F.count_if(reportable(p)).alias("total"))
        every = totals.select("file_id")
    if n_files is not None:
        every = calls.sparkSession.range(n_files).select(F.col("id").cast("int").alias("file_id"))
    files = every.join(totals, "file_id", "left").fillna(0, ["total"])
    # One entry per input file: the pairs are unfolded from one list, not joined.
    grid = (
        files.agg(F.collect_list(F.struct("file_id", "total")).alias("f"))
        .select("f", F.explode("f.file_id").alias("file_i"))
        .select("file_i", F.explode("f").alias("j"))
        .select("file_i", "j.file_id", "j.total")
    )
    rows = grid.join(matched, ["file_i", "file_id"], "left")
    m = F.coalesce("matched", F.lit(0))
    return rows.select(
        F.col("file_i").cast("int").alias("file_i"),
        F.col("file_id").cast("int").alias("file_j"),
        F.col("total").cast("bigint").alias("total"),
        m.cast("bigint").alias("matched"),
        F.when(F.col("file_i") == F.col("file_id"), F.col("total").cast("double"))
        .otherwise(_rate(m, F.col("total")))
        .alias("value"),
    )


class SeedScan:
    """Consensus of one island: a call joins the newest seed it matches, else becomes a seed."""

    def __init__(self, emit, p: CompareParams):
        self.emit, self.p = emit, p
        self.seeds: list[dict] = []
        self.last, self.last_seed = None, None
        self.made = 0

    def row(self, batch, i: int, v: tuple) -> None:
        if v != self.last:
            self._leave(v[1])
            self.last_seed = next(
                (s for s in reversed(self.seeds) if same_shape(s["shape"], v, self.p.window, self.p.min_len_ratio)), None
            )
            self.last = v
            if self.last_seed is None:
                self.last_seed = {"shape": v, "at": (batch, i), "n": 0}
                self.seeds.append(self.last_seed)
        self.last_seed["n"] += 1

    def _leave(self, pos: int) -> None:
        while self.seeds and pos - self.seeds[0]["shape"][1] > self.p.window:
            s = self.seeds.pop(0)
            self.emit(*s["at"], s["n"])

    def close(self) -> None:
        for s in self.seeds:
            self.emit(*s["at"], s["n"])


def same_shape(b: tuple, t: tuple, w: int, ratio: float) -> bool:
    """Row-level twin of ``functions.typing.same_call`` for the ordered scans, over SHAPE tuples."""
    types = {b[4], t[4]}
    gain = types == {"INS", "DUP"}
    if "BND" not in types:
        x, y = abs(b[5]), abs(t[5])
        alike = abs(x - y) <= 1000 or (x >= y * ratio and y >= x * ratio)
        if not alike or (b[4] != t[4] and not gain):
            return False
    near = lambda c, p, d, q: c == d and abs(p - q) <= w
    if gain:
        return near(b[0], b[1], t[0], t[1])
    if near(b[0], b[1], t[0], t[1]) and near(b[2], b[3], t[2], t[3]):
        return True
    return "BND" in types and near(b[2], b[3], t[0], t[1]) and near(b[0], b[1], t[2], t[3])


class Shapes:
    """``same_shape`` for pairs of rows of one (contig, contig) pair in a table; crossed ends are left out."""

    def __init__(self, t: pa.Table, w: int, ratio: float):
        self.w, self.ratio = w, ratio
        self.pos, self.pos2, self.size = (numbers(t[c]) for c in ("pos", "pos2", "svlen"))
        self.type, self.sized, self.ended = codes(t["svtype"]), known(t["svlen"]), known(t["pos2"])
        words = t["svtype"].combine_chunks().dictionary_encode().dictionary.to_pylist()
        self.bnd, self.ins, self.dup = (self.type == (words.index(x) if x in words else -2) for x in ("BND", "INS", "DUP"))

    def match(self, a, b) -> np.ndarray:
        x, y = np.abs(self.size[a]), np.abs(self.size[b])
        alike = self.sized[a] & self.sized[b] & ((np.abs(x - y) <= 1000) | ((x >= y * self.ratio) & (y >= x * self.ratio)))
        gain = (self.ins[a] & self.dup[b]) | (self.dup[a] & self.ins[b])
        fits = self.bnd[a] | self.bnd[b] | (alike & ((self.type[a] == self.type[b]) | gain))
        ends = gain | (self.ended[a] & self.ended[b] & (np.abs(self.pos2[a] - self.pos2[b]) <= self.w))
        return fits & ends & (np.abs(self.pos[a] - self.pos[b]) <= self.w)


def island_scan(
    calls: DataFrame, window: int, needed: list[str], out: list[T.StructField], new_tables, new_scan, deep: int = DEEP, each: tuple[str, Column] | None = None
) -> DataFrame:
    """Calls of every (contig, contig) pair in the order of ``ARRIVAL`` through a scan of each island; adds ``island`` and ``out``.

    Cells are found first, on few columns of the calls; calls that are dear to compute should be a table.  ``each``
    (name, generator of texts) copies the calls once they have moved, and the copies of each name are scanned apart.
    """
    keys = ["ctg", "ctg2"]
    light, dense = with_segment(calls, keys, "pos", window, deep)
    fields = [*calls.schema.fields, *([] if each is None else [T.StructField(each[0], T.StringType())]), T.StructField("island", T.LongType()), *out]
    placed = scan_segments(light, keys, ARRIVAL, "pos", window, T.StructType(fields), new_tables, each=each)
    if dense is None:
        return placed
    if each is not None:
        keys, dense = [*keys, each[0]], dense.withColumn(*each)
    extra = [(f.name, f.dataType) for f in out]
    return placed.unionByName(scan_islands(with_island(dense, keys, "pos", window), keys, ARRIVAL, needed, extra, new_scan))


def consensus(calls: DataFrame, p: CompareParams) -> DataFrame:
    """Seeds of the merged call sets with ``support``, the number of calls they stand for.

    Calls match only within one (contig, contig) pair, so that pair is part of the island key.
    """
    rows = with_island(calls, ["ctg", "ctg2"], "pos", p.window)
    return scan_islands(
        rows,
        ["ctg", "ctg2"],
        ARRIVAL,
        SHAPE,
        [("support", T.LongType())],
        lambda emit: SeedScan(emit, p),
    ).drop("island")


def against_consensus(calls: DataFrame, file_id: int, p: CompareParams, bed: DataFrame | None = None) -> DataFrame:
    """RN and RP of one call set against the consensus of all others (supported at least twice for RN)."""
    mine = calls.filter(F.col("file_id") == file_id)
    merged = settle(consensus(calls.filter(F.col("file_id") != file_id), p))
    rows = _asked(mine.withColumn("support", F.lit(None).cast("bigint")), 0, p, bed)
    rows = rows.unionByName(_asked(merged, 1, p, bed, "support >= 2"))
    errors = _errors(rows, p, [("RN", 1), ("RP", 0)])
    return errors.select("label", F.lit(file_id).alias("file_id"), "total", "errors", "rate")


def annotate_first(calls: DataFrame, p: CompareParams, bed: DataFrame | None = None) -> DataFrame:
    """Reportable calls of file 0 with the number of consensus calls of the other files they match."""
    merged = written(consensus(calls.filter("file_id != 0"), p).select(*SHAPE))
    return with_match_count(merged, select_reportable(calls.filter("file_id = 0"), p, bed), p)
