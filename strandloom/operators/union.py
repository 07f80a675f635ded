"""Union of call sets: greedy grouping across files, combination counts and group representatives."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from strandloom.operators.asmfilter import counted_support
from strandloom.operators.compare import SHAPE, Shapes, island_scan, same_shape
from strandloom.operators.intervals import BIN, running
from strandloom.operators.islands import DEEP, IslandTables, numbers, scan_segments
from strandloom.operators.ordinals import dense_index, middle_row
from strandloom.operators.regions import annotate_near, flag_inside
from strandloom.params import CompareParams, UnionParams
from strandloom.session import settle, written

CALL_KEY = ["file_id", "line_no", "svid", *SHAPE]
GROUP_KEY = ["ctg", "ctg2", "island", "grp"]
CATEGORY = "_category"
#: Rows before a call that are looked at for a match without a scan; members of a group whose middle a window finds;
#: largest gaps in a stretch in which the points of a read are paired.
BACK, LARGE, STRETCH = 4, 1000, 16


class GroupScan:
    """A call joins the newest group, started within the window, that has any matching member."""

    def __init__(self, emit, p: UnionParams):
        self.emit, self.p = emit, p
        self.groups: list[dict] = []
        self.made = 0
        self.last, self.last_group = None, None

    def row(self, batch, i: int, v: tuple) -> None:
        shape, seed = v[:6], v[6:]
        if shape != self.last:
            w, ratio = self.p.window, self.p.min_len_ratio
            while self.groups and shape[1] - self.groups[0]["pos"] > w:
                self.groups.pop(0)
            self.last_group = next(
                (g for g in reversed(self.groups) if any(same_shape(m, shape, w, ratio) for m in g["shapes"])), None
            )
            if self.last_group is None:
                self.last_group = {"id": self.made, "pos": shape[1], "seed": seed, "shapes": {}}
                self.made += 1
                self.groups.append(self.last_group)
            self.last_group["shapes"][shape] = True
            self.last = shape
        g = self.last_group
        self.emit(batch, i, g["id"], g["pos"], *g["seed"])

    def close(self) -> None:
        self.groups.clear()


def grouped(
    calls: DataFrame, p: UnionParams = UnionParams(), bed: DataFrame | None = None, deep: int = DEEP, categories: Column | None = None
) -> DataFrame:
    """Calls with their group key, the place of the group's first call, and ``in_bed``.

    Only calls of one (contig, contig) pair can match, so the pair is part of the island key.  With ``categories``, the
    names of those a call is in, the calls of each are grouped apart, and ``CATEGORY`` tells which; calls move once.
    """
    rows = calls.withColumn("in_bed", F.lit(True)) if bed is None else flag_inside(calls, bed, CALL_KEY)
    out = [T.StructField("grp", T.LongType()), T.StructField("seed_pos", T.LongType()), T.StructField("seed_file", T.IntegerType()), T.StructField("seed_line", T.LongType())]
    extra = [("grp", pa.int64()), ("seed_pos", pa.int64()), ("seed_file", pa.int32()), ("seed_line", pa.int64())]

    def plain(t: pa.Table, island, starts):
        """Every call lies in reach of the first one of its island and matches one just before it."""
        shapes, pos, ok = Shapes(t, p.window, p.min_len_ratio), numbers(t["pos"]), np.zeros(t.num_rows, bool)
        ok[starts] = True
        for back in range(1, min(BACK, t.num_rows - 1) + 1):
            a, b = np.arange(t.num_rows - back), np.arange(back, t.num_rows)
            ok[b] |= (island[a] == island[b]) & shapes.match(a, b)
        return np.logical_and.reduceat(ok & (pos - pos[starts][island] <= p.window), starts)

    def settled(t: pa.Table, starts):
        seeds = pa.array(np.repeat(starts, np.diff(np.append(starts, t.num_rows))))
        first = {"island": "pos", "grp": None, "seed_pos": "pos", "seed_file": "file_id", "seed_line": "line_no"}
        cols = t
        for name, c in first.items():
            cols = cols.append_column(name, pa.array(np.zeros(t.num_rows, np.int64)) if c is None else t[c].take(seeds))
        return cols

    scan = lambda emit: GroupScan(emit, p)
    needed = [*SHAPE, "file_id", "line_no"]
    return island_scan(rows, p.window, needed, out, lambda: IslandTables(scan, needed, "pos", extra, plain, settled), scan, deep, None if categories is None else (CATEGORY, F.explode(categories)))


def reported_groups(rows: DataFrame, p: UnionParams = UnionParams(), *more: Column) -> DataFrame:
    """Every group (of every category, if rows have one) with the files it has calls of, and whether it is reported.

    ``more`` are further aggregates of its calls.
    """
    own = [CATEGORY] if CATEGORY in rows.columns else []
    g = rows.groupBy(*own, *GROUP_KEY, "seed_pos", "seed_file", "seed_line").agg(
        F.max("count").alias("max_count"),
        F.max(F.abs("svlen")).alias("max_len"),
        F.bool_or(F.col("svtype") == "BND").alias("has_bnd"),
        F.bool_or("in_bed").alias("in_bed"),
        F.sort_array(F.collect_set("file_id")).alias("files"),
        F.count("*").alias("n_calls"),
        *more,
    )
    kept = (
        (F.col("max_count") >= p.group_min_count)
        & (F.col("has_bnd") | (F.col("max_len") >= p.min_len))
        & F.col("in_bed")
    )
    return g.withColumn("kept", kept)


def group_summary(rows: DataFrame, p: UnionParams = UnionParams()) -> DataFrame:
    """Key and ``kept`` of ``reported_groups`` with a number in creation order."""
    return _numbered(reported_groups(rows, p).select(*GROUP_KEY, "seed_pos", "seed_file", "seed_line", "kept"))


def _numbered(groups: DataFrame) -> DataFrame:
    """Adds ``group_id``: the number of each group in creation order."""
    # Equal seeds cannot start two groups, except for alleles of one line: the key breaks that tie.
    return dense_index(
        groups,
        ["seed_pos", "seed_file", "seed_line", "ctg2", "grp"],
        {"_c_ctg": F.col("ctg"), "_c_at": F.floor(F.col("seed_pos") / 1_000_000)},
        "group_id",
    )


def union_rows(calls: DataFrame, p: UnionParams = UnionParams(), bed: DataFrame | None = None) -> DataFrame:
    """Calls of reported groups with ``group_id``."""
    return rows_of(written(grouped(calls, p, bed)), p)


def rows_of(rows: DataFrame, p: UnionParams) -> DataFrame:
    """``union_rows`` of calls that are ``grouped``."""
    kept = group_summary(rows, p).filter("kept").select(*GROUP_KEY, "group_id")
    return rows.join(kept, GROUP_KEY).drop("island", "grp", "in_bed", "seed_pos", "seed_file", "seed_line")


def combination_counts(
    calls: DataFrame, n_files: int, p: UnionParams = UnionParams(), bed: DataFrame | None = None, unseen: bool = False
) -> DataFrame:
    """Reported groups per combination of files; character i of the label stands for file i.

    With ``unseen``, combinations without a group are listed too: ``2 ** n_files - 1`` rows, so ask for it
    with few files only.
    """
    return combinations_of(grouped(calls, p, bed), n_files, p, unseen)


def combinations_of(rows: DataFrame, n_files: int, p: UnionParams, unseen: bool = False) -> DataFrame:
    """``combination_counts`` of calls that are ``grouped``; of every category, if they have one."""
    kept = reported_groups(rows, p).filter("kept")
    own = [CATEGORY] if CATEGORY in kept.columns else []
    ids = F.sequence(F.lit(0), F.lit(n_files - 1))
    has = lambda i: F.when(F.array_contains("files", i), "1").otherwise("0")
    counts = kept.groupBy(*own, F.array_join(F.transform(ids, has), "").alias("label")).agg(F.count("*").alias("n"))
    if not unseen:
        return counts
    every = rows.sparkSession.range(1, 1 << n_files).select(F.reverse(F.lpad(F.bin("id"), n_files, "0")).alias("label"))
    return every.join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def _best(rows: DataFrame, rest: list[str], score: str) -> Column:
    """Aggregate: ``rest`` of the row with the highest score, the earliest arrival on a tie, then the largest of ``rest``."""
    order = [F.col(score).alias("_0"), *[(-F.col(c)).alias(f"_{i}") for i, c in enumerate(("pos", "file_id", "line_no"), 1)]]
    plain = [c for c, t in rows.dtypes if c in rest and not t.startswith("map")]
    plain = [c for c in rest if c in plain]
    if plain == rest:
        return F.max(F.struct(*order, *rest))
    return F.max_by(F.struct(*rest), F.struct(*order, *plain))


def _first_best(rows: DataFrame, group: list[str], score: str) -> DataFrame:
    """The ``_best`` row per group."""
    rest = [c for c in rows.columns if c not in group]
    return rows.groupBy(*group).agg(_best(rows, rest, score).alias("r")).select(*group, *[F.col("r")[c].alias(c) for c in rest])


def supported_union(
    calls: DataFrame,
    call_reads: DataFrame,
    evidence: DataFrame,
    p: UnionParams = UnionParams(),
    bed: DataFrame | None = None,
    strict: bool = False,
) -> DataFrame:
    """Reported groups with assembly support per call, ``n_asm``; ``strict`` refuses calls without listed reads.

    ``call_reads`` is ``file_id, svid, read``; ``evidence`` comes from ``readids.asm_evidence``.
    Collapsed, a group is its best supported call; otherwise every sufficiently supported call.  Support is counted
    before calls are grouped and stays with them, so groups and support are not joined.
    """
    rows = counted_support(calls, call_reads, evidence, CompareParams(min_len_ratio=p.min_len_ratio), strict)
    rows = written(rows.withColumnRenamed("asm_support", "n_asm").drop("asm_name_support"))
    placed = grouped(rows, p, bed)
    if p.collapsed:
        return _best_of_groups(placed, [*CALL_KEY, *[c for c in calls.columns if c not in CALL_KEY], "n_asm"], p)
    rows = rows_of(written(placed), p).filter(F.col("n_asm") >= p.group_min_count)
    # A call stands for each call of its key.
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).drop("copies")


def _best_of_groups(rows: DataFrame, cols: list[str], p: UnionParams) -> DataFrame:
    """The best supported call of every reported group, if its support suffices, in one pass over calls that are ``grouped``."""
    rest = [c for c in cols if c not in GROUP_KEY]
    groups = reported_groups(rows, p, _best(rows, rest, "n_asm").alias("r"))
    enough = F.col("kept") & (F.col("r")["n_asm"] >= p.group_min_count)
    groups = groups.select(*GROUP_KEY, "seed_pos", "seed_file", "seed_line", F.when(enough, F.col("r")).alias("r"))
    one = [F.col(c) if c in GROUP_KEY else F.col("r")[c].alias(c) for c in cols]
    return _numbered(groups).filter("r is not null").select("group_id", *one)


def union_with_repeats(
    calls: DataFrame,
    n_files: int,
    repeats: DataFrame,
    segdups: DataFrame,
    p: UnionParams = UnionParams(),
    bed: DataFrame | None = None,
) -> DataFrame:
    """Best counted call per reported group, annotated, with lengths and counts of every file.

    ``lens`` and ``counts`` list one value per file, ``NA`` for files without a call in the group and
    ``inf`` for lengths between contigs; a file with several calls shows its last.
    """
    rows = union_rows(calls, p, bed)
    length = F.when(F.col("ctg") != F.col("ctg2"), "inf").otherwise(F.col("svlen").cast("string"))
    order = F.struct("pos", "line_no", *[c for c in SHAPE if c != "pos"])
    per_file = rows.groupBy("group_id", "file_id").agg(
        F.max_by(F.struct(length.alias("len"), F.col("count").cast("string").alias("count")), order).alias("v")
    )
    vectors = per_file.groupBy("group_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("file_id").cast("int"), "v"))).alias("m")
    )
    pick = lambda name: F.array_join(
        F.transform(
            F.sequence(F.lit(0), F.lit(n_files - 1)),
            lambda i: F.coalesce(F.try_element_at("m", i)[name], F.lit("NA")),
        ),
        ",",
    )
    best = settle(_first_best(rows, ["group_id"], "count"))
    best = annotate_near(annotate_near(best, repeats, CALL_KEY, "tr_info"), segdups, CALL_KEY, "segdup_info")
    return best.join(vectors, "group_id").select(
        *best.columns, pick("len").alias("lens"), pick("count").alias("counts")
    )


def median_rows(rows: DataFrame, drop_last_group: bool = False) -> DataFrame:
    """One call per ``group_id``: the middle one by (pos, pos2), with the files of all members.

    ``drop_last_group`` leaves out the group with the highest number, as the replaced tool does.
    """
    if drop_last_group:
        last = rows.agg(F.max("group_id").alias("_last"))
        rows = rows.join(last.select(F.col("_last").alias("group_id")), "group_id", "left_anti")
    rows = written(rows)
    large = settle(rows.groupBy("group_id").agg(F.count("*").alias("n")).filter(F.col("n") > LARGE).select("group_id"))
    if large.isEmpty():
        return _small_medians(rows)
    few, many = (rows.join(large, "group_id", how) for how in ("left_anti", "left_semi"))
    return _small_medians(few).unionByName(_large_medians(many))


def _small_medians(rows: DataFrame) -> DataFrame:
    """Groups of few rows: put in order, with the files of all next to each."""
    w = Window.partitionBy("group_id")
    order = ["pos", "pos2", "file_id", "line_no", "svtype", "svlen", "svid"]
    files = F.array_join(F.transform(F.sort_array(F.collect_list("file_id").over(w)), lambda x: x.cast("string")), ",")
    placed = rows.withColumns({"_at": F.row_number().over(w.orderBy(*order)), "_n": F.count("*").over(w), "file_ids": files})
    return placed.filter(F.col("_at") - 1 == F.floor(F.col("_n") / 2)).drop("_at", "_n")


def _large_medians(rows: DataFrame) -> DataFrame:
    """Groups of any size: narrowed by counting."""
    mid = middle_row(
        rows,
        ["group_id"],
        [
            {"_l_pos": F.col("pos"), "_l_pos2": F.col("pos2")},
            {"_l_file": F.col("file_id"), "_l_chunk": F.floor(F.col("line_no") / 1_000_000)},
            {"_l_line": F.col("line_no"), "_l_type": F.col("svtype"), "_l_len": F.col("svlen"), "_l_id": F.col("svid")},
        ],
    )
    files = rows.groupBy("group_id", "file_id").agg(F.count("*").cast("int").alias("n")).groupBy("group_id").agg(
        F.array_join(
            F.flatten(
                F.transform(
                    F.sort_array(F.collect_list(F.struct("file_id", "n"))),
                    lambda x: F.array_repeat(x["file_id"].cast("string"), x["n"]),
                )
            ),
            ",",
        ).alias("file_ids")
    )
    return mid.join(files, "group_id")


def _break_points(calls: DataFrame, key: list[str], more: tuple[str, ...] = ()) -> DataFrame:
    """Both points of every call: ``key``, ``end`` (0, 1), ``ctg, pos, ori, svtype`` and ``more``."""
    point = lambda ctg, pos, end: F.struct(
        F.lit(end).alias("end"), F.col(ctg).alias("ctg"), F.col(pos).alias("pos"), F.substring("ori", end + 1, 1).alias("ori")
    )
    both = F.explode(F.array(point("ctg", "pos", 0), point("ctg2", "pos2", 1)))
    return calls.select(*[F.col(k).alias("_k_" + k) for k in key], both.alias("p"), "svtype", *more).select(*["_k_" + k for k in key], "p.*", "svtype", *more)


def _banded(pts: DataFrame, on: list[str], allowed: Column, min_gap: int, max_gap: int) -> DataFrame:
    """Pairs of points with equal ``on`` from ``min_gap`` to below ``max_gap`` apart, the first by position as ``*0``."""
    at = F.floor(F.col("pos") / F.lit(max_gap)).cast("bigint")
    left = pts.select(*[F.col(c).alias(c + "0") for c in pts.columns], at.alias("bin0"))
    right = pts.withColumn("bin1", F.explode(F.array(at - 1, at))).select(*[F.col(c).alias(c + "1") for c in pts.columns], "bin1")
    gap = F.col("pos1") - F.col("pos0")
    cond = (F.col("bin0") == F.col("bin1")) & (gap >= min_gap) & (gap < max_gap) & allowed
    for c in on:
        cond = cond & (F.col(c + "0") == F.col(c + "1"))
    return left.join(right, cond).drop("bin0", "bin1")


class PairScan:
    """Pairs of the points of one read on one contig, ``min_gap`` to below ``max_gap`` apart, whose types need a shared read.

    Points come in order.  One that lies in the next stretch (``size`` long) is there as the second of a pair only.
    """

    def __init__(self, cols: list[str], min_gap: int, max_gap: int, size: int, most: int = 200_000):
        self.cols, self.min_gap, self.max_gap, self.size, self.most = cols, min_gap, max_gap, size, most
        self.held: pa.Table | None = None

    def whole(self, t: pa.Table, starts: np.ndarray):
        yield from self._pairs(t, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows))), 0)

    def part(self, t: pa.Table, last: bool):
        before = 0 if self.held is None else self.held.num_rows
        t = t.combine_chunks() if self.held is None else pa.concat_tables([self.held, t]).combine_chunks()
        yield from self._pairs(t, np.zeros(t.num_rows, np.int64), before)
        pos = numbers(t["pos"])
        self.held = None if last else t.slice(int(np.searchsorted(pos, pos[-1] - self.max_gap, side="right")))

    def _pairs(self, t: pa.Table, island: np.ndarray, before: int):
        """Pairs of which the second is not among the first ``before`` rows."""
        pos, kind = numbers(t["pos"]), t["svtype"].combine_chunks()
        bnd, inv, dele = (pc.equal(kind, x).fill_null(False).to_numpy(zero_copy_only=False) for x in ("BND", "INV", "DEL"))
        own = np.floor_divide(pos, self.size) == numbers(t["segment"])
        a, back, found, n = np.flatnonzero(own), 0, [], 0
        while len(a):
            back += 1
            a = a[a + back < t.num_rows]
            b = a + back
            near = (island[a] == island[b]) & (pos[b] - pos[a] < self.max_gap)
            a, b = a[near], b[near]
            ok = (pos[b] - pos[a] >= self.min_gap) & (b >= before) & (bnd[a] | bnd[b] | (inv[a] & inv[b]) | (dele[a] & dele[b]))
            found.append((a[ok], b[ok]))
            n += int(ok.sum())
            if n > self.most or not len(a):
                first, second = (t.take(pa.array(np.concatenate(x))) for x in zip(*found))
                yield pa.table({f"{c}{i}": side[c] for i, side in enumerate((first, second)) for c in self.cols})
                found, n = [], 0


def _paired(pts: DataFrame, cols: list[str], min_gap: int, max_gap: int) -> DataFrame:
    """``_banded`` on equal read and contig for types that need a shared read: points move once and are paired in order.

    A stretch holds many gaps, so few points are copied to the one before theirs.
    """
    size = STRETCH * max_gap
    at = F.floor(F.col("pos") / F.lit(size)).cast("bigint")
    early = F.col("pos") - at * size < max_gap
    rows = pts.filter("pos is not null and ctg is not null").withColumn("segment", F.explode(F.when(early, F.array(at - 1, at)).otherwise(F.array(at))))
    out = [T.StructField(f"{c}{i}", rows.schema[c].dataType) for i in (0, 1) for c in cols]
    scan = lambda: PairScan(cols, min_gap, max_gap, size)
    return scan_segments(rows, ["read", "ctg"], ["pos"], "pos", max_gap, T.StructType(out), scan)


def _shared_pairs(calls: DataFrame, reads: DataFrame, key: list[str], min_gap: int, max_gap: int) -> DataFrame:
    """Classified pairs of points that share assembly reads, counted read by read."""
    c = F.col
    names = ["_k_" + k for k in key]
    # The reads of a call come together once, where they are counted and meet the call.
    listed = reads.select(*key, "read").repartition(*key).groupBy(*key, "read").agg(F.count("*").alias("times"))
    listed = listed.withColumn("listed", F.sum("times").over(Window.partitionBy(*key))).filter("read is not null").drop("times")
    pts = _break_points(calls.select(*key, "ctg", "pos", "ori", "ctg2", "pos2", "svtype").join(listed, key), key, ("read", "listed"))
    bnd = (c("svtype0") == "BND") | (c("svtype1") == "BND")
    both = lambda t: (c("svtype0") == t) & (c("svtype1") == t)
    cols = [*names, "end", "ctg", "pos", "ori", "svtype"]
    if min_gap > 0:
        met = _paired(pts, [*cols, "listed"], min_gap, max_gap)
    else:  # a point is then its own partner too, and two of one place are two pairs
        met = _banded(pts, ["ctg", "read"], bnd | both("INV") | both("DEL"), min_gap, max_gap)
    sides = [f"{x}{i}" for i in (0, 1) for x in cols]
    counted = met.groupBy(*sides, "listed0").agg(F.count("*").alias("shared"))
    kind = (
        F.when(bnd & (c("shared") == c("listed0")), "Insertions_case3")
        .when(both("INV") | (bnd & (c("ori0") == c("ori1"))), "Parallel_Breakpoints_case4")
        .when(both("DEL"), "case1")
    )
    return counted.withColumn("dsb_type", kind).filter("dsb_type is not null").select(*sides, "dsb_type")


def _named(pairs: DataFrame, key: list[str]) -> DataFrame:
    return pairs.withColumnsRenamed({f"_k_{k}{i}": f"{k}{i}" for k in key for i in (0, 1)}).drop("end0", "end1")


def strand_break_pairs(
    calls: DataFrame, reads: DataFrame, key: list[str] = ("file_id", "line_no", "svid"), max_gap: int = 25_000, min_gap: int = 50
) -> DataFrame:
    """Pairs of nearby break points classified by their types and shared assembly reads.

    ``reads`` has a row per read a call lists (``key, read``).  Points meet read by read on (contig, read, position
    bin), so no call carries its reads through a join; shared reads are counted per pair.  Pairs of duplications
    need no common read: their points meet on (contig, position bin).
    """
    key = list(key)
    dup = _break_points(calls.filter("svtype = 'DUP'"), key)
    pairs = _banded(dup, ["ctg"], F.lit(True), min_gap, max_gap).withColumn("dsb_type", F.lit("case2"))
    return _named(_shared_pairs(calls, reads, key, min_gap, max_gap).unionByName(pairs), key)


def strand_break_stats(
    calls: DataFrame, reads: DataFrame, key: list[str] = ("file_id", "line_no", "svid"), max_gap: int = 25_000, min_gap: int = 50
) -> DataFrame:
    """``dsb_type, n`` of all pairs.  Pairs of duplications are counted from sums over positions, none is formed."""
    counts = _shared_pairs(calls, reads, list(key), min_gap, max_gap).groupBy("dsb_type").agg(F.count("*").alias("n"))
    at = _break_points(calls.filter("svtype = 'DUP'"), list(key)).groupBy("ctg", "pos").agg(F.count("*").alias("n"))
    # Every point asks how many lie up to min_gap before it, less those max_gap before it and further.
    ask = lambda back, sign: F.struct((F.col("pos") - back).alias("at"), F.lit(0).cast("bigint").alias("has"), (sign * F.col("n")).alias("times"))
    own = F.struct(F.col("pos").alias("at"), F.col("n").alias("has"), F.lit(None).cast("bigint").alias("times"))
    rows = at.select("ctg", F.explode(F.array(own, ask(min_gap, 1), ask(max_gap, -1))).alias("x")).select("ctg", "x.*")
    rows = rows.withColumn("bin", F.floor(F.col("at") / BIN).cast("bigint"))
    rows, local, carry = running(rows, ["ctg"], [F.col("at"), F.col("times").isNotNull()], F.sum, F.col("has"), own=True)
    upto = F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    total = F.sum(upto.cast("decimal(19,0)") * F.col("times").cast("decimal(19,0)")).cast("bigint")
    dups = rows.agg(total.alias("n")).filter("n > 0").select(F.lit("case2").alias("dsb_type"), "n")
    return counts.unionByName(dups)
