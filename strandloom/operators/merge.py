"""Read-level signals to calls: ordered greedy clustering and its summary.

Plan, on tables of any skew:

1. rows that agree in everything but the read name are counted first (map-side combine), so a hot
   position, source or group of copies shrinks to its distinct rows before anything is shuffled;
2. gap islands on the occupied bins, for each kind of signal (type, breakend or not, second contig): rows of
   different kinds never vote for each other, so this cuts a deep locus exactly;
3. one ordered scan per island, which streams and keeps only open clusters;
4. a plain aggregate per cluster; the scan has already marked the representative row.

Arrival order within an island is (position, signature, other attributes), a refinement of the
(contig, position) order the clustering requires.  Votes are exact: identical members are one entry
with a weight, so no sampling is needed for deep clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from strandloom.operators.islands import DEEP, IslandTables, codes, gathered, numbers, scan_islands, scan_segments, with_island, with_segment
from strandloom.params import MergeParams
from strandloom.session import written

SIGNATURE = ["pos", "is_bp", "en", "ori", "ctg2", "pos2", "svtype", "svlen"]
CLUSTER_KEY = ["ctg", "kind", "island", "cluster"]
OPTIONAL = {"tsd_len": "bigint", "polya_len": "bigint", "cen_dist": "bigint", "cen_overlap": "bigint", "info": "string"}


class VoteScan:
    """Open clusters of one island, oldest first.

    A row joins the cluster with the most matching members (the oldest on a tie), or opens a new one.
    Clusters leave from the front once they are out of reach.  Only on request (``max_alleles``) do they
    also leave while more than that are open.  Clusters of one row each that are alike in all but their number
    (copies of a zero length) are held as one with ``copies``.
    """

    def __init__(self, emit, p: MergeParams):
        self.emit, self.p = emit, p
        self.open: list[dict] = []
        self.n_seen = 0
        self.last: tuple | None = None
        self.last_cluster: dict | None = None

    def row(self, batch, i: int, v: tuple) -> None:
        sig, n, has_rt = v[:8], v[8], v[9]
        if sig == self.last and self.last_cluster is not None:
            # Same evidence as the row before: it already holds the most votes for this signature.
            self._join(self.last_cluster, sig, batch, i, n, has_rt)
            return
        # A zero length never matches itself: its copies follow another cluster together or stay alone each.
        alone = sig[7] == 0
        for _ in range(n if alone and self.p.max_alleles is not None else 1):
            self._evict(sig[0])
            best, most = None, 0
            for at, c in enumerate(self.open):
                if c["label"] != sig[6] and not (c["label"] == "INS" and sig[6] == "DUP"):
                    continue
                votes = self._votes(c["members"], sig)
                if votes > most:
                    best, most, place = c, votes, at
            each = 1 if alone and (best is None or self.p.max_alleles is not None) else n
            if best is None:
                label = "INS" if sig[6] == "DUP" else sig[6]
                copies = n if alone and self.p.max_alleles is None else 1
                best = {"label": label, "upto": sig[0], "members": {}, "rows": [], "n": 0, "id": self.n_seen, "copies": copies}
                self.n_seen += copies
                self.open.append(best)
            elif best["copies"] > 1:
                # The oldest of several clusters of one row each is joined; the others stay behind it.
                best = {**best, "members": dict(best["members"]), "rows": list(best["rows"]), "copies": 1}
                self.open[place]["id"] += 1
                self.open[place]["copies"] -= 1
                self.open.insert(place, best)
            self._join(best, sig, batch, i, each, has_rt)
        self.last, self.last_cluster = (None, None) if alone else (sig, best)

    def close(self) -> None:
        while self.open:
            self._finish(self.open.pop(0))

    def _join(self, c: dict, sig: tuple, batch, i: int, n: int, has_rt: bool) -> None:
        c["upto"] = max(c["upto"], sig[0])
        c["members"][sig] = c["members"].get(sig, 0) + n
        c["rows"].append((batch, i, n, has_rt))
        c["n"] += n

    def _evict(self, pos: int) -> None:
        while self.open and (
            pos - self.open[0]["upto"] > self.p.window
            or (self.p.max_alleles is not None and len(self.open) > self.p.max_alleles)
        ):
            gone = self.open.pop(0)
            if gone is self.last_cluster:
                self.last = self.last_cluster = None
            self._finish(gone)

    def _same(self, m: tuple, v: tuple) -> bool:
        w = self.p.window
        if m[6] != v[6] or m[1] != v[1] or abs(m[0] - v[0]) > w:
            return False
        if v[1]:
            turned = {m[3], v[3]} == {"><", "<>"}
            if (m[3] != v[3] and not turned) or m[4] != v[4] or abs(m[5] - v[5]) > w:
                return False
        elif abs(m[2] - v[2]) > w:
            return False
        if m[7] is None or v[7] is None:
            return True
        a, b = abs(m[7]), abs(v[7])
        return m[7] * v[7] > 0 and abs(a - b) <= 0.5 * (a + b) * self.p.max_len_diff

    def _votes(self, members: dict, v: tuple) -> int:
        pos, w, votes = v[0], self.p.window, 0
        for m, n in members.items():
            if -w <= m[0] - pos <= w and self._same(m, v):
                votes += n
        return votes

    def _finish(self, c: dict) -> None:
        half, rt_total = c["n"] >> 1, sum(n for _, _, n, rt in c["rows"] if rt)
        seen = rt_seen = 0
        for batch, i, n, rt in c["rows"]:
            is_mid = seen <= half < seen + n
            is_rt = rt and rt_seen <= (rt_total >> 1) < rt_seen + n
            for k in range(c["copies"]):
                self.emit(batch, i, c["id"] + k, n, is_mid, is_rt)
            seen += n
            rt_seen += n if rt else 0


class ReadScan(VoteScan):
    """Places single rows, each as soon as it is read: open clusters keep counts per signature and no rows."""

    def __init__(self, emit, p: MergeParams):
        super().__init__(emit, p)
        self.joined: dict | None = None
        self.copied: tuple | None = None

    def row(self, batch, i: int, v: tuple) -> None:
        if self.copied is not None and self.copied[0] == v:
            _, c, new = self.copied
            if not new:
                self._join(c, v, batch, i, 1, False)
                return
            c["copies"] += 1
            self.n_seen += 1
            self.emit(batch, i, c["id"] + c["copies"] - 1)
            return
        seen = self.n_seen
        super().row(batch, i, (*v, 1, False))
        self.copied = (v, self.joined, self.n_seen > seen) if v[7] == 0 and self.p.max_alleles is None else None

    def _join(self, c: dict, sig: tuple, batch, i: int, n: int, has_rt: bool) -> None:
        c["upto"] = max(c["upto"], sig[0])
        c["members"][sig] = c["members"].get(sig, 0) + n
        self.joined = c
        self.emit(batch, i, c["id"])

    def _finish(self, c: dict) -> None:
        pass


def with_optional(signals: DataFrame) -> DataFrame:
    """Absent optional columns are filled with null."""
    for c, t in OPTIONAL.items():
        if c not in signals.columns:
            signals = signals.withColumn(c, F.lit(None).cast(t))
    return signals


def distinct_rows(signals: DataFrame) -> DataFrame:
    """Signals without read names, counted."""
    signals = with_optional(signals)
    keys = [c for c in signals.columns if c != "read"]
    return signals.groupBy(*keys).agg(F.count("*").alias("n"))


def _kind(p: MergeParams) -> Column:
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("is_bp", "svtype", "ctg2")]
    return F.concat_ws("|", *own) if p.max_alleles is None else F.lit("")


def with_groups(rows: DataFrame, p: MergeParams) -> DataFrame:
    """Adds ``kind`` and ``island``: rows of different ones never share a cluster.

    A limit on open clusters counts those of all kinds, so with one all kinds are one.
    """
    rows = rows.withColumn("kind", _kind(p))
    rows = with_island(rows, ["ctg", "kind"], "pos", p.window)
    if p.max_alleles is None:
        # The other end must be near too: a long island falls apart where it has gaps there.
        other = F.coalesce(F.when(F.col("is_bp"), F.col("pos2")).otherwise(F.col("en")), F.lit(0))
        rows = rows.withColumnsRenamed({"island": "_at"}).withColumn("_other", other)
        rows = with_island(rows, ["ctg", "kind", "_at"], "_other", p.window)
        rows = rows.withColumns({"kind": F.concat_ws("|", "kind", F.col("island").cast("string")), "island": F.col("_at")}).drop("_at", "_other")
    return rows


def assign_clusters(signals: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """Distinct signal rows with ``cluster`` (creation index in the island), ``n`` and marks.

    A row appears once per cluster it contributes to; ``is_mid`` marks the middle member in arrival
    order and ``is_rt`` the middle one among members with both flank and tail lengths.
    """
    return _assigned(distinct_rows(signals), p)


def _assigned(rows: DataFrame, p: MergeParams) -> DataFrame:
    attrs = sorted(c for c in rows.columns if c not in {"ctg", "n", *SIGNATURE})
    rows = rows.withColumn("has_rt", F.col("tsd_len").isNotNull() & F.col("polya_len").isNotNull())
    placed = scan_islands(
        with_groups(rows, p),
        ["ctg", "kind"],
        [*SIGNATURE, *attrs],
        [*SIGNATURE, "n", "has_rt"],
        [("cluster", T.LongType()), ("n_in", T.LongType()), ("is_mid", T.BooleanType()), ("is_rt", T.BooleanType())],
        lambda emit: VoteScan(emit, p),
    )
    return placed.drop("n").withColumnRenamed("n_in", "n")


def cluster_reads(signals: DataFrame, p: MergeParams = MergeParams(), whole: bool = False, deep: int = DEEP) -> DataFrame:
    """``ctg, kind, island, cluster`` and the signal columns: every supporting read in its own row.

    The rows themselves are scanned, in the order of ``assign_clusters`` and then by read, so nothing is joined
    back.  A zero length matches nothing, so the copies of such a row may sit in different clusters; they
    take these in read order.  With ``whole``, islands are not cut at the gaps of the other end, and their clusters are
    numbered in the order of their first rows: rows move once, to a scan that finds the islands in segments.
    """
    rows = with_optional(signals)
    cols = rows.columns
    if whole:
        return _whole_islands(rows, p, deep)
    attrs = sorted(c for c in cols if c not in {"ctg", "read", *SIGNATURE})
    placed = scan_islands(
        with_groups(rows, p), ["ctg", "kind"], [*SIGNATURE, *attrs, "read"], SIGNATURE, [("cluster", T.LongType())], lambda emit: ReadScan(emit, p)
    )
    return placed.select(*CLUSTER_KEY, *[c for c in cols if c != "ctg"])


def _whole_islands(rows: DataFrame, p: MergeParams, deep: int) -> DataFrame:
    """``cluster_reads`` with ``whole``; only chains of cells with more than ``deep`` rows are cut before they are spread."""
    cols = rows.columns
    attrs = sorted(c for c in cols if c not in {"ctg", "read", *SIGNATURE})
    light, dense = with_segment(rows.withColumn("kind", _kind(p)), ["ctg", "kind"], "pos", p.window, deep)
    types = {f.name: f.dataType for f in light.schema.fields}
    out = [T.StructField(c, types[c]) for c in ("ctg", "kind", *[c for c in cols if c != "ctg"])]
    out += [T.StructField(c, T.LongType()) for c in ("island", "cluster")]
    single = ClusterScan(p, [])

    def settled(t: pa.Table, starts: np.ndarray) -> pa.Table:
        first = np.repeat(numbers(t["pos"])[starts], np.diff(np.append(starts, t.num_rows)))
        return t.append_column("island", pa.array(first)).append_column("cluster", pa.array(np.zeros(t.num_rows, np.int64)))

    def tables() -> IslandTables:
        plain = (lambda t, island, starts: np.zeros(len(starts), bool)) if p.max_alleles is not None else single._single
        return IslandTables(lambda emit: ReadScan(emit, p), SIGNATURE, "pos", [("cluster", pa.int64())], plain, settled)

    placed = scan_segments(light, ["ctg", "kind"], [*SIGNATURE, *attrs, "read"], "pos", p.window, T.StructType(out), tables)
    order = [*CLUSTER_KEY, *[c for c in cols if c != "ctg"]]
    if dense is None:
        return placed.select(*order)
    # Clusters are numbered within what the other ends leave of an island; here they are in order of their first rows.
    island = ["ctg", "_plain", "island"]
    cut = cluster_reads(dense.drop("kind"), p).withColumn("_plain", F.regexp_replace("kind", r"\|-?\d+$", "") if p.max_alleles is None else F.col("kind"))
    first = F.min(F.struct(*SIGNATURE, *attrs)).over(Window.partitionBy(*island, "kind", "cluster"))
    number = F.dense_rank().over(Window.partitionBy(*island).orderBy("_first", "kind", "cluster")) - 1
    cut = cut.repartition(*island).withColumn("_first", first).withColumn("cluster", number.cast("bigint"))
    return placed.select(*order).unionByName(cut.withColumn("kind", F.col("_plain")).select(*order))


def summarise(placed: DataFrame) -> DataFrame:
    """One row per cluster: representative, supports by source and strand, and orientation counts."""
    n = F.col("n")
    rep_cols = [
        c for c in placed.columns if c not in {*CLUSTER_KEY, "n", "has_rt", "is_mid", "is_rt", "source"}
    ]
    arrival = F.struct(*SIGNATURE, *sorted({*rep_cols, "source"} - set(SIGNATURE)))
    # First per source, then per cluster: the second step only sees one row per (cluster, source).
    when = lambda c: F.sum(F.when(c, n).otherwise(0))
    fwd = F.col("strand") == "+"
    by_source = placed.groupBy(*CLUSTER_KEY, "source").agg(
        F.sum("n").alias("n"),
        when(fwd).alias("n_fwd"),
        F.sum(F.col("mapq").cast("bigint") * n).alias("mapq_sum"),
        when(F.col("ori") == "><").alias("count_fr"),
        when(F.col("ori") == "<>").alias("count_rf"),
        F.min(arrival).alias("first_seen"),
        F.max(F.when(F.col("is_mid"), F.struct(*rep_cols))).alias("rep"),
        F.max(F.when(F.col("is_rt"), F.least("tsd_len", F.abs("polya_len")))).alias("rt_len"),
    )
    support = F.concat(
        "source", F.lit(":"), F.col("n_fwd").cast("string"), F.lit(","), (F.col("n") - F.col("n_fwd")).cast("string")
    )
    sums = by_source.groupBy(*CLUSTER_KEY).agg(
        F.sum("n").alias("n_reads"),
        F.sum("n_fwd").alias("n_fwd"),
        F.floor(F.sum("mapq_sum") / F.sum("n") + 0.5).cast("bigint").alias("avg_mapq"),
        F.array_join(
            F.transform(
                F.sort_array(F.collect_list(F.struct("first_seen", "source", support.alias("text")))),
                lambda s: s["text"],
            ),
            "|",
        ).alias("count"),
        F.max("rep").alias("rep"),
        F.coalesce(F.max("rt_len"), F.lit(0)).cast("bigint").alias("rt_len"),
        F.sum("count_fr").alias("count_fr"),
        F.sum("count_rf").alias("count_rf"),
        F.array_join(F.sort_array(F.collect_list("source")), ",").alias("sources"),
    )
    return sums.select(
        *CLUSTER_KEY, "n_reads", "n_fwd", "avg_mapq", "count", "sources", "rt_len", "count_fr", "count_rf", "rep.*"
    )


class ClusterScan:
    """Tables of whole islands to one row per cluster.

    Where every row matches one of the ``BACK`` rows before it in its island, each joins the only open cluster: such
    islands are settled for a whole table at once.  The others are scanned row by row.
    """

    BACK = 4

    def __init__(self, p: MergeParams, rep: list[str]):
        self.p, self.rep = p, rep
        self.found: list[tuple] = []
        self.votes: VoteScan | None = None
        self.at: int = 0

    def whole(self, t: pa.Table, starts: np.ndarray):
        size = np.diff(np.append(starts, t.num_rows))
        island = np.repeat(np.arange(len(starts)), size)
        first = numbers(t["pos"])[starts]
        plain = np.zeros(len(starts), bool) if self.p.max_alleles is not None else self._single(t, island, starts)
        rows = np.flatnonzero(plain[island])
        if len(rows):
            part = t if len(rows) == t.num_rows else t.take(pa.array(rows))
            yield self._summary(part, island[rows], first[island[rows]], np.zeros(len(rows), np.int64), numbers(part["n"]))
        rows = np.flatnonzero(~plain[island])
        if len(rows):
            part = t if len(rows) == t.num_rows else t.take(pa.array(rows))
            values, own = _votable(part), island[rows]
            votes = last = None
            for i, v in enumerate(values):
                if own[i] != last:
                    if votes is not None:
                        votes.close()
                    last, votes = own[i], VoteScan(lambda table, i, cluster, n, *_: self.found.append((table, i, cluster, n)), self.p)
                votes.row(part, i, v)
            votes.close()
            yield self._flushed(lambda picked: (own[picked], first[own[picked]]))

    def part(self, t: pa.Table, last: bool):
        if self.votes is None:
            self.votes = VoteScan(lambda table, i, cluster, n, *_: self.found.append((table, i, cluster, n)), self.p)
            self.at = int(t["pos"][0].as_py())
        t = t.combine_chunks()
        for i, v in enumerate(_votable(t)):
            self.votes.row(t, i, v)
        if last:
            self.votes.close()
            self.votes = None
        if self.found:
            yield self._flushed(lambda picked: (np.zeros(len(picked), np.int64), np.full(len(picked), self.at)))

    def _flushed(self, placed) -> pa.Table:
        """Clusters that are settled; all rows of a cluster were found together, in arrival order."""
        rows = gathered([f[:2] for f in self.found])
        picked, cluster, n = (np.array([f[k] for f in self.found], np.int64) for k in (1, 2, 3))
        self.found = []
        island, first = placed(picked)
        order = np.lexsort((np.arange(len(picked)), cluster, island))
        return self._summary(rows.take(pa.array(order)), island[order], first[order], cluster[order], n[order])

    def _single(self, t: pa.Table, island: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Islands in which every row but the first matches one of the rows just before it, and no length is zero."""
        w, pos, bp, size = self.p.window, numbers(t["pos"]), numbers(t["is_bp"]), numbers(t["svlen"])
        ori, ty, ctg2 = (codes(t[c]) for c in ("ori", "svtype", "ctg2"))
        turned = _equal(t["ori"], "><") | _equal(t["ori"], "<>")
        end = np.where(bp, numbers(t["pos2"]), numbers(t["en"]))
        known = ~t["svlen"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        ok = np.zeros(t.num_rows, bool)
        ok[starts] = True
        for back in range(1, min(self.BACK, t.num_rows - 1) + 1):
            a, b = slice(None, -back), slice(back, None)
            same = (island[a] == island[b]) & (pos[b] - pos[a] <= w) & (bp[a] == bp[b]) & (ty[a] == ty[b]) & (np.abs(end[a] - end[b]) <= w)
            same &= ~bp[a] | ((ctg2[a] == ctg2[b]) & ((ori[a] == ori[b]) | (turned[a] & turned[b])))
            x, y = np.abs(size[a]), np.abs(size[b])
            alike = (np.sign(size[a]) == np.sign(size[b])) & (np.abs(x - y) <= 0.5 * (x + y) * self.p.max_len_diff)
            ok[b] |= same & (alike | ~known[a] | ~known[b])
        ok &= ~(known & (size == 0))
        return np.logical_and.reduceat(ok, starts)

    def _summary(self, t: pa.Table, island, first, cluster, n) -> pa.Table:
        """One row per (island, cluster); rows are in that order and then in arrival order."""
        new = np.ones(t.num_rows, bool)
        new[1:] = (island[1:] != island[:-1]) | (cluster[1:] != cluster[:-1])
        starts = np.flatnonzero(new)
        own = np.cumsum(new) - 1
        total = lambda x: np.add.reduceat(x, starts)

        def middle(weight):
            """The row at place n div 2 of each cluster, counted by ``weight``."""
            upto = np.cumsum(weight)
            return np.searchsorted(upto, upto[starts] - weight[starts] + (total(weight) >> 1), side="right")

        fwd = np.where(_equal(t["strand"], "+"), n, 0)
        null = lambda c: t[c].combine_chunks().is_null().to_numpy(zero_copy_only=False)
        has_q, has_rt = ~null("mapq"), ~(null("tsd_len") | null("polya_len"))
        quality = total(numbers(t["mapq"]).astype(np.int64) * n)
        rt = np.where(has_rt, n, 0)
        mid_rt = np.minimum(middle(rt), t.num_rows - 1)
        rt_len = np.minimum(numbers(t["tsd_len"]), np.abs(numbers(t["polya_len"])))[mid_rt]
        names = t["source"].combine_chunks().dictionary_encode()
        word = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        _, seen, back = np.unique(own * (len(names.dictionary) + 1) + word, return_index=True, return_inverse=True)
        by_time = np.argsort(seen)
        per = lambda x: np.bincount(back, x, len(seen)).astype(np.int64)[by_time]  # noqa: E731  # exact: counts stay under 2^53
        entry = pa.StructArray.from_arrays(
            [t["source"].combine_chunks().take(pa.array(seen[by_time])), pa.array(per(n)), pa.array(per(fwd))], ["source", "n", "n_fwd"]
        )
        ends = np.searchsorted(own[seen[by_time]], np.arange(len(starts) + 1))
        cols = {
            "island": pa.array(first[starts]), "cluster": pa.array(cluster[starts]), "n_reads": pa.array(total(n)), "n_fwd": pa.array(total(fwd)),
            "mapq_sum": pa.array(quality, mask=~np.logical_or.reduceat(has_q, starts)),
            "by_source": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entry),
            "rt_len": pa.array(np.where(total(rt) > 0, rt_len, 0)),
            "count_fr": pa.array(total(np.where(_equal(t["ori"], "><"), n, 0))), "count_rf": pa.array(total(np.where(_equal(t["ori"], "<>"), n, 0))),
        }
        rep = t.select(["ctg", "kind", *self.rep]).take(pa.array(middle(n)))
        for name, c in cols.items():
            rep = rep.append_column(name, c)
        return rep


def _equal(column: pa.ChunkedArray, value: str) -> np.ndarray:
    return pc.equal(column.combine_chunks(), value).fill_null(False).to_numpy(zero_copy_only=False)


def _votable(t: pa.Table):
    """Signature, count and whether both flank and tail lengths are there, row by row."""
    cols = [t[c].to_pylist() for c in (*SIGNATURE, "n", "tsd_len", "polya_len")]
    for *sig, n, tsd, polya in zip(*cols):
        yield (*sig, n, tsd is not None and polya is not None)


def clusters(signals: DataFrame, p: MergeParams = MergeParams(), deep: int = DEEP) -> DataFrame:
    """``summarise(assign_clusters(signals, p))``, summed up where the rows are scanned.

    Distinct rows are written once; a segment of positions is one ordered scan, which finds the islands in it.
    Only chains of cells with more than ``deep`` distinct rows are cut into islands before they are spread.
    """
    rows = distinct_rows(signals).withColumn("kind", _kind(p))
    rows = written(rows)
    light, dense = with_segment(rows, ["ctg", "kind"], "pos", p.window, deep)
    rep = [c for c in rows.columns if c not in {"ctg", "kind", "n", "source"}]
    attrs = sorted(c for c in rows.columns if c not in {"ctg", "kind", "n", *SIGNATURE})
    types = {f.name: f.dataType for f in rows.schema.fields}
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    entry = T.StructType([T.StructField("source", T.StringType()), *longs("n", "n_fwd")])
    out = [T.StructField(c, types[c]) for c in ("ctg", "kind", *rep)]
    out += [*longs("island", "cluster", "n_reads", "n_fwd", "mapq_sum"), T.StructField("by_source", T.ArrayType(entry)), *longs("rt_len", "count_fr", "count_rf")]
    found = scan_segments(light, ["ctg", "kind"], [*SIGNATURE, *attrs], "pos", p.window, T.StructType(out), lambda: ClusterScan(p, rep))
    support = lambda s: F.concat(s["source"], F.lit(":"), s["n_fwd"].cast("string"), F.lit(","), (s["n"] - s["n_fwd"]).cast("string"))
    found = found.withColumns({
        "avg_mapq": F.floor(F.col("mapq_sum") / F.col("n_reads") + 0.5).cast("bigint"),
        "count": F.array_join(F.transform("by_source", support), "|"),
        "sources": F.array_join(F.sort_array("by_source.source"), ","),
    })
    head = [*CLUSTER_KEY, "n_reads", "n_fwd", "avg_mapq", "count", "sources", "rt_len", "count_fr", "count_rf"]
    found = found.select(*head, *rep)
    return found if dense is None else found.unionByName(summarise(_assigned(dense.drop("kind"), p)))


def passes(p: MergeParams) -> Column:
    """Reporting filter of a summarised cluster."""
    c = F.col
    near_cen = F.coalesce(c("cen_overlap") > 0, F.lit(False)) | F.coalesce(
        c("cen_dist") <= p.min_cen_dist, F.lit(False)
    )
    both_strands = (c("n_fwd") >= p.min_count_strand) & (c("n_reads") - c("n_fwd") >= p.min_count_strand)
    plain = (c("n_reads") >= p.min_count) & both_strands
    rescued = c("rt_len") >= p.min_rt_len
    enough = F.when(rescued, c("n_reads") >= p.min_count_rt).otherwise(plain) if p.min_rt_len > 0 else plain
    return enough & ~near_cen if p.min_cen_dist > 0 else enough


def merge_signals(signals: DataFrame, p: MergeParams = MergeParams()) -> DataFrame:
    """Calls supported by enough reads."""
    calls = clusters(signals, p).filter(passes(p))
    return calls.withColumn(
        "foldback",
        (F.col("count_fr") + F.col("count_rf") > 0)
        & (F.col("count_fr") * F.col("count_rf") == 0)
        & F.coalesce(F.col("ctg") == F.col("ctg2"), F.lit(False)),
    )


def only_sources(calls: DataFrame, include: str, exclude: str) -> DataFrame:
    """Calls seen in one sample and not in another, by their per-source counts."""
    has = lambda s: F.array_contains(F.split("sources", ","), s)
    return calls.filter(has(include) & ~has(exclude))
