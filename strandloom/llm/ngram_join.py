"""Jaccard self-join of documents over word n-grams, as a blocked sparse product with bounds.

The incidence matrix has a row per distinct shingle set and a column per n-gram.  The product of the
matrix with its transpose counts overlaps; only entries that can reach the threshold are computed:

* equal sets collapse to one row first;
* n-grams are put in one global order, rare ones first, and a row enters the product with so many of its
  first n-grams that two sets above the threshold must meet in one of them (bounds from their sizes);
* within a column, sizes and positions bound the overlap that is still possible, and parity bits of the sets
  bound it again; pairs below are discarded;
* a column whose rows are linked already needs no more pairs.  So a column is worked off in rounds: every
  row against the column's first row (as many pairs as rows), components of the links found, then the rows
  of different components only.  The last round takes all pairs of rows of different components, so no
  link is lost whatever the earlier rounds did.

Pairs that remain are verified exactly on the whole sets, in blocks of one set against many.

The order comes from a table of counters of fixed size over the n-grams of all documents.  It decides how
much work there is, never the result.

Sets and n-grams are told apart by 64-bit hashes.  A document without words has the empty set and is linked
with nothing; null texts count as empty; rows that repeat an id are separate rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.components import components
from strandloom.llm.rows import text_key
from strandloom.llm.scratch import written
from strandloom.llm.words import chain, mix, shingle_sets, small_batches

COUNTERS = 1 << 20
SEGMENTS = 16
BITMAP = 1 << 23
HOT = 10_000
SKETCH_WORDS = 8
SKETCH = "struct<" + ", ".join(f"w{k}: bigint" for k in range(SKETCH_WORDS)) + ">"
SIGNATURES = "uid long, doc_id long, text_key long, n_shingles long, set_id long, segment int, counts binary"


def _set_id(grams: np.ndarray) -> int:
    """A 64-bit hash of a sorted set: order-dependent sums of well mixed values."""
    if not len(grams):
        return 0
    step = mix(np.arange(1, len(grams) + 1, dtype=np.uint64))
    with np.errstate(over="ignore"):
        a, b = np.sum(mix(grams ^ step)), np.sum(mix(grams + step))
    return int(chain(np.array([a]), np.array([b]), np.array([len(grams)], np.uint64)).view(np.int64)[0])


def _counter(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(44)).astype(np.int64)


def signatures(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """A row per document with its set's size and hash, and after each task's rows its n-gram counters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTERS, np.int64)
        for batch in small_batches(batches, "_text"):
            sets = shingle_sets(batch.column(3), width)
            if sets:
                counts += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS)
            n = len(sets)
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3],
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_set_id(s) for s in sets], pa.int64()),
                    pa.nulls(n, pa.int32()),
                    pa.nulls(n, pa.binary()),
                ],
                schema=schema,
            )
        if counts.any():
            parts = [zlib.compress(p.astype("<u4").tobytes(), 1) for p in np.split(counts, SEGMENTS)]
            blank = [pa.nulls(SEGMENTS, pa.int64())] * 5
            yield pa.RecordBatch.from_arrays([*blank, pa.array(range(SEGMENTS), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    long, kinds = pa.int64(), {"segment": pa.int32(), "counts": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds.get(c.split()[0], long)) for c in SIGNATURES.split(", ")])
    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        text_key(text_col).alias("text_key"),
        F.col(text_col).cast("string").alias("_text"),
    )
    return rows.mapInArrow(run, SIGNATURES)


def _summed_counters(signed: DataFrame) -> np.ndarray:
    """The counters of all tasks, added up per segment; ``COUNTERS`` numbers reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for seg, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = np.frombuffer(zlib.decompress(packed.as_buffer()), "<u4").astype(np.int64)
                sums[seg] = sums[seg] + part if seg in sums else part
        for seg, part in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([seg], pa.int32()), pa.array([part.astype("<i8").tobytes()], pa.binary())], names=["segment", "counts"])

    parts = signed.filter("segment is not null").select("segment", "counts").repartition(SEGMENTS, "segment")
    total = np.zeros((SEGMENTS, COUNTERS // SEGMENTS), np.int64)
    for row in parts.mapInArrow(add, "segment int, counts binary").collect():
        total[row["segment"]] = np.frombuffer(row["counts"], "<i8")
    return total.ravel()


def _need(x: np.ndarray | int, percent: int):
    """Probe prefix: n-grams of a set of size ``x`` of which a linked set of at most that size has one."""
    return x - -(-x * percent // 100) + 1


def _need_index(x: Column, percent: int) -> Column:
    """Index prefix: the same against sets of at least that size."""
    return x - F.ceil(x * (2 * percent) / (100 + percent)) + 1


def incidence(docs: DataFrame, order: np.ndarray, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """``gram, part, set_id, size, pos``: the first n-grams of every set, rare ones first.

    Copies of a set within a task are left out.  A gram that the counters call hot is dealt over parts from 1 on.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen = shipped.value, set()
        usual = float(np.median(counters))
        for batch in small_batches(batches, "_text"):
            out: list[tuple] = []
            for grams in shingle_sets(batch.column(0), width):
                n = len(grams)
                me = _set_id(grams)
                if not n or me in seen:
                    continue
                seen.add(me)
                often = counters[_counter(grams)]
                first = np.lexsort((grams, often))[: _need(n, percent)]
                parts = np.maximum((often[first] - usual) // HOT, 0).astype(np.int64) + 1
                part = np.where(parts > 1, (me & 0x7FFFFFFF) % parts + 1, 0)
                out.append((grams[first].view(np.int64), part, np.full(len(first), me), np.full(len(first), n), np.arange(len(first))))
            if len(seen) > 500_000:
                seen = set()
            if out:
                cols = [np.concatenate(c) for c in zip(*out)]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["gram", "part", "set_id", "size", "pos"])

    return docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, "gram long, part int, set_id long, size int, pos int")


def shared_columns(rows: DataFrame, percent: int) -> DataFrame:
    """The rows of columns with two sets or more, each with its column's first set (``c_*``).

    One sorted pass: nothing is held but a column's first row.  Parts of a hot column keep all rows.  Two rows
    that are alone in their column and cannot reach the threshold there are left out.
    """
    names = ["gram", "part", "set_id", "size", "pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, written_first = None, True  # the open column's first row, and whether it went out
        last = None
        for batch in batches:
            cols = [np.asarray(c) for c in batch.columns]
            if not len(cols[0]):
                continue
            if last is not None:
                cols = [np.concatenate(([h], c)) for h, c in zip(last, cols)]
            g, p, d = cols[:3]
            fresh = np.ones(len(g), bool)
            fresh[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1]) | (d[1:] != d[:-1])
            if last is not None:
                fresh[0] = False  # seen with the batch before
            last = [c[-1] for c in cols]
            cols = [c[fresh] for c in cols]
            if not len(cols[0]):
                continue
            if held is not None:
                cols = [np.concatenate(([h], c)) for h, c in zip(held, cols)]
            g, p = cols[:2]
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (p[1:] != p[:-1])
            at = np.flatnonzero(new)
            n = np.diff(np.append(at, len(g)))
            head = np.repeat(at, n)
            go = np.repeat(n > 1, n) | (p > 0)
            two = at[:-1][(n[:-1] == 2) & (p[at[:-1]] == 0)]  # the last column may go on
            if held is not None and written_first:
                two = two[two > 0]
            a, i, b, j = (c[k].astype(np.int64) for k in (two, two + 1) for c in (cols[3], cols[4]))
            meet = (np.minimum(a - i, b - j) * (100 + percent) >= (a + b) * percent) & (np.minimum(a, b) * 100 >= np.maximum(a, b) * percent)
            go[two[~meet]] = go[two[~meet] + 1] = False
            was_out = written_first if held is not None else False
            held = [c[at[-1]] for c in cols]
            out_now = bool(go[at[-1]])
            if was_out:
                go[0] = False
                out_now = out_now or at[-1] == 0
            written_first = out_now
            keep = np.flatnonzero(go)
            if len(keep):
                h = head[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0][keep]), *[pa.array(c[keep]) for c in cols[2:]], *[pa.array(c[h]) for c in cols[2:]]],
                    names=["gram", "set_id", "size", "pos", "c_id", "c_size", "c_pos"],
                )

    sorted_rows = rows.repartition("gram", "part").sortWithinPartitions("gram", "part", "set_id")
    return sorted_rows.select(*names).mapInArrow(run, "gram long, set_id long, size int, pos int, c_id long, c_size int, c_pos int")


def _possible(size_a: str, pos_a: str, size_b: str, pos_b: str, percent: int) -> Column:
    """Whether two sets whose first common n-gram has these positions can still reach the threshold.

    Where the pair meets later again this may say no, but its first meeting says yes if the pair is linked.
    """
    a, b, i, j = (F.col(c).cast("bigint") for c in (size_a, size_b, pos_a, pos_b))
    overlap = F.least(a - i, b - j)
    return (overlap * (100 + percent) >= (a + b) * percent) & (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _differ_little(size_a: str, size_b: str, sketch_a: str, sketch_b: str, percent: int) -> Column:
    """Whether the parity bits allow the threshold: bits that differ are at most the n-grams that differ."""
    both = F.col(size_a).cast("bigint") + F.col(size_b).cast("bigint")
    most = both - 2 * F.ceil(both * percent / (100 + percent))
    bits = [F.bit_count(F.col(f"{sketch_a}.w{k}").bitwiseXOR(F.col(f"{sketch_b}.w{k}"))) for k in range(SKETCH_WORDS)]
    return sum(bits[1:], bits[0]) <= most


def _parities(grams: np.ndarray) -> list[int]:
    """Parity of the n-grams per bit of ``64 * SKETCH_WORDS``."""
    bits = np.bincount((mix(grams) >> np.uint64(32)).astype(np.int64) % (64 * SKETCH_WORDS), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(bits.astype(np.uint8)).view(">i8").tolist()


def _bitmap(sets: DataFrame) -> np.ndarray:
    """A bit per ``set_id`` modulo ``BITMAP``: of fixed size, so it can be shipped whatever the table's size."""
    bits = sets.select(F.pmod("set_id", F.lit(BITMAP)).alias("bit")).distinct()
    slot, place = F.bitmap_bucket_number(F.col("bit") + 1), F.bitmap_bit_position(F.col("bit") + 1)
    filled = np.zeros(BITMAP // 8, np.uint8)
    for row in bits.groupBy(slot.alias("bucket")).agg(F.bitmap_construct_agg(place).alias("bits")).collect():
        at = (row["bucket"] - 1) * 4096
        filled[at : at + 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return filled


def _let_through(filled: np.ndarray, ids: np.ndarray) -> np.ndarray:
    k = ids % BITMAP
    return (filled[k >> 3] >> (k & 7).astype(np.uint8) & 1).astype(bool)


def candidate_texts(docs: DataFrame, shared: DataFrame, width: int, text_col: str) -> DataFrame:
    """``set_id, sketch, text`` of the sets in ``shared`` and of a few more that the bitmap lets through."""
    shipped = docs.sparkSession.sparkContext.broadcast(_bitmap(shared))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, seen = shipped.value, set()
        for batch in small_batches(batches, "_text"):
            sets = shingle_sets(batch.column(0), width)
            ids = np.array([_set_id(grams) for grams in sets], np.int64)
            at = []
            for i in np.flatnonzero(_let_through(known, ids)).tolist():
                if len(sets[i]) and ids[i] not in seen:
                    seen.add(ids[i])
                    at.append(i)
            if len(seen) > 500_000:
                seen = set()
            if at:
                words = list(zip(*[_parities(sets[i]) for i in at]))
                sketch = pa.StructArray.from_arrays([pa.array(w, pa.int64()) for w in words], names=[f"w{k}" for k in range(SKETCH_WORDS)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), sketch, batch.column(0).take(pa.array(at))], names=["set_id", "sketch", "text"])

    return docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(run, f"set_id long, sketch {SKETCH}, text string")


def _asked_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The texts of the pairs' sets and of a few more, so that little is shuffled."""
    sets = pairs.select(F.explode(F.array("a", "b")).alias("set_id"))
    shipped = pairs.sparkSession.sparkContext.broadcast(_bitmap(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shipped.value
        for batch in batches:
            yield batch.filter(pa.array(_let_through(known, np.asarray(batch.column(0)))))

    return texts.select("set_id", "text").mapInArrow(run, "set_id long, text string")


def overlaps(pairs: DataFrame, texts: DataFrame, width: int, block: int = 256) -> DataFrame:
    """``a, b, overlap, size_a, size_b`` of every pair (``a, b``), counted on the whole sets.

    Blocks of one set ``a`` and up to about ``block`` sets ``b`` stream through a task, which holds one set.
    """
    n_parts = F.ceil(F.count("*") / F.lit(block))
    many = pairs.groupBy("a").agg(n_parts.alias("parts"))
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.col("b"), F.col("parts")))
    asked = dealt.select("a", "part", F.col("b").alias("set_id"), F.lit(1).alias("role"))
    heads = many.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    asked = asked.unionByName(heads.select("a", "part", F.col("a").alias("set_id"), F.lit(0).alias("role")))
    lined_up = asked.join(_asked_texts(pairs, texts), "set_id").repartition("a", "part").sortWithinPartitions("a", "part", "role", "set_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, grams_a, last = None, None, None
        for batch in small_batches(batches, "text"):
            found = []
            cols = [batch.column(i).to_pylist() for i in range(4)]
            for a, part, me, role, grams in zip(*cols, shingle_sets(batch.column(4), width)):
                if (a, part, me, role) == last:
                    continue  # a copy of the set from another task
                last = (a, part, me, role)
                if role == 0:
                    head, grams_a = (a, part), grams
                elif head == (a, part):
                    at = np.minimum(np.searchsorted(grams_a, grams), len(grams_a) - 1)
                    found.append((a, me, int(np.count_nonzero(grams_a[at] == grams)), len(grams_a), len(grams)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b", "overlap", "size_a", "size_b"])

    return lined_up.select("a", "part", "set_id", "role", "text").mapInArrow(run, "a long, b long, overlap long, size_a long, size_b long")


def _linked(counted: DataFrame, percent: int) -> DataFrame:
    enough = F.col("overlap") * 100 >= (F.col("size_a") + F.col("size_b") - F.col("overlap")) * percent
    return counted.filter(enough).select("a", "b")


def _could_link(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (``a, b, size_a, size_b``) whose sketches allow the threshold."""
    side = lambda c: sketches.select(F.col("set_id").alias(c), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.filter("a != b").distinct().join(side("a"), "a").join(side("b"), "b")
    return both.filter(_differ_little("size_a", "size_b", "sketch_a", "sketch_b", percent)).select("a", "b")


def labelled(shared: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of the columns that still meet more than one component, with their component."""
    rows = shared.select("gram", "set_id", "size", "pos").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left")
    rows = rows.withColumn("comp", F.coalesce("label", "set_id")).drop("label")
    open_grams = rows.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi")
    return rows.join(open_grams.select("gram"), "gram", "left_semi")


def star_pairs(rows: DataFrame, turn: int, percent: int) -> DataFrame:
    """Every row of an open column against one row of its largest component, and against one other row."""
    point = F.xxhash64("set_id", F.lit(turn))
    comps = rows.groupBy("gram", "comp").agg(F.count("*").alias("n"), F.min(F.struct(point.alias("k"), "set_id", "size", "pos", "comp")).alias("pick"))
    picks = comps.groupBy("gram").agg(F.max(F.struct("n", "pick")).alias("x"), F.min("pick").alias("y"))
    heads = picks.select("gram", F.explode(F.array("x.pick", "y")).alias("h"))
    heads = heads.select("gram", *[F.col(f"h.{c}").alias(f"c_{n}") for c, n in (("set_id", "id"), ("size", "size"), ("pos", "pos"), ("comp", "comp"))])
    met = rows.join(heads, "gram").filter((F.col("comp") != F.col("c_comp")) & _possible("size", "pos", "c_size", "c_pos", percent))
    return met.select(F.col("c_id").alias("a"), F.col("set_id").alias("b"), F.col("c_size").alias("size_a"), F.col("size").alias("size_b"))


def product_pairs(rows: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Pairs of rows of different components that meet in a column and that all bounds allow.

    The larger set probes with its longer prefix, the smaller one is found by its shorter one.  The bounds
    are part of the join, so a pair that cannot reach the threshold is never made.
    """
    rows = rows.join(sketches, "set_id")
    small = rows.filter(F.col("pos") < _need_index(F.col("size").cast("bigint"), percent))
    cols = ("set_id", "size", "pos", "comp", "sketch")
    x, y = (df.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in cols]) for df, s in ((rows, "x"), (small, "y")))
    first = F.expr("comp_x != comp_y and (size_x > size_y or (size_x = size_y and set_id_x > set_id_y))")
    possible = _possible("size_x", "pos_x", "size_y", "pos_y", percent) & _differ_little("size_x", "size_y", "sketch_x", "sketch_y", percent)
    met = x.join(y, "gram").filter(first & possible)
    return met.select(F.col("set_id_x").alias("a"), F.col("set_id_y").alias("b")).distinct()


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after more links: only labels that a new link joins are walked."""
    if labels is None:
        return written(components(links), "labels")
    to = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    lifted = links.join(to("a"), "a", "left").join(to("b"), "b", "left")
    lifted = lifted.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    moved = components(lifted)
    old = labels.join(moved.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left")
    old = old.select("node", F.coalesce("to", "label").alias("label"))
    new = moved.join(labels.select("node"), "node", "left_anti").select("node", "label")
    return written(old.unionByName(new), "labels")


def joined(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    star_turns: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``uid, doc_id, text_key, n_shingles, set_id, component_id, kept``.

    ``component_id`` is the smallest id reachable by links; ``kept`` marks one row of each component, the
    one with the smallest id (null ids last, then the earliest row).
    """
    signed = written(signatures(docs, width, id_col, text_col), "signatures")
    order = _summed_counters(signed)
    shared = written(shared_columns(incidence(docs, order, width, percent, id_col, text_col), percent), "shared")
    texts = written(candidate_texts(docs, shared, width, text_col), "texts")

    sketches = written(texts.select("set_id", "sketch").dropDuplicates(["set_id"]), "sketches")

    first = shared.filter("set_id != c_id").filter(_possible("size", "pos", "c_size", "c_pos", percent))
    first = first.select(F.col("c_id").alias("a"), F.col("set_id").alias("b"), F.col("c_size").alias("size_a"), F.col("size").alias("size_b"))
    asked = written(_could_link(first, sketches, percent), "pairs")
    labels = _merge(None, _linked(overlaps(asked, texts, width), percent))
    for turn in range(star_turns + 1):
        rows = written(labelled(shared, labels), "open")
        new = _could_link(star_pairs(rows, turn, percent), sketches, percent) if turn < star_turns else product_pairs(rows, sketches, percent)
        for known in (asked, asked.select(F.col("a").alias("b"), F.col("b").alias("a"))):
            new = new.join(known, ["a", "b"], "left_anti")
        new = written(new, "pairs")
        labels = _merge(labels, _linked(overlaps(new, texts, width), percent))
        asked = asked.unionByName(new)

    rows = signed.filter("segment is null").drop("segment", "counts")
    some = F.col("n_shingles") > 0
    best = F.min(F.struct(F.coalesce("doc_id", F.lit((1 << 63) - 1)).alias("doc_id"), "uid")).alias("best")
    sets = rows.filter(some).groupBy("set_id").agg(best, F.count("*").alias("copies"))
    sets = sets.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("label", "set_id"))
    roots = sets.groupBy("root").agg(F.min("best").alias("first"))
    several = sets.filter("copies > 1 or label is not null").join(roots, "root").select("set_id", "first")
    out = rows.join(several, "set_id", "left")
    alone = ~some | F.col("first").isNull()
    whole = F.when(alone, F.col("doc_id")).otherwise(F.when(F.col("first.doc_id") < (1 << 63) - 1, F.col("first.doc_id")))
    return out.select(
        "uid", "doc_id", "text_key", "n_shingles", "set_id", whole.alias("component_id"), (alone | (F.col("first.uid") == F.col("uid"))).alias("kept")
    )
