"""Mixing sources to target weights by a low-discrepancy schedule.

1. Each source's documents are shuffled by a hash and laid end to end: a stream of words, cut into blocks
   of equal size.  The size is the source's own, so that a small source has as many slots as a large one.
2. Slot ``k`` of the schedule gets the point ``frac(k / golden ratio)``, and the source whose span of the
   cumulative slot numbers holds it.  A source's slots come evenly all along the schedule.
3. Slots are ranked per source; they take the blocks of its stream in order, around and around, until its
   target is reached: the last slot takes only the words that are left, later slots of the source stay empty.
   What the points have left out (a few slots) follows after the last one.  So each source gets its target,
   rounded to a word.

Targets share all words by weight; a target above ``max_repeats`` times its source is cut to that, and the
excess is shared again by weight until none is above.

Running sums go over (source, hash cell) and then within a cell, so a source with a third of all rows is no
single task.  Points are integers of 32 bits: no rounding, and reruns agree.

Defined cases: null texts and texts without words have size 0 and are never taken; null sources are a
source of their own, the last; documents with equal ids are separate documents; no words at all give
targets of 0.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from strandloom.llm.rows import text_key
from strandloom.llm.scratch import written
from strandloom.llm.words import count_words, small_batches, text_bytes

#: Golden ratio less 1, times 2**32.
GOLDEN = 2654435769
BINS = 4096
#: Words of a block at most; slots of a source at least, if its target has so many words.
MAX_BLOCK = 1024
LEAST_SLOTS = 1024
CELLS = 1024


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``uid, doc_id, text_key, source, size`` of every row; ``size`` counts words."""

    def run(batches):
        for batch in small_batches(batches, "_text"):
            n = count_words(*text_bytes(batch.column(4)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(n, pa.int64())], names=["uid", "doc_id", "text_key", "source", "size"])

    rows = docs.select(
        F.monotonically_increasing_id().alias("uid"),
        F.col(id_col).cast("bigint").alias("doc_id"),
        text_key(text_col).alias("text_key"),
        F.col(source_col).cast("string").alias("source"),
        F.col(text_col).cast("string").alias("_text"),
    )
    return rows.mapInArrow(run, "uid long, doc_id long, text_key long, source string, size long")


def targets(sized: DataFrame, weights: list[float], max_repeats: int = 3) -> DataFrame:
    """``source, no, weight, source_size, target``: one row per source, in code point order, null last.

    In order of size over weight, the sources that hit their limit come first: those whose weight's share
    of what the ones before them leave is above their limit.
    """
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    named = total.withColumn("no", F.row_number().over(by_name) - 1)
    shares = F.array(*[F.lit(float(w)) for w in weights])
    named = named.withColumn("weight", F.get(shares, F.pmod(F.col("no"), F.lit(len(weights)))))
    most = F.lit(float(max_repeats)) * F.col("source_size")
    by_limit = Window.orderBy(most / F.col("weight"), "no")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = named.withColumn("_rate", left / weight_left).withColumn("_most", most)
    filled = filled.withColumn("_over", F.col("_rate") * F.col("weight") >= F.col("_most"))
    rate = F.min(F.when(~F.col("_over"), F.struct(most / F.col("weight"), "no", "_rate"))).over(everything)["_rate"]
    target = F.when(F.col("_over"), F.col("_most")).otherwise(rate * F.col("weight"))
    return filled.select("source", "no", "weight", "source_size", target.alias("target"))


def running(df: DataFrame, group: str, cell: Column, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over the earlier rows of the group; rows of smaller cells come first."""
    df = df.withColumn("_cell", cell).withColumn("_value", value)
    cells = df.groupBy(group, "_cell").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(group, "_cell", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_cell").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    out = df.join(cells, [group, "_cell"])
    return out.withColumn(name, F.col("_base") + F.col("_inside")).drop("_cell", "_value", "_base", "_inside")


def golden_point(k: Column) -> Column:
    """``k * GOLDEN`` modulo 2**32, in halves so that no product overflows."""
    low, high = F.pmod(k, F.lit(1 << 16)), F.pmod(F.shiftright(k, 16), F.lit(1 << 16))
    upper = F.pmod(high * F.lit(GOLDEN), F.lit(1 << 16)) * F.lit(1 << 16)
    return F.pmod(low * F.lit(GOLDEN) + upper, F.lit(1 << 32))


def with_slots(wanted: DataFrame) -> DataFrame:
    """Adds ``block, n_blocks, laps, rest, n_slots``: a source's stream is taken ``laps`` times, then ``rest`` words.

    A block has ``MAX_BLOCK`` words, or less where the source would have fewer than ``LEAST_SLOTS`` slots.
    """
    out = wanted.withColumn("_words", F.round("target").cast("bigint"))
    out = out.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(MAX_BLOCK), F.expr(f"_words div {LEAST_SLOTS}"))))
    out = out.withColumn("n_blocks", F.expr("(source_size + block - 1) div block"))
    out = out.withColumn("laps", F.expr("_words div greatest(source_size, 1)"))
    out = out.withColumn("rest", F.expr("_words - laps * source_size"))
    return out.withColumn("n_slots", F.expr("laps * n_blocks + (rest + block - 1) div block")).drop("_words")


def schedule(wanted: DataFrame) -> DataFrame:
    """``slot, no, rank, block_no, upto, whole``: a row per taken block, up to word ``upto`` of the stream.

    The spans of the sources are cut at the edges of equal bins, so a slot meets the few sources of its bin.
    """
    spark = wanted.sparkSession
    n_slots = wanted.agg(F.sum("n_slots")).first()[0] or 0
    order = Window.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.sum("n_slots").over(order) / F.lit(float(max(1, n_slots)))
    spans = wanted.filter("n_slots > 0").withColumn("_hi", F.round(upto * F.lit(float(1 << 32))).cast("bigint"))
    spans = spans.withColumn("_lo", F.coalesce(F.lag("_hi").over(Window.orderBy("no")), F.lit(0).cast("bigint")))
    width = (1 << 32) // BINS
    bins = F.sequence(F.floor(F.col("_lo") / width), F.floor((F.col("_hi") - 1) / width))
    spans = spans.filter("_hi > _lo").select("no", "_lo", "_hi", F.explode(bins).alias("_bin"))
    slots = spark.range(n_slots).select(F.col("id").alias("slot"), golden_point(F.col("id")).alias("_point"))
    slots = slots.withColumn("_bin", F.floor(F.col("_point") / width))
    dealt = slots.join(spans, "_bin").filter("_point >= _lo and _point < _hi").select("slot", "no")
    ranked = running(dealt, "no", F.floor(F.col("slot") / 8192), [F.col("slot")], F.lit(1).cast("bigint"), "rank")
    got = dealt.groupBy("no").agg(F.count("*").alias("_got"))
    short = wanted.select("no", "n_slots").join(got, "no", "left").withColumn("_got", F.coalesce("_got", F.lit(0)))
    short = short.filter("_got < n_slots").withColumn("_base", F.sum(F.col("n_slots") - F.col("_got")).over(order) - F.col("n_slots"))
    late = short.select("no", "_base", F.explode(F.sequence("_got", F.col("n_slots") - 1)).alias("rank"))
    late = late.select((F.lit(n_slots) + F.col("_base") + F.col("rank")).alias("slot"), "no", "rank")
    every = ranked.select("slot", "no", "rank").unionByName(late)
    every = every.join(wanted.select("no", "source_size", "block", "n_blocks", "laps", "rest", "n_slots"), "no").filter("rank < n_slots")
    every = every.withColumn("lap", F.expr("rank div n_blocks")).withColumn("block_no", F.expr("rank % n_blocks"))
    end = F.least((F.col("block_no") + 1) * F.col("block"), F.when(F.col("lap") < F.col("laps"), F.col("source_size")).otherwise(F.col("rest")))
    return every.select("slot", "no", "rank", "block_no", end.alias("upto"), (F.col("lap") < F.col("laps")).alias("whole"))


def placed(sized: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """Documents with words in their source's shuffled stream: ``no``, ``start`` (words before them)."""
    # Rows of one id are told apart by their texts, rows without id by their numbers: no id gathers in one cell.
    key = F.xxhash64("doc_id", "text_key", F.when(F.col("doc_id").isNull(), F.col("uid")), F.lit(seed))
    rows = sized.filter("size > 0").join(
        wanted.select("no", "block", "laps", "rest", F.col("source").alias("_source")),
        F.col("source").eqNullSafe(F.col("_source")),
    )
    rows = rows.drop("source", "_source").withColumn("_key", key)
    cell = F.shiftrightunsigned("_key", 64 - CELLS.bit_length() + 1)
    return running(rows, "no", cell, [F.col("_key"), F.col("doc_id"), F.col("uid")], F.col("size"), "start").drop("_key")


def pieces_of(where: DataFrame) -> DataFrame:
    """``no, block_no, lo, hi`` of the parts of documents that lie in blocks, without blocks that are never taken."""
    first, last = F.expr("start div block"), F.expr("(start + size - 1) div block")
    last = F.when(F.col("laps") == 0, F.least(last, F.expr("(rest - 1) div block"))).otherwise(last)
    rows = where.filter("laps > 0 or start < rest")
    rows = rows.select("uid", "doc_id", "no", "start", "size", "block", F.explode(F.sequence(first, last)).alias("block_no"))
    rows = rows.withColumn("lo", F.greatest(F.col("start"), F.col("block_no") * F.col("block")))
    return rows.withColumn("hi", F.least(F.col("start") + F.col("size"), (F.col("block_no") + 1) * F.col("block")))


def takes(slots: DataFrame) -> DataFrame:
    """``no, block_no, n_taken, upto``: how often each block is taken whole, and how far it is taken once more."""
    once_more = F.coalesce(F.max(F.when(~F.col("whole"), F.col("upto"))), F.lit(0))
    return slots.groupBy("no", "block_no").agg(F.count_if("whole").alias("n_taken"), once_more.alias("upto"))


def mix(
    docs: DataFrame,
    weights: list[float],
    max_repeats: int = 3,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """One row per document: ``uid, doc_id, text_key, source, size, source_size, target, taken, copies``.

    ``taken`` counts the words that the mix takes of it, repeats included; ``copies`` how often it takes its
    middle word, which is how often the whole document is repeated in a mix of whole documents.
    """
    sized = written(sizes(docs, id_col, text_col, source_col), "sizes")
    wanted = written(with_slots(targets(sized, weights, max_repeats)), "targets")
    middle = F.col("start") + F.floor(F.col("size") / 2)
    used = pieces_of(placed(sized, wanted, seed)).join(takes(schedule(wanted)), ["no", "block_no"])
    more = F.greatest(F.lit(0), F.least("hi", "upto") - F.col("lo"))
    used = used.groupBy("uid").agg(
        F.sum((F.col("hi") - F.col("lo")) * F.col("n_taken") + more).alias("taken"),
        F.max(F.when((middle >= F.col("lo")) & (middle < F.col("hi")), F.col("n_taken") + (middle < F.col("upto")).cast("bigint"))).alias("copies"),
    )
    named = wanted.select(F.col("source").alias("_source"), "source_size", "target")
    rows = sized.join(named, F.col("source").eqNullSafe(F.col("_source"))).join(used, "uid", "left")
    zero = F.lit(0).cast("bigint")
    return rows.select(
        "uid", "doc_id", "text_key", "source", "size", "source_size", "target",
        F.coalesce("taken", zero).alias("taken"), F.coalesce("copies", zero).alias("copies"),
    )


def sequence_of(docs: DataFrame, weights: list[float], max_repeats: int = 3, seed: int = 7, **cols: str) -> DataFrame:
    """The mix itself: ``slot, doc_id, first_word, n_words`` in the order of the schedule's slots."""
    sized = written(sizes(docs, **cols), "sizes")
    wanted = written(with_slots(targets(sized, weights, max_repeats)), "targets")
    out = schedule(wanted).join(pieces_of(placed(sized, wanted, seed)), ["no", "block_no"])
    n = F.least("hi", "upto") - F.col("lo")
    return out.select("slot", "doc_id", (F.col("lo") - F.col("start")).alias("first_word"), n.alias("n_words")).filter("n_words > 0")
