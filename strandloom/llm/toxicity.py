"""Toxicity: logistic regression over hashed word n-grams, trained by FTRL-proximal.

Features of a text are 32-bit hashes of what occurs in it: words, pairs of neighbours, pairs with a gap of
one (skip-grams), and the first 4, 5 and 6 bytes of words, which carry over to other endings.  A word loses
outer punctuation; A-Z is lower-cased.  Every feature counts once per text.

Training sees a bounded sample of labelled rows (``max_toxic`` and ``max_clean`` rows, ``max_bytes`` of text of
each kind, by the hash of the id, within an id by row number), once per epoch in hash order.  Every coordinate has its own learning rate, and L1 keeps weights at zero
that the labels do not support, so what is shipped to the scoring tasks is a short sorted list.  Features
seen in one sampled text only are left out.

Scoring reads every whole text.  Defined cases: null and empty texts score as texts without features;
labels that are null or neither 0 nor 1 are not learned from; ids that repeat in the labels are all used;
without labelled rows every score is 0.5 and nothing is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.rows import sample_rate, sampled
from strandloom.llm.scratch import written
from strandloom.llm.words import chain, small_batches, span_hashes, text_bytes, word_spans

PREFIXES = (4, 5, 6)
#: ASCII marks that are cut off at both ends of a word.
MARKS = np.zeros(256, dtype=bool)
MARKS[[ord(c) for c in ".,;:!?\"'()[]{}*%$&#|-_/"]] = True


@dataclass(frozen=True)
class FtrlParams:
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 0.1
    epochs: int = 10
    max_toxic: int = 3_000
    max_clean: int = 9_000
    max_bytes: int = 64 << 20


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(text number, feature)`` of everything that occurs in the texts, not yet made distinct."""
    data, at = text_bytes(texts)
    starts, ends, bounds = word_spans(data, at)
    owner = np.repeat(np.arange(len(at) - 1), np.diff(bounds))
    for _ in range(3):
        if len(starts):
            starts = starts + ((ends - starts > 1) & MARKS[data[starts]])
            ends = ends - ((ends - starts > 1) & MARKS[data[ends - 1]])
    words = span_hashes(data, starts, ends)
    found, of = [words], [owner]
    for gap in (1, 2):
        if len(words) > gap:
            same = owner[gap:] == owner[:-gap]
            found.append(chain(words[:-gap], words[gap:], np.full(len(words) - gap, gap, np.uint64))[same])
            of.append(owner[gap:][same])
    for n in PREFIXES:
        long = ends - starts > n
        found.append(chain(span_hashes(data, starts[long], starts[long] + n), np.full(int(long.sum()), n, np.uint64)))
        of.append(owner[long])
    return np.concatenate(of), (np.concatenate(found) >> np.uint64(32)).astype(np.uint32)


def distinct_features(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct features of each text."""
    owner, found = text_features(texts)
    both = np.unique(owner.astype(np.uint64) << np.uint64(32) | found)
    cuts = np.searchsorted(both >> np.uint64(32), np.arange(1, len(texts)))
    return np.split((both & np.uint64(0xFFFFFFFF)).astype(np.uint32), cuts)


def ftrl(rows: list[np.ndarray], labels: list[int], n_features: int, p: FtrlParams) -> tuple[np.ndarray, float]:
    """Weights and bias after the epochs; ``rows`` hold feature numbers below ``n_features``."""
    z, n = np.zeros(n_features + 1), np.zeros(n_features + 1)

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= p.l1, 0.0, -(zi - np.sign(zi) * p.l1) / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2))

    rows = [np.append(r, n_features) for r in rows]
    for _ in range(p.epochs):
        for at, y in zip(rows, labels):
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -30, 30))) - y
            ni = n[at]
            z[at] += g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / p.alpha * w
            n[at] = ni + g * g
    w = weights(np.arange(n_features + 1))
    return w[:-1], float(w[-1])


def sample_of(docs: DataFrame, labels: DataFrame, label: Column, learn: Column, p: FtrlParams, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, y, text`` of the sampled rows.

    Labels and rows are counted per id before they meet.  The picked ids are few and are shipped, the texts are
    read in one scan and not shuffled.
    """
    ids = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), label.cast("int").alias("y"))
    ids = ids.filter(learn & F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id", "y").agg(F.count("*").alias("m"))
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint"))
    groups = written(texts.groupBy("doc_id").agg(F.count("*").alias("n"), size.alias("bytes")).join(ids, "doc_id"), "ids")
    sums = groups.groupBy("y").agg(F.sum(F.col("n") * F.col("m")).alias("n"), F.sum(F.col("bytes") * F.col("m")).alias("bytes"))
    sums = {r["y"]: (r["n"], r["bytes"]) for r in sums.collect()}
    rate = {}
    for y, most in ((1, p.max_toxic), (0, p.max_clean)):
        n, held = sums.get(y, (0, 0))
        rate[y] = min(sample_rate(most, n), sample_rate(p.max_bytes, held))
    groups = groups.drop("bytes")
    picked = sampled(texts, groups, F.when(F.col("y") == 1, rate[1]).otherwise(rate[0]), 11)
    return picked.select("doc_id", "y", "text")


def train(sample: DataFrame, p: FtrlParams = FtrlParams()) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature hashes (sorted), their weights, and the bias.

    Features are taken from the texts where they lie; one task then runs through the bounded sample.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            packed = [f.tobytes() for f in distinct_features(batch.column(2))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(packed, pa.binary())], names=["doc_id", "y", "features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, ys = [], []
        for batch in batches:
            ys += batch.column(0).to_pylist()
            rows += [np.frombuffer(x.as_buffer(), np.uint32) for x in batch.column(1)]
        if not rows or len(set(ys)) < 2:
            return
        # Features of two texts or more, one range of hashes at a time: the whole sample is never copied.
        known = []
        for lo in range(0, 1 << 32, 1 << 27):
            every = np.sort(np.concatenate([r[np.searchsorted(r, lo) : np.searchsorted(r, lo + (1 << 27))] for r in rows]))
            known.append(np.unique(every[:-1][every[1:] == every[:-1]]))
        known = np.concatenate(known)
        if not len(known):
            return
        for i, r in enumerate(rows):
            at = np.minimum(np.searchsorted(known, r), len(known) - 1)
            rows[i] = at[known[at] == r].astype(np.int32)
        w, bias = ftrl(rows, ys, len(known), p)
        some = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(known[some].astype(np.int64), -1)), pa.array(np.append(w[some], bias))], names=["feature", "weight"]
        )

    packed = sample.mapInArrow(extract, "doc_id long, y int, features binary")
    one = packed.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "features").select("y", "features")
    got = one.mapInArrow(fit, "feature long, weight double").toPandas()
    bias = float(got.weight[got.feature < 0].sum())
    got = got[got.feature >= 0].sort_values("feature")
    return got.feature.to_numpy(np.uint32), got.weight.to_numpy(np.float64), bias


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text_col: str, keep: dict[str, Column]) -> DataFrame:
    """``score`` (0 to 1) of every row beside the columns of ``keep``."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    names = [*keep, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, weights, bias = shipped.value
        gate = np.zeros(1 << 16, bool)
        gate[known >> np.uint32(16)] = True
        for batch in small_batches(batches, "_text"):
            owner, found = text_features(batch.column(batch.num_columns - 1))
            total = np.full(batch.num_rows, bias)
            if len(known):
                near = np.flatnonzero(gate[found >> np.uint32(16)])
                at = np.minimum(np.searchsorted(known, found[near]), len(known) - 1)
                hit = known[at] == found[near]
                pairs = np.unique(owner[near][hit].astype(np.int64) * len(known) + at[hit])
                total += np.bincount(pairs // len(known), weights[pairs % len(known)], minlength=batch.num_rows)
            points = 1.0 / (1.0 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(points)], names=names)

    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).cast("string").alias("_text"))
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}, score double")


def classified(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    p: FtrlParams = FtrlParams(),
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: dict[str, Column] | None = None,
) -> DataFrame:
    """``score`` of every document, learned from the rows of ``labels`` (``doc_id, toxic``) that ``learn`` allows."""
    learn = F.lit(True) if learn is None else learn
    model = train(sample_of(docs, labels, F.col("toxic"), learn, p, id_col, text_col), p)
    return score(docs, model, text_col, keep or {"doc_id": F.col(id_col).cast("bigint")})
