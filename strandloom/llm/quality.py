"""Quality by positive-unlabelled learning.

The learner sees trusted positives and unlabelled web text only, never a negative label:

1. every whole text becomes a fixed list of numbers (``FEATURES``): shares of kinds of bytes, word lengths,
   repetition of words, neighbours and lines;
2. a first model, trained on one half of both samples, tells positives from unlabelled texts in the other
   half, and the other way round; the share of positives among unlabelled texts (the class prior) is the
   smallest ratio, over thresholds, of the unlabelled to the positive texts above it, each share widened by
   its sampling error;
3. the model is trained on the non-negative unbiased risk: prior times the positives' loss, plus the
   unlabelled texts' loss as negatives less prior times the positives' loss as negatives, where the second
   part may not fall below zero.

The model is logistic over bins of each number, so it is one weight per bin.  Positives and unlabelled texts
are bounded samples of rows (``max_positive``, ``max_unlabelled``, by the hash of the id, within an id by row
number); scores are made for every text.

Defined cases: null and empty texts have all numbers zero and get a score like any other; null labels are not
used; without any positive every score is 0.5.
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

FEATURES = [
    "upper", "lower", "digit", "space", "line_end", "bar", "symbol", "shout", "stop", "comma", "other_ascii", "beyond_ascii",
    "log_words", "word_length", "long_words", "distinct_words", "top_word", "same_as_before", "distinct_pairs", "marked_words",
    "words_per_line", "distinct_lines",
]


@dataclass(frozen=True)
class PuParams:
    max_positive: int = 20_000
    max_unlabelled: int = 20_000
    bins: int = 12
    steps: int = 1_500
    rate: float = 2.0
    ridge: float = 1e-4
    min_recall: float = 0.1


def _byte_kinds() -> np.ndarray:
    """A number for each byte: which of the first twelve features it counts for."""
    kind = np.full(256, 10, np.int64)
    kind[65:91], kind[97:123], kind[48:58], kind[128:] = 0, 1, 2, 11
    for i, marks in ((3, " \t"), (4, "\n\r"), (5, "|"), (6, "%$&#*@^~<>=+{}[]\\_"), (7, "!?"), (8, "."), (9, ",;:")):
        kind[[ord(c) for c in marks]] = i
    return kind


def _distinct(owner: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and how often its most frequent one occurs."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, owner))
    o, k = owner[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (o[1:] != o[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(k)))
    top = np.zeros(n)
    np.maximum.at(top, o[at], runs)
    return np.bincount(o[at], minlength=n).astype(float), top


def text_numbers(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for each text."""
    data, at = text_bytes(texts)
    n = len(at) - 1
    out = np.zeros((n, len(FEATURES)))
    length = np.maximum(np.diff(at), 1)
    kinds = _byte_kinds()[data]
    for i in range(12):
        out[:, i] = np.diff(np.searchsorted(np.flatnonzero(kinds == i), at)) / length
    starts, ends, bounds = word_spans(data, at)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    count = np.diff(bounds)
    some = np.maximum(count, 1)
    words = span_hashes(data, starts, ends)
    size = ends - starts
    per = lambda w, o=owner: np.bincount(o, w, minlength=n)
    distinct, top = _distinct(owner, words, n)
    out[:, 12], out[:, 13], out[:, 14] = np.log1p(count), per(size) / some, per(size > 12) / some
    out[:, 15], out[:, 16] = distinct / some, top / some
    if len(words) > 1:
        same = owner[1:] == owner[:-1]
        out[:, 17] = per((words[1:] == words[:-1])[same], owner[1:][same]) / some
        pairs, _ = _distinct(owner[1:][same], chain(words[:-1], words[1:])[same], n)
        out[:, 18] = pairs / np.maximum(count - 1, 1)
    if len(words):
        out[:, 19] = per(np.isin(kinds[ends - 1], (5, 6, 7))) / some
    ends_at = np.union1d(np.flatnonzero(data == 10) + 1, at[1:])
    ends_at = ends_at[ends_at > 0]
    line_starts = np.concatenate(([0], ends_at[:-1])).astype(np.int64)
    line_owner = np.searchsorted(at, line_starts, side="right") - 1
    full = (ends_at > line_starts) & (line_owner < n)
    lines, _ = _distinct(line_owner[full], span_hashes(data, line_starts[full], ends_at[full]), n)
    n_lines = np.maximum(np.bincount(line_owner[full], minlength=n), 1)
    out[:, 20], out[:, 21] = np.log1p(count / n_lines), lines / n_lines
    return out


def numbers(docs: DataFrame, keep: dict[str, Column], text_col: str) -> DataFrame:
    """``x`` (array of double) of every whole text beside the columns of ``keep``."""
    names = [*keep, "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            x = text_numbers(batch.column(batch.num_columns - 1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=names)

    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).cast("string").alias("_text"))
    kinds = "".join(f"`{n}` {t}, " for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(run, f"{kinds}x array<double>")


def _binned(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of the weight of each feature's bin."""
    bins = edges.shape[1] + 1
    return np.stack([np.searchsorted(edges[j], x[:, j], side="right") + j * bins for j in range(x.shape[1])], axis=1)


def _sigmoid(f: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(f, -30, 30)))


def _descend(parts, n_weights: int, prior: float | None, p: PuParams) -> tuple[np.ndarray, float]:
    """Weights and bias; with a prior by the non-negative risk, without one positives against the rest."""
    pos, rest = parts
    w, b = np.zeros(n_weights), 0.0
    vel, vel_b = np.zeros(n_weights), 0.0
    for _ in range(p.steps):
        fp, fu = w[pos].sum(axis=1) + b, w[rest].sum(axis=1) + b
        if prior is None:
            gp, gu = (_sigmoid(fp) - 1) / len(fp) / 2, _sigmoid(fu) / len(fu) / 2
        else:
            negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
            if negative >= 0:
                gp = prior * (_sigmoid(fp) - 1) / len(fp) - prior * _sigmoid(fp) / len(fp)
                gu = _sigmoid(fu) / len(fu)
            else:  # walk back until the estimate of the negatives' risk is possible again
                gp, gu = prior * _sigmoid(fp) / len(fp), -_sigmoid(fu) / len(fu)
        g = np.bincount(pos.ravel(), np.repeat(gp, pos.shape[1]), n_weights) + np.bincount(rest.ravel(), np.repeat(gu, rest.shape[1]), n_weights)
        vel = 0.9 * vel - p.rate * (g + p.ridge * w)
        vel_b = 0.9 * vel_b - p.rate * (gp.sum() + gu.sum()) / pos.shape[1]
        w, b = w + vel, b + vel_b
    return w, b


def class_prior(positive: np.ndarray, rest: np.ndarray, min_recall: float) -> float:
    """Smallest share ratio above a threshold of the scores, each share widened by its sampling error."""
    cuts = np.quantile(positive, np.linspace(0.0, 1.0 - min_recall, 200))
    above = lambda s: 1.0 - np.searchsorted(np.sort(s), cuts, side="left") / len(s)
    err = lambda s: 0.3 * np.sqrt(np.log(4 * len(s)) / (2 * len(s)))
    top, low = above(rest) + err(rest), np.maximum(above(positive) - err(positive), 1e-9)
    k = int(np.argmin(top / low))
    return float(np.clip(above(rest)[k] / above(positive)[k], 0.01, 0.99))


def fit(positive: np.ndarray, rest: np.ndarray, p: PuParams) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Bin edges, weights, bias and the estimated prior."""
    both = np.concatenate((positive, rest))
    edges = np.quantile(both, np.linspace(0, 1, p.bins + 1)[1:-1], axis=0).T
    extra = np.stack([np.quantile(both, q, axis=0) for q in (0.01, 0.03, 0.97, 0.99)], axis=1)
    edges = np.sort(np.concatenate((edges, extra), axis=1), axis=1)
    n_weights = both.shape[1] * (edges.shape[1] + 1)
    parts = _binned(positive, edges), _binned(rest, edges)
    # Each half of both samples is scored by a model that has seen the other half only.
    seen: list[list[np.ndarray]] = [[], []]
    for half in (0, 1):
        w, _ = _descend([x[half::2] for x in parts], n_weights, None, p)
        for scores, x in zip(seen, parts):
            scores.append(w[x[1 - half :: 2]].sum(axis=1))
    prior = class_prior(*[np.concatenate(scores) for scores in seen], p.min_recall)
    w, b = _descend(parts, n_weights, prior, p)
    return edges, w, b, prior


def train(rows: DataFrame, labels: DataFrame, label: Column, learn: Column, p: PuParams, id_col: str) -> tuple | None:
    """Fit in one task on the bounded samples of ``rows`` (``doc_id, x``)."""
    good = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), label.cast("int").alias("y")).filter(learn & (F.col("y") == 1))
    good = good.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    every = written(rows.groupBy("doc_id").agg(F.count("*").alias("n")).withColumn("m", F.lit(1)), "ids")
    known = every.join(good, "doc_id", "left_semi")
    total, n_good = (groups.agg(F.sum("n")).first()[0] or 0 for groups in (every, known))
    positive = sampled(rows, known, F.lit(sample_rate(p.max_positive, n_good)), 3).select(F.lit(1).alias("y"), "doc_id", "x")
    rest = sampled(rows, every, F.lit(sample_rate(p.max_unlabelled, total)), 4).select(F.lit(0).alias("y"), "doc_id", "x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ys, xs = [], []
        for batch in batches:
            ys.append(np.asarray(batch.column(0)))
            xs.append(np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1))
        if not ys:
            return
        y, x = np.concatenate(ys), np.concatenate(xs)
        if not (y == 1).any() or not (y == 0).any():
            return
        edges, w, b, prior = fit(x[y == 1], x[y == 0], p)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array([a.ravel().tolist()], pa.list_(pa.float64())) for a in (edges, w)], pa.array([b]), pa.array([prior])],
            names=["edges", "w", "b", "prior"],
        )

    one = positive.unionByName(rest).repartition(1).sortWithinPartitions("y", F.xxhash64("doc_id"), "doc_id", "x").select("y", "x")
    got = one.mapInArrow(run, "edges array<double>, w array<double>, b double, prior double").collect()
    if not got:
        return None
    return np.array(got[0]["edges"]).reshape(len(FEATURES), -1), np.array(got[0]["w"]), got[0]["b"], got[0]["prior"]


def scored(docs: DataFrame, labels: DataFrame, learn: Column | None = None, p: PuParams = PuParams(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` of every document; positives are the rows of ``labels`` with quality 1 that ``learn`` allows."""
    rows = written(numbers(docs, {"doc_id": F.col(id_col).cast("bigint")}, text_col), "numbers")
    model = train(rows, labels, F.col("quality"), F.lit(True) if learn is None else learn, p, id_col)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = shipped.value
        for batch in batches:
            if not batch.num_rows:
                continue
            if made is None:
                points = np.full(batch.num_rows, 0.5)
            else:
                x = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
                points = _sigmoid(made[1][_binned(x, made[0])].sum(axis=1) + made[2])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points)], names=["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")
