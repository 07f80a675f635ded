"""Classifiers on held-out rows, nearest neighbours against brute force, the pipeline end to end."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandloom.llm import ann, quality, toxicity

BAD = ["nasty", "vile", "rotten"]


def words(rng, n):
    return [rng.choice(["the", "of", "and", "river", "stone"]) + rng.choice(["", "s", "ing", f"{rng.randrange(50)}"]) for _ in range(n)]


def labelled_docs(seed=1, n=240):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 120))
        toxic, poor = i % 4 == 0, i % 5 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(BAD) + rng.choice(["", ","]))
        if poor:
            w = [x + "%%%" for x in w]
        docs.append((i, " ".join(w) + "."))
        labels.append((i, int(not poor), int(toxic)))
    docs += [(900, None), (901, ""), (None, "the stone"), (902, "river " * 9000), (3, docs[3][1])]
    labels += [(None, 1, 1), (5000, 1, 0), (901, None, None), (3, 1, 0)]
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = labelled_docs()
    return (
        spark.createDataFrame([(i, t, 0.5) for i, t in docs], "doc_id long, text string, score double"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        docs,
    )


def test_toxicity(spark, tables):
    docs, labels, rows = tables
    got = toxicity.classified(docs, labels, learn=F.col("doc_id") % 3 != 1).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 3 == 1]
    assert sum((r["score"] >= 0.5) == (r["doc_id"] % 4 == 0) for r in held) >= 0.95 * len(held)
    scores = {r["doc_id"]: r["score"] for r in got}
    assert scores[900] == scores[901]
    none = toxicity.classified(docs, labels.limit(0)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert toxicity.classified(docs.limit(0), labels).count() == 0


def test_ftrl_is_sparse():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(1, 400, 40), [0] if i % 2 else [])).astype(np.int64) for i in range(200)]
    w, _ = toxicity.ftrl(rows, [i % 2 for i in range(200)], 400, toxicity.FtrlParams())
    assert w[0] == w.max() and (w != 0).mean() < 0.3


def test_quality(spark, tables):
    docs, labels, rows = tables
    p = quality.PuParams(steps=400)
    got = quality.scored(docs, labels, learn=F.col("doc_id") % 7 != 0, p=p).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 240 and r["doc_id"] % 7 == 0]
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 5 != 0) for r in held) >= 0.9 * len(held)
    assert {r["score"] for r in quality.scored(docs, labels.filter("quality = 0"), p=p).collect()} == {0.5}
    assert quality.scored(docs.limit(0), labels, p=p).count() == 0


def test_class_prior():
    rng = np.random.default_rng(1)
    pos, rest = rng.normal(2, 1, 4000), np.concatenate((rng.normal(2, 1, 2800), rng.normal(-2, 1, 1200)))
    assert quality.class_prior(pos, rest, 0.1) == pytest.approx(0.7, abs=0.06)


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0] * 3), (2005, [float("inf")] * 16), (None, [1.0] * 16), (2006, [])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    p = ann.AnnParams(block_rows=400, query_rows=9)
    got = ann.search(df, F.col("vec_id") % 20 == 0, p).collect()
    v = x.astype(float)
    unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
    hit = total = 0
    for q in range(0, 1500, 20):
        s = unit @ unit[q]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == [1, 2, 3, 4, 5] and q not in {r["vec_id"] for r in mine}
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in mine)
        s[q] = -9
        best = set(np.lexsort((np.arange(1500), -s.round(12)))[:5].tolist())
        hit, total = hit + len(best & {r["vec_id"] for r in mine}), total + 5
    assert hit / total >= 0.9
    assert {r["query_id"] for r in got} == set(range(0, 1500, 20))
    assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 100), key=lambda r: r["rank"])] == [101, 102, 103, 104, 105]
    few = ann.search(df.filter("vec_id < 3"), F.col("vec_id") == 0, p).collect()
    assert len(few) == 2 and ann.search(df.limit(0), F.col("vec_id") == 0, p).count() == 0


def test_samples_are_bounded_whatever_the_ids(spark, monkeypatch):
    """A third of the rows has one id and a third has none; each kind is in the samples by its share."""
    docs = spark.createDataFrame([(7 if i % 3 == 0 else None if i % 3 == 1 else i, f"word {i}") for i in range(3000)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1, 1)] * 3 + [(i, 1, i % 2) for i in range(2, 3000, 3)], "doc_id long, quality int, toxic int")
    got = toxicity.sample_of(docs, labels, F.col("toxic"), F.lit(True), toxicity.FtrlParams(max_toxic=350, max_clean=100), "doc_id", "text").collect()
    toxic = [r for r in got if r["y"] == 1]
    assert 280 <= len(toxic) <= 420 and 70 <= len(got) - len(toxic) <= 130
    assert 0.8 <= sum(r["doc_id"] == 7 for r in toxic) / len(toxic) <= 0.92 and len({r["text"] for r in toxic}) > 200
    seen = {}

    def fit(positive, rest, p):
        seen.update(positive=len(positive), rest=len(rest))
        raise ValueError("seen " + repr(seen))

    monkeypatch.setattr(quality, "fit", fit)
    with pytest.raises(Exception, match="seen") as caught:
        quality.scored(docs, labels, p=quality.PuParams(max_positive=200, max_unlabelled=300))
    n = [int(x) for x in re.search(r"'positive': (\d+), 'rest': (\d+)", str(caught.value)).groups()]
    assert 150 <= n[0] <= 250 and 240 <= n[1] <= 360


@pytest.mark.parametrize("scaled", [False, True])
def test_copies_of_a_vector_do_not_end_the_search(scaled):
    """A third of the rows has one direction; the neighbours of the others are found as well as without it."""
    ids = np.arange(1500)
    for seed in (1, 4):
        rng = np.random.default_rng(seed)
        x = rng.standard_normal((1500, 64))
        x[500:1000] = x[500]
        if scaled:
            x[500:1000] *= rng.uniform(0.5, 2, (500, 1))
        index, unit, hit = ann.BlockIndex(ids, x, ann.AnnParams()), x / np.sqrt((x * x).sum(axis=1))[:, None], 0
        for q in range(0, 500, 5):
            s = (unit @ unit[q]).round(12)
            s[q] = -9
            best = set(np.lexsort((ids, -s))[:5].tolist())
            hit += len(best & {i for _, i in index.nearest(q, x[q])})
        assert hit / 500 >= 0.95


def test_repeated_ids_are_one_candidate():
    ids, x = np.array([1, 1, 1, 2, 3, 3, 4, 9]), np.ones((8, 4))
    x[7] = [1, 2, 3, 4]
    got = ann.BlockIndex(ids, x, ann.AnnParams(k=3)).nearest(1, x[0])
    assert [i for _, i in got] == [2, 3, 4]


def test_pipeline(spark, tmp_path):
    docs, labels = labelled_docs(2, 160)
    docs = [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(docs)]
    base = " ".join(f"n{i}" for i in range(100))
    docs += [(2000 + k, base + f" tail{k}", "de", "s1", 5) for k in range(4)] + [(2010, base.upper() + " TAIL0", "de", None, 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = str(tmp_path / f"out{k}")
        stage(spark, now, str(tmp_path)).write.parquet(out)
        last, now = now, spark.read.parquet(out)
        seen.append((last.collect(), now.collect()))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == last.columns
    toxic = {r["doc_id"] for r in seen[0][0]} - {r["doc_id"] for r in seen[0][1]}
    assert toxic and all(i % 4 == 0 for i in toxic)
    texts = [(r["text"] or "").lower() for r in seen[1][1]]
    assert len(texts) == len(set(texts)) and set(texts) == {(r["text"] or "").lower() for r in seen[1][0]}
    assert [r["doc_id"] for r in seen[2][1] if (r["doc_id"] or 0) >= 2000 and "n5" in r["text"].lower()] == [2001]
    assert {r["doc_id"] for r in seen[2][0]} - {r["doc_id"] for r in seen[2][1]} == {2002, 2003, 2010}
    assert {r["doc_id"] for r in seen[3][1]} <= {r["doc_id"] for r in seen[3][0]}
    assert sorted(r["decoded"] for r in seen[4][1]) == sorted(r["text"] or "" for r in seen[4][0])
