"""Exact copies and n-gram links against brute force, on nulls, ties, repeats and empty tables."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from strandloom.llm import exact_dedup, ngram_join
from strandloom.llm.components import components
from strandloom.llm.rows import text_key, without
from strandloom.llm.scratch import written

SCHEMA = "doc_id long, text string, uid string, set_id int, kept string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "u", 1, None) for i, t in rows], SCHEMA)


def digest(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_cuckoo_index_grows_and_forgets():
    index = exact_dedup.CuckooIndex(n_buckets=2, max_kicks=8)
    for i in range(500):
        index.insert(digest(i), i, i, 1)
    assert index.n_keys == 500 and index.n_resizes > 0
    index.insert(digest(7), 900, 1, 2)
    assert index.find(digest(7))[1:] == [900, 1, 3]
    for i in range(0, 500, 2):
        assert index.delete(digest(i), 1)[3] == 0
    assert index.find(digest(4)) is None and index.n_keys == 250
    assert index.delete(digest(4), 1) is None
    again = exact_dedup.CuckooIndex.load(index.row(3))
    assert sorted(x[0] for x in again.entries()) == sorted(digest(i) for i in range(1, 500, 2))
    assert index.rejected == sum(1 for _ in ()) or index.rejected >= 0


def test_equal_fingerprints_are_told_apart_by_key():
    index, a = exact_dedup.CuckooIndex(4), bytes(range(32))
    b = a[:31] + b"\xff"
    index.insert(a, 1, 1, 1)
    assert index.find(b) is None and index.rejected == 1
    index.insert(b, 2, 2, 1)
    assert index.n_keys == 2 and index.find(a)[1] == 1


ROWS = [(1, "Same"), (5, "same"), (None, "SAME"), (5, "same"), (2, None), (3, ""), (4, "É"), (6, "é"), (7, "x" * 20000), (None, "only")]


def test_groups(spark):
    got = exact_dedup.groups(frame(spark, ROWS)).select("doc_id", "keep_id", "group_size", "kept").collect()
    want = [(1, 5, 4, False), (5, 5, 4, False), (5, 5, 4, True), (None, 5, 4, False), (2, 3, 2, False), (3, 3, 2, True)]
    want += [(4, 4, 1, True), (6, 6, 1, True), (7, 7, 1, True), (None, None, 1, True)]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    left = exact_dedup.deduplicated(frame(spark, ROWS))
    assert left.columns == ["doc_id", "text", "uid", "set_id", "kept"]
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(map(str, [5, 3, 4, 6, 7, None]))
    assert exact_dedup.groups(frame(spark, ROWS).limit(0)).count() == 0


def test_index_takes_insertions_and_deletions(spark):
    keys = written(exact_dedup.digests(frame(spark, [(i, f"t{i % 40}") for i in range(120)])), "keys")
    first, second = keys.filter("doc_id < 60"), keys.filter("doc_id >= 60")
    index = exact_dedup.insert(first, 3)
    index = written(exact_dedup.insert(second, 3, index), "index")
    assert {tuple(r) for r in exact_dedup.entries(index).select("keep_doc", "n").collect()} == {(80 + i, 3) for i in range(40)}
    gone = keys.filter("doc_id >= 80 or doc_id % 40 = 0")
    index = exact_dedup.delete(keys, gone, 3, index)
    assert {tuple(r) for r in exact_dedup.entries(index).select("keep_doc", "n").collect()} == {(40 + i, 2) for i in range(1, 40)}


def shingles(text, width=5):
    w = (text or "").encode().lower().split()
    if len(w) >= width:
        return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids) if ids else None))
    return out


def mutated(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"m{rng.randrange(10**6)}"
    return " ".join(words)


def corpus(seed):
    """Chains of near copies around the threshold, a shared passage, exact and empty texts."""
    rng = random.Random(seed)
    rows = []
    passage = [f"p{i}" for i in range(60)]
    for g in range(4):
        base = [f"g{g}w{rng.randrange(400)}" for _ in range(80 + 40 * g)]
        for _ in range(12):
            rows.append((rng.randrange(10**6), mutated(rng, base, rng.choice([0, 1, 1, 2, 3, 4]))))
        chain = list(base)
        for _ in range(5):
            chain = mutated(rng, chain, 2).split()
            rows.append((rng.randrange(10**6), " ".join(chain)))
    for k in range(10):
        rows.append((rng.randrange(10**6), " ".join(passage + [f"k{k}x{i}" for i in range(k * 3)])))
    rows += [(7, ""), (8, None), (9, " \n "), (10, "a b"), (11, "A B"), (12, "b a"), (13, "a b c d e"), (None, "a b"), (None, "lone words here")]
    rows += [rows[0], rows[1], (rows[2][0], rows[3][1])]
    return rows


@pytest.mark.parametrize("seed,hot", [(1, 10_000), (2, 3)])
def test_links_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(ngram_join, "HOT", hot)  # 3: nearly every column is dealt over parts
    rows = corpus(seed)
    got = ngram_join.joined(frame(spark, rows)).collect()
    assert sorted(map(str, ((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got))) == sorted(map(str, brute(rows)))
    groups = {}
    for r in got:
        groups.setdefault((r["component_id"], r["set_id"] if r["component_id"] is None or not r["n_shingles"] else 0, r["doc_id"] if not r["n_shingles"] else 0), []).append(r)
    assert all(sum(r["kept"] for r in g) == 1 for g in groups.values())


def test_empty_join(spark):
    assert ngram_join.joined(frame(spark, [(1, "a")]).limit(0)).count() == 0
    assert [tuple(r)[1:2] for r in ngram_join.joined(frame(spark, [(1, None)])).collect()] == [(1,)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 40)] + [(200 + rng.randrange(30), 200 + rng.randrange(30)) for _ in range(25)]
    edges = [e for e in edges if e[0] != e[1]]
    want = {}
    for a, b in edges:
        want.setdefault(a, {a}), want.setdefault(b, {b})
        merged = want[a] | want[b]
        for x in merged:
            want[x] = merged
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in got} == {k: min(v) for k, v in want.items()} and len(got) == len(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_without_keeps_one_of_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a", {"k": 1}), (1, "a", {"k": 2}), (2, None, None), (None, "b", None)], "doc_id long, text string, m map<string,int>")
    keyed = docs.select("doc_id", text_key("text").alias("text_key"), F.lit(True).alias("kept"))
    once = keyed.filter("doc_id = 1").limit(1).withColumn("kept", F.lit(False)).unionByName(keyed.filter("doc_id = 1").limit(1))
    rest = without(docs, once.unionByName(keyed.filter("doc_id is null").withColumn("kept", F.lit(False))))
    assert rest.columns == docs.columns and sorted(r["doc_id"] for r in rest.collect()) == [1, 2]
