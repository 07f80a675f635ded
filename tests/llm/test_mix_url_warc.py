"""Mixing, URL rules and WARC archives against plain restatements."""

import base64
import hashlib
from urllib.parse import quote

import pytest
from hypothesis import given, settings, strategies as st

from strandloom.llm import mixing, url_filter, warc
from strandloom.llm.queries import URL_RULES


def wanted(sizes, weights, most):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    left, free, target = sum(sizes.values()), set(names), {}
    while free:
        rate = left / sum(weight[n] for n in free)
        over = [n for n in free if rate * weight[n] > most * sizes[n]]
        if not over:
            return target | {n: rate * weight[n] for n in free}
        for n in over:
            target[n] = most * sizes[n]
            left -= target[n]
            free.remove(n)
    return target


def test_mix(spark):
    rows = [(i, "w " * (i % 37), "abcd"[i % 4]) for i in range(400)] + [(1000 + i, "z z", "tiny") for i in range(5)]
    rows += [(None, "n n n", None), (None, None, None), (3, "again and again", "a"), (5000, "big " * 4000, "d"), (5001, "", "none")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs, [5, 2, 1]).collect()
    assert len(got) == len(rows)
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    target = wanted(size, [5, 2, 1], 3)
    taken = {}
    for r in got:
        assert r["source_size"] == size[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - target[s]) <= 0.02 * target[s] + 8
    again = mixing.mix(docs, [5, 2, 1]).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    whole = {s: sum(r["copies"] * r["size"] for r in got if r["source"] == s) for s in "abc"}
    assert all(abs(whole[s] - target[s]) <= 40 for s in whole)
    parts = mixing.sequence_of(docs, [5, 2, 1])
    assert parts.agg({"n_words": "sum"}).first()[0] == sum(r["taken"] for r in got)
    assert mixing.mix(docs.limit(0), [5, 2, 1]).count() == 0


def test_small_sources_get_their_targets_beside_large_ones(spark):
    """Sources of a few words beside one whose blocks are longer than they are."""
    from pyspark.sql import functions as F

    small = {f"s{n:05d}": n for n in (1, 7, 50, 150, 300, 1000, 1500, 3000)}
    rows = [(i, "w " * 20000, "large") for i in range(180)]
    rows += [(1000 + i, "w " * max(1, n // 5), s) for s, n in small.items() for i in range(min(5, n))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(docs, [5, 2, 1], max_repeats=3).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    got = {r["source"]: r for r in mixed.collect()}
    assert set(got) == {"large", *small}
    assert all(abs(r["taken"] - r["target"]) <= 0.5 for r in got.values())
    parts = mixing.sequence_of(docs, [5, 2, 1])
    assert parts.agg({"n_words": "sum"}).first()[0] == sum(r["taken"] for r in got.values())
    # Slots of a small source are spread over the schedule.
    where = parts.filter("doc_id >= 1000").groupBy(F.col("doc_id") >= 1035).agg(F.min("slot"), F.max("slot")).collect()
    n_slots = parts.agg(F.max("slot")).first()[0]
    assert all(lo < 0.1 * n_slots and hi > 0.9 * n_slots for _, lo, hi in where)


def test_whole_documents_of_every_source_stay_within_half_a_document(spark):
    """Also where one long document holds most words, and for tiny and null sources beside a large one."""
    rows = [(i, "w " * 20000, "large") for i in range(180)] + [(1000 + i, "z z", "tiny") for i in range(5)]
    rows += [(2000 + i, "w " * (1 + i % 37), "d") for i in range(100)] + [(3000, "big " * 4000, "d"), (None, "n n n", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs, [5, 2, 1], max_repeats=3).collect()
    for s in ("large", "tiny", "d", None):
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["copies"] * r["size"] for r in mine) - mine[0]["target"]) <= max(r["size"] for r in mine) / 2 + 1


def test_golden_points_are_exact(spark):
    from pyspark.sql import functions as F

    ks = [0, 1, 2, 65535, 65536, 2**31, 2**32 - 1, 2**32 + 5, 10**15]
    df = spark.createDataFrame([(k,) for k in ks], "k long").select(mixing.golden_point(F.col("k")).alias("p"))
    assert [r["p"] for r in df.collect()] == [k * mixing.GOLDEN % 2**32 for k in ks]


def slow_match(rules, host, path):
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            key = (h.count(".") + 1, len(p), verdict == "block")
            if best is None or key > best[0]:
                best = (key, (verdict, h + p))
    return best and best[1]


HOSTS = st.lists(st.sampled_from(["net", "example", "org", "a", ""]), min_size=1, max_size=4).map(".".join)
PATHS = st.lists(st.sampled_from(["en", "e", "english", "", "x"]), max_size=4).map(lambda p: "/" + "/".join(p) if p else "")


@given(st.lists(st.tuples(st.sampled_from(["allow", "block"]), HOSTS, PATHS), max_size=6), HOSTS, PATHS)
@settings(max_examples=300, deadline=None)
def test_trie_equals_scanning_all_rules(rules, host, path):
    assert url_filter.match(url_filter.build_trie(rules), host, path) == slow_match(rules, host, path)


def test_judged_urls(spark):
    urls = ["HTTP://Foo.NET/x?q", "https://example.net/en/1", "https://m.example.net/en", "http://example.com/de/", "a.org/fr/", None, "", "x://", "http://é.ORG/fr/É#f", "http://net?x/y", "s://user@a.example.net:80/en/"]
    rows = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r["page_id"]: tuple(r)[1:] for r in url_filter.judge(rows, URL_RULES).collect()}
    assert got[0] == ("foo.net", "/x", "net/", "block") and got[1][2:] == ("example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block")
    assert got[4] == got[5] == got[6] == got[7] == ("", "", None, "allow")
    assert got[8] == ("é.org", "/fr/É", "org/fr/", "allow") and got[9] == ("net", "", None, "allow")
    assert got[10] == ("user@a.example.net:80", "/en/", None, "allow")
    assert url_filter.judge(rows.limit(0), URL_RULES).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(rows, URL_RULES, max_bytes=10)


def test_archives_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 3)
    html = ["<p>a</p>", "<p>a</p>", None, "", "é" * 70000, "x\r\n\r\ny\x00", "<p>a</p>", "solo", "nul"]
    ids = [4, 9, 2, 3, 5, 6, None, 8, None]
    urls = [f"http://h{i % 3}.example.org/p\t{i}?q={i}" for i in range(7)] + [None, "nourl"]
    rows = list(zip(ids, urls, html))
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, member string").repartition(3)
    arc, idx = str(tmp_path / "arc"), str(tmp_path / "idx")
    warc.write_archives(pages, arc)
    warc.write_index(warc.captures(spark, arc), idx)
    index = spark.read.parquet(idx)
    assert index.count() > 2
    got = warc.read_records(warc.index_lines(index), arc).collect()
    group = {}
    for i, _, h in rows:
        group.setdefault((h or "").encode(), []).append(i)
    want = []
    for h, members in group.items():
        keep = max((m for m in members if m is not None), default=None)
        for m in members:
            sha = base64.b32encode(hashlib.sha1(h).digest()).decode()
            want.append((m, "response" if m == keep else "revisit", len(h), sha, None if m == keep else keep))
    assert sorted(map(str, ((r["page_id"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in got))) == sorted(map(str, want))
    assert {bytes(r["payload"]) for r in got if r["record_type"] == "response"} == set(group)
    for (i, u, h) in rows[:6]:
        found = warc.lookup(spark, idx, u)
        assert len(found) == 1 and found[0][0]["warc-target-uri"] == u.replace("\t", "%09")
    assert warc.lookup(spark, idx, "http://h0.example.org/none") == []
    big = str(tmp_path / "big")
    warc.write_archives(pages, big, min_bytes=9)
    assert {r["record_type"] for r in warc.read_records(warc.captures(spark, big), big).collect()} == {"response"}
    none = str(tmp_path / "none")
    warc.write_archives(pages.limit(0), none)
    assert warc.captures(spark, none).count() == 0


def test_large_members_end_in_zero():
    record = b"q" * (17 << 20)
    made = warc._member(record, 1)
    assert made[-1] == 0 and [d for _, _, d in warc.members(made + warc._member(b"next", 1))] == [record, b"next"]


def test_keys_sort_by_reversed_host():
    assert warc.url_key("http://A.b.Example.org/x?y#z") == "org,example,b,a)/x?y#z"
    assert quote(warc.url_key(None)) == "" and warc.url_key("plain") == "plain"
