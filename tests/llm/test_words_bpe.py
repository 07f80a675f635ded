"""Word hashing, BPE round trips and token files against the plain library."""

import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandloom.llm import bpe, token_files, words

TEXTS = [
    "The cat's on the mat, isn't it?  Two  spaces\n\nand lines\r\n",
    "",
    None,
    "   ",
    "é\u00a0x \u2003y\u3000z a\x1cb !\x1c c\x85 d",
    "says <|endoftext|> here<|endoftext|> <|startoftext|>x",
    "a<|ENDOFTEXT|> <|endoftext|>b, <|EndOfText|>. X<b> x<B> x<b>",
    "don't (we'll) [b]c{d}e 'quoted' 12 345,678 a1b2 ﬁ ß İ µm ªº Ωmega 日本語 text",
    "word " * 3000 + "x" * 5000,
    "e\u0301 cafe\u0301 \u0301 a \u0301",
]


def plain(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.no_padding()
    t.no_truncation()
    return t


@given(st.lists(st.text(alphabet="aB \t\n\x0b\x1c\x85é.", max_size=40), max_size=6))
@settings(max_examples=60, deadline=None)
def test_words_are_split_as_bytes_split_does(texts):
    arr = pa.array(texts, pa.string())
    hashes, bounds = words.word_hashes(arr)
    seen = {}
    for i, t in enumerate(texts):
        want = [w.lower() for w in t.encode().split()]
        got = hashes[bounds[i] : bounds[i + 1]].tolist()
        assert len(got) == len(want)
        for w, h in zip(want, got):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_small_batches_keep_all_rows():
    batch = pa.record_batch([pa.array(["ab", None, "c" * 50, "", "d"])], names=["t"])
    parts = list(words.small_batches(iter([batch]), "t", most_bytes=4))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_equal_the_library(name):
    lib = plain(name)
    enc = bpe.WordEncoder(lib.to_str(), None, most=5)
    for texts in (TEXTS, TEXTS[:1], []):
        ids, n = enc.batch(pa.array(texts, pa.string()))
        want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert ids.tolist() == [i for x in want for i in x]
        assert n.tolist() == [len(x) for x in want]


@given(st.text(max_size=60))
@settings(max_examples=200, deadline=None)
def test_any_text_encodes_as_the_library_does(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        lib, enc = LIBS[name]
        assert enc.batch(pa.array([text]))[0].tolist() == lib.encode(text, add_special_tokens=False).ids


def test_words_of_earlier_batches_are_not_encoded_again(monkeypatch):
    lib = plain("word_bpe_49k.json")
    monkeypatch.setattr(bpe, "RECENT", 50)
    enc, asked = bpe.WordEncoder(lib.to_str(), None, most=4000), []
    encode_words = enc.encode_words
    enc.encode_words = lambda words: asked.extend(words) or encode_words(words)
    texts = [" ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + k)} {i % 7}" for i in range(100)) for k in range(20)]
    for text in texts * 2:
        ids, n = enc.batch(pa.array([text, None]))
        assert ids.tolist() == lib.encode(text, add_special_tokens=False).ids and n.tolist() == [len(ids), 0]
    assert len(asked) == len(set(asked)) and len(enc.own) <= 50
    small = bpe.WordEncoder(lib.to_str(), None, most=300)
    for text in texts * 2:
        assert small.batch(pa.array([text]))[0].tolist() == lib.encode(text, add_special_tokens=False).ids
        assert len(small.hashes) <= 300 and (np.diff(small.hashes.astype(object)) > 0).all()


LIBS = {n: (plain(n), bpe.WordEncoder(plain(n).to_str(), None)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def test_round_trip_with_table(spark):
    rows = [(i if i != 3 else None, t, "x") for i, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    table = bpe.word_table(docs, path, most_words=4)
    assert 0 < len(table[0]) <= 4
    lib = plain("byte_bpe_50k.json")
    fused = bpe.round_trip(docs, path, {"doc_id": F.col("doc_id")}, table=table).collect()
    apart = bpe.decode(bpe.encode(docs, path, {"doc_id": F.col("doc_id")}), path).collect()
    for got in (fused, apart):
        assert len(got) == len(rows)
        for (i, text, _), r in zip(sorted(rows, key=str), sorted(got, key=lambda r: str((r["doc_id"], r["decoded"], "x")))):
            assert r["ids"] == lib.encode(r["decoded"], add_special_tokens=False).ids
        assert sorted(r["decoded"] for r in got) == sorted(t or "" for t in TEXTS)
    empty = bpe.round_trip(docs.limit(0), path, {"doc_id": F.col("doc_id")}, table=bpe.word_table(docs.limit(0), path))
    assert empty.count() == 0


def test_unknown_ids_have_no_piece(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    df = spark.createDataFrame([([64, -1, 10**6, 65],), ([],), (None,)], "ids array<int>")
    assert [r["decoded"] for r in bpe.decode(df, path).collect()] == ["ab", "", ""]


def test_token_files(spark, tmp_path):
    ids = [5, None, 3, 3, 9, -1, 7, 8, 2, 11]
    docs = spark.createDataFrame(list(zip(ids, TEXTS, range(10))), "doc_id long, text string, row long")
    path = str(tmp_path / "tokens")
    token_files.write(docs, path, public_tokenizers.path("word_bpe_49k.json"), 2)
    rows = token_files.with_start(token_files.checksums(token_files.read(spark, path))).orderBy("row").collect()
    lib, start = plain("word_bpe_49k.json"), 0
    order = sorted(range(10), key=lambda i: (ids[i] is not None, ids[i] or 0, i))
    for i, r in zip(order, rows):
        want = lib.encode(TEXTS[i] or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"]) == (ids[i], start, len(want))
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    assert token_files.read(spark, path).filter("doc_id = 9").select("ids").first()["ids"][-1] == 2
    token_files.write(docs.limit(0), path + "0", public_tokenizers.path("word_bpe_49k.json"), 2)
    assert token_files.with_start(token_files.checksums(token_files.read(spark, path + "0"))).count() == 0
