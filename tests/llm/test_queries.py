"""Every registered query on a small directory: columns, types, folds and thresholds; oracle SQL where there is one."""

import random
import zlib

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from strandloom.llm.queries import ORACLES, QUERIES

LONG, TEXT, FLOAT, INT, BOOL = "bigint", "string", "double", "int", "boolean"
CONTRACTS = {
    "op1_source_mix": {"doc_id": LONG, "size": LONG, "source_size": LONG, "target": FLOAT, "taken": LONG},
    "op2_ngram_jaccard": {"doc_id": LONG, "n_shingles": LONG, "component_id": LONG},
    "op3_bpe": {"doc_id": LONG, "n_tokens": LONG, "ids_sha256": TEXT, "decoded_sha256": TEXT},
    "op4_token_files": {"doc_id": LONG, "start": LONG, "n_tokens": LONG, "ids_crc32": LONG},
    "op5_quality": {"doc_id": LONG, "held_out": BOOL, "score": FLOAT, "predicted": INT},
    "op6_nearest": {"query_id": LONG, "rank": INT, "vec_id": LONG, "score": FLOAT},
    "op7_url_filter": {"page_id": LONG, "host": TEXT, "path": TEXT, "rule": TEXT, "verdict": TEXT},
    "op8_toxicity": {"doc_id": LONG, "held_out": BOOL, "score": FLOAT, "predicted": INT},
    "op9_warc": {"page_id": LONG, "payload_bytes": LONG, "payload_digest": TEXT, "record_type": TEXT, "refers_to": LONG},
    "op10_exact_dedup": {"doc_id": LONG, "keep_id": LONG, "group_size": LONG, "kept": BOOL, "text_sha256": TEXT},
    "op11_phrases": {"lang": TEXT, "rank": LONG, "phrase": TEXT, "a": LONG, "l": LONG, "r": LONG, "n": LONG, "score": LONG},
    "op12_exact_topk": {"query_id": LONG, "rank": INT, "vec_id": LONG, "score": LONG},
    "op13_hard_negatives": {"anchor_id": LONG, "positive_id": LONG, "rank": INT, "negative_id": LONG, "positive_score": LONG, "negative_score": LONG},
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, r = tmp_path_factory.mktemp("tables"), random.Random(1)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(r.choices(words, k=r.randrange(1, 60))) + r.choice([" vile filth", "", ""]) for _ in range(110)]
    texts += [texts[3].upper(), texts[3] + " more", None, "", "one, two. One two! one two"]
    n = len(texts)
    docs = {
        "doc_id": pa.array(range(n), pa.int64()),
        "text": pa.array(texts, pa.string()),
        "lang": pa.array([r.choice(["en", "en", "de", None]) for _ in range(n)], pa.string()),
        "source": pa.array([r.choice(["a", "b", None]) for _ in range(n)], pa.string()),
        "n_chars": pa.array([len(t or "") for t in texts], pa.int64()),
    }
    pq.write_table(pa.table(docs), at / "documents.parquet")
    toxic = [int("vile" in (t or "")) for t in texts]
    labels = {"doc_id": docs["doc_id"], "quality": pa.array([int(len(t or "") > 80) for t in texts], pa.int32()), "toxic": pa.array(toxic, pa.int32())}
    pq.write_table(pa.table(labels), at / "labels.parquet")
    vectors = [[r.gauss(0, 0.2) for _ in range(8)] for _ in range(240)]
    vectors[7], vectors[9], vectors[100] = None, [float("nan")] * 8, vectors[101]
    emb = {"vec_id": pa.array(range(240), pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([None if i == 50 else i % 4 for i in range(240)], pa.int32())}
    pq.write_table(pa.table(emb), at / "embeddings.parquet")
    urls = [f"http://{h}/{p}/x?q" for h in ("a.Example.net", "example.com", "b.org") for p in ("en", "de", "fr")] + [None, "no scheme"]
    pages = {"page_id": pa.array(range(len(urls)), pa.int64()), "url": pa.array(urls, pa.string()), "html": pa.array(["<p>same</p>"] * 5 + [f"<p>{i}</p>" for i in range(len(urls) - 6)] + [None], pa.string())}
    pq.write_table(pa.table(pages), at / "pages.parquet")
    return at


@pytest.mark.parametrize("name", CONTRACTS)
def test_contract(spark, folder, name):
    df = QUERIES[name](spark, str(folder))
    assert dict(df.dtypes) == CONTRACTS[name]
    rows = df.collect()
    tables = {"op11_phrases": "documents", "op7_url_filter": "pages", "op9_warc": "pages", "op6_nearest": "embeddings", "op12_exact_topk": "embeddings", "op13_hard_negatives": "embeddings"}
    table = tables.get(name, "documents")
    n = pq.read_metadata(folder / f"{table}.parquet").num_rows
    if table in ("documents", "pages") and name != "op11_phrases":
        assert len(rows) == n and len({r[0] for r in rows}) == n
    if name in ("op5_quality", "op8_toxicity"):
        mod, out, least = (5, 0, 0.3) if name == "op5_quality" else (3, 1, 0.7)
        for r in rows:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == out)
            assert 0 <= r.score <= 1 and r.predicted == int(r.score >= least)
    if name in ORACLES:
        con = duckdb.connect()
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
        res = con.execute(ORACLES[name])
        cols = [d[0] for d in res.description]
        key = lambda r: tuple((x is None, x) for x in r)
        assert sorted((tuple(r[c] for c in cols) for r in rows), key=key) == sorted(res.fetchall(), key=key)
        assert rows or name == "op11_phrases"


def test_pipeline_on_empty_tables(spark, folder, tmp_path):
    for t in ("documents", "labels"):
        pq.write_table(pq.read_table(folder / f"{t}.parquet").slice(0, 0), tmp_path / f"{t}.parquet")
    assert QUERIES["pipeline"](spark, str(tmp_path)).collect() == []
