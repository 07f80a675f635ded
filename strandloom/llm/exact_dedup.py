"""Exact duplicates through a cuckoo-filter index of live digests.

Two texts are equal when they are identical after lower-casing A-Z.  Their SHA-256 is spread over
shards; each shard is one cuckoo filter (``CuckooIndex``): 16-bit fingerprints in buckets of four, and
beside every fingerprint the stored key and its entry.  A fingerprint that hits is compared with the
key stored in that place, so false positives never reach the result.  When an insertion finds no place,
the shard doubles and is filled again from its stored keys.

The index is a table of one row per shard.  ``insert`` and ``delete`` return a new one; batches touch
only the shards they name.  Copies are counted before they are shuffled, so a text that makes up a third
of all rows sends a few rows per task.

Defined cases: a null text equals the empty one; a null id is smaller than any id; rows that repeat an id
and a text are separate rows, of which one is kept; an empty table gives an empty index and result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from strandloom.llm.rows import text_key, without
from strandloom.llm.scratch import written
from strandloom.llm.words import small_batches

SLOTS = 4
INDEX_SCHEMA = "shard int, n_buckets long, n_keys long, n_resizes int, tags binary, keys binary, doc_ids binary, uids binary, counts binary"
NO_ID = -(1 << 63)


class CuckooIndex:
    """One shard: fingerprints, and in the same places the keys and entries (id, row, copies)."""

    def __init__(self, n_buckets: int = 64, max_kicks: int = 200):
        self.max_kicks, self.n_resizes, self.n_keys, self.verified, self.rejected = max_kicks, 0, 0, 0, 0
        self._empty(n_buckets)

    def _empty(self, n_buckets: int) -> None:
        self.n_buckets = n_buckets
        self.tags = [0] * (n_buckets * SLOTS)
        self.items: list[list | None] = [None] * (n_buckets * SLOTS)

    @staticmethod
    def _tag(key: bytes) -> int:
        return int.from_bytes(key[8:10], "little") | 1

    def _home(self, key: bytes) -> int:
        return int.from_bytes(key[:8], "little") & (self.n_buckets - 1)

    def _other(self, bucket: int, tag: int) -> int:
        """The second bucket follows from the first and the fingerprint alone, both ways."""
        return bucket ^ ((tag * 0x5BD1E995) & (self.n_buckets - 1))

    def find(self, key: bytes) -> list | None:
        """The live entry of a key: filter first, then the stored key."""
        tag, b = self._tag(key), self._home(key)
        for bucket in (b, self._other(b, tag)):
            for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
                if self.tags[at] == tag:
                    item = self.items[at]
                    if item[0] == key:
                        self.verified += 1
                        return item
                    self.rejected += 1
        return None

    def insert(self, key: bytes, doc_id: int, uid: int, n: int) -> None:
        """Count ``n`` more live rows; the entry keeps the largest (id, row)."""
        item = self.find(key)
        if item is not None:
            item[3] += n
            if (doc_id, uid) > (item[1], item[2]):
                item[1], item[2] = doc_id, uid
            return
        self.n_keys += 1
        self._place([key, doc_id, uid, n])

    def _place(self, item: list) -> None:
        tag = self._tag(item[0])
        bucket = self._home(item[0])
        for kick in range(self.max_kicks):
            for b in (bucket, self._other(bucket, tag)) if kick == 0 else (bucket,):
                for at in range(b * SLOTS, b * SLOTS + SLOTS):
                    if not self.tags[at]:
                        self.tags[at], self.items[at] = tag, item
                        return
            at = bucket * SLOTS + kick % SLOTS
            self.tags[at], tag = tag, self.tags[at]
            self.items[at], item = item, self.items[at]
            bucket = self._other(bucket, tag)
        self._resize(item)

    def _resize(self, homeless: list) -> None:
        stored = [x for x in self.items if x is not None] + [homeless]
        self.n_resizes += 1
        self._empty(self.n_buckets * 2)
        for x in stored:
            self._place(x)

    def delete(self, key: bytes, n: int) -> list | None:
        """Take ``n`` live rows away; the last one frees the place.  Unknown keys are left alone."""
        item = self.find(key)
        if item is None:
            return None
        item[3] -= n
        if item[3] <= 0:
            at = next(i for i, x in enumerate(self.items) if x is item)
            self.tags[at], self.items[at] = 0, None
            self.n_keys -= 1
        return item

    def entries(self) -> Iterator[list]:
        return (x for x in self.items if x is not None)

    def row(self, shard: int) -> dict:
        """The shard as one row; places without a key hold zeros."""
        blank = [bytes(32), 0, 0, 0]
        items = [x or blank for x in self.items]
        return {
            "shard": shard, "n_buckets": self.n_buckets, "n_keys": self.n_keys, "n_resizes": self.n_resizes,
            "tags": np.array(self.tags, np.uint16).tobytes(), "keys": b"".join(x[0] for x in items),
            "doc_ids": np.array([x[1] for x in items], np.int64).tobytes(),
            "uids": np.array([x[2] for x in items], np.int64).tobytes(),
            "counts": np.array([x[3] for x in items], np.int64).tobytes(),
        }

    @classmethod
    def load(cls, row: dict) -> CuckooIndex:
        out = cls(row["n_buckets"])
        out.n_keys, out.n_resizes = row["n_keys"], row["n_resizes"]
        out.tags = np.frombuffer(row["tags"], np.uint16).tolist()
        ids, uids, counts = (np.frombuffer(row[c], np.int64).tolist() for c in ("doc_ids", "uids", "counts"))
        keys = row["keys"]
        out.items = [[keys[i * 32 : i * 32 + 32], ids[i], uids[i], counts[i]] if t else None for i, t in enumerate(out.tags)]
        return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``uid, doc_id, text_key, digest`` of every row; ``uid`` numbers the rows, so write the table before using it twice."""

    def run(batches):
        for batch in small_batches(batches, "_text"):
            raw = [hashlib.sha256(x.lower()).digest() for x in batch.column(3).cast(pa.binary()).fill_null(b"").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(raw, pa.binary())], names=["uid", "doc_id", "text_key", "digest"])

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).cast("string").alias("_text"))
    return rows.mapInArrow(run, "uid long, doc_id long, text_key long, digest binary")


def _shard(n_shards: int):
    return F.pmod(F.xxhash64("digest"), F.lit(n_shards)).cast("int")


def combined(keys: DataFrame, n_shards: int) -> DataFrame:
    """Copies counted per digest and spread, so that no text sends all its rows to one place."""
    spread = F.pmod(F.hash("uid"), F.lit(32))
    best = F.max(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "uid")).alias("best")
    parts = keys.groupBy("digest", spread.alias("part")).agg(best, F.count("*").alias("n"))
    return parts.select(_shard(n_shards).alias("shard"), "digest", "best.doc_id", "best.uid", "n")


def insert(keys: DataFrame, n_shards: int, index: DataFrame | None = None) -> DataFrame:
    """The index with the rows of ``keys`` (``uid, doc_id, digest``) in it."""
    new = combined(keys, n_shards)

    if index is None:

        def fill(batches):
            shards: dict[int, CuckooIndex] = {}
            for batch in batches:
                for s, key, d, u, n in zip(*[c.to_pylist() for c in batch.columns]):
                    if s not in shards:
                        shards[s] = CuckooIndex()
                    shards[s].insert(key, d, u, n)
            for s, x in shards.items():
                yield pa.RecordBatch.from_pylist([x.row(s)], schema=_arrow_schema())

        return new.repartition(n_shards, "shard").mapInArrow(fill, INDEX_SCHEMA)

    def change(old: pa.Table, add: pa.Table) -> pa.Table:
        rows = old.to_pylist()
        shard = rows[0]["shard"] if rows else add.column("shard")[0].as_py()
        x = CuckooIndex.load(rows[0]) if rows else CuckooIndex()
        for _, key, d, u, n in zip(*[c.to_pylist() for c in add.columns]):
            x.insert(key, d, u, n)
        return pa.Table.from_pylist([x.row(shard)], schema=_arrow_schema())

    return index.groupBy("shard").cogroup(new.groupBy("shard")).applyInArrow(change, INDEX_SCHEMA)


def delete(keys: DataFrame, gone: DataFrame, n_shards: int, index: DataFrame) -> DataFrame:
    """The index without the rows of ``gone`` (``uid, doc_id, digest``), which are rows of ``keys``.

    The last live row of a digest frees its place.  Where the row that stood for a digest goes, the largest
    of the remaining rows takes over; those come from ``keys``, and only for digests of ``gone``.
    """
    taken = gone.groupBy("digest").agg(F.count("*").alias("n_gone"))
    left = keys.join(gone.select("uid").distinct(), "uid", "left_anti").join(taken.select("digest"), "digest", "left_semi")
    best = left.groupBy("digest").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "uid")).alias("best"))
    changes = taken.join(best, "digest", "left").select(_shard(n_shards).alias("shard"), "digest", "n_gone", "best.doc_id", "best.uid")

    def change(old: pa.Table, sub: pa.Table) -> pa.Table:
        rows = old.to_pylist()
        if not rows:
            return pa.Table.from_pylist([], schema=_arrow_schema())
        x = CuckooIndex.load(rows[0])
        for _, key, n, d, u in zip(*[c.to_pylist() for c in sub.columns]):
            item = x.delete(key, n)
            if item is not None and d is not None:
                item[1], item[2] = d, u
        return pa.Table.from_pylist([x.row(rows[0]["shard"])], schema=_arrow_schema())

    return index.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(change, INDEX_SCHEMA)


def entries(index: DataFrame) -> DataFrame:
    """``digest, keep_doc, keep_uid, n`` of every live digest."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                got = list(CuckooIndex.load(row).entries())
                cols = [[x[i] for x in got] for i in range(4)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.binary()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                    names=["digest", "keep_doc", "keep_uid", "n"],
                )

    return index.mapInArrow(run, "digest binary, keep_doc long, keep_uid long, n long")


def _arrow_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in INDEX_SCHEMA.split(", "))])


def n_shards_for(n_rows: int, rows_per_shard: int = 50_000) -> int:
    """Shards grow with the table; one holds about ``rows_per_shard`` keys in memory."""
    return max(1, -(-n_rows // rows_per_shard))


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``uid, doc_id, text_key, digest, keep_id, group_size, kept``."""
    keys = written(digests(docs, id_col, text_col), "digests")
    index = insert(keys, n_shards_for(keys.count()))
    several = entries(index).filter("n > 1")
    rows = keys.join(several, "digest", "left")
    single = F.col("n").isNull()
    keep = F.when(single, F.col("doc_id")).otherwise(F.when(F.col("keep_doc") != NO_ID, F.col("keep_doc")))
    return rows.select(
        "uid",
        "doc_id",
        "text_key",
        "digest",
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"),
        (single | (F.col("uid") == F.col("keep_uid"))).alias("kept"),
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that are not kept; all columns stay."""
    decided = written(groups(docs, id_col, text_col).select("doc_id", "text_key", "kept"), "groups")
    return without(docs, decided, id_col, text_col)
