"""BPE encoding and decoding through a table of distinct words.

A text is cut before a space, tab or line end that follows a character which is no white space, and between
an ASCII letter and an ASCII mark other than an apostrophe or one of ``<|>``, which special tokens are made
of.  No pre-token or special token of the vocabularies spans such a place, so the ids of a text are the ids of
its words in a row.

1. Words are split and counted in Spark over all texts; the most frequent ones, ``most_words`` at most, are
   encoded once each: the word table, bounded, which all tasks get.
2. A task finds the distinct words of its rows, takes their ids from the table, and encodes once each those
   that are too rare for it.  Ids join back to the texts by position.  A word of letters alone is one
   pre-token and goes to the vocabulary's merges directly.
3. Decoding joins ids to the vocabulary's pieces, whose number is fixed, and joins the pieces' bytes.

Words are told apart by 64-bit hashes.  Null and empty texts have no ids; ids outside the vocabulary have no
piece.  Special tokens written in a text get their ids, as the tokenizers library does by default.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from strandloom.llm.scratch import written
from strandloom.llm.words import small_batches, span_hashes, text_bytes

MOST_WORDS = 1 << 18
#: Words a task remembers as Python objects before they move to its table.
RECENT = 1 << 15
BREAKS = np.zeros(256, dtype=bool)
BREAKS[[0x20, 0x09, 0x0A, 0x0D]] = True
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
MARKS = np.zeros(256, dtype=bool)
MARKS[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'<|>"]] = True


def byte_chars() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from 256 on in turn."""
    itself = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(itself)]
    return {b: chr(b) for b in itself} | {b: chr(256 + i) for i, b in enumerate(rest)}


def bpe_spans(data: np.ndarray, at: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one more at the end).

    The character before a cut must be certain to be no white space: a printable ASCII byte, or the end of
    a longer character that does not begin like one of Unicode's spaces.
    """
    n = len(data)
    cut = np.zeros(n, dtype=bool)
    if n > 1:
        before = data[:-1]
        lead2 = np.concatenate((np.zeros(1, np.uint8), data[: n - 2])) if n > 2 else np.zeros(n - 1, np.uint8)
        lead3 = np.concatenate((np.zeros(2, np.uint8), data[: n - 3])) if n > 3 else np.zeros(n - 1, np.uint8)
        spacelike = (lead2[: n - 1] == 0xC2) | ((lead3[: n - 1] >= 0xE1) & (lead3[: n - 1] <= 0xE3))
        sure = ((before > 0x20) & (before < 0x7F)) | ((before >= 0x80) & ~spacelike)
        cut[1:] = (BREAKS[data[1:]] & sure) | (LETTERS[before] & MARKS[data[1:]])
    cut[at[:-1][at[:-1] < n]] = True
    starts = np.flatnonzero(cut)
    ends, bounds = np.append(starts[1:], n), np.searchsorted(starts, at)
    if fold and n:
        for _ in range(2):
            starts = starts + ((starts < ends) & BREAKS[data[np.minimum(starts, n - 1)]])
    return starts, ends, bounds


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words, and which of them hold a ``<``: special tokens are matched by case, so those never fold."""
    opens = np.flatnonzero(data == ord("<"))
    special = np.searchsorted(opens, ends) > np.searchsorted(opens, starts)
    keys = span_hashes(data, starts, ends, lower=fold)
    if fold and special.any():
        keys[special] = span_hashes(data, starts[special], ends[special], lower=False)
    return keys, special


def gather(flat: np.ndarray, offsets: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The entries of the picked lists in a row, and the length of each."""
    lengths = (offsets[1:] - offsets[:-1])[pick]
    return lists_at(flat, offsets[pick], lengths), lengths


def lists_at(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The lists of these places in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def _ways(tokenizer_json: str) -> tuple[bool, bool]:
    """Whether the vocabulary folds case and white space, and whether words of letters are one pre-token of it.

    Vocabularies with a special token that a cut or folding could change are refused.
    """
    made = json.loads(tokenizer_json)
    fold, direct = _kind(made)
    for special in made["added_tokens"]:
        raw = np.frombuffer(special["content"].encode("utf-8"), np.uint8)
        if len(bpe_spans(raw, np.array([0, len(raw)]))[0]) > 1:
            raise ValueError(f"texts would be cut inside the special token {special['content']!r}")
        if fold and "<" not in special["content"]:
            raise ValueError(f"the special token {special['content']!r} could fold into another word")
    return fold, direct


def _kind(made: dict) -> tuple[bool, bool]:
    norm, pre = made["normalizer"], made["pre_tokenizer"]
    steps = pre.get("pretokenizers", [pre]) if pre else []
    kinds = [x["type"] for x in steps]
    if norm is None:
        return False, kinds == ["ByteLevel"] and steps[0]["use_regex"] and not steps[0]["add_prefix_space"]
    lowers = any(x["type"] == "Lowercase" for x in norm.get("normalizers", [norm]))
    dropped = kinds == ["Split", "ByteLevel"] and steps[0]["behavior"] == "Removed" and steps[0]["invert"]
    fold = lowers and dropped and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
    return fold, fold


class WordEncoder:
    """Ids of distinct words: from the shared table, else from the tokenizer, remembered up to a bound.

    Words encoded here join the table in sorted arrays, some tens of bytes each.  A table of more than ``most`` words
    goes on with those that were met since it was last cut, half of ``most`` at most.

    ``fold`` is set for vocabularies that lower-case and drop white space: words that differ in these alone
    are then one word.
    """

    def __init__(self, tokenizer_json: str, table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None, most: int = 1 << 19, ways: tuple[bool, bool] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(tokenizer_json)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.fold, self.direct = ways or _ways(tokenizer_json)
        self.chars = byte_chars()
        hashes, offsets, flat = table or (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32))
        #: Hashes in order, and where the ids of each word are and how many.
        self.hashes, self.starts, self.sizes, self.flat = hashes, offsets[:-1], np.diff(offsets).astype(np.int32), flat
        self.used = np.zeros(len(self.hashes), bool)
        self.own: dict[int, bytes] = {}
        self.most = most

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Letters up to U+00FF are one pre-token, with a space before them if need be; the rest is the library's."""
        out: list = [None] * len(words)
        rest = []
        for i, word in enumerate(words):
            body = word[1:] if word[:1] == " " else word
            if self.direct and body.isalpha() and (body.isascii() or max(body) <= "\u00ff"):
                piece = body.lower() if self.fold else word
                if not (piece.isascii() and piece.isalpha()):
                    piece = piece.encode("utf-8").decode("latin-1").translate(self.chars)
                out[i] = [t.id for t in self.tok.model.tokenize(piece)]
            else:
                rest.append(i)
        for i, e in zip(rest, self.tok.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out

    def _remember(self) -> None:
        """Move ``own`` to the table."""
        if len(self.hashes) + len(self.own) > self.most:
            kept = np.flatnonzero(self.used)[: self.most // 2]
            self.flat = lists_at(self.flat, self.starts[kept], self.sizes[kept])
            self.hashes, self.sizes = self.hashes[kept], self.sizes[kept]
            self.starts = np.cumsum(self.sizes, dtype=np.int64) - self.sizes
            self.used = np.zeros(len(kept), bool)
        mine = np.fromiter(self.own, np.uint64, len(self.own))
        sizes = np.array([len(x) // 4 for x in self.own.values()], np.int32)
        starts = len(self.flat) + np.cumsum(sizes, dtype=np.int64) - sizes
        order = np.argsort(mine)
        at = np.searchsorted(self.hashes, mine[order])
        self.flat = np.concatenate((self.flat, np.frombuffer(b"".join(self.own.values()), np.int32)))
        self.starts, self.sizes = np.insert(self.starts, at, starts[order]), np.insert(self.sizes, at, sizes[order])
        self.hashes, self.used = np.insert(self.hashes, at, mine[order]), np.insert(self.used, at, True)
        self.own = {}

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has."""
        data, at = text_bytes(texts)
        starts, ends, bounds = bpe_spans(data, at, self.fold)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        distinct, first, place = np.unique(word_keys(data, starts, ends, self.fold)[0], return_index=True, return_inverse=True)
        hashes = self.hashes
        at_table = np.minimum(np.searchsorted(hashes, distinct), max(len(hashes) - 1, 0))
        hit = hashes[at_table] == distinct if len(hashes) else np.zeros(len(distinct), bool)
        self.used[at_table[hit]] = True
        rare = np.flatnonzero(~hit)
        keys = distinct[rare].tolist()
        new = [i for i, k in enumerate(keys) if k not in self.own]
        if new:
            raw, where = data.tobytes(), first[rare[new]]
            words = [raw[s:e].decode("utf-8") for s, e in zip(starts[where].tolist(), ends[where].tolist())]
            for i, ids in zip(new, self.encode_words(words)):
                self.own[keys[i]] = array("i", ids).tobytes()
        there = at_table[hit]
        shared_n = self.sizes[there]
        shared = lists_at(self.flat, self.starts[there], shared_n)
        mine = [self.own[k] for k in keys]
        if len(self.own) > min(RECENT, self.most // 2):
            self._remember()
        sizes = np.empty(len(distinct), np.int64)
        sizes[hit], sizes[rare] = shared_n, [len(x) // 4 for x in mine]
        # Lists of the distinct words: those of the table first, then the rare ones.
        rank = np.empty(len(distinct), np.int64)
        rank[np.flatnonzero(hit)] = np.arange(int(hit.sum()))
        rank[rare] = int(hit.sum()) + np.arange(len(rare))
        lists = np.concatenate((shared, np.frombuffer(b"".join(mine), np.int32)))
        ordered = np.empty(len(distinct), np.int64)
        ordered[rank] = sizes
        ids, lengths = gather(lists, np.concatenate(([0], np.cumsum(ordered))), rank[place])
        upto = np.concatenate(([0], np.cumsum(lengths)))
        return ids, np.diff(upto[bounds])


def word_counts(docs: DataFrame, text_col: str = "text", fold: bool = False) -> DataFrame:
    """``word, n`` over all texts.  Tasks send each distinct word of a few texts once; words with a ``<`` are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "_text"):
            data, at = text_bytes(batch.column(0))
            starts, ends, _ = bpe_spans(data, at, fold)
            if len(starts):
                keys, special = word_keys(data, starts, ends, fold)
                starts, ends = starts[~special], ends[~special]
                _, first, n = np.unique(keys[~special], return_index=True, return_counts=True)
                raw = data.tobytes()
                words = [raw[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist())]
                if fold:
                    words = [w.lower() for w in words]
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(n, pa.int64())], names=["word", "n"])

    texts = docs.select(F.col(text_col).cast("string").alias("_text"))
    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(docs: DataFrame, tokenizer_path: str, text_col: str = "text", most_words: int = MOST_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, offsets and ids of the most frequent words, at most ``most_words`` of them.

    The least count that stays within the bound comes from the numbers of words per step of counts.
    """
    tokenizer_json = Path(tokenizer_path).read_text("utf-8")
    counts = word_counts(docs, text_col, _ways(tokenizer_json)[0]).filter("n > 1")
    step = F.floor(F.log2("n") * 8).cast("int")
    counts = written(counts.withColumn("step", step), "words")
    room, least = most_words, None
    for row in sorted(counts.groupBy("step").agg(F.count("*").alias("n")).collect(), reverse=True):
        room -= row["n"]
        if room < 0:
            break
        least = row["step"]
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.int32)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = WordEncoder(tokenizer_json, None)
        for batch in batches:
            words = batch.column(0).to_pylist()
            raw = np.frombuffer(b"".join(words), np.uint8)
            ends = np.cumsum([len(w) for w in words])
            hashes = span_hashes(raw, np.concatenate(([0], ends[:-1])), ends, lower=enc.fold) if words else np.zeros(0, np.uint64)
            ids = enc.encode_words([w.decode("utf-8") for w in words])
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(ids, pa.list_(pa.int32()))], names=["hash", "ids"])

    # At most ``most_words`` rows, so a few tasks do, and each builds one tokenizer.
    few = counts.filter(F.col("step") >= least).select("word").coalesce(max(1, most_words >> 15))
    got = few.mapInArrow(encode, "hash long, ids array<int>").toArrow().combine_chunks()
    hashes, ids = got.column("hash").to_numpy().view(np.uint64), got.column("ids").to_pylist()
    order = np.argsort(hashes)
    lists = [ids[i] for i in order]
    return hashes[order], np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64), np.fromiter((i for x in lists for i in x), np.int32)


def _shipment(tokenizer_path: str, table) -> dict:
    """What tasks need to encode.  A worker keeps its encoder here, so later tasks need not build it again."""
    made = Path(tokenizer_path).read_text("utf-8")
    return {"tokenizer": made, "table": table, "ways": _ways(made)}


def _encoding(shipped, names: list[str], end_ids: list[int] | None):
    """Batches with ``_text`` last to batches with ``ids`` in its place."""
    end = np.array(end_ids or [], np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kit = shipped.value
        if "encoder" not in kit:
            kit["encoder"] = WordEncoder(kit.pop("tokenizer"), kit["table"], ways=kit["ways"])
        enc = kit["encoder"]
        for batch in small_batches(batches, "_text", 1 << 19):
            ids, n = enc.batch(batch.column(batch.num_columns - 1))
            if len(end):
                ids = np.insert(ids, np.repeat(np.cumsum(n), len(end)), np.tile(end, len(n)))
                n = n + len(end)
            offsets = pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(offsets, pa.array(ids))], names=names)

    return run


def _decoding(shipped, names: list[str], where: int):
    """Batches with lists of ids in column ``where`` to the same with their texts as another column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_id = np.array([*shipped.value, b""], dtype=object)
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch, texts = whole.slice(start, 512), []
                for row in batch.column(where):
                    got = row.values
                    ids = np.asarray(got if got is not None else [], dtype=np.int64)
                    known = np.where((ids >= 0) & (ids < len(by_id)), ids, -1)
                    texts.append(b"".join(by_id[known].tolist()).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=names)

    return run


def _texts(docs: DataFrame, keep: dict[str, Column], text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(*[c.alias(n) for n, c in keep.items()], F.col(text_col).cast("string").alias("_text"))
    return rows, "".join(f"`{n}` {t}, " for n, t in rows.dtypes[:-1])


def encode(
    docs: DataFrame,
    tokenizer_path: str,
    keep: dict[str, Column],
    text_col: str = "text",
    table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
    end_ids: list[int] | None = None,
) -> DataFrame:
    """``ids`` (array of int) of every whole text beside the columns of ``keep``; ``end_ids`` follow each text's ids.

    Rows stay where and in the order they are.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(_shipment(tokenizer_path, table))
    rows, kinds = _texts(docs, keep, text_col)
    return rows.mapInArrow(_encoding(shipped, [*keep, "ids"], end_ids), f"{kinds}ids array<int>")


def round_trip(
    docs: DataFrame,
    tokenizer_path: str,
    keep: dict[str, Column],
    text_col: str = "text",
    table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None,
) -> DataFrame:
    """``ids`` and ``decoded``: encoding and decoding in one pass, without moving the ids in between."""
    sc = docs.sparkSession.sparkContext
    shipped = sc.broadcast(_shipment(tokenizer_path, table))
    rows, kinds = _texts(docs, keep, text_col)
    first = _encoding(shipped, [*keep, "ids"], None)
    second = _decoding(sc.broadcast(pieces(tokenizer_path)), [*keep, "ids", "decoded"], len(keep))
    return rows.mapInArrow(lambda batches: second(first(batches)), f"{kinds}ids array<int>, decoded string")


def pieces(tokenizer_path: str) -> list[bytes]:
    """Bytes of every id, by id."""
    made = json.loads(Path(tokenizer_path).read_text("utf-8"))
    byte_of = {c: b for b, c in byte_chars().items()}
    vocab = {i: t for t, i in made["model"]["vocab"].items()} | {a["id"]: a["content"] for a in made["added_tokens"]}
    out = [b""] * (max(vocab) + 1)
    for i, t in vocab.items():
        out[i] = bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode("utf-8")
    return out


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", name: str = "decoded") -> DataFrame:
    """``encoded`` with the text of its ids in the column ``name``."""
    shipped = encoded.sparkSession.sparkContext.broadcast(pieces(tokenizer_path))
    cols = [c for c in encoded.columns if c != name]
    rows = encoded.select(*cols)
    kinds = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(_decoding(shipped, [*cols, name], cols.index(ids_col)), f"{kinds}, `{name}` string")
