"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space and tab to carriage return.  Hashing lower-cases A-Z only.
Texts are never cut: the arrays are filled in windows that end between words, so working memory is a
few windows besides one number per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACES = np.zeros(256, dtype=bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9E3779B97F4A7C15
WINDOW = 1 << 20
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (an invertible finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _byte_values(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
    if lower:
        table[65:91] = table[97:123]
    return table


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and where each text starts (one more entry at the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else pa.large_string()
    texts = pc.fill_null(texts.cast(kind), b"" if kind == pa.large_binary() else "")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def give_back() -> None:
    """Return free memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def small_batches(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most_bytes`` of text; a longer text comes alone.

    At the end the worker, which later tasks use again, gives memory back that it does not hold any more.
    """
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0)
        ends = np.cumsum(np.asarray(lengths, dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
    give_back()


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each text the index of its first word (one more at the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~SPACES[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:n]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, at)


def count_words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Words of each text."""
    return np.diff(word_spans(data, at)[2])


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and do not overlap.

    Sums of byte values times powers of an odd base: a running sum gives every span of a window at once.
    """
    out = np.empty(len(starts), np.uint64)
    values = _byte_values(lower)
    i = 0
    while i < len(starts):
        lo = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, lo + WINDOW, side="right")))
        size = int(ends[j - 1] - lo)
        if len(_POWERS.get("up", ())) < size:
            m = max(size, WINDOW)
            for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
                _POWERS[name] = np.cumprod(np.full(m, base, np.uint64))
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data[lo : lo + size]] * _POWERS["up"][:size], out=sums[1:])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (sums[e] - sums[s]) * _POWERS["down"][s]
        i = j
    return mix(out ^ ((ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def place_sums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """For each span the sum of its bytes' values, mixed with their places: unlike ``span_hashes`` no polynomial."""
    out, size = np.zeros(len(starts), np.uint64), ends - starts
    upto, lo = np.cumsum(size), 0
    value = lambda at, place: mix(data[at].astype(np.uint64) << np.uint64(40) | place.astype(np.uint64))
    while lo < len(out):
        done = upto[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(upto, done + most, side="right")))
        if hi == lo + 1:
            for a in range(0, int(size[lo]), most):
                place = np.arange(a, min(a + most, int(size[lo])))
                out[lo:hi] += value(place + starts[lo], place).sum()
        else:
            n = size[lo:hi]
            first = upto[lo:hi] - n - done
            place = np.arange(int(n.sum())) - np.repeat(first, n)
            out[lo:hi] = np.add.reduceat(value(place + np.repeat(starts[lo:hi], n), place), first)
        lo = hi
    return out


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every lower-cased word, and the index of each text's first word (one more at the end)."""
    data, at = text_bytes(texts)
    starts, ends, bounds = word_spans(data, at)
    return span_hashes(data, starts, ends), bounds


def chain(first: np.ndarray, *rest: np.ndarray) -> np.ndarray:
    """One hash for each tuple of hashes; order counts."""
    acc = mix(first + np.uint64(len(rest) + 1))
    for r in rest:
        acc = mix((acc << np.uint64(7) | acc >> np.uint64(57)) + r)
    return acc


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    A text with fewer than ``width`` words is one shingle, its whole sequence; one without words has none.
    """
    words, bounds = word_hashes(texts)
    rolled = chain(*[words[i : len(words) - width + 1 + i] for i in range(width)]) if len(words) >= width else words[:0]
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if hi - lo >= width:
            out.append(np.unique(rolled[lo : hi - width + 1]))
        elif hi > lo:
            out.append(chain(*[words[k : k + 1] for k in range(lo, hi)]))
        else:
            out.append(words[:0])
    return out
