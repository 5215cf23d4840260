"""Texts as flat byte arrays: words, word hashes and k-grams of many documents at once, in numpy.

An Arrow string column already holds all its texts as one run of bytes and an array of offsets. The helpers
work on that run in blocks of half a megabyte, so the memory of a task is bounded by a block (or by the longest
single text) and no Python object is made per document or word. Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

BLOCK_BYTES = 500_000
#: Words longer than this get the hash of their whole bytes instead of one step per byte.
LONG_WORD = 64

_MIX = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_A = np.uint64(0xBF58476D1CE4E5B9)
_B = np.uint64(0x94D049BB133111EB)


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """Which byte values belong to a word, from inclusive ranges."""
    table = np.zeros(256, bool)
    for a, b in ranges:
        table[a : b + 1] = True
    return table


#: Digits, ASCII letters and everything that is not ASCII.
ALNUM = byte_table((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
#: Everything but blank, tab, newline, vertical tab, form feed and carriage return.
NOT_BLANK = ~byte_table((0x20, 0x20), (0x09, 0x0D))
#: A-Z to a-z, other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and where each begins (one entry more than texts)."""
    texts = pc.fill_null(texts, "")
    size = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, size)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole, at


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first and last index, their bytes, their offsets."""
    data, at = flat(texts)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * _A
    h = (h ^ (h >> np.uint64(27))) * _B
    return h ^ (h >> np.uint64(31))


def word_spans(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document of each word. No word crosses the edge of a document."""
    if not len(data):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    inside = table[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word. One step per byte position over all words still going."""
    size = ends - starts
    h = size.astype(np.uint64) * _P
    live = np.arange(len(starts))
    for k in range(LONG_WORD):
        live = live[size[live] > k]
        if not len(live):
            break
        h[live] = (h[live] ^ _MIX[data[starts[live] + k]]) * _P + (h[live] >> np.uint64(29))
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return mix(h)


def kgrams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words of one document, and the index of its first word."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, np.uint64(k))
    for j in range(k):
        out = out * _P + h[j : j + n]
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(out[at]), at


def counts(doc: np.ndarray, n: int) -> np.ndarray:
    """How many entries each document has."""
    return np.bincount(doc, minlength=n).astype(np.int64)
