"""Vectorised helpers over Arrow text columns: words, 64-bit hashes, windows.

A text column is seen as one byte buffer plus bounds, so that a batch of
documents is split and hashed by a few numpy passes. All hashes are keyed
multilinear sums modulo 2**64 behind a finaliser; they are the same in every
task and every run.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one numpy pass handles, unless a single text is longer.
PASS_BYTES = 1 << 21

#: True for the bytes that part words: 0x20 and 0x09 to 0x0D.
GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True

#: Maps A-Z to a-z and every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_keys = np.empty(0, np.uint64)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = np.asarray(values, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def keys(n: int) -> np.ndarray:
    """The first n odd keys of the hash."""
    global _keys
    if len(_keys) < n:
        size = max(n, 256, 2 * len(_keys))
        _keys = mix(np.arange(1, size + 1, dtype=np.uint64) * _ODD) | np.uint64(1)
    return _keys[:n]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its texts; null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    bounds = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]], bounds - bounds[0]


def passes(batch: pa.RecordBatch, column: str = "text", limit: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``limit`` bytes of text, or one longer text."""
    _, bounds = text_bytes(batch.column(column))
    begin = 0
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(bounds, bounds[begin] + limit, side="right")) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def split_words(buffer: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = GAPS):
    """Starts and ends of all words in bytes, and for each text the bounds of its words."""
    inside = ~gaps[buffer]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    edges = bounds[:-1][bounds[:-1] < len(buffer)]
    first[edges] = inside[edges]
    before = edges[edges > 0] - 1
    last[before] = inside[before]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_slices(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every slice of bytes; slices are not empty and do not overlap."""
    if not len(starts):
        return np.empty(0, np.uint64)
    sizes = ends - starts
    offsets = np.cumsum(sizes) - sizes
    place = np.arange(int(sizes.sum()), dtype=np.int64) - np.repeat(offsets, sizes)
    at = place + np.repeat(starts, sizes)
    terms = (buffer[at].astype(np.uint64) + np.uint64(1)) * keys(int(sizes.max()))[place]
    return mix(np.add.reduceat(terms, offsets) + sizes.astype(np.uint64) * _ODD)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k neighbours; shorter than the input by k - 1."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, np.uint64)
    for j, key in enumerate(keys(k)):
        total += hashes[j : j + n] * key
    return mix(total)


def owners(word_bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the runs of k words that stay inside one text, and that text's index."""
    sizes = np.maximum(np.diff(word_bounds) - (k - 1), 0)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    offsets = np.cumsum(sizes) - sizes
    return np.arange(len(doc)) - offsets[doc] + word_bounds[:-1][doc], doc


def window_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """The place of the minimum of each window of w values; the rightmost of equal ones."""
    n = len(values) - w + 1
    if n <= 0:
        return np.empty(0, np.int64)
    best, place, span = values, np.arange(len(values)), 1
    while span < w:
        step = min(span, w - span)
        right = best[step:]
        left = best[: len(right)]
        later = right <= left
        place = np.where(later, place[step:], place[: len(right)])
        best = np.where(later, right, left)
        span += step
    return place[:n]
