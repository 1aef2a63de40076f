"""A compressed FM-index over short word sequences.

The text is the given sequences, each closed by a separator that no pattern can
hold. Its Burrows-Wheeler transform is kept as a wavelet tree in level order: one
packed bit plane per bit of a symbol, with counts per 64 bits. Backward search
runs over many patterns at once.
"""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; every separator differs from all others."""
    n = len(symbols)
    rank = symbols.astype(np.int64) + len(separators)
    rank[separators] = np.arange(len(separators))
    span = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - span] = rank[span:] + 1
        pair = rank * (int(follow.max()) + 1) + follow
        order = np.argsort(pair, kind="stable")
        sorted_pair = pair[order]
        step = np.empty(n, np.int64)
        step[0] = 0
        step[1:] = np.cumsum(sorted_pair[1:] != sorted_pair[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = step
        if step[-1] == n - 1:
            return order
        span *= 2


class BitPlane:
    """Packed bits with the number of ones before every word of 64."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones) - ones
        self.zeros = len(bits) - int(ones.sum())

    def ones(self, ends: np.ndarray) -> np.ndarray:
        """How many ones come before each place."""
        word = ends >> 6
        mask = (np.uint64(1) << (ends & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class FMIndex:
    """Counts and places of patterns in ``symbols``; symbol 0 is the separator, the others are 1 to ``sigma``."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = len(symbols)
        separators = np.flatnonzero(symbols == 0)
        self.places = suffix_array(symbols, separators)
        last = symbols[self.places - 1]
        counts = np.bincount(symbols, minlength=sigma + 2)
        self.begins = np.cumsum(counts) - counts
        self.levels = max(1, int(sigma).bit_length())
        self.planes = []
        for level in reversed(range(self.levels)):
            bits = ((last >> level) & 1).astype(np.uint8)
            self.planes.append(BitPlane(bits))
            last = np.concatenate([last[bits == 0], last[bits == 1]])
        self.first = self._descend(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))

    def _descend(self, symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
        for level, plane in zip(reversed(range(self.levels)), self.planes, strict=True):
            ones = plane.ones(ends)
            ends = np.where((symbols >> level) & 1, plane.zeros + ones, ends - ones)
        return ends

    def extend(self, symbols: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front: a step of backward search."""
        ends = self._descend(np.concatenate([symbols, symbols]), np.concatenate([lows, highs]))
        base = np.concatenate([self.begins[symbols] - self.first[symbols]] * 2)
        return tuple(np.split(ends + base, 2))

    def matching_statistics(self, text: np.ndarray, ends: np.ndarray, threshold: int):
        """For each end in ``text``, how far the match before it can grow to the left, up to ``threshold``.

        ``text`` holds symbols of this index. A match counts while the index has at
        least two places for it, since ``text`` itself is one of them. Returns the
        lengths and the suffix intervals of those that reach the threshold.
        """
        lengths = np.zeros(len(ends), np.int64)
        lows, highs = np.zeros(len(ends), np.int64), np.full(len(ends), self.n, np.int64)
        live = np.arange(len(ends))
        for step in range(1, threshold + 1):
            at = ends[live] - step
            live = live[at >= 0]
            symbols = text[ends[live] - step]
            low, high = self.extend(symbols, lows[live], highs[live])
            keep = (high - low > 1) & (symbols > 0)
            live = live[keep]
            lows[live], highs[live] = low[keep], high[keep]
            lengths[live] = step
        return lengths, lows, highs

    def least(self, lows: np.ndarray, highs: np.ndarray, values: np.ndarray) -> np.ndarray:
        """The least of ``values`` (one per place of the text) in each interval of suffixes."""
        if not len(lows):
            return np.empty(0, values.dtype)
        spans, back = np.unique(np.stack([lows, highs]), axis=1, return_inverse=True)
        ordered = np.append(values[self.places], values.max())
        least = np.minimum.reduceat(ordered, spans.T.ravel())[::2]
        return least[back.ravel()]


def earlier_windows(words: list[np.ndarray], orders: np.ndarray, threshold: int) -> list[np.ndarray]:
    """For each sequence, whether each of its windows of ``threshold`` words also starts earlier in another.

    ``orders`` rises with the place where a sequence begins; a window's place is
    its sequence's plus its offset. Sequences are unequal and may overlap.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.concatenate([x for w in words for x in (w, w[:1])]) if len(words) else np.empty(0, np.uint64)
    ends = np.cumsum(sizes + 1) - 1
    alphabet, symbols = np.unique(flat, return_inverse=True)
    symbols = symbols.astype(np.int64) + 1
    symbols[ends] = 0
    index = FMIndex(symbols, len(alphabet))
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    offset = np.arange(len(symbols)) - (ends - sizes)[owner]
    value = orders[owner] + offset
    stops = np.flatnonzero((offset >= threshold) & (symbols >= 0))
    lengths, lows, highs = index.matching_statistics(symbols, stops, threshold)
    hit = lengths == threshold
    result = np.zeros(len(stops), bool)
    result[hit] = index.least(lows[hit], highs[hit], value) < value[stops[hit] - threshold]
    return np.split(result, np.cumsum(np.maximum(sizes - threshold + 1, 0))[:-1]) if len(words) else []
