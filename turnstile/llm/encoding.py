"""Encoding of distinct chunks: texts are cut where no token can cross, and equal chunks are encoded once.

``ByteEncoder`` runs the tokenizers library, whose first step parts a text so
that a lone space opens the next part and a lone newline is a part of its own;
no merge crosses parts. The ids are those of encoding each whole text.
"""

from __future__ import annotations

import json
import os
from abc import ABC, abstractmethod

import numpy as np

from turnstile.llm.words import hash_slices

SPACE, NEWLINE = 0x20, 0x0A

#: A worker forgets its chunks when it has so many; they are encoded again when met.
REMEMBERED = 1 << 21

#: Chunks that go to the library as one string.
TOGETHER = 16


def cuts(buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Starts of the chunks: a lone space, or a lone newline and what follows it, between visible characters.

    Bytes that could belong to a wide space (after 0xC2, or in a sequence that
    opens with 0xE1 to 0xE3) do not count as visible.
    """
    n = len(buffer)
    out = np.zeros(n + 1, bool)
    out[bounds] = True
    if n > 2:
        opens = (buffer > 0x20) & (buffer != 0x7F) & (buffer != 0xC2) & ((buffer < 0xE1) | (buffer > 0xE3))
        closes = (buffer > 0x20) & (buffer != 0x7F)
        closes[1:] &= (buffer[:-1] != 0xC2) | (buffer[1:] < 0x80)
        closes[2:] &= (buffer[:-2] < 0xE1) | (buffer[:-2] > 0xE3) | (buffer[2:] < 0x80)
        lone = np.zeros(n, bool)
        lone[1:-1] = closes[:-2] & opens[2:]
        edges = bounds[(bounds > 0) & (bounds < n)]
        lone[edges] = False
        lone[edges - 1] = False
        space, line = lone & (buffer == SPACE), lone & (buffer == NEWLINE)
        out[:-1] |= space | line
        out[1:] |= line
    return np.flatnonzero(out[:n])


class ChunkEncoder(ABC):
    """Remembers the ids of chunks by their hashes, for as long as the Python worker lives."""

    _known: dict[tuple[type, str], ChunkEncoder] = {}

    @classmethod
    def shared(cls, path: str):
        """One per Python worker and file."""
        if (cls, path) not in cls._known:
            cls._known[cls, path] = cls(path)
        return cls._known[cls, path]

    def __init__(self) -> None:
        self.forget()

    def forget(self) -> None:
        self.hashes = np.empty(0, np.uint64)
        self.places = np.empty(0, np.int64)
        self.sizes = np.empty(0, np.int64)
        self.ids = np.empty(0, np.uint32)

    @abstractmethod
    def cuts(self, buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Starts of the chunks of some texts; every byte is in a chunk and no chunk crosses texts."""

    @abstractmethod
    def encode_chunks(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the chunks, one after another, and the number of ids of each."""

    def encode(self, buffer: np.ndarray, bounds: np.ndarray, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of ids of each; ``end`` is put after each text."""
        starts = self.cuts(buffer, bounds)
        ends = np.append(starts[1:], len(buffer))
        hashes = hash_slices(buffer, starts, ends)
        distinct, first = np.unique(hashes, return_index=True)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        at = np.searchsorted(self.hashes, distinct)
        new = np.ones(len(distinct), bool)
        inside = at < len(self.hashes)
        new[inside] = self.hashes[at[inside]] != distinct[inside]
        if new.any():
            ids, sizes = self.encode_chunks(buffer.tobytes(), starts[first[new]], ends[first[new]])
            places = len(self.ids) + np.cumsum(sizes) - sizes
            self.ids = np.concatenate([self.ids, ids])
            self.hashes = np.insert(self.hashes, at[new], distinct[new])
            self.places = np.insert(self.places, at[new], places)
            self.sizes = np.insert(self.sizes, at[new], sizes)
        at = np.searchsorted(self.hashes, hashes)
        sizes, places = self.sizes[at], self.places[at]
        text = np.searchsorted(bounds, starts, side="right") - 1
        counts = np.bincount(text, sizes, minlength=len(bounds) - 1).astype(np.int64)
        total = np.cumsum(sizes) - sizes
        ids = self.ids[np.arange(int(sizes.sum())) - np.repeat(total, sizes) + np.repeat(places, sizes)]
        if end is not None:
            ids = np.insert(ids, np.cumsum(counts), np.uint32(end))
            counts = counts + 1
        return ids, counts


class ByteEncoder(ChunkEncoder):
    """Byte-level BPE of a tokenizers file."""

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        first = content.get("pre_tokenizer") or {}
        if first.get("type") != "ByteLevel" or first.get("add_prefix_space") or content.get("normalizer"):
            raise ValueError("needs a byte-level tokenizer without prefix space and normalizer")
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.widths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)  # one character stands for one byte

    def cuts(self, buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return cuts(buffer, bounds)

    def encode_chunks(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks that open with a space and end visibly can follow one another in one string;
        the ids are dealt back to the chunks by their lengths in bytes.
        """
        buffer = np.frombuffer(data, np.uint8)
        last, second = buffer[ends - 1], buffer[np.minimum(starts + 1, ends - 1)]
        joins = (buffer[starts] == SPACE) & (second > 0x20) & (second < 0x7F) & (last > 0x20) & (last < 0x7F)
        order = np.argsort(~joins, kind="stable")
        parts = [data[a:b] for a, b in zip(starts[order], ends[order], strict=True)]
        n = int(joins.sum())
        strings = [b"".join(parts[i : min(i + TOGETHER, n)]).decode() for i in range(0, n, TOGETHER)]
        strings += [x.decode() for x in parts[n:]]
        found = self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)
        ids = np.concatenate([np.empty(0, np.uint32), *(np.array(e.ids, np.uint32) for e in found)])
        token_ends = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum((ends - starts)[order])) + 1
        sizes = np.diff(token_ends, prepend=0)
        return in_order(ids, sizes, order)


def in_order(ids: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put runs of ids, given in some order of their owners, into the owners' own order."""
    begins = np.empty(len(order), np.int64)
    begins[order] = np.cumsum(sizes) - sizes
    own = np.empty(len(order), np.int64)
    own[order] = sizes
    total = np.cumsum(own) - own
    return ids[np.arange(len(ids)) - np.repeat(total, own) + np.repeat(begins, own)], own
