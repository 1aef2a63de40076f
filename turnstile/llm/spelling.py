"""Spelling variants: rare words that are one edit away from a much more frequent word.

Words meet by asymmetric chunks. The longer word of a pair (of equally long ones
the first in code-point order) contributes two disjoint chunks of half its
length, its start and its end. The other contributes its positional grams of
that length. One edit leaves one of the two chunks whole and moves it by one
place at most, so only the grams at shift nought or one can meet a chunk. What
meets is verified. A gram of very many words is cut further: one edit outside
the chunk leaves a half of the remainder whole too, and the pair is joined on
both.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.stored import forget, stored, stored_at
from turnstile.llm.words import LOWER, hash_slices, passes, split_words, text_bytes

#: Bytes of text that one numpy pass handles.
PASS_BYTES = 1 << 22
#: Runs longer than this are summed one by one.
LONG = 64
#: A gram of more words than this is cut further.
CROWD = 50

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LEAD = 0xC3  # U+00C0 to U+00FF are this byte and one more


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> 1), table >> 1)
    return table


CRC = _crc_table()


def crc32_from(states: np.ndarray, buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """crc32 of each slice, continued from the crc32 of what stands before it; short slices advance together."""
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(starts - ends, kind="stable")
    sizes = (ends - starts)[order]
    n_long = int(np.searchsorted(-sizes, -LONG))
    for i in order[:n_long]:
        out[i] = zlib.crc32(buffer[starts[i] : ends[i]].tobytes(), int(states[i]))
    order, sizes = order[n_long:], sizes[n_long:]
    crc, at = ~states[order], starts[order]
    for p in range(int(sizes[0]) if len(sizes) else 0):
        m = int(np.searchsorted(-sizes, -p))
        crc[:m] = CRC[(crc[:m] ^ buffer[at[:m] + p]) & np.uint32(255)] ^ (crc[:m] >> np.uint32(8))
    out[order] = ~crc
    return out


def runs(buffer: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, lengths in code points and texts of the letter runs with ``least`` code points."""
    lead = buffer == _LEAD
    inside = _LETTER[buffer] | lead
    inside[1:] |= lead[:-1]
    starts, ends, word_bounds = split_words(np.where(inside, buffer, np.uint8(0x20)), bounds)
    leads = np.concatenate([[0], np.cumsum(lead)])
    lengths = ends - starts - (leads[ends] - leads[starts])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(word_bounds))
    kept = lengths >= least
    return starts[kept], ends[kept], lengths[kept], text[kept]


def gathered(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.StringArray:
    """The slices as a string column."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], sizes) + np.repeat(starts, sizes)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(buffer[at]))


def count_runs(buffer: np.ndarray, bounds: np.ndarray, ids: list, divisor: int, least: int) -> tuple[pa.Array, np.ndarray]:
    """Distinct words of some texts and their counts, after the seeded deletions."""
    buffer = LOWER[buffer]
    starts, ends, lengths, text = runs(buffer, bounds, least)
    heads = np.array([zlib.crc32(f"{'' if i is None else i}:".encode()) for i in ids], np.uint32)
    crc = crc32_from(heads[text], buffer, starts, ends)
    hit = crc % divisor == 0
    edited = []
    for a, b, n, h in zip(starts[hit], ends[hit], lengths[hit], crc[hit], strict=True):
        word = buffer[a:b].tobytes().decode()
        at = int(h) % int(n)
        if n > least:
            edited.append(word[:at] + word[at + 1 :])
    starts, ends = starts[~hit], ends[~hit]
    _, first, counts = np.unique(hash_slices(buffer, starts, ends), return_index=True, return_counts=True)
    words = gathered(buffer, starts[first], ends[first])
    return pa.concat_arrays([words, pa.array(edited, pa.string())]), np.concatenate([counts, np.ones(len(edited), np.int64)])


def word_counts(
    df: DataFrame, id: str = "doc_id", text: str = "text", divisor: int = 199, least: int = 6, occurrences: int = 5
) -> DataFrame:
    """(word, n): the words of all texts with ``least`` code points and ``occurrences`` in all.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased.
    Where ``divisor`` divides the crc32 of "id:run", the code point at that crc32
    modulo the length is missing from the word. A null text has no words, a null id
    counts as an empty one, repeated rows count each. Counts are added up in the
    task before they travel.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch, "text", PASS_BYTES):
                words, counts = count_runs(*text_bytes(part.column("text")), part.column("id").to_pylist(), divisor, least)
                yield pa.record_batch([words, pa.array(counts, pa.int64())], ["word", "n"])

    rows = df.select(F.col(id).cast("string").alias("id"), F.col(text).cast("string").alias("text"))
    counted = rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= occurrences)


def _tail(word: Column, size: Column) -> Column:
    return F.substring(word, F.length(word) - size + 1, size)


def _pieces(words: DataFrame, chunks: bool) -> DataFrame:
    """(key, word, n, slot, size): the two chunks of each word, or the grams that chunks of its length and of one more can meet."""
    own = F.length("word")
    sizes = F.array(own) if chunks else F.array(own, own + 1)
    rows = words.select("word", "n", F.explode(sizes).alias("size"))
    half = (F.col("size") / 2).cast("int")
    slots = F.array(
        F.struct(F.lit(1).alias("slot"), F.substring("word", F.lit(1), half).alias("chunk")),
        F.struct(F.lit(2).alias("slot"), _tail(F.col("word"), half).alias("chunk")),
    )
    rows = rows.select("word", "n", "size", F.inline(slots))
    return rows.select(F.xxhash64("size", "slot", "chunk").alias("key"), "word", "n", "slot", "size")


def _halves(pieces: DataFrame) -> DataFrame:
    """The rows of ``_pieces`` twice, with the start and the end of what the chunk leaves over as part of the key."""
    half = (F.col("size") / 2).cast("int")
    rest = F.when(F.col("slot") == 1, F.substring("word", half + 1, F.length("word"))).otherwise(
        F.substring("word", F.lit(1), F.length("word") - half)
    )
    first = ((F.col("size") - half) / 2).cast("int")
    parts = F.array(
        F.struct(F.lit(1).alias("part"), F.substring(rest, F.lit(1), first).alias("piece")),
        F.struct(F.lit(2).alias("part"), _tail(rest, F.col("size") - half - first).alias("piece")),
    )
    rows = pieces.select("key", "word", "n", "slot", "size", F.inline(parts))
    return rows.select(F.xxhash64("key", "part", "piece").alias("key"), "word", "n", "slot", "size", "part")


def _verified(left: DataFrame, right: DataFrame, parts: bool) -> DataFrame:
    """(a, n_a, b, n_b): pairs of equal keys at one edit. A pair that met in an earlier slot or part is not counted again."""
    a = left.select("key", "slot", "size", F.col("word").alias("a"), F.col("n").alias("n_a"), *(["part"] if parts else []))
    b = right.select("key", F.col("word").alias("b"), F.col("n").alias("n_b"))
    half = (F.col("size") / 2).cast("int")
    first = ((F.col("size") - half) / 2).cast("int")
    fresh = (F.col("slot") == 1) | (F.substring("a", F.lit(1), half) != F.substring("b", F.lit(1), half))
    if parts:
        start = F.when(F.col("slot") == 1, half + 1).otherwise(1)
        fresh &= (F.col("part") == 1) | (F.substring("a", start, first) != F.substring("b", start, first))
    longer = (F.length("a") > F.length("b")) | (F.col("a") < F.col("b"))
    met = a.join(b, "key").filter(longer & fresh)
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "n_a", "b", "n_b")


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """(a, n_a, b, n_b): every unordered pair of distinct words at exactly one inserted, deleted or replaced code point, once.

    ``words`` is (word, n) with distinct words of two code points at least.
    """
    chunks, grams = _pieces(words, True), _pieces(words, False)
    crowded = grams.groupBy("key").count().filter(F.col("count") > crowd).select("key")
    crowded = stored(crowded, "crowded")
    light = _verified(chunks.join(crowded, "key", "left_anti"), grams, False)
    heavy = _verified(
        _halves(chunks.join(crowded, "key", "left_semi")), _halves(grams.join(crowded, "key", "left_semi")), True
    )
    return light.unionByName(heavy)


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word on the way of forms from each word of (word, form).

    Pointer jumping: each round joins the table with itself, so the number of
    rounds is the logarithm of the longest way. Forms must not run in a circle.
    """
    links, path = stored_at(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = links.join(further, "root", "left")
        new, new_path = stored_at(joined.select("word", F.coalesce("further", "root").alias("root"), "further"), "forms")
        forget(links, path)
        links, path = new, new_path
        if new.filter("further is not null").isEmpty():
            return links.select("word", "root")
        links = links.select("word", "root")


def spelling_variants(df: DataFrame, id: str = "doc_id", text: str = "text", ratio: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for each word of ``word_counts``.

    ``n_near`` counts the words at one edit. ``form`` is the most frequent of them
    (of equally frequent ones the first in code-point order) if it occurs at least
    ``ratio`` times as often as the word, else null; ``form_n`` is its count.
    ``root`` follows forms to the last one, a word without form is its own root.
    ``ratio`` is above 1, so forms cannot run in a circle. An empty table gives no rows.
    """
    words = stored(word_counts(df, id, text), "words")
    pairs = near_words(words)
    # Both directions of a pair as it is found: a union would plan and run near_words twice.
    directions = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")),
    )
    both = pairs.select(F.inline(directions))
    best = both.groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best")
    )
    counted = F.coalesce("n_near", F.lit(0).cast("long"))
    enough = -F.col("best.less") >= ratio * F.col("n")
    judged = words.join(best, "word", "left").select(
        "word", "n", counted.alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")
    )
    judged = stored(judged, "variants")
    ends = roots(judged.filter("form is not null"))
    found = judged.join(ends, "word", "left")
    return found.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
