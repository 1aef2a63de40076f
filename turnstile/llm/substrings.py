"""Substring dedup: windows of words that also start earlier, found with FM-indexes.

A window's minimizer is the smallest hash of its runs of ``RUN`` words, so equal
windows share it. Neighbouring windows with the same minimizer form a segment;
segments travel by minimizer, and those whose minimizer occurs once are dropped,
since none of their windows can occur twice. Equal segments are one query: the
later ones are answered by the first. What is left goes to shards, each with a
compressed FM-index of its segments, against which every segment is streamed; its
matching statistics give the windows with an earlier place.

Words are compared by 64-bit hashes, segments by 64-bit hashes of these.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnstile.llm.fmindex import earlier_windows
from turnstile.llm.heavy import among, heavy_values
from turnstile.llm.order import partitions
from turnstile.llm.stored import stored
from turnstile.llm.words import grams, hash_slices, keys, mix, owners, passes, split_words, text_bytes, window_argmin

WINDOW = 20
RUN = 8
#: Words of a shard, as planned; segments of one minimizer stay together up to CROWD.
SHARD_WORDS = 250_000
#: Minimizers with more distinct segments are split into windows, each by its own hash.
CROWD = 4096
#: Minimizers in this share of the documents are split so before they travel.
HEAVY = 0.002


def segments(words: np.ndarray, word_bounds: np.ndarray, window: int, run: int):
    """Minimizer, start, words and text of every run of windows that share a minimizer's place."""
    at, text = owners(word_bounds, window)
    if not len(at):
        return (np.empty(0, np.uint64), *(np.empty(0, np.int64) for _ in range(3)))
    hashes = grams(words, run)
    place = window_argmin(hashes, window - run + 1)[at]
    new = np.ones(len(at), bool)
    new[1:] = (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    sizes = np.diff(np.append(first, len(at))) + window - 1
    return hashes[place[first]], at[first], sizes, text[first]


def contents(words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A hash of each segment's words."""
    total = sizes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    padded = np.append(words, np.zeros(int(sizes.max()) if len(sizes) else 0, np.uint64))
    for j, key in enumerate(keys(int(sizes.max()) if len(sizes) else 0)):
        total += np.where(j < sizes, padded[starts + j], np.uint64(0)) * key
    return mix(total)


def _windows(starts: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the single windows of segments, and each one's segment."""
    counts = sizes - window + 1
    owner = np.repeat(np.arange(len(starts)), counts)
    return starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts), owner


def _minimizers(window: int, run: int):
    def values(buffer: np.ndarray, bounds: np.ndarray):
        starts, ends, word_bounds = split_words(buffer, bounds)
        found, _, _, text = segments(hash_slices(buffer, starts, ends), word_bounds, window, run)
        return found, text

    return values


ROWS = "key bigint, content bigint, doc bigint, start bigint, size bigint, later boolean"
_ROWS = pa.schema([(c, pa.int64()) for c in ("key", "content", "doc", "start", "size")] + [("later", pa.bool_())])


def segment_rows(docs: DataFrame, window: int, run: int, heavy: np.ndarray) -> DataFrame:
    """All segments of (doc, text). Of equal ones in a pass all but the first are ``later`` and keyed at random."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                buffer, bounds = text_bytes(part.column("text"))
                begins, ends, word_bounds = split_words(buffer, bounds)
                words = hash_slices(buffer, begins, ends)
                key, start, size, text = segments(words, word_bounds, window, run)
                hot = among(key, heavy)
                if hot.any():
                    single, owner = _windows(start[hot], size[hot], window)
                    whole = contents(words, single, np.full(len(single), window))
                    key = np.concatenate([key[~hot], mix(whole)])
                    text = np.concatenate([text[~hot], text[hot][owner]])
                    start = np.concatenate([start[~hot], single])
                    size = np.concatenate([size[~hot], np.full(len(single), window)])
                content = contents(words, start, size)
                doc = part.column("doc").to_numpy()[text]
                start = start - word_bounds[text]
                order = np.lexsort((start, doc, content))
                same = content[order]
                later = np.zeros(len(order), bool)
                later[order[1:]] = same[1:] == same[:-1]
                key = np.where(later, mix(doc.view(np.uint64) + start.view(np.uint64)), key)
                yield pa.record_batch([key.view(np.int64), content.view(np.int64), doc, start, size, later], schema=_ROWS)

    return docs.mapInArrow(cut, ROWS)


def match_segments(rows: DataFrame) -> DataFrame:
    """Group segments by key. Returns (key, content, doc, start, size, later).

    Later places of equal segments are marked ``later``; their windows all start
    earlier elsewhere. First places are returned if other segments share their
    key. Keys are walked in sorted order with the state of one segment in memory.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last first place, not yet known to share its key
        last = None  # key and content before this batch
        for batch in batches:
            if not batch.num_rows:
                continue
            later = batch.column("later").to_numpy(zero_copy_only=False)
            if later.any():
                yield batch.filter(pa.array(later))
                batch = batch.filter(pa.array(~later))
                if not batch.num_rows:
                    continue
            key, content = batch.column("key").to_numpy(), batch.column("content").to_numpy()
            before_key, before = np.roll(key, 1), np.roll(content, 1)
            same_key = key == before_key
            same_key[0] = last is not None and last[0] == key[0]
            before[0] = last[1] if last else 0
            equal = same_key & (content == before)
            first = ~equal
            if equal.any():
                again = batch.filter(pa.array(equal))
                yield again.set_column(5, "later", pa.array(np.ones(again.num_rows, bool)))
            last = key[-1], content[-1]
            places = np.flatnonzero(first)
            if not len(places):
                continue
            own = key[places]
            left = np.zeros(len(places), bool)
            left[1:] = own[1:] == own[:-1]
            left[0] = held is not None and held.column("key")[0].as_py() == own[0]
            if left[0] and held_alone:
                yield held
            right = np.zeros(len(places), bool)
            right[:-1] = own[1:] == own[:-1]
            shared = left | right
            out = batch.take(pa.array(places[shared]))
            if out.num_rows:
                yield out
            held = batch.slice(int(places[-1]), 1)
            held_alone = not shared[-1]

    n = partitions(rows)
    grouped = rows.repartition(n, "key").sortWithinPartitions("key", "content", "doc", "start")
    return grouped.mapInArrow(walk, ROWS)


def indexed_spans(docs: DataFrame, firsts: DataFrame, window: int) -> DataFrame:
    """Spans (doc, start, size) of first places whose windows start earlier, by the shards' FM-indexes."""
    total = firsts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_WORDS))
    crowded = firsts.groupBy("key").count().filter(F.col("count") > CROWD).select("key", F.lit(True).alias("crowded"))
    wanted = (
        firsts.join(crowded, "key", "left")
        .groupBy("doc")
        .agg(F.collect_list(F.struct("start", "size", "key", F.coalesce("crowded", F.lit(False)).alias("crowded"))).alias("wanted"))
    )
    fetched = docs.join(wanted, "doc").select("doc", "text", "wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                buffer, bounds = text_bytes(part.column("text"))
                begins, ends, word_bounds = split_words(buffer, bounds)
                words = hash_slices(buffer, begins, ends)
                cells = part.column("wanted")
                counts = np.diff(cells.offsets.to_numpy())
                flat = cells.flatten()
                start, size, key, crowd = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                text = np.repeat(np.arange(part.num_rows), counts)
                start = start + word_bounds[text]
                if crowd.any():
                    single, owner = _windows(start[crowd], size[crowd], window)
                    text = np.concatenate([text[~crowd], text[crowd][owner]])
                    start = np.concatenate([start[~crowd], single])
                    whole = contents(words, single, np.full(len(single), window))
                    key = np.concatenate([key[~crowd], whole.view(np.int64)])
                    size = np.concatenate([size[~crowd], np.full(len(single), window)])
                offsets = np.concatenate([[0], np.cumsum(size)])
                at = np.arange(offsets[-1]) - np.repeat(offsets[:-1], size) + np.repeat(start, size)
                yield pa.record_batch(
                    [
                        pa.array(key),
                        pa.array(part.column("doc").to_numpy()[text]),
                        pa.array(start - word_bounds[text]),
                        pa.ListArray.from_arrays(offsets.astype(np.int32), pa.array(words[at].view(np.int64))),
                    ],
                    ["key", "doc", "start", "words"],
                )

    sent = fetched.mapInArrow(fetch, "key bigint, doc bigint, start bigint, words array<bigint>")
    sent = sent.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            cuts = np.flatnonzero(np.diff(batch.column("shard").to_numpy())) + 1
            for a, b in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                part = batch.slice(a, b - a)
                if held and part.num_rows and held[-1].column("shard")[0] != part.column("shard")[0]:
                    yield _search_shard(held, window)
                    held = []
                if part.num_rows:
                    held.append(part)
        if held:
            yield _search_shard(held, window)

    n = partitions(docs)
    return (
        sent.repartition(n, "shard")
        .sortWithinPartitions("shard", "doc", "start")
        .mapInArrow(search, "doc bigint, start bigint, size bigint")
    )


def _search_shard(parts: list[pa.RecordBatch], window: int) -> pa.RecordBatch:
    rows = pa.Table.from_batches(parts).combine_chunks()
    doc, start = rows["doc"].to_numpy(), rows["start"].to_numpy()
    cells = rows["words"].combine_chunks()
    offsets = cells.offsets.to_numpy()
    flat = cells.flatten().to_numpy()
    words = [flat[a:b] for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)]
    _, rank = np.unique(doc, return_inverse=True)
    out = []
    for i, earlier in enumerate(earlier_windows(words, (rank.astype(np.int64) << 32) + start, window)):
        if earlier.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[0], earlier.view(np.int8), [0]])))
            out += [(doc[i], start[i] + a, b - a + window - 1) for a, b in edge.reshape(-1, 2)]
    table = np.array(out, np.int64).reshape(-1, 3)
    return pa.record_batch([table[:, 0], table[:, 1], table[:, 2]], ["doc", "start", "size"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """Spans (doc, start, size) that cover every window of (doc, text) that also starts earlier."""
    run = min(run, window)
    heavy = heavy_values(docs, _minimizers(window, run), HEAVY)
    found = stored(match_segments(segment_rows(docs, window, run, heavy)), "segments")
    later = found.filter("later").select("doc", "start", "size")
    return later.unionByName(indexed_spans(docs, found.filter("not later"), window))


def document_keys(df: DataFrame, id: str, text: str, carry: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(id, text, doc) of every row, and the distinct ones, with ``doc`` unique per distinct row and rising with the id.

    It is the id itself if no id is null or repeated; else the rank of id (null
    first) and text among the distinct rows.
    """
    rows = df.select(
        F.col(id).cast("long").alias("id"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        *([F.struct(*carry).alias("others")] if carry else []),
    )
    bad = rows.groupBy("id").count().filter("id is null or count > 1")
    if bad.isEmpty():
        keyed = rows.withColumn("doc", F.col("id"))
        return keyed, keyed
    tagged = rows.withColumn("tag", F.sha2("text", 256))
    ranked = tagged.select("id", "tag").distinct().orderBy(F.col("id").asc_nulls_first(), "tag")
    ranks = stored(
        df.sparkSession.createDataFrame(
            ranked.rdd.zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1])), "rank_id bigint, rank_tag string, doc bigint"
        ),
        "ranks",
    )
    same = F.col("id").eqNullSafe(F.col("rank_id")) & (F.col("tag") == F.col("rank_tag"))
    keyed = tagged.join(ranks, same).select(*rows.columns, "doc")
    return keyed, keyed.dropDuplicates(["doc"])


def remove_repeats(
    df: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    run: int = RUN,
    carry: Sequence[str] = (),
    joined: bool = True,
) -> DataFrame:
    """(id, n_words, n_removed, kept, carry) for every row; ``kept`` has the words left, joined by one space.

    Without ``joined`` a text that loses nothing stays as it is.

    A word goes if a window of ``window`` words that covers it also starts
    earlier: in a smaller id, or earlier in its document. Windows are judged on
    the input. Null texts are empty; texts with fewer words lose nothing. Rows
    with a null id come first; of rows with one id the smaller hash of the text;
    equal rows count as one document and get equal results.
    """
    docs, distinct = document_keys(df, id, text, carry)
    spans = repeated_spans(distinct.select("doc", "text"), window, run)
    by_doc = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "size")).alias("spans"))

    found = docs.join(by_doc, "doc", "left").select("id", *(["others"] if carry else []), "text", "spans")
    ends = found.columns[: -2]
    schema = StructType([*found.select(ends).schema, *StructType.fromDDL("n_words bigint, n_removed bigint, kept string")])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                rows = zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True)
                counts, removed, kept = zip(*(_kept(*row, joined) for row in rows), strict=True)
                new = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ends), *new], schema.names)

    kept = found.mapInArrow(keep, schema).withColumnRenamed("id", id)
    return kept.select(id, "n_words", "n_removed", "kept", *(["others.*"] if carry else []))


def _kept(text: str, spans: list | None, joined: bool) -> tuple[int, int, str]:
    words = text.encode().split()  # bytes.split() parts at 0x20 and 0x09 to 0x0D
    if not spans:
        return len(words), 0, b" ".join(words).decode() if joined else text
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, [s["start"] for s in spans], 1)
    np.add.at(edges, [s["start"] + s["size"] for s in spans], -1)
    stays = np.cumsum(edges)[:-1] == 0
    kept = list(compress(words, stays))
    return len(words), len(words) - len(kept), b" ".join(kept).decode()
