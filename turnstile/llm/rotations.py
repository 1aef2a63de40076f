"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is turned by seeded random rotations and kept as the signs of the
result, with one correction factor per rotation: the inner product of the turned
vector and its sign vector. Turned back and divided by its factor, a sign vector
is an unbiased estimate of the vector, and estimates from different rotations of
two vectors give an unbiased estimate of their inner product with a known error.
Vectors meet on equal segments of their codes; of a pair that met, codes and
factors alone tell whether the cosine may reach the threshold, and only such
pairs have their vectors fetched and their cosine computed.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnstile.llm.components import components
from turnstile.llm.order import partitions
from turnstile.llm.stored import stored
from turnstile.llm.words import mix


@dataclass(frozen=True)
class Settings:
    """``miss`` is the chance that a pair right at the threshold meets on no segment; closer pairs are missed far less.

    ``width`` is the half width of the confidence interval of an estimate in
    standard deviations; ``block`` the members of a segment that one task compares
    with as many others.
    """

    cosine: float = 0.98
    miss: float = 1e-4
    width: float = 4.5
    block: int = 1024
    seed: int = 5


@dataclass(frozen=True)
class Shape:
    """Segments of ``bits`` signs each; enough of them for ``miss``, with signs for at least two buckets a vector."""

    bits: int
    segments: int
    settings: Settings

    def rotations(self, size: int) -> int:
        """Rotations for vectors of this size: an even number, since halves estimate against each other."""
        return 2 * math.ceil(self.bits * self.segments / (2 * size))


def shape_for(rows: int, settings: Settings) -> Shape:
    """More rows take longer segments, so that chance meetings stay a fixed share of the rows."""
    bits = min(60, max(4, math.ceil(math.log2(max(rows, 1))) + 2))
    same = (1 - math.acos(settings.cosine) / math.pi) ** bits
    return Shape(bits, max(1, math.ceil(math.log(settings.miss) / math.log(1 - same))), settings)


@functools.lru_cache(64)
def rotation(size: int, number: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng([seed, size, number]).standard_normal((size, size)))
    return q * np.where(np.diag(r) < 0, -1.0, 1.0)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Rows at length one; scaled by their largest component first, so that no square overflows."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def encode(vectors: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Signs (rows, rotations * size) and correction factors (rows, rotations) of unit vectors."""
    size = vectors.shape[1]
    signs, factors = [], []
    for r in range(shape.rotations(size)):
        turned = vectors @ rotation(size, r, shape.settings.seed).T
        signs.append(turned >= 0)
        factors.append(np.abs(turned).sum(axis=1) / math.sqrt(size))
    return np.concatenate(signs, axis=1), np.stack(factors, axis=1)


def segments(signs: np.ndarray, shape: Shape) -> np.ndarray:
    """The segments of each code as numbers (rows, segments)."""
    used = signs[:, : shape.bits * shape.segments].reshape(len(signs), shape.segments, shape.bits)
    return used.astype(np.uint64) @ (np.uint64(1) << np.arange(shape.bits, dtype=np.uint64))


def halves(signs: np.ndarray, factors: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Two unbiased estimates of each vector, from the even and the odd rotations, and their error variance per direction."""
    rotations = factors.shape[1]
    parts = np.zeros((2, len(signs), size), np.float32)
    for r in range(rotations):
        back = np.where(signs[:, r * size : (r + 1) * size], np.float32(1), np.float32(-1)) / np.float32(math.sqrt(size))
        parts[r % 2] += (back / factors[:, r : r + 1].astype(np.float32)) @ rotation(size, r, seed).astype(np.float32)
    spread = np.maximum(1 / factors.astype(np.float64) ** 2 - 1, 0) / max(size - 1, 1)
    return parts[0] / (rotations / 2), parts[1] / (rotations / 2), spread.max(axis=1) / (rotations / 2)


class Members:
    """Some whole groups of codes, in the order of their groups."""

    def __init__(self, batch: pa.RecordBatch, shape: Shape):
        self.shape, self.batch = shape, batch
        number = lambda name: batch.column(name).to_numpy(zero_copy_only=False)
        self.group, self.space, self.table = number("group"), number("space"), number("segment")
        self.side, self.inner = number("side"), number("inner")
        self.size = int(number("size")[0])
        rotations = shape.rotations(self.size)
        codes = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
        self.signs = np.unpackbits(codes, axis=1, count=rotations * self.size).astype(bool)
        factors = np.frombuffer(b"".join(batch.column("factors").to_pylist()), np.float32).reshape(-1, rotations)
        self.even, self.odd, self.spread = halves(self.signs, factors, self.size, shape.settings.seed)
        self.keys = segments(self.signs, shape)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs whose interval reaches the threshold, each in the group of the first segment that it shares."""
        settings, n = self.shape.settings, len(self.group)
        for step in range(1, n):
            same = self.group[:-step] == self.group[step:]
            if not same.any():
                return
            a = np.flatnonzero(same & (self.space[:-step] == self.space[step:]) & (self.table[:-step] == self.table[step:]))
            a = a[self.inner[a] | (self.side[a] != self.side[a + step])]
            b = a + step
            guess = (np.einsum("ij,ij->i", self.even[a], self.odd[b]) + np.einsum("ij,ij->i", self.odd[a], self.even[b])) / 2
            error = self.spread[a] + self.spread[b] + self.spread[a] * self.spread[b] * (self.size - 1)
            near = guess + settings.width * np.sqrt(error) + 1e-4 >= settings.cosine
            a, b = a[near], b[near]
            first = (self.keys[a] == self.keys[b]).argmax(axis=1)
            own = first == self.table[a]
            if own.any():
                yield a[own], b[own]


def grouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups and one vector size, of about ``rows`` rows or one group, from rows sorted by size and group."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        group, size = table["group"].to_numpy(), table["size"].to_numpy()
        edges = np.flatnonzero((group[1:] != group[:-1]) | (size[1:] != size[:-1])) + 1
        if len(edges):
            yield from _by_size(table.slice(0, edges[-1]))
            table = table.slice(edges[-1])
        held = table.to_batches()
    if held:
        yield from _by_size(pa.Table.from_batches(held))


def _by_size(table: pa.Table) -> Iterator[pa.RecordBatch]:
    size = table["size"].to_numpy()
    cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1), len(size)]
    for begin, end in zip(cuts[:-1], cuts[1:], strict=True):
        if end > begin:
            yield table.slice(begin, end - begin).combine_chunks().to_batches()[0]


def _local(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index reachable from each of n indexes over pairs."""
    least = np.arange(n)
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
        if np.array_equal(least, before):
            return least


#: Rows that one numpy pass holds, unless a group has more.
PASS_ROWS = 4096


def _undecided(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, PASS_ROWS):
            members = Members(batch, shape)
            wanted = np.zeros(batch.num_rows, bool)
            for a, b in members.pairs():
                wanted[a] = wanted[b] = True
            yield batch.filter(pa.array(wanted)).select(["group", "size", "space", "segment", "side", "inner", "node"])

    return work


def _linked(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in grouped(batches, PASS_ROWS):
            members = Members(batch, shape)
            vectors = unit(_vectors(batch.column("vector"), members.size))
            copies, node = batch.column("copies").to_numpy(), batch.column("node").to_numpy()
            counts = np.zeros(batch.num_rows, np.int64)
            found = []
            for a, b in members.pairs():
                close = np.einsum("ij,ij->i", vectors[a], vectors[b]) >= shape.settings.cosine
                a, b = a[close], b[close]
                np.add.at(counts, a, copies[b])
                np.add.at(counts, b, copies[a])
                found.append((a, b))
            if not found:
                continue
            least = _local(batch.num_rows, np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
            at = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(node[at]), pa.array(counts[at]), pa.array(node[least[at]])], ["node", "links", "hub"])

    return work


def _vectors(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def _encoded(shape: Shape) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            sizes = whole.column("size").to_numpy()
            for size in np.unique(sizes):
                batch = whole.filter(pa.array(sizes == size))
                signs, factors = encode(unit(_vectors(batch.column("vector"), int(size))), shape)
                space = batch.column("space").to_numpy().astype(np.uint64)
                place = mix(np.arange(1, shape.segments + 1, dtype=np.uint64))
                buckets = mix(mix(segments(signs, shape) ^ place[None, :]) + space[:, None]).view(np.int64)
                codes = [c.tobytes() for c in np.packbits(signs, axis=1)]
                corrections = [f.tobytes() for f in factors.astype(np.float32)]
                lists = pa.ListArray.from_arrays(np.arange(0, buckets.size + 1, shape.segments, dtype=np.int32), pa.array(buckets.ravel()))
                yield pa.record_batch(
                    [batch.column("node"), batch.column("size"), batch.column("space"), pa.array(codes, pa.binary()), pa.array(corrections, pa.binary()), lists],
                    ["node", "size", "space", "code", "factors", "buckets"],
                )

    return work


def usable(vector: Column) -> Column:
    """Not null, not zero, all components finite numbers."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def near_vectors(
    df: DataFrame, settings: Settings = Settings(), id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(id, n_links, component_id, kept) for each row of ``df``.

    Vectors link if their labels are equal and not null, their sizes are equal and
    their cosine is at least ``settings.cosine``. Vectors that are null, empty or
    zero, or hold null or non-finite components, link with nothing. ``n_links``
    counts the other rows that a row links with, ``component_id`` is the smallest id
    that links reach, its own included (null ids do not count unless there is no
    other); ``kept`` marks rows with that id. Equal vectors of a label are one node
    with a number of copies, so copies make no pairs. A large group that shares a
    segment is compared block by block; no row per pair leaves a task. Every link is
    computed in double precision, so none is below the threshold; ``settings.miss``
    bounds the chance to lose one right at it. An empty table gives no rows.
    """
    kind = dict(df.dtypes)[vector]
    value = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    fit = usable(value) & F.col(label).isNotNull()
    rows = df.select(F.col(id).alias("id"), F.col(label).alias("label"), value.alias("vector"), fit.alias("fit"))
    rows = rows.withColumn("node", F.when(F.col("fit"), F.xxhash64("label", "vector")))
    nodes = (
        rows.filter("fit")
        .groupBy("node")
        .agg(F.count("*").alias("copies"), F.min("id").alias("least"), F.first("vector").alias("vector"), F.first("label").alias("label"))
        .withColumn("size", F.size("vector"))
        .withColumn("space", F.xxhash64("label", "size"))
        .drop("label")
    )
    nodes = stored(nodes, "vectors")
    largest = nodes.groupBy("space").count().agg(F.max("count")).first()[0]
    shape = shape_for(largest or 1, settings)
    kinds = "node bigint, size int, space bigint, code binary, factors binary, buckets array<bigint>"
    codes = stored(nodes.select("node", "size", "space", "vector").mapInArrow(_encoded(shape), kinds), "codes")

    keys = codes.select("node", F.posexplode("buckets").alias("segment", "bucket"))
    shared = keys.groupBy("bucket").count().filter("count > 1")
    blocks = F.ceil(F.col("count") / settings.block)
    met = keys.join(shared, "bucket").withColumn("own", F.pmod(F.xxhash64("node"), blocks))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    lower, upper = F.least("own", "other"), F.greatest("own", "other")
    met = met.select(
        F.xxhash64("bucket", lower, upper).alias("group"), "segment", (F.col("own") == lower).alias("side"), (lower == upper).alias("inner"), "node"
    )
    n = partitions(df)
    order = ["group", "size", "node"]
    met = met.join(codes.drop("buckets"), "node").repartition(n, "group").sortWithinPartitions(*order)
    passed = "group bigint, size int, space bigint, segment int, side boolean, inner boolean, node bigint"
    wanted = stored(met.mapInArrow(_undecided(shape), passed), "undecided")
    full = wanted.join(codes.select("node", "code", "factors"), "node").join(nodes.select("node", "vector", "copies"), "node")
    links = full.repartition(n, "group").sortWithinPartitions(*order).mapInArrow(_linked(shape), "node bigint, links bigint, hub bigint")
    links = stored(links, "links")

    joined = components(links.filter("node <> hub").select("node", "hub").distinct(), "node", "hub")
    least = joined.join(nodes.select("node", "least"), "node").groupBy("component").agg(F.min("least").alias("smallest"))
    ends = joined.join(least, "component").select("node", "smallest")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.select("node", "copies", "least").join(counts, "node", "left").join(ends, "node", "left")
    known = known.select(
        "node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("smallest", "least").alias("smallest")
    )
    judged = rows.select("id", "node").join(known, "node", "left").select(
        F.col("id").alias(id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("smallest", "id").alias("component_id")
    )
    return judged.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
