"""Jaccard self-join of shingle sets by parity sketches.

Every shingle flips one bit of a wide sketch, so two sketches differ in at most as
many bits as the sets have shingles apart. The sketch is cut into segments; the
bits of a segment are held as the XOR of a random word per set bit. Sets of one
size band with Jaccard similarity t or more are apart by at most D shingles, so
of the first D + 1 segments that are not empty in one of them, one is equal in
the other: sets meet on equal segments. A narrow sketch then bounds the distance
from below: only sketches travel to the groups that share a segment, and a set only
to the pairs that are verified, closest first and none between sets that links join.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from turnstile.llm.components import components
from turnstile.llm.heavy import among, heavy_values
from turnstile.llm.order import partitions
from turnstile.llm.stored import stored
from turnstile.llm.words import LOWER, grams, hash_slices, mix, owners, passes, split_words, text_bytes

#: Shingles that at least this share of the documents hold make heavy segments, which are used last.
HEAVY = 0.002
#: Larger candidate groups are compared in blocks of this many sets.
BLOCK = 1024
#: A round lets each component take part in so many times the verified pairs of the round before.
MORE = 8
#: Segment key of a set that has too few segments with a shingle for its band.
SHORT = 1


@dataclass(frozen=True)
class Likeness:
    """Sets link from ``part / whole`` of Jaccard similarity on; ``shingle`` is in words.

    A band has ``segments`` segments, and four, per hundred that can differ.
    """

    part: int = 80
    whole: int = 100
    shingle: int = 5
    segments: int = 120

    def apart(self, a: int, b: int) -> int:
        """The most shingles by which linked sets of a and b can differ."""
        return (a + b) * (self.whole - self.part) // (self.whole + self.part)

    def largest(self, a: int) -> int:
        """The largest set that can link with one of ``a`` shingles."""
        return a * self.whole // self.part

    def links(self, common: int, a: int, b: int) -> bool:
        return self.whole * common >= self.part * (a + b - common) and common > 0


def bands(likeness: Likeness, most: int) -> list[tuple[int, int]]:
    """Size bands (low, high): a set can only link inside its band and with its neighbours."""
    out, low = [], 1
    while low <= most:
        high = max(low, likeness.largest(low))
        out.append((low, high))
        low = high + 1
    return out


def shingle_sets(buffer: np.ndarray, bounds: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, sorted in it, and their bounds; A-Z count as a-z.

    A text with fewer words than a shingle gives all of them as one.
    """
    low = LOWER[buffer]
    starts, ends, word_bounds = split_words(low, bounds)
    words = hash_slices(low, starts, ends)
    at, text = owners(word_bounds, shingle)
    found = grams(words, shingle)[at] if len(at) else np.empty(0, np.uint64)
    sizes = np.diff(word_bounds)
    few = np.flatnonzero((sizes > 0) & (sizes < shingle))
    whole = [mix(grams(words[word_bounds[i] : word_bounds[i + 1]], int(sizes[i])) + np.uint64(sizes[i])) for i in few]
    text = np.concatenate([text, few])
    found = np.concatenate([found, *whole]) if whole else found
    order = np.lexsort((found, text))
    text, found = text[order], found[order]
    new = np.ones(len(found), bool)
    new[1:] = (text[1:] != text[:-1]) | (found[1:] != found[:-1])
    text, found = text[new], found[new]
    return found, np.searchsorted(text, np.arange(len(bounds)))


def _values(shingle: int):
    def values(buffer: np.ndarray, bounds: np.ndarray):
        found, cuts = shingle_sets(buffer, bounds, shingle)
        return found, np.repeat(np.arange(len(bounds) - 1), np.diff(cuts))

    return values


def set_ids(found: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set; sets without shingles are named 0."""
    sizes = np.diff(cuts)
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        sums = np.add.reduceat(mix(found), cuts[:-1][some])
        out[some] = mix(sums + sizes[some].astype(np.uint64)) | np.uint64(1)
    return out


def segment_place(members: np.ndarray, width: int) -> np.ndarray:
    """The segment of each shingle, by the top bits of its hash; members are sorted, so places rise."""
    return (members >> np.uint64(32)) * np.uint64(width) >> np.uint64(32)


def segment_keys(members: np.ndarray, heavy: np.ndarray, likeness: Likeness, wide: bool) -> np.ndarray:
    """The keys on which one set meets others: in its own band and, as the smaller one, in the next.

    Segments with a shingle that is not heavy come first. With ``wide`` every
    shingle has a segment of its own. If a band's segments are too few for the
    guarantee the key ``SHORT`` is added.
    """
    n = len(members)
    (low, high), (next_low, next_high) = _band(likeness, n)
    out = []
    rare = ~among(members, heavy)
    for name, most, partner in ((low, high, min(high, likeness.largest(n))), (next_low, next_high, likeness.largest(n))):
        if partner < name:
            continue
        needed = likeness.apart(n, partner) + 1
        width = likeness.apart(most, most) + 1
        if wide or most <= 40:
            firsts, words = np.arange(n), mix(members)
            light = rare
        else:
            place = segment_place(members, width * likeness.segments // 100 + 4)
            firsts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            words = np.bitwise_xor.reduceat(mix(members), firsts)
            words = mix(words ^ mix(place[firsts] + np.uint64(7)))
            light = np.bitwise_or.reduceat(rare, firsts)
        order = np.argsort(~light, kind="stable")[:needed]
        out.append(mix(words[order] + np.uint64(name)))
        if len(order) < min(needed, n) and len(words) < n:
            out.append(np.array([SHORT], np.uint64))
    return np.concatenate(out)


_BANDS: dict[Likeness, list[tuple[int, int]]] = {}


def _band(likeness: Likeness, n: int) -> tuple[tuple[int, int], tuple[int, int]]:
    known = _BANDS.setdefault(likeness, bands(likeness, 1 << 30))
    i = next(i for i, (_, high) in enumerate(known) if n <= high)
    return known[i], known[i + 1]


def sketch_words(n: int) -> int:
    """Words of the narrow sketch of n shingles, a power of two: four to eight bits per shingle."""
    return max(8, 1 << max(0, (4 * n - 1).bit_length() - 6))


def narrow_sketch(members: np.ndarray, words: int) -> np.ndarray:
    """Parity of the set in so many words of bits, a power of two: one bit per shingle."""
    bits = (mix(members ^ np.uint64(0x5BD1E995)) % np.uint64(64 * words)).astype(np.int64)
    odd = np.bincount(bits, minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(sketches: np.ndarray, words: int) -> np.ndarray:
    """The sketches, a row each, of the same sets in fewer words."""
    while sketches.shape[-1] > words:
        half = sketches.shape[-1] // 2
        sketches = sketches[..., :half] ^ sketches[..., half:]
    return sketches


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


class Side:
    """Sets of a block: names, components, sizes and sketches, those of one width together."""

    def __init__(self, rows: list[tuple[int, int, int, bytes]]):
        self.nodes, self.labels, self.sizes = (np.array(c, np.int64) for c in list(zip(*rows, strict=True))[:3])
        self.sketches = [np.frombuffer(r[3], "<u8") for r in rows]
        widths = np.array([len(x) for x in self.sketches])
        self.classes = [(int(w), at, np.stack([self.sketches[i] for i in at])) for w in np.unique(widths) for at in [np.flatnonzero(widths == w)]]


def near_pairs(left: Side, right: Side | None, likeness: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """Rows inside ``left``, or of left and right, that have two components and may link, closest first."""
    others = left if right is None else right
    rows, columns, distances = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    rate = likeness.whole + likeness.part
    for width, at, sketches in others.classes:
        by_label = {}
        for i in range(len(left.nodes)):
            label = int(left.labels[i])
            if label not in by_label:  # the members of a large component meet the few others only
                by_label = {label: np.flatnonzero(others.labels[at] != label)}
            apart = by_label[label]
            if right is None:
                apart = apart[np.searchsorted(at[apart], i, side="right") :]
            most = (others.sizes[at[apart]] + left.sizes[i]) * (likeness.whole - likeness.part) // rate
            fits = np.abs(others.sizes[at[apart]] - left.sizes[i]) <= most
            apart, most = apart[fits], most[fits]
            if not len(apart):
                continue
            words = min(width, len(left.sketches[i]))
            distance = np.bitwise_count(folded(sketches[apart], words) ^ folded(left.sketches[i], words)).sum(axis=1, dtype=np.int64)
            near = distance <= most
            rows.append(np.full(int(near.sum()), i))
            columns.append(at[apart[near]])
            distances.append(distance[near])
    order = np.argsort(np.concatenate(distances), kind="stable")
    return np.concatenate(rows)[order], np.concatenate(columns)[order]


def group_pairs(left: Side, right: Side | None, likeness: Likeness, most: int) -> tuple[list[tuple[int, int]], bool]:
    """Pairs to verify, closest first, and whether others were left out.

    Left out is a pair whose components earlier pairs join if both have ``most``
    pairs by then. So what is left out can matter only if one of the others proves
    not to link.
    """
    others = left if right is None else right
    rows, columns = near_pairs(left, right, likeness)
    names, place = np.unique(np.concatenate([left.labels, others.labels]), return_inverse=True)
    place = place.tolist()
    forest, taken, out = Forest(len(names)), [0] * len(names), []
    for i, j in zip(rows.tolist(), columns.tolist(), strict=True):
        x, y = place[i], place[len(left.labels) + j]
        if forest.join(x, y) or min(taken[x], taken[y]) < most:
            taken[x] += 1
            taken[y] += 1
            out.append((int(left.nodes[i]), int(others.nodes[j])))
    return out, len(out) < len(rows)


def shared_segments(docs: DataFrame, heavy: np.ndarray, likeness: Likeness, wide: bool) -> DataFrame:
    """(node, head): sets that share a segment, each with the smallest set that has it; SHORT marks short ones.

    Keys are walked in sorted order, so a key of any size costs one set of memory.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                found, cuts = shingle_sets(*text_bytes(part.column("text")), likeness.shingle)
                nodes = set_ids(found, cuts)
                _, once = np.unique(nodes, return_index=True)
                once = once[nodes[once] > 0]
                each = [segment_keys(found[cuts[i] : cuts[i + 1]], heavy, likeness, wide) for i in once]
                if each:
                    node = np.repeat(nodes[once], [len(k) for k in each])
                    yield pa.record_batch([np.concatenate(each).view(np.int64), node.view(np.int64)], ["key", "node"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key and head before this batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node = batch.column("key").to_numpy(), batch.column("node").to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            new[0] = last is None or last[0] != key[0]
            group = np.cumsum(new)
            heads = np.concatenate([[last[1] if last and not new[0] else 0], node[new]])
            head = heads[group]
            last = key[-1], head[-1]
            pick = (head != node) & (key != SHORT)
            pairs = np.unique(np.stack([node[pick], head[pick]]), axis=1)
            short = np.unique(node[key == SHORT])
            yield pa.record_batch(
                [np.concatenate([pairs[0], short]), np.concatenate([pairs[1], np.full(len(short), SHORT)])], ["node", "head"]
            )

    rows = docs.select("text").mapInArrow(sketch, "key bigint, node bigint")
    rows = rows.repartition(partitions(docs), "key").sortWithinPartitions("key", "node")
    return rows.mapInArrow(walk, "node bigint, head bigint").distinct()


def wanted_texts(docs: DataFrame, nodes: DataFrame, likeness: Likeness) -> DataFrame:
    """(node, text, n, sketch) of each set in ``nodes``, which refers to one document per set."""

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                found, cuts = shingle_sets(*text_bytes(part.column("text")), likeness.shingle)
                meant = np.flatnonzero(set_ids(found, cuts).view(np.int64) == part.column("node").to_numpy())  # not all where ids repeat
                sizes = np.diff(cuts)[meant]
                sketches = [narrow_sketch(found[cuts[i] : cuts[i + 1]], sketch_words(int(n))).tobytes() for i, n in zip(meant, sizes, strict=True)]
                kept = part.select(["node", "text"]).take(pa.array(meant))
                yield pa.record_batch([*kept.columns, pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())], ["node", "text", "n", "sketch"])

    return docs.join(nodes, "ref").select("node", "text").mapInArrow(fetch, "node bigint, text string, n bigint, sketch binary")


def verified(pairs: DataFrame, texts: DataFrame, likeness: Likeness) -> DataFrame:
    """(a, b, linked): whether the sets of each pair link; each text goes once to each of its pairs."""
    ends = F.array(F.struct(F.col("a").alias("node"), F.lit(0).alias("side")), F.struct(F.col("b").alias("node"), F.lit(1).alias("side")))
    sent = pairs.select("a", "b", F.inline(ends))
    rows = texts.join(sent, "node").select("a", "b", "side", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first = None, None
        for batch in batches:
            for part in passes(batch):
                found, cuts = shingle_sets(*text_bytes(part.column("text")), likeness.shingle)
                out = []
                for i, (a, b, side) in enumerate(zip(*(part.column(c).to_pylist() for c in ("a", "b", "side")), strict=True)):
                    own = found[cuts[i] : cuts[i + 1]]
                    if not side:
                        held, first = (a, b), own.copy()
                    elif held == (a, b):  # once, also where a text comes twice
                        common = len(np.intersect1d(first, own, assume_unique=True))
                        out.append((a, b, likeness.links(common, len(first), len(own))))
                        held = None
                columns = zip(*out, strict=True) if out else ([], [], [])
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.bool_()), strict=True)], ["a", "b", "linked"])

    rows = rows.repartition(partitions(texts), "a", "b").sortWithinPartitions("a", "b", "side")
    return rows.mapInArrow(compare, "a bigint, b bigint, linked boolean")


def nearest_heads(pairs: DataFrame, sketches: DataFrame, likeness: Likeness) -> DataFrame:
    """(a, b): each set of ``pairs`` with that of its heads which its sketch is closest to, if they may link."""
    head = sketches.select(F.col("node").alias("head"), F.col("n").alias("head_n"), F.col("sketch").alias("head_sketch"))
    rate = likeness.whole + likeness.part

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for node, head, n, head_n, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                words = min(len(x), len(y))
                distance = int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum())
                most = (n + head_n) * (likeness.whole - likeness.part) // rate
                if max(distance, abs(n - head_n)) <= most:
                    out.append((node, head, distance))
            columns = zip(*out, strict=True) if out else ([], [], [])
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["node", "head", "distance"])

    both = pairs.join(sketches, "node").join(head, "head").select("node", "head", "n", "head_n", "sketch", "head_sketch")
    near = both.mapInArrow(compare, "node bigint, head bigint, distance bigint")
    best = near.groupBy("node").agg(F.min(F.struct("distance", "head")).alias("best"))
    return best.select(F.least("node", "best.head").alias("a"), F.greatest("node", "best.head").alias("b")).distinct()


def pairs_to_verify(members: DataFrame, sketches: DataFrame, likeness: Likeness, most: int) -> DataFrame:
    """(head, a, b): pairs of each head's group as of ``group_pairs``, and one row without a and b if a task left others out.

    ``members`` is (head, node, label). Groups over ``BLOCK`` sets are compared block
    by block, each pair of blocks by a task of its own.
    """
    split = members.groupBy("head").agg(F.count("*").alias("sets"), F.min("label").alias("low"), F.max("label").alias("high"))
    split = split.filter("low <> high").select("head", F.ceil(F.col("sets") / F.lit(float(BLOCK))).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    sent = members.join(split, "head").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = sent.join(sketches, "node").select(
        "head", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "node", "label", "n", "sketch"
    )

    def work(task: tuple, rows: list[tuple]) -> list[tuple]:
        head, x, y = task
        left = [r[1:] for r in rows if r[0] == x]
        right = None if x == y else [r[1:] for r in rows if r[0] == y]
        if not left or (right is not None and not right):
            return []
        found, cut = group_pairs(Side(left), None if right is None else Side(right), likeness, most)
        return [(head, min(p), max(p)) for p in found] + [(head, None, None)] * cut

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held != row[:3] and rows:
                    yield _pairs(work(held, rows))
                    rows = []
                held = row[:3]
                rows.append(row[3:])
        if rows:
            yield _pairs(work(held, rows))

    return (
        cells.repartition(partitions(members), "head", "x", "y")
        .sortWithinPartitions("head", "x", "y", "block", "node")
        .mapInArrow(compare, "head bigint, a bigint, b bigint")
    )


def _pairs(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.record_batch([pa.array(c, pa.int64()) for c in columns], ["head", "a", "b"])


def linked_groups(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, likeness: Likeness) -> DataFrame:
    """(node, component): the sets of ``pairs`` that links inside a head's group join, by the smallest of them.

    ``nodes`` refers to one document per set. First each set is verified with its
    nearest head. Then rounds verify pairs of two components in one group; where a
    pair does not link and others were left out, the group goes on with more pairs.
    """
    member = pairs.select("head", "node").unionByName(pairs.select("head", F.col("head").alias("node")).distinct())
    texts = stored(wanted_texts(docs, nodes.join(member.select("node").distinct(), "node", "left_semi"), likeness), "texts")
    sketches = stored(texts.select("node", "n", "sketch").dropDuplicates(["node"]), "sketches")
    tried = stored(verified(nearest_heads(pairs, sketches, likeness), texts, likeness), "verified")
    groups = components(tried.filter("linked"))
    most = 1
    while True:
        label = F.coalesce("component", "node").alias("label")
        labelled = member.join(groups, "node", "left").select("head", "node", label)
        found = stored(pairs_to_verify(labelled, sketches, likeness, most), "near")
        picked, cut = found.filter("a is not null"), found.filter("a is null").select("head").distinct()
        new = stored(verified(picked.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), texts, likeness), "verified")
        tried = tried.unionByName(new)
        if not new.filter("linked").isEmpty():
            groups = components(tried.filter("linked"))
        failed = picked.join(tried.filter("linked"), ["a", "b"], "left_anti").select("head").distinct()
        going = stored(cut.join(failed, "head", "left_semi"), "going")
        if going.isEmpty():
            return groups
        member, most = member.join(going, "head", "left_semi"), most * MORE


def near_components(
    df: DataFrame, id: str = "doc_id", text: str = "text", likeness: Likeness = Likeness()
) -> DataFrame:
    """(id, n_shingles, component_id) for every row.

    A document's set is that of its distinct shingles, lower-cased; with fewer
    words than a shingle all of them are one; without words it is empty and links
    with nothing. component_id is the smallest id reachable by links, itself
    included. Rows with equal sets link, so they need no pairs: a set is one node.
    Repeated ids are separate rows; a null id never names a component unless all
    its ids are null. Shingles and sets are compared by 64-bit hashes.
    """
    return near_groups(df, id, text, likeness).select(id, "n_shingles", "component_id")


def near_groups(
    df: DataFrame, id: str = "doc_id", text: str = "text", likeness: Likeness = Likeness(), carry: Sequence[str] = ()
) -> DataFrame:
    """(id, n_shingles, component_id, component, carry) for every row; as ``near_components``.

    ``component`` is one number for all rows of a component, whatever their ids;
    null for rows without words.
    """
    rows = df.select(F.col(id).cast("long").alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("text"), *([F.struct(*carry).alias("others")] if carry else []))
    rows = rows.withColumn("ref", F.coalesce(F.col("doc").cast("string"), F.concat(F.lit("text "), F.md5("text"))))

    ends = ["doc", "ref", *(["others"] if carry else [])]
    schema = StructType([*rows.select(ends).schema, *StructType.fromDDL("n bigint, node bigint")])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in passes(batch):
                found, cuts = shingle_sets(*text_bytes(part.column("text")), likeness.shingle)
                node = set_ids(found, cuts).view(np.int64)
                columns = [*(part.column(c) for c in ends), pa.array(np.diff(cuts)), pa.array(node)]
                yield pa.record_batch(columns, schema.names)

    sizes = stored(rows.mapInArrow(measure, schema), "sets")
    heavy = heavy_values(rows, _values(likeness.shingle), HEAVY)
    pairs = stored(shared_segments(rows, heavy, likeness, False), "pairs")
    if not pairs.filter(F.col("head") == SHORT).isEmpty():
        pairs = stored(shared_segments(rows, heavy, likeness, True), "pairs")
    nodes = sizes.filter("node <> 0").groupBy("node").agg(F.min("doc").alias("doc"), F.min("ref").alias("ref"))
    groups = linked_groups(rows, nodes.select("node", "ref"), pairs, likeness)
    least = nodes.join(groups, "node", "left").withColumn("group", F.coalesce("component", "node"))
    named = least.groupBy("group").agg(F.min("doc").alias("component_id"))
    names = least.select("node", "group").join(named, "group").select("node", "group", "component_id")
    # Rows without words are one node, but link with nothing: they stay out of the join.
    wordless = sizes.filter("node = 0").withColumns({"group": F.lit(None).cast("long"), "component_id": F.lit(None).cast("long")})
    return sizes.filter("node <> 0").join(names, "node").unionByName(wordless).select(
        F.col("doc").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"),
        F.col("group").alias("component"), *(["others.*"] if carry else []),
    )
