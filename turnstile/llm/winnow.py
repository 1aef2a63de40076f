"""Document fingerprints by winnowing.

The rolling hash of every run of ``gram`` code points is taken; of each
``window`` neighbouring hashes the smallest is kept, the rightmost of equal
ones, with its position. Any passage of at least ``gram + window - 1`` code
points that two texts share puts a common mark into both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnstile.llm.order import block_bounds, block_of, order_key
from turnstile.llm.words import mix, window_argmin

GRAM = 12
WINDOW = 8
_BASE = 0x9E3779B97F4A7C55


def rolling_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash modulo 2**64 of each run of k codes, by doubling."""
    total, width, power = None, 0, 1
    run, span, base = mix(codes.astype(np.uint64) + np.uint64(1)), 1, _BASE
    while True:
        if k & span:
            n = len(codes) - (width + span) + 1
            total = run[:n] if total is None else total[:n] * np.uint64(base) + run[width : width + n]
            width += span
        if width == k:
            return mix(total)
        run = run[: len(run) - span] * np.uint64(base) + run[span:]
        span, base = span * 2, base * base % 2**64


def marks(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the chosen grams, by position.

    An empty text has none. A text shorter than ``gram`` counts as one gram; with
    fewer than ``window`` grams all of them form one window.
    """
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    hashes = rolling_hashes(codes, min(gram, len(codes)))
    chosen = window_argmin(hashes, min(window, len(hashes)))
    chosen = chosen[np.r_[True, chosen[1:] != chosen[:-1]]]
    return hashes[chosen], chosen


def digest(hashes: np.ndarray, places: np.ndarray) -> str:
    """One string for a fingerprint: hashes and positions, in order."""
    return hashlib.blake2b(hashes.tobytes() + places.tobytes(), digest_size=16).hexdigest()


def likeness(left: np.ndarray, right: np.ndarray) -> float:
    """Jaccard similarity of two fingerprints' distinct hashes; two empty ones are alike."""
    a, b = np.unique(left), np.unique(right)
    common = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - common
    return common / union if union else 1.0


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per chosen gram: id, hash, position in code points.

    Empty and null texts give no rows. Repeated rows give repeated marks. Other
    columns are not read.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                hashes, places = marks(batch.column(1)[row].as_py() or "", gram, window)
                ids = pa.array([batch.column(0)[row].as_py()] * len(places), batch.schema.field(0).type)
                yield pa.record_batch([ids, hashes.view(np.int64), places], ["id", "hash", "position"])

    kind = df.schema[id].dataType.simpleString()
    return (
        df.select(F.col(id), F.col(text))
        .mapInArrow(mark, f"id {kind}, hash bigint, position bigint")
        .withColumnRenamed("id", id)
    )


def with_next(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows in blocks of ascending id, one block per partition; each block ends with the next one's first row.

    Columns: id, text, lead (true for the extra row). The last block is followed
    by the first. Only the blocks' first ids pass the driver, one per partition.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = block_bounds(rows, "id")
    rows = rows.withColumn("block", block_of("id", bounds))
    heads = rows.groupBy("block").agg(F.min(order_key("id")).alias("head")).collect()
    heads = sorted((r.block, r.head) for r in heads)
    if not heads:
        return rows.select("id", "text", F.lit(False).alias("lead"))
    first, owner_of = [0] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, (block, head) in enumerate(heads):
        first[block], owner_of[block] = head, heads[i - 1][0]
    leads = order_key("id") == F.get(F.lit(first), F.col("block"))
    owner = F.when(leads, F.get(F.lit(owner_of), F.col("block")))
    copies = F.array_compact(
        F.array(
            F.struct(F.col("block").alias("to"), F.lit(False).alias("lead")),
            F.when(owner.isNotNull(), F.struct(owner.alias("to"), F.lit(True).alias("lead"))),
        )
    )
    return (
        rows.withColumn("copy", F.explode(copies))
        .select("id", "text", "copy.lead", "copy.to")
        .repartitionById(len(bounds) + 1, F.col("to"))
        .sortWithinPartitions("lead", order_key("id"), "text")
        .select("id", "text", "lead")
    )


def edited_likeness(
    df: DataFrame, id: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW
) -> DataFrame:
    """Each text's fingerprint beside that of its edited text and of the next document.

    Edited: the last quarter of the code points (rounded down) gives way to as
    many of the next document's first ones. Rows follow the id, then the text;
    rows with a null id come first, equal rows follow one another, and the last
    row is followed by the first, a single row by itself. Null texts are empty.
    Columns of the input other than id and text are not read.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        rows: list[tuple] = []
        for batch in batches:
            for i, now, lead in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                found = marks(now, gram, window)
                if held is not None:
                    rows.append(_row(*held, now, found[0], gram, window))
                held = None if lead else (i, now, found)
                if lead:
                    break
                if len(rows) >= 1000:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)

    out = with_next(df, id, text).mapInArrow(compare, _ROW)
    return out.withColumnRenamed("id", id)


_ROW = (
    "id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, n_marks bigint"
)
_TYPES = pa.schema(
    [("id", pa.int64()), ("n_chars", pa.int64())]
    + [(c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_marks", pa.int64())]
)


def _row(i, now, found, following, next_hashes, gram, window) -> tuple:
    size = len(now)
    edited = now[: size - size // 4] + following[: size // 4]
    other = marks(edited, gram, window)
    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
    near = likeness(found[0], other[0]), likeness(found[0], next_hashes)
    return i, size, sha, digest(*found), digest(*other), *near, len(found[0])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES.types, strict=True)], schema=_TYPES)
