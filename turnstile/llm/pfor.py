"""Token ids in patched frame-of-reference files.

A file holds the ids of consecutive documents in blocks of up to ``BLOCK`` ids.
A block stores its smallest id, a bit width that a percentile of its differences
fits in, the differences packed at that width, and a list of the larger ones.

Layout, little-endian: ``PFR1``; u64 documents, ids and blocks; i64 document ids;
u64 starts of the documents' ids within the file and the number of ids; u64 byte
starts of the blocks; then the blocks: u32 minimum, u32 ids, u32 exceptions, u8
width, three zero bytes, packed bits padded to 8 bytes, u32 places and u32 values
of the exceptions. The block starts let a reader seek to any id.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnstile.llm.encoding import ByteEncoder
from turnstile.llm.order import block_bounds, block_of, order_key
from turnstile.llm.words import passes, text_bytes
from turnstile.session import work_path

BLOCK = 4096
#: Share of a block's differences that its width holds; the rest are exceptions.
PERCENTILE = 95.0
END = 0
_HEAD = struct.Struct("<4sQQQ")
_BLOCK = struct.Struct("<IIIB3x")
NULL_ID = -(2**63)
#: Ids that are decoded at a time, unless a document has more.
CHUNK = 1 << 20
MANIFEST = "block int, file string, n_docs bigint, n_ids bigint"


def pack(values: np.ndarray, width: int) -> bytes:
    """Values below 2**width, packed low bit first, padded to 8 bytes."""
    if not width or not len(values):
        return b""
    bits = (values[:, None].astype(np.uint32) >> np.arange(width, dtype=np.uint32)) & np.uint32(1)
    data = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return data + b"\0" * (-len(data) % 8)


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    padded = np.zeros((n, 32), np.uint8)
    padded[:, :width] = bits
    return np.packbits(padded, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min())
    rest = ids.astype(np.uint32) - np.uint32(low)
    limit = int(np.percentile(rest, percentile, method="higher"))
    width = limit.bit_length()
    places = np.flatnonzero(rest >> np.uint32(width) if width < 32 else np.zeros(len(rest), bool))
    kept = rest.copy()
    kept[places] = 0
    head = _BLOCK.pack(low, len(ids), len(places), width)
    return head + pack(kept, width) + places.astype("<u4").tobytes() + rest[places].astype("<u4").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    low, n, patches, width = _BLOCK.unpack_from(data)
    packed = -(-n * width // 64) * 8
    at = _BLOCK.size
    rest = unpack(data[at : at + packed], n, width)
    at += packed
    places = np.frombuffer(data, "<u4", patches, at)
    rest[places] = np.frombuffer(data, "<u4", patches, at + 4 * patches)
    return rest + np.uint32(low)


class Writer:
    """Collects documents; keeps encoded blocks and fewer than ``BLOCK`` plain ids in memory."""

    def __init__(self) -> None:
        self.docs: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.blocks: list[bytes] = []
        self.rest = np.empty(0, np.uint32)

    def add(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(docs)
        self.sizes.append(sizes)
        ids = np.concatenate([self.rest, ids.astype(np.uint32)])
        full = len(ids) - len(ids) % BLOCK
        self.blocks += [encode_block(ids[i : i + BLOCK]) for i in range(0, full, BLOCK)]
        self.rest = ids[full:]

    def parts(self) -> tuple[Iterator[bytes], int, int]:
        if len(self.rest):
            self.blocks.append(encode_block(self.rest))
            self.rest = np.empty(0, np.uint32)
        docs = np.concatenate([np.empty(0, np.int64), *self.docs])
        starts = np.concatenate([[0], np.cumsum(np.concatenate([np.empty(0, np.int64), *self.sizes]))]).astype("<u8")
        at = _HEAD.size + 8 * (len(docs) + len(starts) + len(self.blocks) + 1)
        places = (at + np.cumsum([0] + [len(b) for b in self.blocks])).astype("<u8")

        def out() -> Iterator[bytes]:
            yield _HEAD.pack(b"PFR1", len(docs), int(starts[-1]), len(self.blocks))
            yield docs.astype("<i8").tobytes()
            yield starts.tobytes()
            yield places.tobytes()
            yield from self.blocks

        return out(), len(docs), int(starts[-1])


class Reader:
    """Random access to a file: the tables at its start, then any range of ids."""

    def __init__(self, file) -> None:
        self.file = file
        magic, n, self.n_ids, blocks = _HEAD.unpack(file.read(_HEAD.size))
        if magic != b"PFR1":
            raise ValueError("not a file of patched frames")
        self.docs = np.frombuffer(file.read(8 * n), "<i8")
        self.starts = np.frombuffer(file.read(8 * (n + 1)), "<u8").astype(np.int64)
        self.places = np.frombuffer(file.read(8 * (blocks + 1)), "<u8").astype(np.int64)

    def ids(self, begin: int, end: int) -> np.ndarray:
        if end <= begin:
            return np.empty(0, np.uint32)
        first, last = begin // BLOCK, (end - 1) // BLOCK
        self.file.seek(int(self.places[first]))
        data = self.file.read(int(self.places[last + 1] - self.places[first]))
        cuts = self.places[first : last + 2] - self.places[first]
        out = np.concatenate([decode_block(data[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        return out[begin - first * BLOCK : end - first * BLOCK]


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_ids(df: DataFrame, folder: str, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every text and write the ids in ascending order of ``id``, one file per range of it.

    Returns the manifest (block, file, n_docs, n_ids), written to ``folder`` once
    all files are complete. A task writes a file of its own name, so a lost or
    repeated task leaves a file that the manifest does not list. Rows with a null
    id come first, equal ids in order of their texts; null texts are empty and
    get the end id only. An empty table gives an empty manifest.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = block_bounds(rows, "id")
    rows = (
        rows.withColumn("block", block_of("id", bounds))
        .repartitionById(len(bounds) + 1, F.col("block"))
        .sortWithinPartitions(order_key("id"), "text")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, block = ByteEncoder.shared(tokenizer), Writer(), None
        for batch in batches:
            for part in passes(batch):
                if not part.num_rows:
                    continue
                block = part.column("block")[0].as_py()
                ids, sizes = encoder.encode(*text_bytes(part.column("text")), end=END)
                docs = pc.fill_null(part.column("id"), NULL_ID).to_numpy(zero_copy_only=False)
                writer.add(docs, sizes, ids)
        if block is None:
            return
        name = f"{folder}/ids-{block:06d}-{uuid.uuid4().hex}.pfr"
        system, path = _open(name)
        parts, n_docs, n_ids = writer.parts()
        with system.open_output_stream(path) as out:
            for data in parts:
                out.write(data)
        yield pa.record_batch([pa.array([block], pa.int32()), [name], [n_docs], [n_ids]], ["block", "file", "n_docs", "n_ids"])

    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    manifest = rows.mapInArrow(write, MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return df.sparkSession.read.schema(manifest.schema).parquet(f"{folder}/manifest")


def _chunks(path: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Document ids, bounds in the file's ids (one more) and the ids, about a million at a time."""
    system, path = _open(path)
    with system.open_input_file(path) as file:
        reader = Reader(file)
        begin = 0
        while begin < len(reader.docs):
            limit = reader.starts[begin] + CHUNK
            end = max(begin + 1, int(np.searchsorted(reader.starts, limit, side="right")) - 1)
            bounds = reader.starts[begin : end + 1]
            yield reader.docs[begin:end], bounds, reader.ids(int(bounds[0]), int(bounds[-1]))
            begin = end


def _from_files(spark: SparkSession, folder: str, kind: pa.DataType, ddl: str, value) -> DataFrame:
    """(block, id, at, n_tokens, value) of every document in the files that the manifest lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for docs, bounds, ids in _chunks(row["file"]):
                    columns = [
                        pa.array(np.full(len(docs), row["block"], np.int32)),
                        pa.array(docs, mask=docs == NULL_ID),
                        pa.array(bounds[:-1]),
                        pa.array(np.diff(bounds)),
                        value(bounds - bounds[0], ids).cast(kind),
                    ]
                    yield pa.record_batch(columns, ["block", "id", "at", "n_tokens", "value"])

    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    spread = files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "block")
    return spread.select("block", "file").mapInArrow(read, f"block int, id bigint, at bigint, n_tokens bigint, value {ddl}")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(block, id, at, n_tokens, ids) of every document; ``at`` counts the ids before it in its file."""

    def cells(bounds: np.ndarray, ids: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array(ids.astype(np.int32)))

    return _from_files(spark, folder, pa.list_(pa.int32()), "array<int>", cells).withColumnRenamed("value", "ids")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """As ``read_documents``, with the unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def sums(bounds: np.ndarray, ids: np.ndarray) -> pa.Array:
        data = ids.astype("<u4").tobytes()
        return pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.int64())

    return _from_files(spark, folder, pa.int64(), "bigint", sums).withColumnRenamed("value", "ids_crc32")


def with_starts(documents: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before it. The manifest has one row per file."""
    ahead = Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = manifest.select("block", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("base"))
    return documents.join(F.broadcast(bases), "block").withColumn("start", F.col("base") + F.col("at")).drop("base", "at")


def encoded(df: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids below the shared folder and read them back: (id, start, n_tokens, ids_crc32)."""
    folder = work_path(df.sparkSession, "token-ids")
    manifest = write_ids(df, folder, tokenizer, id, text)
    found = with_starts(read_checksums(df.sparkSession, folder), manifest)
    return found.select(F.col("id").alias(id), "start", "n_tokens", "ids_crc32")
