"""SentencePiece encoding and decoding by batched Viterbi.

A text gets a leading space and is cut into words, each with the spaces before
it; no piece of the model may cross words. Distinct words of equal length advance
together: at each end, the hashes of all substrings that end there probe the
sorted piece hashes, and the best sums of scores and their last pieces are kept
as arrays. Of equal sums the longer last piece wins. Characters without a piece
become byte pieces. Where few words share a length, as in scripts without spaces,
a word's substrings are probed together and only the maxima go from end to end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from turnstile.llm.encoding import SPACE, ChunkEncoder, in_order
from turnstile.llm.words import mix, passes, text_bytes

#: The model's mark for a space.
MARK = 0x2581
#: Stands for that character in a text, which no piece then matches.
NO_MARK = 0x110000
_BASE = np.uint64(0x9E3779B97F4A7C55)
_UNBASE = np.uint64(pow(int(_BASE), -1, 2**64))
#: What a character without a piece costs below the least score.
UNKNOWN = 10.0
#: Fewer words of a length than this, or longer ones, are probed word by word.
FEW, LONG = 64, 4096
#: So many ends of a word are probed at once.
ENDS = 1 << 15
#: Words of one length advance in groups of at most so many characters.
CELLS = 1 << 18


class PieceModel(ChunkEncoder):
    """Pieces and scores of a SentencePiece file, with an identity normaliser and byte pieces."""

    def __init__(self, path: str):
        super().__init__()
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.byte_ids = np.zeros(256, np.int64)
        table: list[bytes] = []
        plain = []
        for i, name in enumerate(names):
            if model.is_byte(i):
                self.byte_ids[int(name[3:5], 16)] = i
                table.append(bytes([int(name[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                table.append(b"")
            else:
                if chr(MARK) in name.lstrip(chr(MARK)):
                    raise ValueError(f"piece crosses words: {name}")
                plain.append(i)
                table.append(name.replace(chr(MARK), " ").encode())
        if not self.byte_ids.any():
            raise ValueError("needs a model with byte pieces")
        codes = [np.frombuffer(names[i].encode("utf-32-le"), np.uint32) for i in plain]
        self.longest = max(map(len, codes))
        hashes = np.array([self._prefixes(c[None, :])[0, -1] for c in codes], np.uint64)
        keys = mix(hashes + np.array([len(c) for c in codes], np.uint64))
        order = np.argsort(keys)
        self.keys = keys[order]
        self.piece = np.array(plain)[order]
        self.score = np.array([model.get_score(i) for i in plain])[order]
        self.unknown = float(self.score.min()) - UNKNOWN
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(self.longest, _BASE)), dtype=np.uint64)
        self.decode_sizes = np.array([len(b) for b in table])
        self.decode_starts = np.cumsum(self.decode_sizes) - self.decode_sizes
        self.decode_bytes = np.frombuffer(b"".join(table), np.uint8)

    @staticmethod
    def _prefixes(codes: np.ndarray) -> np.ndarray:
        """Hashes of all prefixes of each row of code points, the empty one first."""
        size = codes.shape[1]
        down, up = (np.cumprod(np.append(np.uint64(1), np.full(size, x)), dtype=np.uint64) for x in (_UNBASE, _BASE))
        out = np.zeros((codes.shape[0], size + 1), np.uint64)
        # the sum of term i times base ** (j - 1 - i) below j, modulo 2 ** 64
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(1)) * down[1:], axis=1, dtype=np.uint64, out=out[:, 1:])
        return out * up

    def cuts(self, buffer: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        out = np.zeros(len(buffer) + 1, bool)
        out[1:-1] = (buffer[1:] == SPACE) & (buffer[:-1] != SPACE)
        out[bounds] = True
        return np.flatnonzero(out[: len(buffer)])

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the best last piece at each end of each word; id -1 for a character without piece."""
        n, size = codes.shape
        if n < FEW or size > LONG:
            length, last = zip(*map(self._alone, codes), strict=True)
            return np.stack(length), np.stack(last)
        prefixes = self._prefixes(codes)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0.0
        length = np.ones((n, size + 1), np.int64)
        last = np.full((n, size + 1), -1, np.int64)
        for end in range(1, size + 1):
            for long in range(min(self.longest, end), 0, -1):
                begin = end - long
                probe = mix(prefixes[:, end] - prefixes[:, begin] * self.powers[long] + np.uint64(long))
                at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
                found = self.keys[at] == probe
                score = np.where(found, self.score[at], self.unknown if long == 1 else -np.inf) + best[:, begin]
                better = score > best[:, end]
                best[:, end] = np.where(better, score, best[:, end])
                length[:, end] = np.where(better, long, length[:, end])
                last[:, end] = np.where(better, np.where(found, self.piece[at], -1), last[:, end])
        return length, last

    def _alone(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``viterbi`` of one word: all its substrings are looked up first, ``ENDS`` ends at a time."""
        size = len(codes)
        prefixes = self._prefixes(codes[None, :])[0]
        best, length, last = [0.0], [np.ones(1, np.int64)], [np.full(1, -1)]
        for low in range(1, size + 1, ENDS):
            high = min(low + ENDS, size + 1)
            ends, sizes, pieces, scores = [], [], [], []
            for long in range(min(self.longest, high - 1), 0, -1):
                end = np.arange(max(low, long), high)
                probe = mix(prefixes[end] - prefixes[end - long] * self.powers[long] + np.uint64(long))
                at = np.minimum(np.searchsorted(self.keys, probe), len(self.keys) - 1)
                found = self.keys[at] == probe
                some = np.ones(len(end), bool) if long == 1 else found
                ends.append(end[some])
                sizes.append(np.full(int(some.sum()), long))
                pieces.append(np.where(found, self.piece[at], -1)[some])
                scores.append(np.where(found, self.score[at], self.unknown)[some])
            end = np.concatenate(ends)
            order = np.argsort(end, kind="stable")  # of one end the longer pieces first
            first = np.searchsorted(end[order], np.arange(low, high + 1)).tolist()
            size_of, piece_of, score_of = (np.concatenate(x)[order].tolist() for x in (sizes, pieces, scores))
            best, chosen = best[-self.longest :], []
            for start, stop in zip(first, first[1:], strict=False):
                top, choice = -np.inf, stop - 1
                for i in range(start, stop):
                    score = score_of[i] + best[-size_of[i]]
                    if score > top:
                        top, choice = score, i
                best.append(top)
                chosen.append(choice)
            length.append(np.array(size_of)[chosen])
            last.append(np.array(piece_of)[chosen])
        return np.concatenate(length), np.concatenate(last)

    def encode_chunks(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [data[a:b].decode() for a, b in zip(starts, ends, strict=True)]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        ids, sizes = [], []
        cuts = np.flatnonzero(np.diff(lengths[order])) + 1
        for group in (part for same in np.split(order, cuts) for part in self._parts(same, lengths)):
            codes = np.frombuffer("".join([words[i] for i in group]).encode("utf-32-le"), np.uint32).reshape(len(group), -1)
            found, counts = self._paths(np.where(codes == MARK, NO_MARK, np.where(codes == SPACE, MARK, codes)))
            ids.append(found)
            sizes.append(counts)
        return in_order(np.concatenate(ids), np.concatenate(sizes), order)

    @staticmethod
    def _parts(group: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
        rows = max(1, CELLS // max(1, int(lengths[group[0]]))) if len(group) else 1
        for begin in range(0, len(group), rows):
            yield group[begin : begin + rows]

    def _paths(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length, last = self.viterbi(codes)
        n, size = codes.shape
        rows, ends, pieces = [], [], []
        live, end = np.arange(n), np.full(n, size)
        while len(live):
            rows.append(live)
            ends.append(end)
            pieces.append(last[live, end])
            end = end - length[live, end]
            live, end = live[end > 0], end[end > 0]
        row, end, piece = map(np.concatenate, (rows, ends, pieces))
        order = np.lexsort((end, row))
        row, end, piece = row[order], end[order], piece[order]
        counts = np.ones(len(row), np.int64)
        unknown = np.flatnonzero(piece < 0)
        if len(unknown):
            chars = [chr(MARK) if c == NO_MARK else chr(c) for c in codes[row[unknown], end[unknown] - 1].tolist()]
            raw = [c.encode("utf-8", "surrogatepass") for c in chars]
            counts[unknown] = [len(b) for b in raw]
            piece = np.repeat(piece, counts)
            piece[piece < 0] = self.byte_ids[np.frombuffer(b"".join(raw), np.uint8)]
        return piece.astype(np.uint32), np.bincount(row, counts, minlength=n).astype(np.int64)

    def encode_texts(self, buffer: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts, each with a leading space unless it is empty, and their numbers."""
        some = np.diff(bounds) > 0
        spaced = np.insert(buffer, bounds[:-1][some], np.uint8(SPACE))
        return self.encode(spaced, bounds + np.concatenate([[0], np.cumsum(some)]))

    def decode_ids(self, ids: np.ndarray) -> str:
        """The text of one document's ids: the pieces' bytes without the leading space."""
        sizes = self.decode_sizes[ids]
        total = np.cumsum(sizes) - sizes
        at = np.arange(int(sizes.sum())) - np.repeat(total, sizes) + np.repeat(self.decode_starts[ids], sizes)
        data = self.decode_bytes[at].tobytes()
        return data.removeprefix(b" ").decode("utf-8", "replace")


def _with(df: DataFrame, field: StructField) -> tuple[DataFrame, StructType]:
    rows = df.select([c for c in df.columns if c != field.name])
    return rows, StructType([*rows.schema, field])


def encode_pieces(df: DataFrame, model: str, text: str = "text", column: str = "ids") -> DataFrame:
    """Adds the piece ids of each text as an array; null and empty texts get an empty one.

    Other columns pass through; one called like the new column is replaced.
    """
    rows, schema = _with(df, StructField(column, ArrayType(IntegerType(), False)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.shared(model)
        for batch in batches:
            for part in passes(batch, text):
                ids, sizes = pieces.encode_texts(*text_bytes(part.column(text)))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                cells = pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, cells], [*part.schema.names, column])

    return rows.mapInArrow(work, schema)


def decode_pieces(df: DataFrame, model: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """Adds the text of each array of ids; null counts as no ids, which is the empty text.

    Every text that ``encode_pieces`` encoded comes back unchanged.
    """
    rows, schema = _with(df, StructField(column, StringType()))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = PieceModel.shared(model)
        for batch in batches:
            cells = batch.column(ids)
            texts = [pieces.decode_ids(np.array([], np.int64) if c.values is None else c.values.to_numpy()) for c in cells]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, column])

    return rows.mapInArrow(work, schema)
