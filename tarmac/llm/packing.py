"""Packing documents into training windows by the online sum-of-squares rule."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.tokens import default_vocabulary, encoded_batches

_ID = 4  # bytes of an id
#: A task's sequences are numbered from its partition's number times this.
SEQUENCES_A_TASK = 1 << 32
#: Windows that a task holds open at most, about 4 KB of ids each.
OPEN_WINDOWS = 4096


class SumOfSquares:
    """Keeps windows of ``size`` tokens that are partly filled, and how many there are at each fill level.

    A piece goes to the level for which the sum of the squared counts, after it is placed, is least; an empty window
    counts as level 0. Of equal levels the fullest is taken. A full window is given out at once.
    """

    def __init__(self, size: int):
        self.size = size
        self.count = np.zeros(size + 1, np.int64)  # the level array
        self.open: dict[int, list[list[tuple]]] = defaultdict(list)

    def place(self, piece: tuple, length: int) -> list[tuple] | None:
        """``piece`` into a window; the window if it is full now."""
        count, size = self.count, self.size
        levels = np.flatnonzero(count[: size - length + 1])
        levels = levels[levels > 0]
        # The change of the sum of squares; a full window (level size) is no longer counted.
        change = np.where(levels + length == size, 1 - 2 * count[levels], 2 * (count[levels + length] - count[levels] + 1))
        level = 0
        if len(levels) and (best := change.min()) <= 2 * count[length] + 1:
            level = int(levels[np.flatnonzero(change == best)[-1]])
        window = [piece]
        if level:
            window = self.open[level].pop()
            window.append(piece)
            count[level] -= 1
        if level + length == size:
            return window
        count[level + length] += 1
        self.open[level + length].append(window)
        return None

    def pair(self) -> Iterator[list[tuple]]:
        """Put open windows together where one fits into the room of another, the fullest first; gives those now full."""
        for level in range(self.size - 1, 0, -1):
            while self.open[level]:
                window, filled = self._take(level), level
                while len(room := np.flatnonzero(self.count[1 : min(self.size - filled, level) + 1])):
                    window += self._take(other := int(room[-1]) + 1)
                    filled += other
                if filled == self.size:
                    yield window
                    continue
                self._put(filled, window)
                if filled == level:
                    break

    def _take(self, level: int) -> list[tuple]:
        self.count[level] -= 1
        return self.open[level].pop()

    def _put(self, level: int, window: list[tuple]) -> None:
        self.count[level] += 1
        self.open[level].append(window)

    def release(self, most: int) -> list[tuple]:
        """Pieces of windows beyond ``most``, taken from the level that has the most windows, where each is a square less."""
        out = []
        for _ in range(int(self.count.sum()) - most):
            out += self._take(int(self.count.argmax()))
        return out

    def rest(self) -> Iterator[tuple]:
        """The pieces of the windows still open, the fullest window first."""
        for level in sorted(self.open, reverse=True):
            for window in self.open[level]:
                yield from window


def pack(documents: Iterator[tuple[object, bytes]], size: int, most: int = OPEN_WINDOWS) -> Iterator[list[tuple]]:
    """Windows of pieces (document, start, ids, tokens of the document).

    Whole windows are cut from a document's start and its remainder goes to the level array. When more than ``most``
    windows are open, and at the end, windows that fit together are joined; if more than half of ``most`` are left, those
    beyond (at the end, all) are laid end to end and cut anew. What a cut in between leaves is placed by the rule again;
    the very last part is cut at powers of two, which need no padding.
    """
    levels = SumOfSquares(size)
    for key, ids in documents:
        total = len(ids) // _ID
        whole = total - total % size
        for start in range(0, whole, size):
            yield [(key, start, ids[_ID * start : _ID * (start + size)], total)]
        if whole < total and (full := levels.place((key, whole, ids[_ID * whole :], total), total - whole)):
            yield full
        if levels.count.sum() > most:
            yield from levels.pair()
            made = list(_recut(levels.release(most // 2), size))
            if made and sum(len(x[2]) for x in made[-1]) < _ID * size:
                for piece in made.pop():
                    if full := levels.place(piece, len(piece[2]) // _ID):
                        yield full
            yield from made
    yield from levels.pair()
    for window in _recut(list(levels.rest()), size):
        yield from _powers(window, size)


def _recut(pieces: list[tuple], size: int) -> Iterator[list[tuple]]:
    """Pieces end to end in windows of ``size`` tokens; the last may have fewer."""
    window: list[tuple] = []
    room = size
    for key, start, ids, total in pieces:
        while ids:
            part = ids[: _ID * room]
            window.append((key, start, part, total))
            n = len(part) // _ID
            ids, start, room = ids[len(part) :], start + n, room - n
            if not room:
                yield window
                window, room = [], size
    if window:
        yield window


def _powers(window: list[tuple], size: int) -> Iterator[list[tuple]]:
    """A window as it is if full, else in windows of powers of two."""
    tokens = sum(len(x[2]) for x in window) // _ID
    while tokens and tokens < size:
        power = 1 << tokens.bit_length() - 1
        first, *others = _recut(window, power)
        yield first
        window, tokens = [x for y in others for x in y], tokens - power
    if tokens:
        yield window


def pack_documents(docs: DataFrame, vocabulary: str | None = None, window: int = 1024, end_id: int = 0, most: int = OPEN_WINDOWS) -> DataFrame:
    """Pack every whole text of ``docs`` into sequences of at most ``window`` tokens.

    A row for each piece: ``doc_id, start, length, ids`` (little-endian unsigned 32-bit, as binary), ``doc_tokens``,
    ``sequence_id, offset``. Each partition of the input packs its own documents in one map, without a shuffle; it holds
    one step of encoded texts, the level array and at most ``most`` open windows. A task that runs again gives the same
    sequences. Full windows have no padding, and what remains of a partition is cut at powers of two, so there is none.

    A null or empty text is the end id alone. Repeated rows and rows without doc_id are documents of their own. An empty
    table gives no rows; columns other than doc_id and text are left out.
    """
    vocabulary = vocabulary or default_vocabulary()
    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(x, T.LongType()) for x in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(x, T.LongType()) for x in ("doc_tokens", "sequence_id", "offset"))])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def documents() -> Iterator[tuple[object, bytes]]:
            for batch, ids, ends in encoded_batches(batches, vocabulary, end_id):
                types[:] = [batch.schema.field("doc_id").type]
                data, at = ids.tobytes(), (_ID * ends).tolist()
                yield from zip(batch.column("doc_id").to_pylist(), (data[a:b] for a, b in zip(at, at[1:])))

        def made(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [types[0], pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], names)

        rows: list[tuple] = []
        sequence = TaskContext.get().partitionId() * SEQUENCES_A_TASK
        for pieces in pack(documents(), window, most):
            offset = 0
            for key, start, ids, total in pieces:
                n = len(ids) // _ID
                rows.append((key, start, n, ids, total, sequence, offset))
                offset += n
            sequence += 1
            if len(rows) >= 2000:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
