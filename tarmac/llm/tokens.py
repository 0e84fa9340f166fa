"""Token ids by the tokenizers library, with a bounded cache of whole units.

A byte-level BPE never merges across a space or line end that stands between two characters that are not white space,
nor from an ASCII letter to an ASCII mark: its pre-tokenizer starts a new piece there. A text may therefore be cut before
each such place, and the ids of the cuts, joined, are the ids of the text. Words repeat, so most cuts come from a cache of the worker, and only new ones reach the
library. Cuts are found, told apart and put together for millions of bytes at once.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarmac.llm.common import raw_bytes, steps, text_column

#: Units in each of the two generations of a worker's cache, about 25 MB each.
CACHE_UNITS = 120_000
#: Bytes of text whose units are told apart in one step; a longer text takes several.
STEP_BYTES = 2 << 20
#: New units that the library takes at once.
CALL_UNITS = 8192
_SPACE, _LINE = "Ġ", "Ċ"  # the space and the line end in a byte-level vocabulary
_WHITE = np.zeros(256, bool)
_WHITE[[32, *range(9, 14), *range(28, 32)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_OPENS = np.zeros(256, bool)
_OPENS[[32, 10]] = True
#: First two bytes of the characters beyond ASCII among which white space is found; next to these no cut is made.
_WIDE = [(0xC2, 0x85), (0xC2, 0xA0), (0xE1, 0x9A), (0xE1, 0xA0), (0xE2, 0x80), (0xE2, 0x81), (0xE3, 0x80)]
_LEAD = np.zeros(256, bool)
_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _blank(data: np.ndarray) -> np.ndarray:
    """Bytes that belong to white space, or may."""
    out = _WHITE[data]
    for at in np.flatnonzero(_LEAD[data[:-1]]) if len(data) > 1 else ():
        if (int(data[at]), int(data[at + 1])) in _WIDE:
            out[at : at + (2 if data[at] == 0xC2 else 3)] = True
    return out


def _cuts(data: np.ndarray, marks: bool) -> np.ndarray:
    """Places of spaces and line ends that have no white space beside them and, if asked, of marks after letters."""
    found = []
    for low in range(0, len(data), STEP_BYTES):
        a = max(low - 3, 0)  # a character's bytes before the step, and the byte after it
        part = data[a : low + STEP_BYTES + 3]
        blank = _blank(part)
        cut = np.zeros(len(part), bool)
        if marks:
            cut[1:] = _MARK[part[1:]] & _LETTER[part[:-1]]
        cut[1:-1] |= _OPENS[part[1:-1]] & ~blank[:-2] & ~blank[2:]
        at = np.flatnonzero(cut) + a
        found.append(at[(at >= low) & (at < low + STEP_BYTES)])
    return np.concatenate(found) if found else np.empty(0, np.int64)


class Encoder:
    """Encodes texts into ids."""

    _open: dict[str, Encoder] = {}

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(vocabulary)
        words = self.library.get_vocab()
        top = max(words.values())
        self.kind = np.dtype("<u2" if top < 1 << 16 else "<u4")
        self.opens = np.zeros(top + 1, bool)  # ids that only the start of a unit gives
        self.opens[[i for token, i in words.items() if token.startswith(_SPACE) or token == _LINE]] = True
        self.special = [x.content.encode() for x in self.library.get_added_tokens_decoder().values()]
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    @classmethod
    def of(cls, vocabulary: str) -> Encoder:
        """One encoder for each vocabulary and worker."""
        if vocabulary not in cls._open:
            cls._open[vocabulary] = cls(vocabulary)
        return cls._open[vocabulary]

    def _library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, self.kind) for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, units: list[bytes], plain: list[bool]) -> list[bytes]:
        """The ids of each unit. Those that are one word after a space or line end go to the library end to end."""
        out: dict[bytes, bytes] = {}
        words, width = list(compress(units, plain)), self.kind.itemsize
        for k in range(0, len(words), CALL_UNITS):
            some = words[k : k + CALL_UNITS]
            ids = self._library([b"".join(some).decode()])[0]
            ends = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * width
            if len(ends) == len(some) + 1:
                data, ends = ids.tobytes(), ends.tolist()
                out.update(zip(some, [data[a:b] for a, b in zip(ends, ends[1:])]))
        rest = [x for x in units if x not in out]
        out.update(zip(rest, (x.tobytes() for x in self._library([x.decode() for x in rest]))))
        return list(map(out.__getitem__, units))

    def _known(self, units: list[bytes], plain: np.ndarray) -> list[bytes]:
        """The ids of distinct units, from the cache where it holds them. Of two generations the older is dropped."""
        if len(self.young) > CACHE_UNITS:
            self.old, self.young = self.young, {}
        found = list(map(self.young.get, units))
        missing = [k for k, x in enumerate(found) if x is None]
        names = [units[k] for k in missing]
        held = list(map(self.old.get, names))
        new = [k for k, x in enumerate(held) if x is None]
        for k, x in zip(new, self._learn([names[k] for k in new], plain[missing][new].tolist())):
            held[k] = x
        self.young.update(zip(names, held))
        for k, x in zip(missing, held):
            found[k] = x
        return found

    def encode(self, data: np.ndarray, offsets: np.ndarray, step: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts whose UTF-8 bytes lie end to end at ``offsets`` (n+1), and the n+1 offsets of each text's ids."""
        special = any(x in data.tobytes() for x in self.special)  # such a token is not to be cut
        mark = np.zeros(len(data) + 1, bool)
        mark[_cuts(data, not special)] = True
        inner = offsets[(offsets > 0) & (offsets < len(data))]
        mark[inner[_OPENS[data[inner - 1]]] - 1] = False  # a space that ends a text is not between two characters
        mark[offsets] = True
        bounds = np.flatnonzero(mark)
        blanks = np.concatenate([[0], np.cumsum(_blank(data), dtype=np.int32)])
        alone = _OPENS[data[bounds[:-1]]] & (blanks[bounds[1:]] == blanks[bounds[:-1]] + 1)  # units with no other white space
        if special:
            alone[:] = False
        made, sizes = [], []
        for a, b in steps(np.diff(bounds), step or STEP_BYTES):
            own = bounds[a : b + 1]
            places = (own - own[0]).astype(np.int32)
            units = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(places), pa.py_buffer(np.ascontiguousarray(data[own[0] : own[-1]]))]).dictionary_encode()
            code = units.indices.to_numpy()
            plain = np.empty(len(units.dictionary), bool)
            plain[code] = alone[a:b]
            known = self._known(units.dictionary.to_numpy(zero_copy_only=False).tolist(), plain)
            held = np.frombuffer(b"".join(known), self.kind)
            length = np.fromiter(map(len, known), np.int64, len(known)) // self.kind.itemsize
            n = length[code]
            start = np.cumsum(length) - length
            # Where each id is taken from: its unit's start, and on.
            at = np.repeat((start[code] - (np.cumsum(n) - n)).astype(np.int32), n)
            at += np.arange(len(at), dtype=np.int32)
            made.append(held[at])
            sizes.append(n)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        ids = np.concatenate(made) if made else np.empty(0, self.kind)
        return ids, ends[np.searchsorted(bounds, offsets)] if sizes else np.zeros(len(offsets), np.int64)


def encoded_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int | None, step: int | None = None) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of documents (column ``text``), their ids (unsigned 32-bit) end to end and the n+1 offsets of these.

    ``end_id``, where given, stands after the ids of each document. ``step``: bytes of text taken at once (STEP_BYTES).
    """
    encoder = Encoder.of(vocabulary)
    for whole in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(whole.column("text")), 0), np.int64)
        for start, stop in steps(sizes, step or STEP_BYTES):
            batch = whole.slice(start, stop - start)
            ids, ends = encoder.encode(*raw_bytes(text_column(batch)), step)
            if end_id is None:
                yield batch, ids.astype("<u4"), ends
                continue
            out = np.full(len(ids) + batch.num_rows, end_id, "<u4")
            ends = ends + np.arange(len(ends))
            own = np.ones(len(out), bool)
            own[ends[1:] - 1] = False
            out[own] = ids
            yield batch, out, ends


def id_column(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Runs of ids, parted at ``ends`` (n+1), as a binary column."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((4 * ends).astype(np.int32)), pa.py_buffer(ids)])


def token_ids(docs: DataFrame, vocabulary: str, end_id: int | None = None) -> DataFrame:
    """``doc_id`` and ``ids`` (little-endian unsigned 32-bit, as binary) of every whole text of ``docs``.

    A null text counts as empty; ``end_id``, where given, is put after each document. One map over the input's own
    partitions, without a shuffle. Rows stay rows: a repeated row gives a repeated result, extra columns are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, ends in encoded_batches(batches, vocabulary, end_id):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), id_column(ids, ends)], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", "text").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.BinaryType())]))


def token_lengths(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``n_tokens`` of every whole text of ``docs`` (a null or empty one: 0), a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, ends in encoded_batches(batches, vocabulary, None):
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(ends), pa.int64())], ["n_tokens"])

    return docs.select("text").mapInArrow(run, "n_tokens long")
