"""Exact deduplication of word passages by fixed-block anchors.

A window of ``width`` words holds a whole block of (width + 1) / 2 words wherever blocks begin. So every document gives
its non-overlapping blocks to an index, and probes it with all its rolling windows of a block's size. Where a probe hits a
block of another document, the windows about it are compared as a whole, word for word to both sides; neighbouring
windows that repeat make a maximal repeat.

Documents are dealt to parts of a few megabytes, written once as a table bucketed by part, and read in three steps:

1. Each part sends its distinct probes (32 bits, two of them marks: is a block, stands in two documents) to the buckets
   of the index, which answer with those that hit a block of another document. A chance hit costs a comparison only.
2. Each part sends the distinct windows about hits, as digests of 96 bits besides the bucket, with the least document
   that has each, and is told by one bit a window whether a smaller document elsewhere has it too.
3. Words that such windows cover go.

A passage in any share of the corpus is one row a part and step, so no group grows with the number of its copies.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import cut_lineage, raw_bytes, shared_folder
from tarmac.llm.shingles import SPACE, scramble
from tarmac.llm.substring_dedup import with_numbers

#: Bytes of text in a part, about.
PART_BYTES = 4 << 20
#: Bytes of text whose probes share a bucket of the index, about.
BUCKET_BYTES = 8 << 20
_VALUE = 30  # bits of a probe within its bucket
_HITS, _WINDOWS = 0, 1
_PROBE = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("part", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("data", T.BinaryType()), T.StructField("least", T.BinaryType())])
_ODD = np.array([int.from_bytes(xxhash.xxh3_64_digest(str(k)), "little") | 1 for k in range(256)], np.uint64)


def _rows(rows: list[tuple]) -> pa.Table:
    bucket, part, kind, data, least = zip(*rows) if rows else ((), (), (), (), ())
    return pa.table([pa.array(bucket, pa.int64()), pa.array(part, pa.int64()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()), pa.array(least, pa.binary())], _PROBE.names)


class _Words:
    """The words of a part's documents, end to end, with 128 bits of hash each."""

    def __init__(self, texts: pa.Table) -> None:
        data, offsets = raw_bytes(pc.fill_null(pa.chunked_array(texts.column("text")).combine_chunks(), ""))
        inside = ~SPACE[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        starts, stops = inside & edge[:-1], inside & edge[1:]
        starts[1:] |= inside[1:] & ~inside[:-1]
        stops[:-1] |= inside[:-1] & ~inside[1:]
        at = np.flatnonzero(starts)
        self.doc = np.searchsorted(offsets, at, side="right") - 1
        held = data[inside]
        ends = np.concatenate([[0], np.cumsum(np.flatnonzero(stops) + 1 - at)]).astype(np.int64)
        self.text = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(ends), pa.py_buffer(held))
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        told = self.text.dictionary_encode()
        distinct = told.dictionary.cast(pa.large_binary()).to_pylist()
        lanes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, distinct)), "<u8").reshape(-1, 2)
        code = told.indices.to_numpy(zero_copy_only=False)
        self.high, self.low = (lanes[:, k][code] if len(code) else np.empty(0, np.uint64) for k in (0, 1))

    def runs(self, width: int) -> np.ndarray:
        """Where runs of ``width`` words of one document begin."""
        n = max(len(self.doc) - width + 1, 0)
        return np.flatnonzero(self.doc[:n] == self.doc[width - 1 :][:n])

    @staticmethod
    def digest(lane: np.ndarray, at: np.ndarray, width: int, odd: int) -> np.ndarray:
        """A digest of the words at..at+width by sums of products; two lanes have hashes of their own."""
        out = np.zeros(len(at), np.uint64)
        for k in range(width):
            out += lane[at + k] * _ODD[(odd + k) % 256]
        return scramble(out + np.uint64(width))

    def probes(self, block: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of a block's size begin, and the bucket and value of each as one number."""
        at = self.runs(block)
        h = self.digest(self.high, at, block, 0)
        return at, (((h >> np.uint64(_VALUE)) % np.uint64(buckets)) << np.uint64(_VALUE)) | (h & np.uint64((1 << _VALUE) - 1))


def _cuts(key: np.ndarray) -> np.ndarray:
    """Where runs of equal numbers begin."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    return np.flatnonzero(new)


def _spans(cuts: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    return zip(cuts.tolist(), [*cuts[1:].tolist(), n])


def _probe(block: int, buckets: int):
    def run(texts: pa.Table) -> pa.Table:
        words = _Words(texts)
        at, key = words.probes(block, buckets)
        if not len(at):
            return _rows([])
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        number = texts.column("number").to_numpy()[words.doc[at]]
        cuts = _cuts(key)
        is_block = np.maximum.reduceat(((at - words.first[words.doc[at]]) % block == 0).astype(np.uint32), cuts)
        several = (np.maximum.reduceat(number, cuts) != np.minimum.reduceat(number, cuts)).astype(np.uint32)
        key = key[cuts]
        entry = ((key & np.uint64((1 << _VALUE) - 1)).astype(np.uint32) << np.uint32(2)) | (several << np.uint32(1)) | is_block
        bucket, part = (key >> np.uint64(_VALUE)).astype(np.int64), texts.column("part")[0].as_py()
        return _rows([(int(bucket[a]), part, _HITS, entry[a:b].tobytes(), None) for a, b in _spans(_cuts(bucket), len(bucket))])

    return run


def _meet(table: pa.Table) -> pa.Table:
    """The probes of a bucket that hit a block while two documents hold them, back to their parts."""
    data = table.column("data").to_pylist()
    sizes = [len(x) // 4 for x in data]
    entry, row = np.frombuffer(b"".join(data), "<u4"), np.repeat(np.arange(len(data), dtype=np.int32), sizes)
    order = np.argsort(entry, kind="stable")
    value = entry[order] >> 2
    cuts = _cuts(value)
    count = np.diff(np.append(cuts, len(value)))
    mark = np.bitwise_or.reduceat(entry[order] & 3, cuts) if len(cuts) else np.empty(0, np.uint32)
    hit = np.zeros(len(entry), bool)
    hit[order] = np.repeat((mark & 1 == 1) & ((count > 1) | (mark & 2 == 2)), count)
    row, value = row[hit], entry[hit] >> 2
    bucket, parts = table.column("bucket")[0].as_py(), table.column("part").to_pylist()
    return _rows([(bucket, parts[row[a]], _HITS, value[a:b].tobytes(), None) for a, b in _spans(_cuts(row), len(row))])


class _Windows:
    """The distinct windows of a part that hold a hit, in order of bucket and digest, and the least document with each."""

    def __init__(self, texts: pa.Table, asked: pa.Table, width: int, buckets: int, windows: int) -> None:
        block = (width + 1) // 2
        self.words = words = _Words(texts)
        at, key = words.probes(block, buckets)
        hits = asked.filter(pc.equal(asked.column("kind"), _HITS))
        known = [(np.uint64(b) << np.uint64(_VALUE)) | np.frombuffer(x, "<u4").astype(np.uint64) for b, x in zip(hits.column("bucket").to_pylist(), hits.column("data").to_pylist())]
        near = np.zeros(len(words.doc) + width, np.int32)  # +1 where windows with a hit begin to begin, -1 where they end
        if known:
            found = at[np.isin(key, np.concatenate(known))]
            np.add.at(near, np.maximum(found - (width - block), 0), 1)
            np.add.at(near, found + 1, -1)
        begins = words.runs(width)
        begins = begins[np.cumsum(near)[begins] > 0]
        high, low = words.digest(words.high, begins, width, 0), words.digest(words.low, begins, width, 64) & np.uint64(0xFFFFFFFF)
        bucket = (high % np.uint64(windows)).astype(np.int64)
        order = np.lexsort((low, high, bucket))
        self.begins = begins[order]
        bucket, high, low = bucket[order], high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        cuts = np.flatnonzero(new)
        self.own = np.cumsum(new) - 1  # of each window, its place among the distinct ones
        self.number = texts.column("number").to_numpy()[words.doc[self.begins]]
        self.least = np.minimum.reduceat(self.number, cuts) if len(cuts) else np.empty(0, np.int64)
        self.bucket = bucket[cuts]
        self.data = np.empty((len(cuts), 12), np.uint8)
        self.data[:, :8] = high[cuts].astype("<u8").view(np.uint8).reshape(-1, 8)
        self.data[:, 8:] = low[cuts].astype("<u4").view(np.uint8).reshape(-1, 4)
        self.of_bucket = {int(self.bucket[a]): (a, b) for a, b in _spans(_cuts(self.bucket), len(self.bucket))}


def _send(width: int, buckets: int, windows: int):
    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        if not texts.num_rows or not asked.num_rows:
            return _rows([])
        held, part = _Windows(texts, asked, width, buckets, windows), texts.column("part")[0].as_py()
        return _rows([(bucket, part, _WINDOWS, held.data[a:b].tobytes(), held.least[a:b].astype("<i8").tobytes()) for bucket, (a, b) in held.of_bucket.items()])

    return run


def _least_elsewhere(table: pa.Table) -> pa.Table:
    """For each part, a bit a window sent: whether a smaller document of another part has it."""
    data, parts = table.column("data").to_pylist(), table.column("part").to_pylist()
    sizes = [len(x) // 12 for x in data]
    digest = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 12)
    high, low = np.ascontiguousarray(digest[:, :8]).view("<u8").ravel(), np.ascontiguousarray(digest[:, 8:]).view("<u4").ravel()
    least = np.frombuffer(b"".join(table.column("least").to_pylist()), "<i8")
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    cuts = np.flatnonzero(new)
    smallest = np.empty(len(least), np.int64)
    smallest[order] = np.minimum.reduceat(least[order], cuts)[np.cumsum(new) - 1]
    gone, rows, at = smallest < least, [], 0
    bucket = table.column("bucket")[0].as_py()
    for part, n in zip(parts, sizes):
        if gone[at : at + n].any():
            rows.append((bucket, part, _WINDOWS, np.packbits(gone[at : at + n]).tobytes(), None))
        at += n
    return _rows(rows)


def _cut(width: int, buckets: int, windows: int):
    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        held = _Windows(texts, asked, width, buckets, windows)
        words, elsewhere = held.words, np.zeros(len(held.least), bool)
        told = asked.filter(pc.equal(asked.column("kind"), _WINDOWS))
        for bucket, bits in zip(told.column("bucket").to_pylist(), told.column("data").to_pylist()):
            a, b = held.of_bucket[bucket]
            elsewhere[a:b] = np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
        gone = held.begins[elsewhere[held.own] | (held.number > held.least[held.own])]
        n = len(words.doc)
        cover = np.zeros(n + width + 1, np.int64)
        cover[gone] += 1
        cover[gone + width] -= 1
        removed = np.cumsum(cover)[:n] > 0
        first = removed.copy()  # words that begin a removed run of their document
        first[1:] &= ~(removed[:-1] & (words.doc[1:] == words.doc[:-1]))
        docs = texts.num_rows
        per = lambda mask: np.bincount(words.doc[mask], minlength=docs).astype(np.int64)
        stays = ~removed
        ends = np.concatenate([[0], np.cumsum(per(stays))])
        kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words.text.filter(pa.array(stays)).cast(pa.string())), " ")
        begin = np.flatnonzero(first)
        last = removed.copy()
        last[:-1] &= ~(removed[1:] & (words.doc[1:] == words.doc[:-1]))
        start, size = begin - words.first[words.doc[begin]], np.flatnonzero(last) - begin + 1
        of = pa.array(np.concatenate([[0], np.cumsum(per(first))]), pa.int32())
        spans = pa.ListArray.from_arrays(of, pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(size, pa.int64())], ["start", "length"]))
        counts = [pa.array(x) for x in (np.diff(words.first), per(removed))]
        return pa.table([texts.column("doc_id"), *counts, kept, spans], ["doc_id", "n_words", "n_removed", "text", "removed"])

    return run


def _dealt(docs: DataFrame, parts: int) -> DataFrame:
    """The documents with ``number`` (ordered as doc_id) and ``part``, as a table that later steps read without a shuffle."""
    spark = docs.sparkSession
    held = with_numbers(docs).withColumn("part", F.pmod(F.xxhash64("number", F.monotonically_increasing_id()), F.lit(parts)))
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"passages_{uuid.uuid4().hex}"
    laid = held.select("part", "number", "doc_id", "text").repartition(shuffle, "part")
    laid.write.option("path", f"{shared_folder(spark)}/{name}").bucketBy(shuffle, "part").format("parquet").saveAsTable(name)
    return spark.table(name)


def remove_passages(docs: DataFrame, width: int = 13) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_words, n_removed, text`` (the words that stay, joined by one space) and
    ``removed`` (start and length in words of each maximal removed run).

    Each word goes that is covered by a window of ``width`` words whose words also stand in a row in a document with a
    smaller doc_id, judged on the input. Words are what white space (\\x20, \\x09 to \\x0D) parts, taken as they are. Windows
    never cross documents; a passage that repeats inside one document alone stays.

    A null or empty text has no words. doc_id may be of any type that can be ordered; a null one counts as the smallest.
    Repeated rows come out alike. Rows that share an id are one document with several texts: they take nothing from each
    other. An empty table gives no rows; columns other than doc_id and text are left out.
    """
    if width < 3 or width % 2 == 0 or width > 127:
        raise ValueError("width must be odd, 3 to 127")
    volume = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, buckets = (int(volume / x) + 1 for x in (PART_BYTES, BUCKET_BYTES))
    table = _dealt(docs, parts)
    texts = table.groupBy("part")
    probes = texts.applyInArrow(_probe((width + 1) // 2, buckets), _PROBE)
    hits = cut_lineage(probes.groupBy("bucket").applyInArrow(_meet, _PROBE))
    sent = texts.cogroup(hits.groupBy("part")).applyInArrow(_send(width, buckets, buckets), _PROBE)
    told = sent.groupBy("bucket").applyInArrow(_least_elsewhere, _PROBE)
    run = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("text", T.StringType()), T.StructField("removed", run)])
    return texts.cogroup(hits.unionByName(told).groupBy("part")).applyInArrow(_cut(width, buckets, buckets), schema)
