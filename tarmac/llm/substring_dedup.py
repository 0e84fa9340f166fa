"""Exact substring deduplication with suffix arrays.

Every string of ``length`` bytes has an anchor: the run of ANCHOR bytes in it whose hash is least. Neighbouring strings
with the same anchor make one segment, so each text is a chain of short overlapping segments, and equal strings always
lie in segments of the same anchor. Segments are met by anchor, in three steps:

1. Digests of segments go to buckets of anchors. An equal segment of a smaller doc_id covers a segment as a whole; where
   both stand in one batch of texts that is known at once, so of a passage in many texts each batch sends few digests.
   Segments that agree with a different one of their anchor in enough context to share a string are contested; all
   others are settled.
2. The bytes of contested segments, each distinct one once, are fetched from their texts.
3. Suffix arrays of the contested segments (two-stage sorting, common prefixes of neighbours) show which of their
   strings stand in a smaller doc_id.

An anchor with more than HOT contested segments (a passage in a large share of the corpus meets a new context each time)
is dealt out by its strings in place of itself: a digest of each distinct string once from each group of documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import STEP_BYTES, cut_lineage, raw_bytes, steps, text_column
from tarmac.llm.shingles import prefix_hash, slice_hash
from tarmac.llm.suffix_sort import common_prefixes, suffix_order

ANCHOR = 16
#: Contested segments of an anchor that go to one suffix array at most.
HOT = 2000
#: Text bytes whose digests share a bucket, and whose texts share a group, about.
BUCKET_BYTES = 4 << 20
_COVERED, _CONTESTED, _CONTESTED_HOT = 0, 1, 2
_BYTES, _SETTLED, _DIGEST_ONLY = 0, 1, 2
_NONE = np.iinfo(np.int64).min  # stands for a null doc_id, the smallest of all
_SEPARATOR = 255  # no byte of UTF-8


def _pack(ids: np.ndarray) -> bytes:
    """Numbers with like bytes together, which the exchange's compression shrinks."""
    return np.ascontiguousarray(ids.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _low(values: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def _high(data: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(data) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(-1, width)
    return out.view("<u8").ravel()


def segments(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """start, stop, hash of the anchor, of the segment, and of the anchor with its left and right context (0: cut off).

    ``data`` holds texts end to end, with the n+1 ``offsets``.
    """
    n, span = len(data), length - ANCHOR + 1
    ends = np.repeat(offsets[1:], np.diff(offsets))
    prefix = prefix_hash(data)
    at = np.arange(max(n - ANCHOR + 1, 0))
    value = np.full(n + span, np.iinfo(np.uint64).max, np.uint64)
    value[: len(at)] = slice_hash(prefix, at, at + ANCHOR) >> np.uint64(1)
    where = np.arange(n + span, dtype=np.int64)
    width = 1
    while width < span:  # the least of ``width`` hashes, then of twice as many
        step = min(width, span - width)
        less = value[step:] < value[:-step]
        value[:-step] = np.where(less, value[step:], value[:-step])
        where[:-step] = np.where(less, where[step:], where[:-step])
        width += step
    begins = np.flatnonzero(np.arange(n) + length <= ends) if n else np.empty(0, np.int64)
    if not len(begins):
        none = np.empty(0, np.int64)
        return none, none, *[none.astype(np.uint64)] * 4
    anchor = where[begins]
    new = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (begins[1:] != begins[:-1] + 1)]))
    start, stop, anchor = begins[new], begins[np.append(new[1:], len(begins)) - 1] + length, anchor[new]
    side = (length - ANCHOR + 1) // 2
    left = np.where(anchor - start >= side, slice_hash(prefix, np.maximum(anchor - side, 0), anchor + ANCHOR) | np.uint64(1), np.uint64(0))
    right = np.where(stop - anchor - ANCHOR >= side, slice_hash(prefix, anchor, np.minimum(anchor + ANCHOR + side, n)) | np.uint64(1), np.uint64(0))
    return start, stop, slice_hash(prefix, anchor, anchor + ANCHOR), slice_hash(prefix, start, stop), left, right


def _in_blocks(data: np.ndarray, offsets: np.ndarray, length: int) -> Iterator[tuple[int, tuple[np.ndarray, ...]]]:
    """``segments`` of few texts at once, or of a long one in blocks: (where a block starts, its segments).

    Segments depend on the bytes about them alone. The last of a block may go on, so the next block starts with it.
    """
    if len(data) <= 2 * STEP_BYTES:
        yield 0, segments(data, offsets, length)
        return
    for k in range(len(offsets) - 1):
        low, end = int(offsets[k]), int(offsets[k + 1])
        while True:
            part = data[low : min(low + STEP_BYTES, end)]
            found = segments(part, np.array([0, len(part)]), length)
            if low + len(part) == end or len(found[0]) < 2:
                yield low, found
                break
            yield low, tuple(x[:-1] for x in found)
            low += int(found[0][-1])


def _digests(length: int, buckets: int):
    """Segments of each batch, dealt to buckets by anchor: a row of packed columns for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def dealt() -> pa.RecordBatch:
            doc, variant, start, stop, anchor, whole, left, right = (np.concatenate(x) for x in zip(*held))
            order = np.lexsort((doc, whole, anchor))
            doc, variant, start, stop, anchor, whole, left, right = (x[order] for x in (doc, variant, start, stop, anchor, whole, left, right))
            new = np.ones(len(doc), bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
            covered = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            bucket = np.where(covered, _parts(doc, variant, buckets), (anchor >> np.uint64(40)).astype(np.int64) % buckets)
            order = np.lexsort((covered, bucket))
            cuts = np.flatnonzero(np.concatenate([[True], (np.diff(bucket[order]) != 0) | (np.diff(covered[order]) != 0)])) if len(order) else np.empty(0, np.int64)
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                own = order[a:b]
                row = (int(bucket[own[0]]), bool(covered[own[0]]), _pack(doc[own]), _pack(variant[own]), _low(start[own], 4), _low(stop[own] - start[own], 1))
                rows.append((*row, b"", b"", b"", b"") if row[1] else (*row, _low(anchor[own], 5), _low(whole[own], 6), _low(left[own], 2), _low(right[own], 2)))
            held.clear()
            kinds = [pa.int64(), pa.bool_(), *[pa.binary()] * 8]
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in enumerate(kinds)], _DIGEST.names)

        for whole in batches:
            texts = text_column(whole)
            ids, variants = (whole.column(x).to_numpy(zero_copy_only=False) for x in ("number", "variant"))
            for a, b in steps(np.asarray(pc.binary_length(texts), np.int64)):
                data, offsets = raw_bytes(texts.slice(a, b - a))
                for low, (start, stop, *hashes) in _in_blocks(data, offsets, length):
                    doc = np.searchsorted(offsets, low + start, side="right") - 1
                    held.append((ids[a + doc], variants[a + doc], low + start - offsets[doc], low + stop - offsets[doc], *hashes))
                    size += min(len(data), STEP_BYTES)
                    if size >= BUCKET_BYTES:
                        yield dealt()
                        size = 0
        if held:
            yield dealt()

    return run


_DIGEST = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("covered", T.BooleanType()), *(T.StructField(x, T.BinaryType()) for x in ("doc", "variant", "start", "size", "anchor", "whole", "left", "right"))])
_REPLY = T.StructType([T.StructField("part", T.LongType()), T.StructField("kind", T.IntegerType()), *(T.StructField(x, T.BinaryType()) for x in ("doc", "variant", "start", "size", "where"))])


def _parts(doc: np.ndarray, variant: np.ndarray, parts: int) -> np.ndarray:
    number = (doc.astype(np.int64) ^ variant.astype(np.int64)).view(np.uint64)
    return (number ^ (number >> np.uint64(13)) ^ (number >> np.uint64(29))).view(np.int64) % parts


def _column(table: pa.Table, name: str) -> bytes:
    return b"".join(table.column(name).to_pylist())


def _ids(table: pa.Table, name: str = "doc") -> np.ndarray:
    return np.concatenate([_unpack(x) for x in table.column(name).to_pylist()] or [np.empty(0, np.int64)])


def _replies(kind: np.ndarray, doc: np.ndarray, variant: np.ndarray, start: np.ndarray, size: np.ndarray, where: np.ndarray, parts: int) -> list[tuple]:
    part = _parts(doc, variant, parts)
    order = np.lexsort((kind, part))
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(part[order]) != 0) | (np.diff(kind[order]) != 0)])) if len(order) else np.empty(0, np.int64)
    rows = []
    for a, b in zip(cuts, [*cuts[1:], len(order)]):
        own = order[a:b]
        rows.append((int(part[own[0]]), int(kind[own[0]]), _pack(doc[own]), _pack(variant[own]), _low(start[own], 4), _low(size[own], 4), _low(where[own], 4)))
    return rows


def _table(rows: list[tuple], schema: T.StructType) -> pa.Table:
    kinds = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.BinaryType: pa.binary()}
    return pa.table([pa.array([x[k] for x in rows], kinds[type(f.dataType)]) for k, f in enumerate(schema.fields)], schema.names)


def _differ(group: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each member whether its group (a number from 0) has documents that differ."""
    n = int(group.max()) + 1 if len(group) else 0
    least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
    np.minimum.at(least, group, doc)
    np.maximum.at(most, group, doc)
    return (least != most)[group]


def _places(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Document, variant, start and size (of a byte each) of packed rows."""
    return _ids(table), _ids(table, "variant"), _high(_column(table, "start"), 4).astype(np.int64), _high(_column(table, "size"), 1).astype(np.int64)


def _settle(parts: int, arrays: int, most: int):
    """Of a bucket's segments, which are covered as a whole and which are contested."""

    def run(whole_table: pa.Table) -> pa.Table:
        known = whole_table.filter(whole_table.column("covered"))
        done = _places(known)
        none = np.zeros(len(done[0]), np.int64)
        replies = _replies(np.full(len(none), _COVERED), *done, none, parts)
        table = whole_table.filter(pc.invert(whole_table.column("covered")))
        doc, variant, start, size = _places(table)
        anchor, whole, left, right = (_high(_column(table, x), w) for x, w in (("anchor", 5), ("whole", 6), ("left", 2), ("right", 2)))
        order = np.lexsort((doc, whole, anchor))
        doc, variant, start, size, anchor, whole, left, right = (x[order] for x in (doc, variant, start, size, anchor, whole, left, right))
        new = np.ones(len(doc), bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (whole[1:] != whole[:-1])
        group = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        covered = doc > doc[first][group]
        # The first of each group stands for it; groups of an anchor that share context on a side may share a string.
        contested = np.zeros(len(first), bool)
        for side in (left, right):
            some = np.flatnonzero(side[first])
            key = np.unique(np.column_stack([anchor[first[some]], side[first[some]]]), axis=0, return_inverse=True)[1].ravel()
            contested[some] |= _differ(key, doc[first[some]])
        _, own, count = np.unique(anchor[first[contested]], return_inverse=True, return_counts=True)
        hot = np.zeros(len(first), bool)
        hot[contested] = count[own] > most
        kind = np.where(covered, _COVERED, np.where(hot[group], _CONTESTED_HOT, _CONTESTED))
        held = np.flatnonzero(covered | contested[group])
        where = (anchor % np.uint64(arrays)).astype(np.int64)
        return _table(replies + _replies(kind[held], doc[held], variant[held], start[held], size[held], where[held], parts), _REPLY)

    return run


_STRINGS = T.StructType([T.StructField("array", T.LongType()), *(T.StructField(x, T.BinaryType()) for x in ("doc", "variant", "start", "size", "settled", "data"))])


def _stretches(places: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of consecutive places as (first, number), of 100 at most."""
    first = last = places[0]
    for i in places[1:]:
        if i > last + 1 or i - first >= 100:
            yield first, last - first + 1
            first = i
        last = i
    yield first, last - first + 1


def _fetch(length: int, arrays: int):
    """The bytes of contested segments of a group of documents, dealt to suffix arrays.

    Strings of hot anchors are dealt singly, as digests. Where several documents of the group hold one, the least sends it
    and the others' places are settled: they are sent along as such, without bytes.
    """

    def run(texts: pa.Table, asked: pa.Table) -> pa.Table:
        if not asked.num_rows or not texts.num_rows:
            return _table([], _STRINGS)
        held = _texts(texts)
        doc, variant, start, size = _ids(asked), _ids(asked, "variant"), _high(_column(asked, "start"), 4).astype(np.int64), _high(_column(asked, "size"), 4).astype(np.int64)
        where = _high(_column(asked, "where"), 4).astype(np.int64)
        kind = np.repeat(asked.column("kind").to_numpy(), [len(x) // 8 for x in asked.column("doc").to_pylist()])
        sent: dict[int, list[tuple[tuple[int, int], int, int, bytes]]] = {}
        singles: dict[bytes, list[tuple[tuple[int, int], int]]] = {}
        for d, s, z, w, k in zip(zip(doc.tolist(), variant.tolist()), start.tolist(), size.tolist(), where.tolist(), kind.tolist()):
            text = held.get(d, b"")
            if len(text) < s + z:
                continue
            if k == _CONTESTED:
                sent.setdefault(w, []).append((d, s, 0, text[s : s + z]))
            else:
                for i in range(s, s + z - length + 1):
                    singles.setdefault(text[i : i + length], []).append((d, i))
        gone: dict[tuple[int, int], list[int]] = {}
        if singles:
            at = np.arange(len(singles)) * length
            digests = slice_hash(prefix_hash(np.frombuffer(b"".join(singles), np.uint8)), at, at + length)
            packed = digests.astype("<u8").tobytes()
            for k, (places, w) in enumerate(zip(singles.values(), (digests % np.uint64(arrays)).tolist())):
                least = min(places)[0][0]
                for d, i in places:
                    if d[0] == least:
                        sent.setdefault(w, []).append((d, i, _DIGEST_ONLY, packed[8 * k : 8 * k + 8]))
                    else:
                        gone.setdefault(d, []).append(i)
        for d, places in gone.items():
            for i, n in _stretches(sorted(places)):
                sent.setdefault((d[0] ^ d[1]) % arrays, []).append((d, i, _SETTLED, n + length - 1))
        rows = []
        for w, own in sent.items():
            d, s, done, data = zip(*own)
            sizes = [x if k == _SETTLED else length if k == _DIGEST_ONLY else len(x) for x, k in zip(data, done)]
            of, row = np.array(d, np.int64).T
            rows.append((w, _pack(of), _pack(row), _low(np.array(s), 4), _low(np.array(sizes), 1), bytes(done), b"".join(x for x, k in zip(data, done) if k != _SETTLED)))
        return _table(rows, _STRINGS)

    return run


def _compare(length: int, parts: int):
    """By the suffix array of all strings sent, the places whose string stands in a smaller doc_id."""

    def run(table: pa.Table) -> pa.Table:
        doc, variant, start, size = _places(table)
        sent = np.frombuffer(_column(table, "settled"), np.uint8)
        data = np.frombuffer(_column(table, "data"), np.uint8)
        owner = np.repeat(sent, np.choose(sent, [size, 0, 8]))
        own, single, settled = (np.flatnonzero(sent == k) for k in (_BYTES, _DIGEST_ONLY, _SETTLED))
        digest = data[owner == _DIGEST_ONLY].copy().view("<u8")
        data = data[owner == _BYTES]
        ends = np.cumsum(size[own] + 1)
        text = np.full(int(ends[-1]) if len(ends) else 0, _SEPARATOR, np.uint8)
        keep = np.ones(len(text), bool)
        keep[ends - 1] = False
        text[keep] = data
        begin = ends - size[own] - 1
        order = suffix_order(text, length)
        common = common_prefixes(text, order, length)
        segment = np.searchsorted(begin, order, side="right") - 1
        whole = order + length < ends[segment] if len(order) else np.empty(0, bool)  # strings that end within their segment
        run_of = np.cumsum(common < length) - 1
        least = np.full(int(run_of[-1]) + 1 if len(run_of) else 0, np.iinfo(np.int64).max)
        np.minimum.at(least, run_of[whole], doc[own][segment[whole]])
        gone = whole.copy()
        gone[whole] = least[run_of[whole]] < doc[own][segment[whole]]
        at, of = order[gone], own[segment[gone]]
        _, same = np.unique(digest, return_inverse=True)
        least = np.full(len(digest), np.iinfo(np.int64).max)
        np.minimum.at(least, same, doc[single])
        also = single[least[same] < doc[single]]
        place, of = np.concatenate([start[of] + at - begin[segment[gone]], start[also]]), np.concatenate([of, also])
        row, of = variant[of], doc[of]
        # Neighbouring places of a document are one stretch.
        order = np.lexsort((place, row, of))
        place, row, of = place[order], row[order], of[order]
        new = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (row[1:] != row[:-1]) | (place[1:] > place[:-1] + 1)])) if len(of) else np.empty(0, np.int64)
        last = np.append(new[1:], len(of)) - 1 if len(of) else new
        d, v, s = np.concatenate([of[new], doc[settled]]), np.concatenate([row[new], variant[settled]]), np.concatenate([place[new], start[settled]])
        z = np.concatenate([place[last] - place[new] + length, size[settled]])
        none = np.zeros(len(d), np.int64)
        return _table(_replies(none, d, v, s, z, none, parts), _REPLY)

    return run


def with_numbers(docs: DataFrame) -> DataFrame:
    """``docs`` with ``number``, whose order is that of doc_id (null: the smallest), and ``variant``, which tells apart the
    texts of rows that share a doc_id (a hash of the text; 0 in tables where no id has two texts).

    An integer is its own number. Other ids are ranked: distinct ones in range partitions, the partitions' sizes added up.
    """
    spark = docs.sparkSession
    texts = docs.select("doc_id", F.xxhash64("text").alias("row")).groupBy("doc_id").agg((F.min("row") != F.max("row")).alias("several"))
    shared = not texts.where("several").isEmpty()
    out = docs.select("doc_id", "text").withColumn("variant", F.xxhash64("text") if shared else F.lit(0).cast("long"))
    if isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        return out.withColumn("number", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NONE)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = cut_lineage(docs.where("doc_id is not null").select("doc_id").distinct().repartitionByRange(parts, "doc_id").withColumn("block", F.spark_partition_id()))
    inside = F.row_number().over(Window.partitionBy("block").orderBy("doc_id"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ids.groupBy("block").agg(F.count("*").alias("n")).select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranks = ids.withColumn("inside", inside).join(F.broadcast(starts), "block").select("doc_id", (F.col("inside") + F.col("earlier")).alias("number"))  # a row a partition
    return out.join(ranks, "doc_id", "left").withColumn("number", F.coalesce("number", F.lit(_NONE)))


def duplicate_spans(numbered: DataFrame, length: int = 50, hot: int = HOT) -> tuple[DataFrame, int]:
    """Stretches of bytes to remove, packed by group of documents, and the number of groups.

    ``numbered``: see ``with_numbers``; see ``remove_repeats`` for what goes.
    """
    spark = numbered.sparkSession
    volume = numbered.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffle, int(volume / BUCKET_BYTES)) | 1  # odd, so that ids in even steps are spread too
    arrays = max(shuffle, int(volume / (8 * BUCKET_BYTES)) + 1)
    digests = numbered.select("number", "variant", "text").mapInArrow(_digests(length, parts), _DIGEST)
    replies = cut_lineage(digests.groupBy("bucket").applyInArrow(_settle(parts, arrays, hot), _REPLY))
    asked = replies.where(F.col("kind") != _COVERED)
    strings = _with_texts(numbered, parts).cogroup(asked.groupBy("part")).applyInArrow(_fetch(length, arrays), _STRINGS)
    found = strings.groupBy("array").applyInArrow(_compare(length, parts), _REPLY)
    return replies.where(F.col("kind") == _COVERED).unionByName(found).select("part", "doc", "variant", "start", "size"), parts


def _with_texts(numbered: DataFrame, parts: int):
    """Documents in groups by the number that ``_parts`` gives."""
    number = F.col("number").bitwiseXOR(F.col("variant"))
    spread = number.bitwiseXOR(F.shiftrightunsigned(number, 13)).bitwiseXOR(F.shiftrightunsigned(number, 29))
    return numbered.select(F.pmod(spread, F.lit(parts)).alias("part"), "number", "variant", "doc_id", "text").groupBy("part")


def _texts(texts: pa.Table) -> dict[tuple[int, int], bytes]:
    """The bytes of each text by its number and variant."""
    return dict(zip(zip(texts.column("number").to_pylist(), texts.column("variant").to_pylist()), texts.column("text").cast(pa.large_binary()).to_pylist()))


def _cut(texts: pa.Table, spans: pa.Table) -> pa.Table:
    gone: dict[tuple[int, int], list[tuple[int, int]]] = {}
    if spans.num_rows:
        start, size = _high(_column(spans, "start"), 4).tolist(), _high(_column(spans, "size"), 4).tolist()
        for d, v, a, z in zip(_ids(spans).tolist(), _ids(spans, "variant").tolist(), start, size):
            gone.setdefault((d, v), []).append((a, a + z))
    kept, counts = [], []
    keys = zip(texts.column("number").to_pylist(), texts.column("variant").to_pylist())
    for key, text in zip(keys, texts.column("text").cast(pa.large_binary()).to_pylist()):
        text = text or b""
        parts, at, removed, runs = [], 0, 0, 0
        reach = -1
        for a, b in sorted(gone.get(key, ())):
            a, b = min(a, len(text)), min(b, len(text))
            if a > reach:
                parts.append(text[at:a])
                runs += a < b
            removed += max(0, b - max(a, reach, 0))
            at = reach = max(reach, b)
        kept.append(b"".join([*parts, text[at:]]))
        counts.append((len(text), removed, runs))
    numbers = [pa.array([x[k] for x in counts], pa.int64()) for k in range(3)]
    return pa.table([texts.column("doc_id"), *numbers, pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def remove_repeats(docs: DataFrame, length: int = 50, hot: int = HOT) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept`` (the bytes that stay, as binary).

    Each byte goes that is covered by a string of ``length`` bytes (36 to 127) of the text's UTF-8 form that also starts
    in a document with a smaller doc_id, judged on the input. ``n_spans`` counts the maximal removed runs. Matches never
    cross documents; a string that repeats inside one document alone stays.

    A null or empty text has no bytes. doc_id may be of any type that can be ordered; a null one counts as the smallest.
    Repeated rows come out alike. Rows that share an id are one document with several texts: they take nothing from each
    other, and each loses what stands in documents of smaller ids. An empty table gives no rows; columns other than doc_id
    and text are left out.
    """
    if not 2 * ANCHOR + 4 <= length <= 127:
        raise ValueError("length must be 36 to 127")
    numbered = with_numbers(docs)
    spans, parts = duplicate_spans(numbered, length, hot)
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(x, T.LongType()) for x in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])
    return _with_texts(numbered, parts).cogroup(spans.groupBy("part")).applyInArrow(_cut, schema)
