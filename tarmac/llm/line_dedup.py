"""Line deduplication by range-partitioned hashes and streamed runs."""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import cut_lineage, text_column

_BLANK = b" \t\n\r\x0b\x0c"
_DROP, _OPEN, _TOTAL = 0, 1, 2
_FOUND = ["kind", "key", "doc_id", "row", "n_lines", "pos", "n_docs"]

#: Rows that a task holds on to while it waits for a line's next document.
HELD = 10_000


def line_key(line: bytes, least: int) -> bytes | None:
    """The line stripped and with A-Z lower-cased; None if it has fewer than ``least`` code points."""
    key = line.strip(_BLANK)
    if len(key) < least or (len(key) < 4 * least and len(key.decode()) < least):
        return None
    return key.lower()


def line_hashes(docs: DataFrame, least: int = 20) -> DataFrame:
    """``key`` (128-bit hash), ``doc_id, row`` (hash of the text), ``n_lines, pos`` for each different line of a document.

    ``pos`` holds all places of the line in the document, as little-endian 32-bit integers; lines that are too short have
    no row.
    """
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row", T.LongType()), T.StructField("n_lines", T.IntegerType()), T.StructField("pos", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                keys, own, total, pos = bytearray(), array("i"), array("i"), array("i")
                for i, text in enumerate(text_column(batch).cast(pa.large_binary()).to_pylist()):
                    lines = text.split(b"\n")
                    total.append(len(lines))
                    for k, line in enumerate(lines):
                        if (key := line_key(line, least)) is not None:
                            keys += xxhash.xxh3_128_digest(key)
                            own.append(i)
                            pos.append(k)
                if own:
                    yield _by_line(keys, np.frombuffer(own, np.int32), np.frombuffer(total, np.int32), np.frombuffer(pos, np.int32), batch, schema.names)

    return docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row")).mapInArrow(run, schema)


def _by_line(keys: bytes, own: np.ndarray, total: np.ndarray, pos: np.ndarray, batch: pa.RecordBatch, names: list[str]) -> pa.RecordBatch:
    """A row for each document and key from a row for each place, which stand in order of document and place."""
    halves = np.frombuffer(keys, np.uint64).reshape(-1, 2)
    order = np.lexsort((halves[:, 1], halves[:, 0], own))  # stable: places stay in order
    halves, own = halves[order], own[order]
    first = np.flatnonzero(np.r_[True, (halves[1:] != halves[:-1]).any(1) | (own[1:] != own[:-1])])
    ends = np.r_[first, len(own)].astype(np.int64) * 4
    places = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(pos[order])])
    held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(first), [None, pa.py_buffer(np.ascontiguousarray(halves[first]))])
    at = pa.array(own[first])
    return pa.RecordBatch.from_arrays([held.cast(pa.binary()), batch.column("doc_id").take(at), batch.column("row").take(at), pa.array(total[own[first]]), places.cast(pa.binary())], names)


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are equal."""
    a, b = column[1:], column[:-1]
    one_null = pc.not_equal(pc.is_null(a), pc.is_null(b))
    return pc.or_(pc.fill_null(pc.not_equal(a, b), False), one_null).to_numpy(zero_copy_only=False)


def _stream(least_docs: int, most_held: int):
    """Over rows in order of key, then doc_id from the largest: what goes.

    Rows of a run's first document never go and are not held; those of the next ones are held until enough documents are
    seen, ``most_held`` of them at most: more are given out as open, with the run's total at its end. The first and last
    run of a partition may go on in the next one, so their rows are open as well.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = last = None  # of the run at hand, as scalars
        n_docs, begun, at_start, opened = 0, False, True, False
        held: list[pa.RecordBatch] = []

        def made(kind: int, rows: pa.RecordBatch) -> pa.RecordBatch:
            n, (keys, *others) = rows.num_rows, rows.columns
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), keys if kind == _OPEN else pa.nulls(n, keys.type), *others, pa.nulls(n, pa.int64())], _FOUND)

        def total() -> pa.RecordBatch:
            values = [pa.array([_TOTAL], pa.int32()), pa.array([key.as_py()], pa.binary()), pa.array([first.as_py()], first.type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([n_docs], pa.int64())]
            return pa.RecordBatch.from_arrays(values, _FOUND)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys, ids = batch.column("key"), batch.column("doc_id")
            goes_on = begun and keys[0].equals(key)
            new_run = np.r_[not goes_on, _changes(keys)]
            new_doc = new_run | np.r_[not (goes_on and ids[0].equals(last)), _changes(ids)]
            starts = np.flatnonzero(np.r_[True, new_run[1:]])  # the first may go on from the batch before
            count = np.cumsum(new_doc)
            base = count[starts] - new_doc[starts]
            base[0] -= n_docs if goes_on else 0
            which = np.cumsum(np.r_[False, new_run[1:]])
            doc = count - base[which]  # number of the document in its run, from 1
            reach = doc[np.r_[starts[1:], n] - 1]  # documents of each run, so far
            if begun and not goes_on:  # the run at hand has ended
                if at_start or opened:
                    yield total()
                at_start, opened, held = False, False, []
            if not begun or not goes_on:
                first = ids[0]
            begun = True
            skip = 0
            if at_start:  # the partition's first run, whose beginning may stand in the one before
                skip = int(starts[1]) if len(starts) > 1 else n
                yield made(_OPEN, batch.slice(0, skip))
            enough = reach >= least_docs
            if held and enough[0]:
                for rows in held:
                    yield made(_DROP, rows)
                held = []
            going = (doc > 1) & enough[which]
            going[:skip] = False
            if going.any():
                yield made(_DROP, batch.take(pa.array(np.flatnonzero(going))))
            if len(starts) > 1:  # the first run ends here, the last one begins here
                if at_start or opened:
                    key, n_docs = keys[0], int(reach[0])
                    yield total()
                at_start, opened, held = False, False, []
                first = ids[int(starts[-1])]
            key, last, n_docs = keys[n - 1], ids[n - 1], int(reach[-1])
            if not at_start and not enough[-1]:
                waiting = np.flatnonzero((doc > 1) & (which == which[-1]))
                if len(waiting):
                    held.append(batch.take(pa.array(waiting)))
                if sum(rows.num_rows for rows in held) > most_held:
                    for rows in held:
                        yield made(_OPEN, rows)
                    opened, held = True, []
        if begun:
            for rows in held:
                yield made(_OPEN, rows)
            yield total()

    return run


def line_keep_bitmaps(docs: DataFrame, least: int = 20, least_docs: int = 3, partitions: int | None = None, most_held: int = HELD) -> DataFrame:
    """Which lines of ``docs`` stay, without their text.

    Lines with the same key (stripped of white space, A-Z lower-cased) of at least ``least`` code points that stand in
    at least ``least_docs`` documents stay in the largest doc_id alone, all of them there. The result has a row for each
    document that loses lines: ``doc_id, row`` (hash of its text), ``n_lines, n_dropped, keep`` (a zlib-compressed bitmap
    with a bit for each line, first line first). A null doc_id counts as the smallest.

    Hashes of lines are range-partitioned together with doc_id, so that a line in a third of all documents is spread over
    many tasks, sorted within partitions, and streamed. A document sends one row for each different line, with its places.
    Only a partition's first and last run can cross its bounds, and only a run that waits for its next document over more
    than ``most_held`` rows is not settled at once: their totals, two rows a partition and one for each so many rows at
    most, are put together and settle the rest.
    """
    hashes = line_hashes(docs, least)
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = F.col("doc_id").desc_nulls_last()
    ordered = hashes.repartitionByRange(parts, F.col("key"), down).sortWithinPartitions("key", down, "row")
    schema = T.StructType([T.StructField("kind", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("row", T.LongType()), T.StructField("n_lines", T.IntegerType()), T.StructField("pos", T.BinaryType()), T.StructField("n_docs", T.LongType())])
    found = cut_lineage(ordered.mapInArrow(_stream(least_docs, most_held), schema))
    totals = found.where(F.col("kind") == _TOTAL).groupBy("key").agg(F.sum("n_docs").alias("n_docs"), F.max("doc_id").alias("largest"))
    totals = totals.where(F.col("n_docs") >= least_docs)
    still = found.where(F.col("kind") == _OPEN).drop("n_docs").join(F.broadcast(totals), "key").where(~F.col("doc_id").eqNullSafe(F.col("largest")))
    going = found.where(F.col("kind") == _DROP).select("doc_id", "row", "n_lines", "pos").unionByName(still.select("doc_id", "row", "n_lines", "pos"))
    by_doc = going.groupBy("doc_id", "row").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("gone"))
    return by_doc.mapInArrow(_bitmaps, T.StructType([schema["doc_id"], schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("keep", T.BinaryType())]))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made, dropped = [], []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone").to_pylist()):
            bits = np.ones(n, np.uint8)
            for places in gone:
                bits[np.frombuffer(places, np.int32)] = 0
            made.append(zlib.compress(np.packbits(bits).tobytes()))
            dropped.append(n - int(bits.sum(dtype=np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), batch.column("n_lines").cast(pa.int64()), pa.array(dropped, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "row", "n_lines", "n_dropped", "keep"])


def kept_lines(keep: bytes, n: int) -> np.ndarray:
    """Numbers of the lines that a bitmap keeps."""
    return np.flatnonzero(np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n))


def dedup_lines(docs: DataFrame, least: int = 20, least_docs: int = 3, partitions: int | None = None) -> DataFrame:
    """``docs`` with its columns, the text (null: empty) left with the lines that stay, and ``n_lines, n_dropped``.

    ``n_lines`` counts lines before dropping; a null or empty text has one empty line, which is too short to go. Columns
    of the input with these two names are replaced. Repeated rows are one document and come out alike; rows that share an
    id but not the text count as one document for the number of documents, each with lines of its own. An empty table
    gives no rows.
    """
    bitmaps = line_keep_bitmaps(docs, least, least_docs, partitions).select(F.col("doc_id").alias("__doc"), F.col("row").alias("__row"), F.col("n_dropped").alias("__dropped"), F.col("keep").alias("__keep"))
    held = docs.drop("n_lines", "n_dropped").withColumn("text", F.coalesce("text", F.lit("")))
    joined = held.join(bitmaps, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.xxhash64("text") == F.col("__row")), "left").drop("__doc", "__row")
    schema = T.StructType([*held.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    place, width = held.columns.index("text"), len(held.columns)

    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                texts, counts = [], []
                for text, keep in zip(batch.column(place).to_pylist(), batch.column("__keep").to_pylist()):
                    n = text.count("\n") + 1
                    if keep is not None:
                        lines = text.split("\n")
                        text = "\n".join([lines[i] for i in kept_lines(keep, n)])
                    texts.append(text)
                    counts.append(n)
                columns = list(batch.columns[:width])
                columns[place] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(counts, pa.int64()), pc.fill_null(batch.column("__dropped"), 0)], names)

    return joined.mapInArrow(run, schema)
