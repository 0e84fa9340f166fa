"""Token ids in wavelet matrices: one compressed file a shard, with access, counting and occurrence lookup.

A shard holds the ids of consecutive documents. Its matrix has one bit-plane for each bit of an id, the highest first;
after each plane the ids are parted stably by that bit. A plane is stored in chunks of CHUNK bits, each compressed by
itself together with its rank directory: the ones before each block of 512 bits. The head of the file has the ones before
each chunk. So rank inflates one chunk a plane, and select finds its chunk by binary search.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import shared_folder
from tarmac.llm.tokens import STEP_BYTES, default_vocabulary, encoded_batches, id_column

MAGIC = b"TWM2"
#: Ids in a shard at most, unless a single document has more.
SHARD_IDS = 1 << 21
#: Shards whose starts are added up in one group.
GROUP = 1024
#: Shards whose starts (three numbers each) are sent to every executor at most; beyond, files are joined by a shuffle.
BROADCAST_SHARDS = 100_000
_BLOCK = 512
CHUNK = 1 << 19
_HEAD = struct.Struct("<4sIQQQ")
#: Bytes of a chunk: its directory and its bits.
_DIRECTORY, _BITS = 4 * CHUNK // _BLOCK, CHUNK // 8


def build(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """The file of documents of these lengths, whose ids lie end to end.

    Head; sizes of all parts, the ones before each chunk of each plane; then the documents' lengths and the planes' chunks.
    """
    n = len(ids)
    width = max(1, int(ids.max()).bit_length()) if n else 1
    left = ids.astype(np.uint16 if width <= 16 else np.uint32)
    parted = np.empty_like(left)
    parts, before = [pa.compress(lengths.astype("<u4").tobytes(), "zstd", asbytes=True)], []
    for k in range(width - 1, -1, -1):
        bit = (left & left.dtype.type(1 << k)).astype(bool)
        plane = np.packbits(bit)
        plane = np.pad(plane, (0, -len(plane) % _BITS)).reshape(-1, _BITS)
        count = np.bitwise_count(plane.view("<u8")).reshape(len(plane), CHUNK // _BLOCK, _BLOCK // 64).sum(2, dtype=np.uint32)
        inside = np.cumsum(count, axis=1, dtype=np.uint32)
        before.append(np.concatenate([[0], np.cumsum(inside[:, -1], dtype=np.uint64)]).astype("<u8"))
        for bits, sums, own in zip(plane, inside, count):
            parts.append(pa.compress((sums - own).astype("<u4").tobytes() + bits.tobytes(), "zstd", asbytes=True))
        zeros = n - int(before[-1][-1])
        np.take(left, np.flatnonzero(bit), out=parted[zeros:])
        np.take(left, np.flatnonzero(~bit), out=parted[:zeros])
        left, parted = parted, left
    sizes = np.array([len(x) for x in parts], "<u8")
    return _HEAD.pack(MAGIC, width, n, len(lengths), len(parts)) + sizes.tobytes() + b"".join(x.tobytes() for x in before) + b"".join(parts)


class WaveletMatrix:
    """A file opened: only the head is read, chunks are inflated when they are asked for and then kept."""

    def __init__(self, data: bytes):
        magic, self.width, self.n, self.docs, parts = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.data, at = memoryview(data), _HEAD.size
        sizes = np.frombuffer(data, "<u8", parts, at).astype(np.int64)
        at += 8 * parts
        self.chunks = (parts - 1) // self.width
        #: Ones of each plane before each chunk, and in all.
        self.before = np.frombuffer(data, "<u8", self.width * (self.chunks + 1), at).astype(np.int64).reshape(self.width, -1)
        at += 8 * self.width * (self.chunks + 1)
        self.ends = at + np.concatenate([[0], np.cumsum(sizes)])
        self.zeros = self.n - self.before[:, -1]
        self.inflated: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def _part(self, k: int, size: int) -> bytes:
        return pa.decompress(self.data[self.ends[k] : self.ends[k + 1]], size, "zstd", asbytes=True) if size else b""

    def lengths(self) -> np.ndarray:
        """Ids of each document."""
        return np.frombuffer(self._part(0, 4 * self.docs), "<u4").astype(np.int64)

    def _chunk(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The directory and the bits of a chunk."""
        if (level, k) not in self.inflated:
            held = self._part(1 + level * self.chunks + k, _DIRECTORY + _BITS)
            self.inflated[level, k] = np.frombuffer(held, "<u4", _DIRECTORY // 4), np.frombuffer(held, np.uint8, _BITS, _DIRECTORY)
        return self.inflated[level, k]

    def ids(self) -> np.ndarray:
        """All ids, plane by plane from the last."""
        out = np.zeros(self.n, np.uint16 if self.width <= 16 else np.uint32)
        whole = np.empty_like(out)
        for k in range(self.width):
            level = self.width - 1 - k
            parts = [np.frombuffer(self._part(1 + level * self.chunks + c, _DIRECTORY + _BITS), np.uint8, _BITS, _DIRECTORY) for c in range(self.chunks)]
            bit = np.unpackbits(np.concatenate(parts), count=self.n).view(bool) if parts else np.empty(0, bool)
            zeros = int(self.zeros[level])
            whole[np.flatnonzero(~bit)] = out[:zeros]
            whole[np.flatnonzero(bit)] = out[zeros:] | out.dtype.type(1 << k)
            out, whole = whole, out
        return out

    def _bit(self, level: int, at: int) -> int:
        bits = self._chunk(level, at // CHUNK)[1]
        at %= CHUNK
        return int(bits[at >> 3]) >> (7 - (at & 7)) & 1

    def _ones(self, level: int, at: int) -> int:
        """Ones of a plane before a place."""
        if at >= self.n:
            return int(self.before[level, -1])
        directory, bits = self._chunk(level, at // CHUNK)
        inside = at % CHUNK
        block = inside // _BLOCK
        found = np.unpackbits(bits[block * _BLOCK // 8 : (inside + 7) // 8], count=inside - block * _BLOCK)
        return int(self.before[level, at // CHUNK]) + int(directory[block]) + int(np.count_nonzero(found))

    def access(self, at: int) -> int:
        """The id at a place."""
        value = 0
        for level in range(self.width):
            bit = self._bit(level, at)
            value = value << 1 | bit
            at = int(self.zeros[level]) + self._ones(level, at) if bit else at - self._ones(level, at)
        return value

    def _range(self, value: int, stop: int) -> tuple[int, int]:
        start = 0
        for level in range(self.width):
            if value >> (self.width - 1 - level) & 1:
                start, stop = (int(self.zeros[level]) + self._ones(level, x) for x in (start, stop))
            else:
                start, stop = (x - self._ones(level, x) for x in (start, stop))
        return start, stop

    def rank(self, value: int, stop: int | None = None) -> int:
        """How often an id occurs before a place (by default, in all)."""
        if value >> self.width or not self.n:
            return 0
        start, stop = self._range(value, self.n if stop is None else stop)
        return stop - start

    def _select_bits(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (ascending, from 0) zeros or ones of a plane, chunk by chunk."""
        count = self.before[level] if bit else np.minimum(np.arange(self.chunks + 1) * CHUNK, self.n) - self.before[level]
        chunk = np.searchsorted(count, k, side="right") - 1
        out = np.empty(len(k), np.int64)
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(k)]):
            c = int(chunk[a])
            directory, bits = self._chunk(level, c)
            ranks = k[a:b] - count[c]
            held = directory if bit else np.arange(len(directory)) * _BLOCK - directory
            block = np.searchsorted(held, ranks, side="right") - 1
            low, high = int(block[0]), int(block[-1]) + 1
            found = np.flatnonzero(np.unpackbits(bits[low * _BLOCK // 8 : high * _BLOCK // 8]) == bit)
            out[a:b] = c * CHUNK + low * _BLOCK + found[ranks - int(held[low])]
        return out

    def places(self, value: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """Places of the occurrences number ``first`` (from 0) up to ``last`` of an id, ascending; by default, of all."""
        n = self.rank(value)
        at = np.arange(first, n if last is None else min(last, n))
        if not len(at):
            return at
        at += self._range(value, self.n)[0]
        for level in range(self.width - 1, -1, -1):
            bit = value >> (self.width - 1 - level) & 1
            at = self._select_bits(level, bit, at - self.zeros[level] if bit else at)
        return at

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of an id."""
        if not 0 <= k < self.rank(value):
            raise IndexError(f"no occurrence {k} of {value}")
        return int(self.places(value, k, k + 1)[0])


def write_shards(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = 0, partitions: int | None = None, shard_ids: int = SHARD_IDS) -> None:
    """Write the ids of every whole text, with ``end_id`` after each document, in ascending doc_id order to ``path``.

    Parquet with a row for each shard: ``part, shard, n_ids, doc_ids, file`` (the matrix as bytes). Documents are
    range-partitioned by doc_id and sorted before they are encoded, so only texts are exchanged; a task writes its
    shards one after another, and Spark's writer makes them appear once, whatever executors are lost. A null text is the
    end id alone; null doc_ids come first; repeated rows are documents of their own, in any order among themselves.
    """
    vocabulary = vocabulary or default_vocabulary()
    parts = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text").repartitionByRange(parts, F.col("doc_id")).sortWithinPartitions("doc_id")
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("n_ids", T.LongType()), T.StructField("doc_ids", T.ArrayType(docs.schema["doc_id"].dataType)), T.StructField("file", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[pa.Array] = []
        held: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        size = shard = 0

        def made() -> pa.RecordBatch:
            joined = pa.concat_arrays(keys)
            data = build(np.concatenate(held), np.concatenate(lengths))
            return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([size]), pa.ListArray.from_arrays(pa.array([0, len(joined)], pa.int32()), joined), pa.array([data], pa.binary())], schema.names)

        for batch, ids, ends in encoded_batches(batches, vocabulary, end_id, 2 * STEP_BYTES):
            a = 0
            while a < batch.num_rows:
                b = int(np.searchsorted(ends, ends[a] + shard_ids - size, side="right")) - 1
                if b <= a:
                    if held:
                        yield made()
                        keys, held, lengths, size, shard = [], [], [], 0, shard + 1
                        continue
                    b = a + 1  # a document longer than a shard
                keys.append(batch.column("doc_id").slice(a, b - a))
                held.append(ids[ends[a] : ends[b]])
                lengths.append(np.diff(ends[a : b + 1]))
                size += int(ends[b] - ends[a])
                a = b
        if held:
            yield made()

    ordered.mapInArrow(run, schema).withColumn("part", F.spark_partition_id()).write.mode("overwrite").parquet(path)


def read_shards(spark, path: str) -> DataFrame:
    """The shards with ``first``: how many ids stand in all shards before.

    Sums in two levels: inside groups of shards, and over the groups' totals.
    """
    shards = spark.read.parquet(path)
    sizes = shards.select("part", "shard", "n_ids").withColumn("block", F.floor(F.col("part") / GROUP))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = sizes.groupBy("block").agg(F.sum("n_ids").alias("held")).select("block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("block").orderBy("part", "shard").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).join(blocks, "block")
    first = first.select("part", "shard", (F.col("inside") + F.col("earlier")).alias("first"))
    few = sizes.count() <= BROADCAST_SHARDS
    return shards.join(F.broadcast(first) if few else first, ["part", "shard"])


def stored_documents(spark, path: str) -> DataFrame:
    """Each document from the files: ``doc_id, start`` (ids of all documents before it), ``ids`` (little-endian unsigned
    32-bit, as binary)."""
    shards = read_shards(spark, path)
    kind = shards.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("start", T.LongType()), T.StructField("ids", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(whole.num_rows):
                batch = whole.slice(row, 1)
                matrix = WaveletMatrix(batch.column("file")[0].as_py())
                ends = np.concatenate([[0], np.cumsum(matrix.lengths())])
                starts = ends[:-1] + batch.column("first")[0].as_py()
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids").flatten(), pa.array(starts, pa.int64()), id_column(matrix.ids().astype("<u4"), ends)], ["doc_id", "start", "ids"])

    return shards.select("first", "doc_ids", "file").mapInArrow(run, schema)


def occurrences(spark, path: str, value: int) -> DataFrame:
    """``doc_id, place`` (in the document) of every occurrence of an id, by select in each shard: only the chunks
    that hold it are inflated."""
    shards = read_shards(spark, path)
    kind = shards.schema["doc_ids"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for row in range(whole.num_rows):
                batch = whole.slice(row, 1)
                matrix = WaveletMatrix(batch.column("file")[0].as_py())
                at, lengths = matrix.places(value), matrix.lengths()
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, at, side="right")
                yield pa.RecordBatch.from_arrays([batch.column("doc_ids").flatten().take(pa.array(doc)), pa.array(at - (ends - lengths)[doc])], ["doc_id", "place"])

    return shards.select("doc_ids", "file").mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("place", T.LongType())]))


def token_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = 0, path: str | None = None) -> DataFrame:
    """Write ``docs`` as shards (by default into the shared checkpoint folder) and read the documents back."""
    spark = docs.sparkSession
    if path is None:
        path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_shards(docs, path, vocabulary, end_id)
    return stored_documents(spark, path)


def document_digests(stored: DataFrame) -> DataFrame:
    return stored.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
