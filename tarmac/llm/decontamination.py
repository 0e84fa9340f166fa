"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingles.

A test item of some thirty shingles inside a document of twenty thousand has a Jaccard similarity of about 0.001, at
which banded whole-document signatures find nothing. The containment form of MinHash is used: the short set alone is
sketched, by its k smallest hashes, and the sketch is looked up in the long set. Items are partitioned by size; a
partition's sketch length follows from its size bound so that a document which holds the asked share of an item holds
at least ``SPARE`` of its sketch, whatever the rest: no match is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import raw_bytes, steps, text_column
from tarmac.llm.shingles import shingle_hashes, words

_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Of a sketch, the fewest hashes that a match must hold.
SPARE = 2
#: Bytes of test items that are searched in one pass over the documents.
BLOCK_BYTES = 8 << 20


def shingle_set(text: str | None, n: int) -> set[bytes]:
    """The distinct runs of n words of a text, A-Z lower-cased and without ASCII marks.

    A text of 1 to n-1 words has its whole sequence as its one shingle; one without words has none.
    """
    found = (text or "").encode().lower().translate(None, _MARKS).split()
    if len(found) < n:
        return {b" ".join(found)} if found else set()
    return {b" ".join(found[i : i + n]) for i in range(len(found) - n + 1)}


def _few(size: int, share: float) -> int:
    """The fewest shingles that make up the share of an item."""
    return math.ceil(share * size - 1e-9)


def sketch_length(size: int, share: float) -> int:
    """Hashes in the sketch of an item: set by the upper bound of its size partition (a power of two)."""
    bound = (1 << size.bit_length()) - 1
    return min(size, bound - _few(bound, share) + SPARE)


@dataclass
class _Index:
    """A block of test items in a worker."""

    hashes: np.ndarray
    owners: list[list[int]]
    exact: list[set[bytes]]
    need: list[int]
    short: dict[bytes, list[int]]  # items that are one shingle of fewer than n words, by it
    first: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.first = np.zeros(1 << 20, bool)
        self.first[(self.hashes >> np.uint64(44)).astype(np.int64)] = True

    @classmethod
    def of(cls, texts: list[str], n: int, share: float) -> _Index:
        exact = [shingle_set(x, n) for x in texts]
        owners: dict[int, list[int]] = {}
        for i, own in enumerate(exact):
            joined = b"\n".join(own) if own else b""
            word, doc = words(np.frombuffer(joined, np.uint8), np.array([0, len(joined)]), False)
            ends = np.cumsum([0] + [x.count(b" ") + 1 for x in own])
            if not own or ends[1] < n:
                continue
            h = np.sort(shingle_hashes(word, np.repeat(np.arange(len(own)), n), n)[0])
            for x in h[: sketch_length(len(own), share)].tolist():
                owners.setdefault(x, []).append(i)
        keys = sorted(owners)
        need = [sketch_length(len(x), share) - (len(x) - _few(len(x), share)) for x in exact]
        short: dict[bytes, list[int]] = {}
        for i, own in enumerate(exact):
            for shingle in own:
                if shingle.count(b" ") < n - 1:
                    short.setdefault(shingle, []).append(i)
        return cls(np.array(keys, np.uint64), [owners[k] for k in keys], exact, need, short)

    def candidates(self, hashes: np.ndarray, doc: np.ndarray) -> Iterator[tuple[int, int]]:
        """Pairs (document, item) of which enough sketch hashes meet."""
        at = np.flatnonzero(self.first[(hashes >> np.uint64(44)).astype(np.int64)])
        place = np.searchsorted(self.hashes, hashes[at])
        hit = self.hashes[np.minimum(place, len(self.hashes) - 1)] == hashes[at] if len(self.hashes) else np.zeros(len(at), bool)
        counts: dict[tuple[int, int], int] = {}
        for d, k in set(zip(doc[at[hit]].tolist(), place[hit].tolist())):
            for i in self.owners[k]:
                counts[d, i] = counts.get((d, i), 0) + 1
        return (pair for pair, c in counts.items() if c >= self.need[pair[1]])


def contained_items(docs: DataFrame, items: DataFrame, share: float = 0.8, n: int = 5) -> DataFrame:
    """Pairs of a document and a test item of whose distinct n-word shingles it holds the given share or more.

    ``docs`` (doc_id, text) and ``items`` (item_id, text) give ``doc_id, item_id, n_shared, n_item, containment``, a row
    for each pair. Words are runs without white space, A-Z lower-cased, ASCII marks taken out. An item of fewer than n
    words has its whole sequence as its one shingle, and is held only by a document that is the same sequence. Null and
    empty texts hold nothing and are held by nothing. Repeated rows give one pair; of rows that share an id, the pair
    with the largest containment stays.

    One map over the documents for each block of items (``BLOCK_BYTES`` of text, sent to the workers); there is no
    shuffle but that of the pairs found, and no row of documents is ever exchanged.
    """
    items = items.select("item_id", "text").where(F.col("text").isNotNull())
    volume = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(2 * volume / BLOCK_BYTES))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in ("item", "n_shared", "n_item"))])
    found = None
    for block in range(blocks):
        held = items.where(F.col("block") == block).select("item_id", "text").distinct().collect()  # BLOCK_BYTES at most, by the choice of blocks
        pairs = docs.select("doc_id", "text").mapInArrow(_search(docs.sparkSession, [x.text for x in held], share, n), schema)
        names = docs.sparkSession.createDataFrame([(i, x.item_id) for i, x in enumerate(held)], T.StructType([T.StructField("item", T.LongType()), items.schema["item_id"]]))
        pairs = pairs.join(F.broadcast(names), "item").drop("item")
        found = pairs if found is None else found.unionByName(pairs)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_item")).alias("containment"), "n_shared", "n_item")).alias("x"))
    return best.select("doc_id", "item_id", "x.n_shared", "x.n_item", "x.containment")


def _search(spark, texts: list[str], share: float, n: int):
    sent = spark.sparkContext.broadcast(texts)
    built: list[_Index] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not built:
            built.append(_Index.of(sent.value, n, share))
        index = built[0]
        for whole in batches:
            texts = text_column(whole)
            keys, rows = whole.column("doc_id"), []
            for start, stop in steps(np.asarray(pc.binary_length(texts), np.int64)):
                data, offsets = raw_bytes(texts.slice(start, stop - start))
                word, doc = words(data, offsets, True)
                pairs = set(index.candidates(*shingle_hashes(word, doc, n)))
                if index.short:
                    few = np.flatnonzero(np.bincount(doc, minlength=stop - start) < n).tolist()
                    pairs |= {(d, i) for d in few for x in shingle_set(texts[start + d].as_py(), n) for i in index.short.get(x, ())}
                own: dict[int, set[bytes]] = {}
                for d, i in sorted(pairs):
                    if d not in own:
                        own = {d: shingle_set(texts[start + d].as_py(), n)}
                    size, shared = len(index.exact[i]), len(index.exact[i] & own[d])
                    if shared >= max(1, _few(size, share)):
                        rows.append((start + d, i, shared, size))
            if rows:
                at, *rest = zip(*rows)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(x, pa.int64()) for x in rest)], ["doc_id", "item", "n_shared", "n_item"])

    return run


def clean_documents(docs: DataFrame, items: DataFrame, share: float = 0.8, n: int = 5) -> DataFrame:
    """``docs`` with all its columns, without the documents that hold a test item.

    Rows are told apart by doc_id and text, so rows without doc_id are documents of their own.
    """
    rows = docs.select(F.struct("doc_id", F.xxhash64("text").alias("row")).alias("doc_id"), "text")
    caught = contained_items(rows, items, share, n).select(F.col("doc_id.doc_id").alias("caught_id"), F.col("doc_id.row").alias("caught_row")).distinct()
    return docs.join(caught, F.col("doc_id").eqNullSafe(F.col("caught_id")) & (F.xxhash64("text") == F.col("caught_row")), "left_anti")
