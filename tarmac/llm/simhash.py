"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link if they differ in ``reach`` bits or fewer. The bits are grouped into m partitions, the
correlated ones together. If thresholds T_i (-1: not probed) of the partitions sum to reach - m + 1, then any two linked
fingerprints differ in at most T_i bits in some partition i. Each fingerprint gets thresholds of its own by dynamic
programming on estimated candidate counts, so that it does not probe where it is one of many.

Texts that share 0.8 of their shingles differ in some 10 of 64 bits, and often in 17, a distance at which any partition
is met by a large share of all texts. ``similar_documents`` therefore uses wide fingerprints: shingles are drawn min-wise,
correlated draws are grouped to VIEWS partitions of SAMPLE draws, and a partition is the SimHash of its shingles. The bits of
a partition change together or not at all, so the distance of two wide fingerprints is the number of partitions in which they
differ, and a partition is probed for equality (threshold 0) or not (-1). The thresholds are again each fingerprint's own, by
the same dynamic programming, and sum to reach - m + 1 for a reach of VIEWS - SHARED partitions; pairs that meet are verified
by their exact shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import cut_lineage, raw_bytes, steps, text_column
from tarmac.llm.shingles import scramble, shingle_sets
from tarmac.operators.graph import connected_components

BITS = 64
#: Cells of the histogram of a partition's values, which is broadcast: a bound that the data don't move.
CELLS = 1 << 16
#: Members of a bucket that are compared pair by pair at most; larger ones are linked through centres.
PAIRS_UP_TO = 64
#: Partitions of a wide fingerprint, shingles drawn for each, and partitions that similar texts must share to be met for sure.
#: Texts of similarity s share each with a chance of s ** SAMPLE, and SHARED of them or more with one of 0.999 at 0.8.
VIEWS, SAMPLE, SHARED = 17, 3, 3
DRAWS = VIEWS * SAMPLE
#: Cells of the histogram of a wide fingerprint's partition: a bound as CELLS, smaller as there are more partitions.
WIDE_CELLS = 1 << 13
#: Members of a bucket of wide fingerprints that are verified pair by pair at most, and those of a bucket of later rounds,
#: of which only pairs count that are not joined yet.
SIMILAR_PAIRS_UP_TO, FURTHER_PAIRS_UP_TO = 32, 256
#: Bits that stand for the shingles of a node where pairs are told apart before their shingles are fetched.
SKETCH = 512
_DRAW = np.random.default_rng(8)
_DRAW_XOR, _DRAW_ODD = (_DRAW.integers(0, 1 << 32, DRAWS, np.uint32) for _ in range(2))
_DRAW_BASE = np.arange(DRAWS, dtype=np.uint64) << np.uint64(32)
_SCATTER = np.uint64(0x9E3779B97F4A7C15)


def fingerprint(text: bytes, width: int = 3) -> int:
    """Bit i is 1 if it is set in over half of the XXH64 (seed 42) of the runs of ``width`` words, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    runs = zip(*(words[k:] for k in range(width))) if len(words) >= width else [words]
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(x), 42) for x in runs), "<u8")
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 8192):
        counts += np.unpackbits(h[k : k + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys`` and ``fp`` (as a signed long) of every whole text; null and empty texts have 0."""
    schema = T.StructType([*(T.StructField(x, docs.schema[x].dataType) for x in keys), T.StructField("fp", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                made = [fingerprint(x, width) for x in text_column(batch).cast(pa.large_binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keys), pa.array(np.array(made, np.uint64).view(np.int64))], [*keys, "fp"])

    return docs.select(*keys, "text").mapInArrow(run, schema)


def correlation(prints: DataFrame) -> np.ndarray:
    """The correlation of each two bits over all of ``prints`` (fp), from counts added up by Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS + 1, BITS + 1)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(fp), 8192):
                bits = np.unpackbits(fp[k : k + 8192].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)
                bits = np.column_stack([bits, np.ones(len(bits))])
                total += bits.T @ bits
        i, j = np.indices(total.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], ["i", "j", "both"])

    sums = prints.select("fp").mapInArrow(run, "i int, j int, both double").groupBy("i", "j").agg(F.sum("both").alias("both")).toArrow().to_pydict()
    both = np.zeros((BITS + 1, BITS + 1))
    both[sums["i"], sums["j"]] = sums["both"]
    n = max(both[BITS, BITS], 1)
    p = both[:BITS, BITS] / n
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    return np.abs(both[:BITS, :BITS] / n - np.outer(p, p)) / np.outer(spread, spread)


def group_bits(related: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in ``parts`` groups of nearly equal width: each takes the free bit most related to those that it has."""
    free, groups = set(range(len(related))), []
    related = related - np.diag(np.diag(related))
    for k in range(parts):
        size = len(free) // (parts - k)
        order = sorted(free)
        group = [order[int(related[np.ix_(order, order)].max(1).argmax())]]
        while len(group) < size:
            rest = sorted(free.difference(group))
            group.append(rest[int(related[np.ix_(rest, group)].sum(1).argmax())])
        groups.append(sorted(group))
        free.difference_update(group)
    return groups


def choose_parts(n: int, reach: int) -> int:
    """The number of partitions that makes probes and expected candidates fewest for n random fingerprints."""

    def cost(m: int) -> float:
        width, left = BITS / m, reach - m + 1
        probes = m if left <= 0 else m - left + left * (1 + width)
        return probes * (1 + n / 2.0**width)

    return min(range(2, reach + 2), key=cost)


def allocate(costs: np.ndarray, reach: int) -> np.ndarray:
    """For each row the thresholds of least total cost that sum to reach - m + 1.

    ``costs``: rows x partitions x thresholds -1, 0 and so on. Dynamic programming over partitions and the sum so far.
    """
    n, m, choices = costs.shape
    best = {0: np.zeros(n)}
    came: list[dict[int, np.ndarray]] = []
    for i in range(m):
        new: dict[int, np.ndarray] = {}
        how: dict[int, np.ndarray] = {}
        for total, cost in best.items():
            for t in range(-1, choices - 1):
                value, key = cost + costs[:, i, t + 1], total + t
                if key not in new:
                    new[key], how[key] = value.copy(), np.full(n, t)
                else:
                    less = value < new[key]
                    new[key][less], how[key][less] = value[less], t
        best = new
        came.append(how)
    at, out = np.full(n, reach - m + 1), np.empty((n, m), np.int64)
    for i in range(m - 1, -1, -1):
        for key, how in came[i].items():
            own = at == key
            out[own, i] = how[own]
        at = at - out[:, i]
    return out


def _masks(groups: list[list[int]]) -> np.ndarray:
    return np.array([sum(1 << b for b in g) for g in groups], np.uint64)


def _cells(values: np.ndarray, cells: int = CELLS) -> np.ndarray:
    return ((values * _SCATTER) >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def _histogram(table: DataFrame, values: Callable[[pa.RecordBatch], np.ndarray], parts: int, cells: int) -> np.ndarray:
    """parts x cells: how many rows of ``table`` have a value in the cell; ``values`` gives those of a batch, rows x parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = values(batch)
            for i in range(parts):
                cell, count = np.unique(_cells(own[:, i], cells), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), i, np.int32)), pa.array(cell), pa.array(count)], ["part", "cell", "n"])

    seen = table.mapInArrow(run, "part int, cell long, n long").groupBy("part", "cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros((parts, cells))
    out[seen.column("part").to_numpy(), seen.column("cell").to_numpy()] = seen.column("n").to_numpy()
    return out


def link_fingerprints(prints: DataFrame, reach: int = 2) -> DataFrame:
    """``src, dst``: links between distinct fingerprints (``prints.fp``, each once) that connect all that link.

    A bucket holds the fingerprints that agree in a partition, and visitors that differ there in one bit and probe it.
    Buckets of up to PAIRS_UP_TO are compared pair by pair, and pairs verified. In larger ones, members are written to
    the points one bit away, visitors to the one point that they see: whatever meets at a point differs in two bits at
    most, and all that link there meet at one. So a bucket of k costs 65 k rows, not k squared, and no link is lost.
    """
    if reach != 2:
        raise ValueError("centres link at two bits; other distances are not supported")
    n = prints.count()
    groups = group_bits(correlation(prints), choose_parts(n, reach))
    masks = _masks(groups)
    flips = [np.array([1 << b for b in g], np.uint64) for g in groups]
    histogram = _histogram(prints.select("fp"), lambda batch: batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)[:, None] & masks, len(masks), CELLS)
    sent = prints.sparkSession.sparkContext.broadcast(histogram)

    def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sent.value
        for whole in batches:
            for start in range(0, whole.num_rows, 8192):
                fp = whole.column("fp").slice(start, 8192).to_numpy(zero_copy_only=False).view(np.uint64)
                costs = np.zeros((len(fp), len(masks), 3))
                for i, mask in enumerate(masks):
                    own = fp & mask
                    costs[:, i, 1] = 1 + seen[i][_cells(own)]
                    costs[:, i, 2] = 1 + len(flips[i]) + seen[i][_cells(own)] + sum(seen[i][_cells(own ^ f)] for f in flips[i])
                limits = allocate(costs, reach)
                for i, mask in enumerate(masks):
                    own = fp & mask
                    yield _visits(i, own, fp, 0, limits[:, i] >= 0)
                    far = limits[:, i] >= 1
                    for f in flips[i]:
                        if far.any():
                            yield _visits(i, own[far] ^ f, fp[far], 1, np.ones(far.sum(), bool))

    rows = cut_lineage(prints.select("fp").mapInArrow(visits, "part int, value long, fp long, away int, probes boolean"))
    sizes = rows.groupBy("part", "value").agg(F.count("*").alias("n"), F.max("probes").alias("any")).where("n > 1 and any")
    small = rows.join(sizes.where(F.col("n") <= PAIRS_UP_TO).select("part", "value"), ["part", "value"], "left_semi")
    a, b = small.alias("a"), small.alias("b")
    met = (F.col("a.part") == F.col("b.part")) & (F.col("a.value") == F.col("b.value")) & (F.col("a.fp") < F.col("b.fp")) & (F.col("a.away") + F.col("b.away") < 2) & (F.col("a.probes") | F.col("b.probes"))
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= reach
    pairs = a.join(b, met & near).select(F.col("a.fp").alias("src"), F.col("b.fp").alias("dst"))
    large = rows.join(sizes.where(F.col("n") > PAIRS_UP_TO).select("part", "value"), ["part", "value"], "left_semi")

    def centres(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, value, fp, away = (batch.column(x).to_numpy(zero_copy_only=False) for x in ("part", "value", "fp", "away"))
            value, fp = value.view(np.uint64), fp.view(np.uint64)
            base = (fp & ~masks[part]) | value  # the fingerprint itself, or for a visitor the point that it sees
            yield _pairs(fp, base)
            for i in range(len(masks)):
                own = (part == i) & (away == 0)
                for f in np.concatenate([x for k, x in enumerate(flips) if k != i]):
                    yield _pairs(fp[own], base[own] ^ f)

    points = large.select("part", "value", "fp", "away").mapInArrow(centres, "fp long, centre long").distinct()
    hubs = points.groupBy("centre").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    stars = points.join(hubs, "centre").where("fp <> hub").select(F.col("hub").alias("src"), F.col("fp").alias("dst"))
    return pairs.unionByName(stars).distinct()


def _visits(part: int, value: np.ndarray, fp: np.ndarray, away: int, probes: np.ndarray) -> pa.RecordBatch:
    n = len(fp)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(value.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(np.full(n, away, np.int32)), pa.array(probes)], ["part", "value", "fp", "away", "probes"])


def _pairs(fp: np.ndarray, centre: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.array(centre.view(np.int64))], ["fp", "centre"])


def near_duplicates(docs: DataFrame, width: int = 3, reach: int = 2) -> DataFrame:
    """A row for each row of ``docs``: ``doc_id, fp, component_id`` (the least doc_id reachable over links).

    Equal fingerprints are one node, so copies cost nothing beyond a count. Null and empty texts have the fingerprint 0
    and link like any other. Repeated rows come out alike; a null doc_id is never the least unless a component has no
    other. An empty table gives no rows; other columns are left out.
    """
    return bit_groups(docs, width, reach).select("doc_id", "fp", "component_id")


def bit_groups(docs: DataFrame, width: int = 3, reach: int = 2, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, fp, component, component_id`` of each row; ``component`` tells apart groups that share a component_id."""
    prints = cut_lineage(fingerprints(docs, width, keys))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    found = connected_components(link_fingerprints(distinct, reach)).select(F.col("node").alias("fp"), "component")
    nodes = distinct.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = nodes.groupBy("component").agg(F.min("first").alias("component_id"))
    known = nodes.select("fp", "component").join(least, "component").select("fp", "component", "component_id")
    return prints.join(known, "fp").select(*keys, "fp", "component", "component_id")


def _draws(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The shingles drawn for each document (32 bits of each), documents x DRAWS: ``starts`` is where its distinct shingle
    hashes ``h`` begin."""
    low = (h >> np.uint64(32)).astype(np.uint32)
    return np.column_stack([np.minimum.reduceat((low ^ x) * (y | np.uint32(1)), starts) for x, y in zip(_DRAW_XOR, _DRAW_ODD)])


def _spread(drawn: np.ndarray) -> np.ndarray:
    """The 64 bits of each drawn shingle."""
    return scramble(drawn.astype(np.uint64) + _DRAW_BASE)


def _signs(drawn: np.ndarray) -> np.ndarray:
    """A bit of each draw side by side in 64 bits, for the correlation of draws: the bits of one draw change together."""
    return np.bitwise_or.reduce((_spread(drawn) >> np.uint64(63)) << np.arange(DRAWS, dtype=np.uint64), axis=1)


def _partitions(drawn: np.ndarray, groups: list[list[int]]) -> np.ndarray:
    """The SimHash of the shingles of each group of three draws, documents x groups: a bit is set in over half if in two."""
    bits = _spread(drawn)
    a, b, c = (bits[:, [g[k] for g in groups]] for k in range(SAMPLE))
    return (a & b) | (a & c) | (b & c)


def _wide(docs: DataFrame, keys: tuple[str, ...], width: int) -> DataFrame:
    """``keys, node`` (a digest of the set of shingles), ``signs`` and ``drawn`` (see ``_signs`` and ``_draws``; null and none
    for a text without words)."""
    schema = T.StructType([*(docs.schema[x] for x in keys), T.StructField("node", T.LongType()), T.StructField("signs", T.LongType()), T.StructField("drawn", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, d in _shingled(batches, width):
            n = batch.num_rows
            some, starts = np.unique(d, return_index=True)
            node = np.zeros(n, np.uint64)
            count = np.bincount(d, minlength=n)
            if len(h):
                node[some] = scramble(np.add.reduceat(scramble(h), starts) + count[some].astype(np.uint64))
            made = _draws(h, starts) if len(h) else np.empty((0, DRAWS), np.uint32)
            signs = np.zeros(n, np.uint64)
            signs[some] = _signs(made)
            ends = np.concatenate([[0], np.cumsum(count > 0)]) * DRAWS
            drawn = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(made.ravel().view(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in keys), pa.array(node.view(np.int64)), pa.array(signs.view(np.int64), mask=count == 0), drawn], schema.names)

    return docs.select(*keys, "text").mapInArrow(run, schema)


def probe_rows(nodes: DataFrame) -> DataFrame:
    """``view, value, node, probes``: the value of each node (node, signs, drawn) in each partition, and if it probes it.

    Draws are grouped by their correlation over all nodes, so that frequent shingles crowd few partitions and not all. A
    node probes VIEWS - SHARED + 1 partitions, those where the histogram of all nodes shows it the fewest others: any two
    that share SHARED or more partitions meet in one that the first probes, and in one that the second probes.
    """
    nodes = nodes.where("signs is not null")
    groups = group_bits(correlation(nodes.select(F.col("signs").alias("fp")))[:DRAWS, :DRAWS], VIEWS)
    table = nodes.select("node", "drawn")

    def values(batch: pa.RecordBatch) -> np.ndarray:
        return _partitions(pc.list_flatten(batch.column("drawn")).to_numpy(zero_copy_only=False).view(np.uint32).reshape(-1, DRAWS), groups)

    sent = nodes.sparkSession.sparkContext.broadcast(_histogram(table, values, VIEWS, WIDE_CELLS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, views = sent.value, np.arange(VIEWS, dtype=np.int32)
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                own = values(batch)
                costs = np.zeros((len(own), VIEWS, 2))
                costs[:, :, 1] = 1 + seen[views, _cells(own, WIDE_CELLS)]
                probes = allocate(costs, VIEWS - SHARED) >= 0
                node = batch.column("node").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(views, len(own))), pa.array(own.ravel().view(np.int64)), pa.array(np.repeat(node, VIEWS)), pa.array(probes.ravel())], ["view", "value", "node", "probes"])

    return table.mapInArrow(run, "view int, value long, node long, probes boolean")


def _shingled(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of few texts with the hashes of their distinct shingles and the document of each."""
    for whole in batches:
        texts = text_column(whole)
        for a, b in steps(np.asarray(pc.binary_length(texts), np.int64)):
            yield whole.slice(a, b - a), *shingle_sets(*raw_bytes(texts.slice(a, b - a)), width)


def _shingle_arrays(docs: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` (32 bits of each hash, by which shingles of two texts are told apart) of ``docs`` (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, h, d in _shingled(batches, width):
            ends = np.concatenate([[0], np.cumsum(np.bincount(d, minlength=batch.num_rows))])
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((h >> np.uint64(32)).astype(np.uint32).view(np.int32)))], ["node", "shingles"])

    return docs.select("node", "text").mapInArrow(run, "node long, shingles array<int>").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, share: float) -> DataFrame:
    """The pairs (src, dst) whose shingle sets have a similarity (shared over all distinct) of ``share`` or more."""
    of = lambda side, name: sets.select(F.col("node").alias(side), F.col("shingles").alias(name))
    held = pairs.join(of("dst", "b"), "dst").join(of("src", "a"), "src")
    shared = F.size(F.array_intersect("a", "b"))
    return held.select("src", "dst", shared.alias("n"), (F.size("a") + F.size("b")).alias("both")).where(F.col("n") >= share * (F.col("both") - F.col("n")) - 1e-9).select("src", "dst")


def link_similar(rows: DataFrame, sets: Callable[[DataFrame], DataFrame], share: float, rounds: int = 3) -> DataFrame:
    """``src, dst``: verified links that connect all similar nodes that share a bucket (``rows``: view, value, node, probes)
    which one of them probes.

    Buckets that no node probes are left out. Those of up to SIMILAR_PAIRS_UP_TO nodes are verified pair by pair, as far as
    one of the two probes the bucket. In a larger one all nodes are verified against
    its leader, the node whose buckets are the most crowded (of copies of one text, mostly the text itself). Nodes that are
    not similar to the leader go on to the next round: two of them that are similar meet again in buckets by shingles that the
    leader lacks, or by those that it has (see ``_beyond_leader``), where pairs that links have joined by then are
    left out and buckets of up to FURTHER_PAIRS_UP_TO go pair by pair. A group of k copies thus costs k pairs, not k squared.
    Rounds end where the pairs of nodes that links have not joined yet are no more than FURTHER_PAIRS_UP_TO for each row of a
    bucket, or after ``rounds``; all that is left goes pair by pair then, however large a bucket is (see ``_across``), so that
    no link between two groups is lost. ``sets`` gives the shingle arrays.
    """
    sizes = rows.groupBy("view", "value").agg(F.count("*").alias("n"), F.max("probes").alias("any")).where("n > 1 and any").select("view", "value", "n")
    held = cut_lineage(rows.join(sizes, ["view", "value"]).withColumns({"open": F.lit(True), "joined": F.col("node")}))
    arrays = cut_lineage(sets(held.select("node").distinct()))  # nodes of later rounds are among these
    sketches = cut_lineage(arrays.select("node", F.size("shingles").alias("size"), _sketch("shingles").alias("bits")))
    links = None
    for k in range(rounds):
        most = FURTHER_PAIRS_UP_TO if k else SIMILAR_PAIRS_UP_TO
        small, large = held.where(F.col("n") <= most), held.where(F.col("n") > most)
        seen = small.join(sketches, "node")
        a, b = (seen.select("view", "value", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("probes", "open", "joined", "size", "bits"))) for x in ("src", "dst"))
        pairs = a.join(b, ["view", "value"]).where("src < dst and (probes_src or probes_dst) and (open_src or open_dst) and joined_src <> joined_dst").where(_may_be_similar(share)).select("src", "dst")
        crowd = large.groupBy("node").agg(F.sum("n").alias("crowd"))
        best = F.max_by(F.struct("node", "open"), F.struct("crowd", F.xxhash64("node")))
        leaders = large.join(crowd, "node").groupBy("view", "value").agg(best.alias("x")).select("view", "value", F.col("x.node").alias("leader"), F.col("x.open").alias("leads_open"))
        led = cut_lineage(large.join(leaders, ["view", "value"]).where("node <> leader").groupBy("leader", "node").agg(F.max("open").alias("open"), F.max("leads_open").alias("leads_open")))
        way = led.where("open or leads_open").select(F.least("leader", "node").alias("src"), F.greatest("leader", "node").alias("dst"))
        found = cut_lineage(_verified(pairs.unionByName(way).distinct(), arrays, share))
        links = found if links is None else links.unionByName(found)
        if led.isEmpty():
            return links
        met = found.select("src", "dst").unionByName(found.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select(F.col("src").alias("leader"), F.col("dst").alias("node"), F.lit(True).alias("met"))
        led = cut_lineage(led.join(met, ["leader", "node"], "left").withColumn("open", F.col("open") & F.col("met").isNull()).drop("met"))
        groups = connected_components(links)
        keys = _beyond_leader(led, arrays, share).join(groups, "node", "left").withColumn("joined", F.coalesce("component", "node")).drop("component")
        keys = cut_lineage(keys)
        sizes = keys.groupBy("view", "value").agg(F.count("*").alias("n"), F.max("open").alias("any"), (F.min("joined") < F.max("joined")).alias("several")).where("n > 1 and any and several")
        held = cut_lineage(keys.join(sizes.select("view", "value", "n"), ["view", "value"]))
        left = _groups(held).agg(F.sum(F.col("n") * (F.col("n") - F.col("most"))).alias("pairs"), F.sum("n").alias("rows")).first()
        if not left.rows:
            return links
        if left.pairs <= FURTHER_PAIRS_UP_TO * left.rows:
            break
    rest = cut_lineage(_verified(_across(held.join(sketches, "node"), share).distinct(), arrays, share))
    return rest if links is None else links.unionByName(rest)


def _groups(held: DataFrame) -> DataFrame:
    """``view, value, main, most, n``: the largest group (joined) of a bucket, its nodes, and those of the bucket."""
    groups = held.groupBy("view", "value", "joined").agg(F.count("*").alias("k"))
    return groups.groupBy("view", "value").agg(F.max_by("joined", F.struct("k", "joined")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("n"))


def _across(held: DataFrame, share: float) -> DataFrame:
    """``src, dst``: pairs of a bucket (view, value, node, n, open, joined, size, bits) that may be similar, of which links have
    not joined the two and one is open.

    Nodes outside the largest group of their bucket meet all of it. The bucket is dealt to blocks of FURTHER_PAIRS_UP_TO
    nodes, each a key of its own, for which these others are written again.
    """
    main = _groups(held).select("view", "value", "main")
    blocks = F.ceil(F.col("n") / FURTHER_PAIRS_UP_TO).cast("int")
    seen = held.join(main.hint("merge"), ["view", "value"]).withColumn("other", F.col("joined") != F.col("main"))
    of = lambda df, x: df.select("view", "value", "block", F.col("node").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("open", "joined", "size", "bits", "other")))
    a = of(seen.where("other").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))), "src")
    b = of(seen.withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")), "dst")
    met = a.join(b.hint("merge"), ["view", "value", "block"]).where("(not other_dst or src < dst) and (open_src or open_dst) and joined_src <> joined_dst")
    return met.where(_may_be_similar(share)).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def _sketch(shingles: str) -> F.Column:
    """SKETCH bits, 64 a number, of which each shingle sets one."""

    def number(k: int) -> F.Column:
        bit = lambda x: F.when(F.pmod(F.shiftright(x, 6), F.lit(SKETCH // 64)) == k, F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63))).otherwise(F.lit(0).cast("long"))
        return F.aggregate(shingles, F.lit(0).cast("long"), lambda held, x: held.bitwiseOR(bit(x)))

    return F.array(*map(number, range(SKETCH // 64)))


def _may_be_similar(share: float) -> F.Column:
    """True for every similar pair (size_src, bits_src, size_dst, bits_dst): similar nodes share so much of both that few
    shingles of either are missing in the other, and at least as many are as bits of the one not set in the other."""
    shared = F.ceil(share / (1 + share) * (F.col("size_src") + F.col("size_dst")) - 1e-9)
    missing = lambda a, b: sum((F.bit_count(F.col(a)[k].bitwiseAND(F.bitwise_not(F.col(b)[k]))) for k in range(SKETCH // 64)), F.lit(0))
    return (missing("bits_src", "bits_dst") <= F.col("size_src") - shared) & (missing("bits_dst", "bits_src") <= F.col("size_dst") - shared)


def _beyond_leader(led: DataFrame, arrays: DataFrame, share: float) -> DataFrame:
    """``view, value, node, probes, open``: buckets of nodes (leader, node, open) of one leader, in one of which any two
    similar ones meet of which the leader is not similar to both.

    Similar nodes a and b share at least s times the size of either. If one of the shingles that they share is not the
    leader's, they meet by it (view 0): as they share at least s times the size of either less what that has in common with the
    leader, one is found among the first that each has beyond the leader, in one order for all, when as many are looked at as
    could be missed and one more. If the leader has all that they share, each has s times its size in common with it, and
    they meet in the same way by shingles that it has (view 1). Only leaders of which an open node is so contained get such
    buckets.
    """
    own, head = arrays.select("node", "shingles"), arrays.select(F.col("node").alias("leader"), F.col("shingles").alias("held"))
    whole = lambda df: df.join(own, "node").join(head, "leader").withColumn("need", F.ceil(share * F.size("shingles") - 1e-9).cast("int"))
    first = lambda c, least: F.slice(c, F.lit(1), F.greatest(F.size(c) - least + 1, F.lit(0)))
    met = whole(led).select("leader", "node", "open", "need", F.size("shingles").alias("n"), F.array_sort(F.array_except("shingles", "held")).alias("beyond"))
    least = F.greatest(F.col("need") - (F.col("n") - F.size("beyond")), F.lit(1))
    keys = met.select("leader", "node", "open", F.lit(0).alias("view"), F.explode(first(F.col("beyond"), least)).alias("key"))
    inside = lambda df: whole(df).withColumn("inside", F.array_intersect("shingles", "held")).where(F.size("inside") >= F.col("need"))
    contain = inside(led.where("open")).select("leader").distinct()
    within = inside(led.join(contain.hint("merge"), "leader", "left_semi")).select("leader", "node", "open", F.lit(1).alias("view"), F.explode(first(F.array_sort("inside"), F.col("need"))).alias("key"))
    return keys.unionByName(within).select("view", F.xxhash64("leader", "key").alias("value"), "node", F.lit(True).alias("probes"), "open")


def similar_documents(docs: DataFrame, width: int = 5, share: float = 0.8, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keys, component, component_id`` of each row of ``docs``: groups joined by texts whose distinct shingles of
    ``width`` words (A-Z lower-cased) have a similarity of ``share`` or more; component_id is the least doc_id.

    Texts with the same set of shingles are one node. Texts of fewer words have their whole sequence as their one shingle;
    null and empty texts and those without words are one group. Candidates meet in a partition of a wide fingerprint that one
    of them probes (see VIEWS for the chance) and are verified by the exact sets of hashes. Repeated rows come out alike; a null doc_id is never
    the least unless a group has no other. An empty table gives no rows; other columns are left out.
    """
    marked = docs.withColumn("__text", F.xxhash64("text"))
    wide = cut_lineage(_wide(marked, tuple(dict.fromkeys((*keys, "doc_id", "__text"))), width))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__text"))
    nodes = cut_lineage(wide.groupBy("node").agg(one.alias("x"), *(F.first(x).alias(x) for x in ("signs", "drawn"))).select("node", "x.doc_id", F.col("x.__text").alias("row"), "signs", "drawn"))

    def sets(asked: DataFrame) -> DataFrame:
        texts = nodes.join(asked, "node", "left_semi").select("node", F.col("doc_id").alias("own"), "row")
        held = marked.select("doc_id", "text", "__text").join(texts, F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("__text") == F.col("row"))).select("node", "text")
        return _shingle_arrays(held, width)

    found = connected_components(link_similar(probe_rows(nodes), sets, share)).select("node", "component")
    joined = nodes.select("node", "doc_id").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = joined.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    known = joined.select("node", "component").join(least, "component").select("node", "component", "component_id")
    return wide.join(known, "node").select(*keys, "component", "component_id")


def one_of_each(docs: DataFrame, grouped: Callable[..., DataFrame] = similar_documents, **how) -> DataFrame:
    """``docs`` with its columns: of each group of near duplicates the row with the least (doc_id, hash of the text), once.

    ``grouped`` (``similar_documents``, or ``bit_groups`` for a distance in bits) takes ``docs`` and ``how``. Rows are told
    apart by both, so those without doc_id, or with one doc_id on several texts, are documents of their own. A null doc_id
    is never the least unless a group has no other. Null texts are one text, and a group with the other texts that have no
    words. Extra columns stay; of repeated rows that differ in them, one is kept.
    """
    own = ("__none", "__doc", "__text")
    marked = docs.withColumns({"__none": F.col("doc_id").isNull(), "__doc": F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "__text": F.xxhash64("text")})
    groups = grouped(marked, keys=("doc_id", *own), **how)
    least = groups.groupBy("component").agg(F.min(F.struct("__none", "doc_id", "__text", "__doc")).alias("x"))
    return marked.join(least.select("x.__none", "x.__doc", "x.__text"), list(own), "left_semi").dropDuplicates(list(own)).drop(*own)


def as_hex(fp: str = "fp"):
    """16 lowercase hexadecimal digits."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
