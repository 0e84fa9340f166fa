"""Product codes of vectors by Lloyd's rounds over cover trees.

Vectors become integers and are cut into parts; each part position has a codebook of its own. Each task turns blocks of
its vectors into cover trees, one a part position: the points of a node lie within its radius of the node's first point,
its children's radii are at most half of its own, and siblings' first points are further apart than that. Points are kept
in the order of the tree, so a node is a stretch of them, and running sums give the sum of any node at once.

In a round, a node whose first point is nearer to its best entry than to any other by more than twice the radius has all
its points nearest to that entry (triangle inequality), so its whole sum goes there. Other nodes are opened, and only the
points of leaves that stay in doubt are compared one by one. All sums and decisions that count are of integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.llm.common import cut_lineage

#: Vectors of a tree at most, and points of a node that is not split any more.
BLOCK, LEAF = 4096, 8
#: Components must lie within: squared distances and sums then stay within 64 bits.
LIMIT = 1 << 26

_FOREST = T.StructType([T.StructField(x, T.BinaryType()) for x in ("points", "vector", "nodes", "radius")])


def kept_rows(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``vec_id, label`` and ``vector`` of the rows whose vector is known, with known finite components alone."""
    finite = F.forall(column, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return vectors.where(F.col(column).isNotNull() & finite).select("vec_id", "label", F.col(column).alias("vector"))


def _integers(column: pa.Array, scale: int, length: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes != length).any():
        raise ValueError(f"vectors must all have {length} components")
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale)
    if len(flat) and np.abs(flat).max() >= LIMIT:
        raise ValueError(f"components times {scale} must lie within {LIMIT}")
    return flat.astype(np.int64).reshape(len(sizes), length)


class Forest:
    """Cover trees over the parts of a block of vectors, one a part position.

    ``points``: the parts in the order of the trees, an equal number for each position; ``vector``: the row of each;
    ``nodes``: first point, end, first child and number of children of each node, the roots first; ``radius``: the
    distance from a node's first point that no other of its points exceeds.
    """

    def __init__(self, points: np.ndarray, vector: np.ndarray, nodes: np.ndarray, radius: np.ndarray) -> None:
        self.points, self.vector, self.nodes, self.radius = points, vector, nodes, radius

    @classmethod
    def grown(cls, block: np.ndarray, parts: int) -> Forest:
        n = len(block)
        points = np.ascontiguousarray(block.reshape(n, parts, -1).transpose(1, 0, 2)).reshape(n * parts, -1)
        order = np.arange(n * parts)
        low, high = np.arange(parts) * n, (np.arange(parts) + 1) * n
        square = np.array([int(((points[a:b] - points[a]) ** 2).sum(1).max()) for a, b in zip(low, high)])
        nodes, squares, made = [np.column_stack([low, high, np.zeros((parts, 2), np.int64)])], [square], parts
        while True:
            open_ = (high - low > LEAF) & (square > 0)
            if not open_.any():
                break
            of = np.flatnonzero(open_)
            size = high[of] - low[of]
            place = np.repeat(low[of] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
            child, squared = cls._covered(points, order[place], np.repeat(np.arange(len(of)), size), square[of])
            # Children in order of their parents: each parent's stretch is dealt to them, each with its first point ahead.
            new = np.argsort(child, kind="stable")
            order[place] = order[place][new]
            count = np.bincount(child)
            parent = np.searchsorted(np.cumsum(size), np.cumsum(count) - 1, side="right")
            nodes[-1][of, 2] = made + np.searchsorted(parent, np.arange(len(of)))
            nodes[-1][of, 3] = np.bincount(parent, minlength=len(of))
            begin = np.concatenate([[0], np.cumsum(count)[:-1]])
            low = place[begin]
            high, square = low + count, squared
            nodes.append(np.column_stack([low, high, np.zeros((len(low), 2), np.int64)]))
            squares.append(square)
            made += len(low)
        return cls(points[order], (order % n).astype(np.int32), np.concatenate(nodes), np.sqrt(np.concatenate(squares).astype(np.float64)))

    @staticmethod
    def _covered(points: np.ndarray, item: np.ndarray, node: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The child of each point, and the squared radius of each child.

        The first point of a node that no child covers yet begins one, which takes all within half the node's radius.
        """
        taken_by, first_of, squares, rounds = np.empty(len(item), np.int64), [], [], 0
        left, made = np.arange(len(item)), 0
        while len(left):
            own = node[left]
            new = np.concatenate([[True], own[1:] != own[:-1]])
            group = np.cumsum(new) - 1
            away = ((points[item[left]] - points[item[left[new]]][group]) ** 2).sum(1)
            inside = 4 * away <= square[own]
            taken_by[left[inside]] = made + group[inside]
            widest = np.zeros(int(new.sum()), np.int64)
            np.maximum.at(widest, group[inside], away[inside])
            first_of.append(own[new])
            squares.append(widest)
            made += len(widest)
            left, rounds = left[~inside], rounds + 1
        parents, squares = np.concatenate(first_of), np.concatenate(squares)
        order = np.argsort(parents, kind="stable")
        rank = np.empty(made, np.int64)
        rank[order] = np.arange(made)
        return rank[taken_by], squares[order]

    def row(self) -> list[bytes]:
        return [self.points.astype("<i4").tobytes(), self.vector.astype("<i4").tobytes(), self.nodes.astype("<i4").tobytes(), self.radius.astype("<f8").tobytes()]

    @classmethod
    def of_row(cls, row: dict, width: int) -> Forest:
        points, vector, nodes, radius = (np.frombuffer(row[x], t) for x, t in zip(_FOREST.names, ("<i4", "<i4", "<i4", "<f8")))
        return cls(points.astype(np.int64).reshape(len(vector), width), vector, nodes.reshape(-1, 4).astype(np.int64), radius)

    def assigned(self, books: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Stretches of points as (part positions, begins, ends, entries) whose nearest entry is known; all points, once."""
        parts = len(books)
        per = len(self.points) // parts
        at = np.arange(parts)
        while len(at):
            low, high, child, count = self.nodes[at].T
            part = low // per
            apart = self._apart(low, part, books)
            best = apart.argmin(1)
            roots = np.sqrt(np.sort(apart, 1)[:, :2].astype(np.float64)) if apart.shape[1] > 1 else np.column_stack([np.zeros(len(at)), np.full(len(at), np.inf)])
            # Rounding of the roots is far below the slack; where in doubt, a node is opened.
            slack = 1e-6 * (1 + roots[:, 0])
            whole = (self.radius[at] == 0) | (roots[:, 1] - roots[:, 0] > 2 * self.radius[at] + slack)
            yield part[whole], low[whole], high[whole], best[whole]
            leaf = ~whole & (count == 0)
            size = high[leaf] - low[leaf]
            point = np.repeat(low[leaf] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if leaf.any() else np.empty(0, np.int64)
            own = point // per
            yield own, point, point + 1, self._apart(point, own, books).argmin(1)
            opened = ~whole & (count > 0)
            size = count[opened]
            at = np.repeat(child[opened] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if opened.any() else np.empty(0, np.int64)

    def _apart(self, point: np.ndarray, part: np.ndarray, books: np.ndarray) -> np.ndarray:
        return ((self.points[point][:, None, :] - books[part]) ** 2).sum(2)


def _grow(parts: int, length: int, scale: int, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for whole in batches:
            for start in range(0, whole.num_rows, block):
                piece = whole.slice(start, block)
                if count + piece.num_rows > block:
                    yield grown(held)
                    held, count = [], 0
                held.append(piece)
                count += piece.num_rows
        if count:
            yield grown(held)

    def grown(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches)
        forest = Forest.grown(_integers(table.column("vector").combine_chunks(), scale, length), parts)
        lists = [pa.ListArray.from_arrays(pa.array([0, table.num_rows], pa.int32()), table.column(x).combine_chunks()) for x in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in forest.row())], ["vec_id", "label", *_FOREST.names])

    return run


def _sums(books: np.ndarray):
    """The number and the sum of the parts nearest to each entry, over all of a task's trees."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, width + 1), np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                forest = Forest.of_row(row, width)
                upto = np.zeros((len(forest.points) + 1, width), np.int64)
                np.cumsum(forest.points, axis=0, out=upto[1:])
                for part, low, high, best in forest.assigned(books):
                    np.add.at(total, (part, best), np.column_stack([upto[high] - upto[low], high - low]))
        place = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in place), pa.array(total.ravel())], ["part", "entry", "place", "total"])

    return run


def _codes(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.select(_FOREST.names).to_pylist()):
                forest = Forest.of_row(row, books.shape[2])
                n = len(forest.points) // len(books)
                code, error = np.zeros((n, len(books)), np.uint8), np.zeros(n, np.int64)
                for part, low, high, best in forest.assigned(books):
                    size = high - low
                    point = np.repeat(low - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(size) else low
                    part, best, own = np.repeat(part, size), np.repeat(best, size), forest.vector[point]
                    code[own, part] = best
                    np.add.at(error, own, ((forest.points[point] - books[part, best]) ** 2).sum(1))
                digits = code.tobytes().hex()
                step = 2 * len(books)
                held = [batch.column(x).slice(k, 1).flatten() for x in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*held, pa.array([digits[step * i : step * (i + 1)] for i in range(n)]), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def forests(kept: DataFrame, length: int, parts: int = 8, scale: int = 4096, block: int = BLOCK) -> DataFrame:
    """The cover trees of ``kept_rows``, a row for each block of vectors, stored in the shared folder."""
    lists = [T.StructField(x, T.ArrayType(kept.schema[x].dataType)) for x in ("vec_id", "label")]
    return cut_lineage(kept.mapInArrow(_grow(parts, length, scale, block), T.StructType([*lists, *_FOREST.fields])))


def first_books(kept: DataFrame, parts: int = 8, entries: int = 16, scale: int = 4096) -> np.ndarray:
    """The parts of the vectors with the smallest ids (null last, equal ids by their components): position, entry, component."""
    rows = kept.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).toArrow()
    length = len(rows.column("vector")[0].as_py()) if rows.num_rows else 0
    if length % parts:
        raise ValueError(f"vectors cannot be cut into {parts} equal parts")
    vectors = _integers(rows.column("vector").combine_chunks(), scale, length)
    return vectors.reshape(len(vectors), parts, length // parts).transpose(1, 0, 2)


def lloyd_round(trees: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: the componentwise floor of the mean of each entry's parts; unused entries stay.

    A task sends one sum a component, however many vectors it holds; what reaches the driver has the codebooks' size.
    """
    rows = trees.mapInArrow(_sums(books), "part int, entry int, place int, total long").groupBy("part", "entry", "place").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros((*books.shape[:2], books.shape[2] + 1), np.int64)
    total[tuple(rows.column(x).to_numpy() for x in ("part", "entry", "place"))] = rows.column("total").to_numpy()
    count = total[:, :, -1:]
    return np.where(count > 0, total[:, :, :-1] // np.maximum(count, 1), books)


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode_vectors(vectors: DataFrame, column: str = "embedding", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error`` of each kept row, and the codebooks (position, entry, component).

    Rows whose vector is null or holds null, NaN or infinite components are left out. ``code``: the index of the nearest
    entry (squared distance, ties to the lower index) of each part, two hexadecimal digits each; ``error``: the squared
    distances, summed. Codebooks start as ``first_books``; with fewer kept rows they have fewer entries. vec_id and label
    may be null or repeat: every row is coded. Vectors must have one length, a multiple of ``parts``, and components
    within LIMIT after scaling; others raise an error. An empty table gives no rows; further columns are left out.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two digits: 1 to 256 entries")
    kept = kept_rows(vectors, column)
    books = first_books(kept, parts, entries, scale)
    schema = T.StructType([kept.schema["vec_id"], kept.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not books.size:
        return kept.sparkSession.createDataFrame([], schema), books
    trees = forests(kept, parts * books.shape[2], parts, scale)
    for _ in range(rounds):
        books = lloyd_round(trees, books)
    return trees.mapInArrow(_codes(books), schema), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of error over the rows of an equal label (nulls together).

    Labels with over a thousandth of the rows, a thousand at most, are broadcast; the others are joined by label.
    """
    held = cut_lineage(coded)
    totals = cut_lineage(held.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
    rows = totals.agg(F.sum("n")).first()[0] or 0
    hot = totals.where(F.col("n") * 1000 > rows)
    of = lambda t: t.select(F.col("label").alias("of"), "label_error")
    met = held.join(F.broadcast(of(hot)), F.col("label").eqNullSafe(F.col("of")), "left")
    columns = [*held.columns, "label_error"]
    others = met.where("label_error is null").drop("of", "label_error").join(of(totals.where(F.col("n") * 1000 <= rows)), F.col("label").eqNullSafe(F.col("of")))
    return met.where("label_error is not null").select(columns).unionByName(others.select(columns))
