"""Sums over the zones near lines, without a row for each pair.

Lines and small zones are dealt to cells, which are the keys of a cogroup. In a task the zones of a cell are halved again and
again by their boxes: a line takes the sums of a part whose zones are all within reach for sure, drops a part of which none
can be, and meets single zones only at the rim. So what is shuffled and stored grows with lines and zones, not with pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.operators.spatial import _cell, _crowded, area_weighted_neighbours, cover

#: Edges of a zone that a row holds at most; zones of more, and zones that are wide for the reach, are joined edge by edge.
SIDES = 16
#: Zones wider than this many times the reach are wide. A start in a narrower one has an edge within reach.
WIDE = 1.9
#: Pieces and zones of a cell, at least, from which the cell is cut into blocks of so many.
CROWD = 500_000, 50_000
#: Zones that are met one by one, and numbers that a step of this holds at most.
LEAF, STEP = 24, 1 << 18
_ENDS = ("x0", "y0", "x1", "y1")


def areas_within(pieces: DataFrame, zones: DataFrame, edges: DataFrame, reach: float, category: str, line_id: str = "lid", zone_id: str = "zone_id", crowd: tuple[int, int] = CROWD) -> DataFrame:
    """``lid, category, area, n``: summed area and number of the zones of a category that come within reach of a line.

    Zones are those of ``area_weighted_neighbours``, each once a line: wide ones, those of many edges and those whose edges
    are no closed rings go through it, all others through cells. Lines and zones of a crowded cell are dealt to blocks by
    their ids, and a block meets each of the other side's, so that a task's share is bounded however crowded a cell is. A
    line or category may come in several rows.
    """
    shape = edges.where(F.col(zone_id).isNotNull()).groupBy(zone_id).agg(
        F.count("*").alias("n"), F.count_if(_known()).alias("known"), F.sum(F.hash("x0", "y0").cast("long") - F.hash("x1", "y1")).alias("open"),
        *((F.max(F.greatest(f"{c}0", f"{c}1")) - F.min(F.least(f"{c}0", f"{c}1"))).alias(f"wide_{c}") for c in "xy"),
    )
    small = F.coalesce((F.col("n") <= SIDES) & (F.col("known") == F.col("n")) & (F.col("open") == 0) & (F.greatest("wide_x", "wide_y") <= WIDE * reach), F.lit(False))
    size = max(8 * reach, 1.0)
    middle = lambda c: (F.min(F.least(f"{c}0", f"{c}1")) + F.max(F.greatest(f"{c}0", f"{c}1"))) / 2
    sides = F.flatten(F.collect_list(F.array(*_ENDS))).alias("__sides")
    held = edges.join(shape.where(small).select(zone_id).hint("merge"), zone_id, "left_semi").groupBy(zone_id).agg(sides, middle("x").alias("mx"), middle("y").alias("my"))
    held = held.join(zones.select(zone_id, F.col(category).alias("__kind"), F.col("area").cast("double").alias("__area")).hint("merge"), zone_id)
    held = held.select(zone_id, "__sides", "__kind", "__area", _cell(F.col("mx"), size).alias("cx"), _cell(F.col("my"), size).alias("cy"))
    met = cover(pieces.where(_known()).select(line_id, *_ENDS), reach * (1 + 0.7072 * WIDE), size)
    hot = [_crowded(rows, most).select("cx", "cy", F.ceil(F.col("n") / most).cast("int").alias(f"__n{k}")) for k, (rows, most) in enumerate(zip((met, held), crowd))]
    for k, key in enumerate((line_id, zone_id)):
        rows = (met, held)[k].join(F.broadcast(hot[0]), ["cx", "cy"], "left").join(F.broadcast(hot[1]), ["cx", "cy"], "left")
        n = [F.coalesce(f"__n{i}", F.lit(1)) for i in (0, 1)]
        rows = rows.withColumn(f"__b{k}", F.pmod(F.xxhash64(key), n[k]).cast("int")).withColumn(f"__b{1 - k}", F.explode(F.sequence(F.lit(0), n[1 - k] - 1)))
        met, held = (rows.drop("__n0", "__n1"), held) if k == 0 else (met, rows.drop("__n0", "__n1", zone_id))
    schema = T.StructType([pieces.schema[line_id], T.StructField(category, zones.schema[category].dataType), T.StructField("area", T.DoubleType()), T.StructField("n", T.LongType())])

    def run(lines: pa.Table, near: pa.Table) -> pa.Table:
        if not (lines.num_rows and near.num_rows):
            return pa.Table.from_arrays([pa.array([], lines.schema.field(line_id).type), pa.array([], near.schema.field("__kind").type), pa.array([], pa.float64()), pa.array([], pa.int64())], schema.names)
        (ids, line), (kinds, kind) = (_coded(x) for x in (lines.column(line_id), near.column("__kind")))
        order = np.argsort(line, kind="stable")
        ends = np.column_stack([lines.column(c).to_numpy() for c in _ENDS])[order]
        area = near.column("__area").to_numpy()
        null = near.column("__area").is_null().to_numpy()
        flat = near.column("__sides").combine_chunks()
        sums = _Sums(len(ids), len(kinds), kind, np.where(null, 0.0, area), ~null)
        _meet(ends, line[order], _padded(flat.flatten().to_numpy(), np.diff(flat.offsets.to_numpy())), reach, sums)
        i, k = np.nonzero(sums.count)
        total = pa.array(sums.area[i, k], mask=sums.valued[i, k] == 0)
        return pa.Table.from_arrays([ids.take(pa.array(i)), kinds.take(pa.array(k)), total, pa.array(sums.count[i, k])], schema.names)

    keys = ["cx", "cy", "__b0", "__b1"]
    found = met.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, schema)
    rest = shape.where(~small).select(zone_id)
    if rest.isEmpty():
        return found
    pairs = area_weighted_neighbours(pieces, zones.join(rest.hint("merge"), zone_id, "left_semi"), edges.join(rest.hint("merge"), zone_id, "left_semi"), reach, category, line_id, zone_id)
    return found.unionByName(pairs.groupBy(line_id, category).agg(F.sum("area").cast("double").alias("area"), F.count("*").alias("n")))


def _known():
    """Whether all ends of a piece are numbers."""
    known = F.lit(True)
    for c in _ENDS:
        known = known & F.coalesce(F.abs(c) < 1e15, F.lit(False))
    return known


def _coded(column: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The distinct values of a column, null among them, and the place of each row's value in these."""
    coded = pc.dictionary_encode(column.combine_chunks(), null_encoding="encode")
    return coded.dictionary, coded.indices.to_numpy()


def _padded(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """zones x edges x 4 ends, NaN where a zone has fewer edges than another; ``sizes`` are the numbers of a zone's ends."""
    sizes = sizes // 4
    out = np.full((len(sizes), int(sizes.max()), 4), np.nan)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat.reshape(-1, 4)
    return out


class _Sums:
    """count, area and number of known areas, lines x kinds, of the zones that were added."""

    def __init__(self, lines: int, kinds: int, kind: np.ndarray, area: np.ndarray, known: np.ndarray):
        self.kind, self.own, self.known = kind, area, known
        self.count, self.valued = np.zeros((lines, kinds), np.int64), np.zeros((lines, kinds), np.int64)
        self.area = np.zeros((lines, kinds))

    def add_all(self, lines: np.ndarray, zones: np.ndarray) -> None:
        """All of ``zones`` to each of ``lines`` (each once)."""
        n = self.count.shape[1]
        self.count[lines] += np.bincount(self.kind[zones], minlength=n)
        self.valued[lines] += np.bincount(self.kind[zones], self.known[zones], n).astype(np.int64)
        self.area[lines] += np.bincount(self.kind[zones], self.own[zones], n)

    def add_pairs(self, lines: np.ndarray, zones: np.ndarray) -> None:
        at = lines.astype(np.int64) * self.count.shape[1] + self.kind[zones]
        np.add.at(self.count.reshape(-1), at, 1)
        np.add.at(self.valued.reshape(-1), at, self.known[zones].astype(np.int64))
        np.add.at(self.area.reshape(-1), at, self.own[zones])


def _meet(ends: np.ndarray, line: np.ndarray, sides: np.ndarray, reach: float, sums: _Sums) -> None:
    """Add to ``sums`` each zone (``sides``: zones x edges x 4) to each line (``ends``: pieces x 4, by line) within reach."""
    ends = np.ascontiguousarray(ends.T)
    low, high = np.minimum(ends[:2], ends[2:]), np.maximum(ends[:2], ends[2:])
    box = np.column_stack([f(sides[:, :, [c, c + 2]], axis=(1, 2)) for f in (np.nanmin, np.nanmax) for c in (0, 1)])
    corners = _corners(sides[:, :, 0], sides[:, :, 1])
    far = reach * reach * (1 + 1e-9) + 1e-6
    several, taken = len(line) > sums.count.shape[0], np.zeros(sums.count.shape[0], bool)
    todo = [(np.arange(len(sides)), np.arange(len(line)))]
    while todo:
        zs, ps = todo.pop()
        own = box[zs]
        first, last = own[:, :2].min(0), own[:, 2:].max(0)
        off = [np.maximum(np.maximum(low[c][ps] - last[c], first[c] - high[c][ps]), 0.0) for c in (0, 1)]
        ps = ps[off[0] * off[0] + off[1] * off[1] <= far]
        if not len(ps):
            continue
        if len(zs) > 1:
            half = float(np.hypot(*(last - first))) / 2
            at = ends[:, ps]
            near = _point_d2(*((first + last) / 2), *at) <= (reach + half) ** 2 * (1 + 1e-9) + 1e-6
            sure = np.zeros(len(ps), bool)
            for x, y in corners:
                (x0, x1), (y0, y1) = ((v.min(), v.max()) for v in (x[zs], y[zs]))
                half = float(np.hypot(x1 - x0, y1 - y0)) / 2
                if half < reach:
                    sure |= _point_d2((x0 + x1) / 2, (y0 + y1) / 2, *at) <= (reach - half) ** 2 * (1 - 1e-9) - 1e-6
            if sure.any():
                whole = np.unique(line[ps[sure]])
                sums.add_all(whole, zs)
                taken[whole] = True
                near &= ~taken[line[ps]]
                taken[whole] = False
            ps = ps[near]
        if len(zs) > LEAF:
            if len(ps):
                order = zs[np.argsort(own[:, int(np.argmax(own.max(0) - own.min(0)))], kind="stable")]
                todo += [(part, ps) for part in np.array_split(order, 2)]
            continue
        hits = []
        for k in range(0, len(ps), STEP // len(zs)):
            part = ps[k : k + STEP // len(zs)]
            off = [np.maximum(np.maximum(low[c][part][:, None] - box[zs, 2 + c], box[zs, c] - high[c][part][:, None]), 0.0) for c in (0, 1)]
            i, j = np.nonzero(off[0] * off[0] + off[1] * off[1] <= far)
            most = max(STEP // sides.shape[1], 1)
            for s in range(0, len(i), most):
                p, z = part[i[s : s + most]], zs[j[s : s + most]]
                held = _within(ends[:, p], sides[z], reach)
                hits.append((line[p[held]].astype(np.int64), z[held]))
        if hits:
            at, z = (np.concatenate(x) for x in zip(*hits))
            if several:  # a zone near several pieces of a line is one
                at, z = np.divmod(np.unique(at * len(sides) + z), len(sides))
            sums.add_pairs(at, z)


def _corners(x: np.ndarray, y: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Four corners of each zone (zones x corners): the outermost to the west, east, south and north; of a rectangle all."""
    out = []
    for a, b, least in ((x, y, True), (x, y, False), (y, x, True), (y, x, False)):
        edge = (np.nanmin if least else np.nanmax)(a, axis=1)
        along = np.where(a == edge[:, None], b, np.nan)
        end = (np.nanmin if least == (a is x) else np.nanmax)(along, axis=1)
        out.append((edge, end) if a is x else (end, edge))
    return out


def _point_d2(px, py, x0, y0, x1, y1):
    """Squared distances of points from pieces, by the arithmetic of ``geometry.point_piece_d2``."""
    dx, dy, ax, ay = x1 - x0, y1 - y0, px - x0, py - y0
    size, dot, cross = dx * dx + dy * dy, ax * dx + ay * dy, ax * dy - ay * dx
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(dot <= 0, ax * ax + ay * ay, np.where(dot >= size, (px - x1) * (px - x1) + (py - y1) * (py - y1), cross * cross / size))


def _within(a: np.ndarray, sides: np.ndarray, reach: float) -> np.ndarray:
    """Whether pieces (4 x pairs) have an edge of their zone (pairs x edges x 4) within reach, as ``geometry.piece_piece_d2``."""
    a = a[:, :, None]
    b = np.moveaxis(sides, 2, 0)
    most = reach * reach
    held = (_point_d2(b[0], b[1], *a) <= most).any(1)
    rest = np.flatnonzero(~held)
    a, b = a[:, rest], b[:, rest]
    close = _point_d2(b[2], b[3], *a) <= most
    for k in (0, 2):
        close |= _point_d2(a[k], a[k + 1], *b) <= most
    side = lambda x0, y0, x1, y1, x, y: np.sign((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0))
    cross = (side(*a, b[0], b[1]) * side(*a, b[2], b[3]) <= 0) & (side(*b, a[0], a[1]) * side(*b, a[2], a[3]) <= 0)
    for c in (0, 1):
        cross &= (np.minimum(a[c], a[c + 2]) <= np.maximum(b[c], b[c + 2])) & (np.minimum(b[c], b[c + 2]) <= np.maximum(a[c], a[c + 2]))
    held[rest] = (close | cross).any(1)
    return held
