"""Spatial joins as equi-joins on grid cells with an exact condition.

Pieces are rows ``x0, y0, x1, y1``. The side that is searched is written to every cell that its inflated box meets, the
other side to its own cell, so that each pair meets at least once and a join never compares all with all. Cells are as
wide as the search radius; long pieces are covered in parts. A crowded cell is cut into blocks of bounded numbers of both
sides, each a key of its own. Searches for the nearest begin with a small radius where lines are dense, and widen it for
what is not settled. Searches without a radius go down a pyramid of cells.

Covered sides are joined by merge: their rows are many times those of their table, whose size the optimiser goes by, so it
would send them to every executor through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import geometry as g
from tarmac.operators.graph import checkpoint

#: Ring edges that are sent to every executor at most; larger zone tables are joined by a shuffle.
BROADCAST_EDGES = 100_000
#: Rows of a side in a cell, at least, from which the cell is cut into blocks of so many.
CROWD = 20_000
#: A level of the pyramid has cells of 2**_STEP times the width of those below.
_STEP = 3
#: Pieces in a cell, on average over pieces, up to which a search needs no smaller radius.
DENSE = 64
#: Pairs that a round compares, for each row of its covered side, up to which it needs no smaller radius.
WORTH = 8


def _cell(value: Column, size: float) -> Column:
    return F.floor(value / size).cast("long")


def with_cell(points: DataFrame, size: float, x: str = "px", y: str = "py") -> DataFrame:
    return points.withColumns({"cx": _cell(F.col(x), size), "cy": _cell(F.col(y), size)})


def cover(pieces: DataFrame, reach: Column | float, size: float) -> DataFrame:
    """Each piece in all cells that lie within ``reach`` of it; pieces longer than four cells are covered in parts.

    Cells of a part's box whose middle is farther from the piece than ``reach`` and half a diagonal are left out.
    """
    reach = reach if isinstance(reach, Column) else F.lit(float(reach))
    x0, y0, x1, y1 = (F.col(c) for c in ("x0", "y0", "x1", "y1"))
    n = F.greatest(F.ceil(F.hypot(x1 - x0, y1 - y0) / (4 * size)), F.lit(1)).cast("long")
    parts = pieces.withColumn("__n", n).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1)))
    at = lambda a, b, k: a + (b - a) * (k / F.col("__n"))
    ends = {axis: [at(a, b, F.col("__k") + d) for d in (0, 1)] for axis, a, b in (("x", x0, x1), ("y", y0, y1))}
    span = {axis: F.sequence(_cell(F.least(*v) - reach, size), _cell(F.greatest(*v) + reach, size)) for axis, v in ends.items()}
    cells = parts.withColumn("cx", F.explode(span["x"])).withColumn("cy", F.explode(span["y"])).drop("__k")
    far = reach + size * 0.7072
    off = g.point_piece_d2((F.col("cx") + 0.5) * size, (F.col("cy") + 0.5) * size, x0, y0, x1, y1)
    return cells.where(off <= far * far * (1 + 1e-9) + 1e-6).drop("__n")


def _crowded(rows: DataFrame, crowd: int) -> DataFrame:
    """``cx, cy, n``: the thousand most crowded cells of more rows than ``crowd``; any other holds less than a thousandth."""
    counts = rows.groupBy("cx", "cy").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > crowd).orderBy(F.col("n").desc(), "cx", "cy").limit(1000)


def blocks(left: DataFrame, right: DataFrame, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """Both sides (with cx, cy) with the numbers ``__l, __r`` of a block of their cell, by which they are to be joined.

    The rows of a side in a crowded cell are dealt to blocks, and the other side's rows of that cell are written once for
    each: every pair meets exactly once, and a block holds about ``crowd`` rows of each side. A thousand cells a side are
    looked after, so what is broadcast is bounded.
    """
    sides = {"__l": left, "__r": right}
    for own, rows in (("__l", left), ("__r", right)):
        hot = _crowded(rows, crowd).select("cx", "cy", F.ceil(F.col("n") / crowd).cast("int").alias("__n"))
        for name in sides:
            held = sides[name].join(F.broadcast(hot), ["cx", "cy"], "left")
            n = F.coalesce("__n", F.lit(1))
            dealt = F.when(n > 1, F.pmod(F.xxhash64(*rows.columns), n)).otherwise(0).cast("int")
            sides[name] = held.withColumn(own, dealt if name == own else F.explode(F.sequence(F.lit(0), n - 1))).drop("__n")
    return sides["__l"], sides["__r"]


def cell_join(left: DataFrame, right: DataFrame, crowd: int = CROWD, by: Sequence[str] = ()) -> DataFrame:
    """Rows of both sides that share a cell (cx, cy) and the columns ``by``, in tasks of bounded size however crowded a cell is."""
    a, b = blocks(left, right, crowd)
    return a.join(b.hint("merge"), ["cx", "cy", *by, "__l", "__r"]).drop("__l", "__r")


def near_pairs(points: DataFrame, pieces: DataFrame, reach: Column | float, size: float, point_id: str = "pid", crowd: int = CROWD, by: Sequence[str] = ()) -> DataFrame:
    """Point, piece and ``d2`` (squared distance) of all pairs within reach; ``reach`` may be a column of the points.

    ``size`` bounds the reach. A long piece, covered in parts, may meet a point in more than one; minima and flags over
    pairs are not changed by that. Points without coordinates are near nothing. With ``by``, only pairs that agree in these
    columns of both sides.
    """
    bound = size if isinstance(reach, Column) else float(reach)
    limit = reach if isinstance(reach, Column) else F.lit(float(reach))
    met = cell_join(with_cell(points, size), cover(pieces, bound, size), crowd, by)
    d2 = g.point_piece_d2(F.col("px"), F.col("py"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return met.withColumn("d2", d2).where(F.col("d2") <= limit * limit).drop("cx", "cy")


def nearest(points: DataFrame, pieces: DataFrame, reach: float, keep: Sequence[str] = (), point_id: str = "pid", line_id: str = "lid", size: float | None = None, by: Sequence[str] = (), digits: int | None = None) -> DataFrame:
    """``pid, lid, d2`` and the columns ``keep`` of the nearest line within reach of each point; of equals the least id.

    Points without a line within reach are left out. Minima are made before the second shuffle. With ``by``, only lines that
    agree with the point in these columns of both sides count. With ``digits``, squared distances are rounded to so many
    before they are compared with each other and with the reach.
    """

    def won(points: DataFrame, radius: float, width: float, last: bool) -> DataFrame:
        # Rounding brings squared distances down by half a unit of the last digit at most.
        pairs = near_pairs(points, pieces, radius if digits is None else (radius * radius + 10.0**-digits) ** 0.5, width, point_id, by=by)
        if digits is not None:
            pairs = pairs.withColumn("d2", F.round("d2", digits)).where(F.col("d2") <= radius * radius)
        best = pairs.groupBy(point_id).agg(F.min(F.struct("d2", line_id, *keep)).alias("best"))
        return best.select(point_id, f"best.{line_id}", "best.d2", *(f"best.{c}" for c in keep))

    return _widening(points, pieces, reach, won, point_id, size or reach, by)


def _radii(points: DataFrame, pieces: DataFrame, reach: float, size: float, by: Sequence[str] = ()) -> list[tuple[float, float]]:
    """(width of cells, radius) of the rounds of a search, the widest last: one round unless cells hold many pieces.

    Radii are added, each a quarter of the next, until a cell holds few pieces, or the pairs that a round would compare are
    no longer many times the rows that covering by its cells writes.
    """
    rounds, before, n = [(size, reach)], float("inf"), None
    while len(rounds) < 8:
        width, radius = rounds[0]
        held = cover(pieces.select(*by, "x0", "y0", "x1", "y1"), radius, width).groupBy("cx", "cy", *by).agg(F.count("*").alias("n"))
        got = held.agg(F.sum("n").alias("rows"), (F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("crowd")).first()
        if not got.rows or got.crowd <= DENSE or got.crowd > before / 2:
            break
        n = points.count() if n is None else n
        if n * got.crowd <= WORTH * got.rows:
            break
        before = got.crowd
        rounds.insert(0, (width / 4, width / 16))
    return rounds


def _widening(points: DataFrame, pieces: DataFrame, reach: float, won: Callable[[DataFrame, float, float, bool], DataFrame], point_id: str, size: float, by: Sequence[str] = ()) -> DataFrame:
    """What ``won(points, radius, width of cells, last)`` says of each point, where its nearest pieces within reach decide.

    Points that ``won`` returns for a radius are settled by the pieces within it, as these are all that are no farther; the
    others go on to the next radius. So points do not meet all pieces within reach where many are near.
    """
    found, rounds = None, _radii(points, pieces, reach, size, by) if by else _radii(points, pieces, reach, size)
    for k, (width, radius) in enumerate(rounds):
        last = k == len(rounds) - 1
        got = won(points, radius, width, last)
        got = got if last else checkpoint(got)
        found = got if found is None else found.unionByName(got)
        if not last:
            ids = got.select(F.col(point_id).alias("__settled"))
            points = checkpoint(points.join(ids.hint("merge"), F.col(point_id).eqNullSafe(F.col("__settled")), "left_anti"))
            if points.isEmpty():
                break
    return found


def assign(points: DataFrame, segments: DataFrame, away: DataFrame, reach: float, point_id: str = "pid", line_id: str = "lid", rep_id: str = "rep_seg_id") -> DataFrame:
    """``pid, lid, d2``: the segment that each point counts for, by the nearest geometry within reach.

    Geometries are the pieces of ``segments`` and of the merged-away halves ``away`` (lid, rep_seg_id and pieces), which
    count for their representative if it is a segment. Of equal distances the least id of a geometry wins.
    """
    cols = ["x0", "y0", "x1", "y1"]
    halves = away.join(segments.select(F.col(line_id).alias(rep_id)).distinct().hint("merge"), rep_id, "left_semi")
    targets = segments.select(line_id, *cols, F.col(line_id).alias("__target")).unionByName(halves.select(line_id, *cols, F.col(rep_id).alias("__target")))
    return nearest(points, targets, reach, ("__target",), point_id, line_id).select(point_id, F.col("__target").alias(line_id), "d2")


def nearest_with_ties(points: DataFrame, pieces: DataFrame, reach: float, point_id: str = "pid", line_id: str = "lid") -> DataFrame:
    """All lines at the least distance within reach of each point."""

    def won(points: DataFrame, radius: float, width: float, last: bool) -> DataFrame:
        least = F.min("d2").over(Window.partitionBy(point_id))
        return near_pairs(points, pieces, radius, width, point_id).select(point_id, line_id, "d2").withColumn("__least", least).where("d2 = __least").select(point_id, line_id, "d2").distinct()

    return _widening(points.where(F.col(point_id).isNotNull()), pieces, reach, won, point_id, reach)


def nearest_unbounded(points: DataFrame, pieces: DataFrame, first_reach: float, point_id: str = "pid", line_id: str = "lid", group: tuple[str, str] | None = None) -> DataFrame:
    """``pid, lid, d2``: the nearest line of each point at any distance; of equals the least id.

    Points with a line within ``first_reach`` are settled by one join. The others go down a pyramid of cells (see
    ``_descend``), whose levels grow with the logarithm of the lines' extent, however far a point is off. With ``group``, a
    column of the points and one of the pieces, only lines of a point's own group count.

    A point without coordinates (null or NaN) comes out with null lid and d2; one whose group has no line is left out.
    """
    own, of = group or ("__own", "__of")
    known = ~F.isnan("px") & ~F.isnan("py")
    held = points if group else points.withColumn("__own", F.lit(0))
    lines = (pieces if group else pieces.withColumn("__of", F.lit(0))).select(line_id, F.col(of).alias("__of"), "x0", "y0", "x1", "y1")
    held = held.select(F.col(point_id).alias("__pid"), F.col(own).alias("__own"), F.when(known, F.col("px")).alias("px"), F.when(known, F.col("py")).alias("py"))
    if group:
        held, lines = checkpoint(held), checkpoint(lines)  # both are mostly joins, and read in every round
        got = nearest(held, lines.withColumnRenamed("__of", "__own"), first_reach, (), "__pid", line_id, by=("__own",))
    else:
        got = nearest(held, lines, first_reach, (), "__pid", line_id)
    got = checkpoint(got)
    rest = checkpoint(held.join(got.select("__pid").hint("merge"), "__pid", "left_anti"))
    found = got
    if not rest.where("px is not null and py is not null").isEmpty():
        found = got.unionByName(_descend(rest.where("px is not null and py is not null"), lines, first_reach, line_id))
    none = {line_id: lines.schema[line_id].dataType, "d2": "double"}
    nowhere = rest.where("px is null or py is null").select("__pid", *(F.lit(None).cast(t).alias(c) for c, t in none.items()))
    return found.unionByName(nowhere).withColumnRenamed("__pid", point_id)


def _descend(points: DataFrame, pieces: DataFrame, size: float, line_id: str) -> DataFrame:
    """The nearest piece of each point of its group (``__own``, ``__of``): ``__pid``, line, d2.

    Each cell of a level knows the start of one piece that it holds, at most so far off the nearest piece can be. From the
    top, where a group has four cells at most, points go down to the children of the cells that are not farther off than
    that, until those of the lowest level give up their pieces. So a point meets few cells a level and few pieces, and
    points far off do not meet all lines.
    """
    base = cover(pieces, 0.0, size)
    cell = lambda df: df.groupBy("__of", "cx", "cy").agg(F.min(F.struct("x0", "y0")).alias("at"))
    levels = [checkpoint(cell(base))]
    span = levels[0].agg(*(F.coalesce(F.max(c) - F.min(c), F.lit(0)).alias(c) for c in ("cx", "cy")), F.count("*").alias("n")).first()
    wide = max(span.cx, span.cy)
    while wide >> (_STEP * (len(levels) - 1)):
        up = levels[-1].select("__of", *(F.shiftright(c, _STEP).alias(c) for c in ("cx", "cy")), F.col("at.x0").alias("x0"), F.col("at.y0").alias("y0"))
        levels.append(cell(up))
    front = points
    for k in range(len(levels) - 1, -1, -1):
        top = k == len(levels) - 1
        up = [] if top else [F.shiftright(c, _STEP).alias(f"u{c}") for c in ("cx", "cy")]
        kids = levels[k].select(F.col("__of").alias("__own"), *up, "cx", "cy", "at")
        if span.n <= BROADCAST_EDGES or levels[k].limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES:  # no level has more cells than the lowest
            kids = F.broadcast(kids)
        met = front.join(kids, ["__own"] if top else ["__own", "ucx", "ucy"])
        width = size * (1 << (_STEP * k))
        off = [F.greatest(F.col(c) * width - F.col(p), F.col(p) - (F.col(c) + 1) * width, F.lit(0.0)) for c, p in (("cx", "px"), ("cy", "py"))]
        to = [F.col("px") - F.col("at.x0"), F.col("py") - F.col("at.y0")]
        met = met.withColumns({"low": off[0] * off[0] + off[1] * off[1], "high": to[0] * to[0] + to[1] * to[1]})
        met = met.withColumn("high", F.min("high").over(Window.partitionBy("__pid")))
        left = met.where(F.col("low") <= F.col("high") * (1 + 1e-9) + 1e-6)
        front = left.select("__pid", "__own", "px", "py", *([F.col(c).alias(f"u{c}") for c in ("cx", "cy")] if k else ["cx", "cy"]))
    d2 = g.point_piece_d2(F.col("px"), F.col("py"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    met = cell_join(front, base.withColumnRenamed("__of", "__own"), by=("__own",)).withColumn("d2", d2)
    return met.groupBy("__pid").agg(F.min(F.struct("d2", line_id)).alias("best")).select("__pid", f"best.{line_id}", "best.d2")


def _edge_bands(edges: DataFrame, band: float, zone_id: str) -> DataFrame:
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")
    return edges.select(zone_id, "x0", "y0", "x1", "y1", F.explode(F.sequence(_cell(low, band), _cell(high, band))).alias("band"))


def zones_of_points(points: DataFrame, edges: DataFrame, band: float, point_id: str = "pid", zone_id: str = "zone_id", boundary: str = "half_open") -> DataFrame:
    """``pid, zone_id`` of all zones that hold a point: an odd number of ring edges to its right.

    Edges are spread over bands of y, so that a large boundary is never one row and a point meets only the edges at its
    height. An edge counts by the half-open rule, so holes and touching rings come out right. ``boundary`` says what holds
    for points on an edge or a corner, of a hole too: ``outside`` (strict interior), ``inside`` (closed), or ``half_open``,
    which gives a point on a shared border to one of its zones (west and south sides count). On an edge means exactly so:
    in its box, and in one line with its ends by the arithmetic of doubles.
    """
    if boundary not in ("half_open", "outside", "inside"):
        raise ValueError("boundary must be half_open, outside or inside")
    banded = _edge_bands(edges if boundary != "half_open" else edges.where("y0 <> y1"), band, zone_id)
    if edges.limit(BROADCAST_EDGES + 1).count() <= BROADCAST_EDGES:
        banded = F.broadcast(banded)
    met = points.withColumn("band", _cell(F.col("py"), band)).join(banded, "band")
    px, py, x0, y0, x1, y1 = (F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1"))
    right = ((y0 <= py) != (y1 <= py)) & (px < (x1 - x0) * (py - y0) / F.nullif(y1 - y0, F.lit(0.0)) + x0)
    right = F.coalesce(right, F.lit(False))
    if boundary == "half_open":
        return met.where(right).groupBy(point_id, zone_id).agg(F.count("*").alias("n")).where("n % 2 = 1").select(point_id, zone_id)
    boxed = px.between(F.least(x0, x1), F.greatest(x0, x1)) & py.between(F.least(y0, y1), F.greatest(y0, y1))
    on = boxed & ((x1 - x0) * (py - y0) == (y1 - y0) * (px - x0))
    counted = met.withColumns({"__right": right, "__on": on}).where("__right or __on").groupBy(point_id, zone_id).agg(F.count_if("__right").alias("n"), F.bool_or("__on").alias("edge"))
    return counted.where("n % 2 = 1 and not edge" if boundary == "outside" else "n % 2 = 1 or edge").select(point_id, zone_id)


def zone_of_point(points: DataFrame, edges: DataFrame, band: float, point_id: str = "pid", zone_id: str = "zone_id") -> DataFrame:
    """``pid, zone_id``: the least zone that holds each point, null where none does."""
    found = zones_of_points(points, edges, band, point_id, zone_id).groupBy(point_id).agg(F.min(zone_id).alias(zone_id))
    return points.select(point_id).join(found, point_id, "left")


def nearest_zone(points: DataFrame, edges: DataFrame, band: float, point_id: str = "pid", zone_id: str = "zone_id") -> DataFrame:
    """``pid, zone_id, d2``: the zone that holds a point (distance 0), else the one with the nearest edge."""
    inside = zones_of_points(points, edges, band, point_id, zone_id).groupBy(point_id).agg(F.min(zone_id).alias(zone_id)).withColumn("d2", F.lit(0.0))
    inside = checkpoint(inside)
    outside = points.join(inside.select(point_id), point_id, "left_anti")
    return inside.unionByName(nearest_unbounded(outside, edges, band, point_id, zone_id))


def points_near_zones(points: DataFrame, edges: DataFrame, reach: float, band: float, point_id: str = "pid", zone_id: str = "zone_id") -> DataFrame:
    """``pid, zone_id`` of zones that hold a point or have an edge within reach of it."""
    inside = zones_of_points(points, edges, band, point_id, zone_id)
    near = near_pairs(points, edges, reach, reach, point_id).select(point_id, zone_id)
    return inside.unionByName(near).distinct()


def lines_in_zones(pieces: DataFrame, edges: DataFrame, size: float, line_id: str = "lid", zone_id: str = "zone_id") -> DataFrame:
    """``lid, zone_id`` of lines that meet a zone: an end of a piece inside it, or a piece across its edge."""
    ends = pieces.select(line_id, F.explode(F.array(g.point(F.col("x0"), F.col("y0")), g.point(F.col("x1"), F.col("y1")))).alias("p")).select(line_id, F.col("p.x").alias("px"), F.col("p.y").alias("py")).distinct()
    inside = zones_of_points(ends.withColumn("pid", F.struct(line_id, "px", "py")), edges, size, "pid", zone_id).select(F.col(f"pid.{line_id}").alias(line_id), zone_id)
    across = piece_pairs(pieces, edges.withColumnRenamed(zone_id, "__zone"), 0.0, size, line_id, "__zone").select(line_id, F.col("__zone").alias(zone_id))
    return inside.unionByName(across).distinct()


def piece_pairs(left: DataFrame, right: DataFrame, reach: float, size: float, left_id: str, right_id: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs of pieces within reach of each other: ``left_id, right_id, d2``, the nearest pieces of two lines.

    With ``by``, only pairs that agree in these columns of both sides.
    """
    a = cover(left, 0.0, size).select(left_id, *by, "cx", "cy", *_ends("a"))
    b = cover(right, reach, size).select(right_id, *by, "cx", "cy", *_ends("b"))
    met = _within(a.join(b.hint("merge"), ["cx", "cy", *by]), reach)
    return met.groupBy(left_id, right_id).agg(F.min("d2").alias("d2"))


def _ends(side: str) -> list[Column]:
    """The ends of covered pieces under names of their own: never null, which keeps the code of their distances short."""
    return [F.coalesce(F.col(c), F.lit(0.0)).alias(f"{side}{c}") for c in ("x0", "y0", "x1", "y1")]


def _within(met: DataFrame, reach: float) -> DataFrame:
    """Rows whose pieces (ends with a and b before their names) are within reach, with ``d2``.

    The distance is worked out in steps of its own, once: a filter on it would be pushed below the join with all its
    formula, and the JVM does not compile methods of over 8,000 bytes, which such code has.
    """
    off = [F.greatest(F.least(f"a{c}0", f"a{c}1") - F.greatest(f"b{c}0", f"b{c}1"), F.least(f"b{c}0", f"b{c}1") - F.greatest(f"a{c}0", f"a{c}1"), F.lit(0.0)) for c in "xy"]
    met = met.where(off[0] * off[0] + off[1] * off[1] <= reach * reach * (1 + 1e-9) + 1e-6)
    a, b = (tuple(F.col(f"{side}{c}") for c in ("x0", "y0", "x1", "y1")) for side in "ab")
    near = [g.point_piece_d2(a[0], a[1], *b), g.point_piece_d2(a[2], a[3], *b), g.point_piece_d2(b[0], b[1], *a), g.point_piece_d2(b[2], b[3], *a)]
    for k, d2 in enumerate([*near, g.pieces_cross(a, b)]):
        met = met.withColumn("__one", F.explode(F.array(d2))).withColumnRenamed("__one", f"__d{k}")
    d2 = F.when(F.col("__d4"), F.lit(0.0)).otherwise(F.least(*(f"__d{k}" for k in range(4))))
    met = met.withColumn("d2", F.explode(F.array(d2)))
    return met.where(F.col("d2") <= reach * reach).drop(*(f"__d{k}" for k in range(5)))


def sample_points(lines: DataFrame, fractions: Sequence[float], line_id: str = "lid", points: str = "geometry") -> DataFrame:
    """``lid, k, px, py``: a row for each fraction along each line."""
    each = lines.select(line_id, points, F.posexplode(F.array(*(F.lit(float(f)) for f in fractions))).alias("k", "f"))
    return each.select(line_id, "k", g.interpolate(F.col(points), F.col("f")).alias("p")).select(line_id, "k", F.col("p.x").alias("px"), F.col("p.y").alias("py"))


def snap_match(lines: DataFrame, source: DataFrame, fields: dict[str, str], reach: float = 60.0, least_share: float = 0.4, fractions: Sequence[float] = (0.1, 0.3, 0.5, 0.7, 0.9), line_id: str = "lid", source_id: str = "sid") -> DataFrame:
    """Carry attributes of ``source`` pieces over to ``lines``: sample points, snap each to the nearest piece, aggregate.

    ``fields``: column -> mode, mean or median. ``match_frac`` is the share of points that met a piece with any field not
    null, rounded to three digits; values are given from ``least_share`` on. Of equally frequent values the least wins.
    """
    points = sample_points(lines, fractions, line_id).withColumn("pid", F.struct(line_id, "k"))
    won = nearest(points, source, reach, tuple(fields), "pid", source_id)
    held = won.select(F.col(f"pid.{line_id}").alias(line_id), *fields).where(F.coalesce(*(F.col(c).cast("string") for c in fields)).isNotNull())
    kinds = {"mode": lambda c: F.mode(c, True), "mean": F.avg, "median": F.median}
    got = held.groupBy(line_id).agg(F.count("*").alias("n"), *(kinds[how](F.col(c)).alias(c) for c, how in fields.items()))
    share = F.coalesce(F.col("n"), F.lit(0)) / len(fractions)
    enough = share >= least_share
    return lines.select(line_id).join(got, line_id, "left").select(line_id, F.bround(share, 3).alias("match_frac"), *(F.when(enough, F.col(c)).alias(c) for c in fields))


def overlap_share(pieces: DataFrame, other: DataFrame, reach: float, line_id: str = "lid") -> DataFrame:
    """``lid, share``: how much of a line's length lies within reach of any piece of the other layer.

    Along a piece, the places within reach of another piece are one stretch, as that set is convex: its ends come from
    the circles about the other's ends and the strip along it. Stretches are put together by a running maximum.

    Where a place of the other layer lies in a cell whose diagonal is the reach, all of the cell is within reach. Pieces that
    touch such cells only count as a whole, so that few are left to be compared where the other layer is dense.
    """
    own = pieces.where("x0 <> x1 or y0 <> y1").withColumn("__id", F.struct(line_id, "piece"))  # others have no length to share
    whole = None
    if reach > 0:
        own, whole = _within_full_cells(own, other, reach * 0.7071)
    a = cover(own, 0.0, max(reach, 1.0)).select(line_id, "__id", "cx", "cy", *(F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1")))
    b = cover(other.select("x0", "y0", "x1", "y1"), reach, max(reach, 1.0)).select("cx", "cy", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    met = a.join(b.hint("merge"), ["cx", "cy"]).drop("cx", "cy").distinct()
    # Each step is a projection of its own: products that several later ones use are worked out once.
    met = met.withColumns({"bx": F.col("ax1") - F.col("ax0"), "by": F.col("ay1") - F.col("ay0"), "ux": F.col("bx1") - F.col("bx0"), "uy": F.col("by1") - F.col("by0")})
    ax, ay, bx, by, ux, uy = (F.col(c) for c in ("ax0", "ay0", "bx", "by", "ux", "uy"))
    met = met.withColumns({"size": bx * bx + by * by, "wide": F.sqrt(ux * ux + uy * uy)})
    for k in (0, 1):  # where the circle about an end of the other piece is crossed
        cx, cy = F.col(f"bx{k}") - ax, F.col(f"by{k}") - ay
        met = met.withColumns({f"t{k}": (cx * bx + cy * by) / F.col("size"), f"cross{k}": cx * by - cy * bx})
        left = F.lit(reach * reach) - F.col(f"cross{k}") * F.col(f"cross{k}") / F.col("size")
        met = met.withColumn(f"half{k}", F.sqrt(F.when(left >= 0, left) / F.col("size")))
        met = met.withColumns({f"low{k}": F.col(f"t{k}") - F.col(f"half{k}"), f"high{k}": F.col(f"t{k}") + F.col(f"half{k}")})
    # The strip along the other piece, between its ends and within reach on both sides.
    cx, cy = ax - F.col("bx0"), ay - F.col("by0")
    met = met.withColumns({"base2": cx * ux + cy * uy, "slope2": bx * ux + by * uy, "base3": cx * uy - cy * ux, "slope3": bx * uy - by * ux})
    for k, low, high in ((2, F.lit(0.0), F.col("wide") * F.col("wide")), (3, -reach * F.col("wide"), reach * F.col("wide"))):
        base, slope = F.col(f"base{k}"), F.nullif(F.col(f"slope{k}"), F.lit(0.0))
        met = met.withColumns({f"from{k}": (low - base) / slope, f"to{k}": (high - base) / slope, f"held{k}": (base >= low) & (base <= high)})
        flat, inside = F.col(f"from{k}").isNull(), F.col(f"held{k}")
        met = met.withColumns({
            f"low{k}": F.when(flat & inside, F.lit(-1e18)).when(~flat, F.least(f"from{k}", f"to{k}")),
            f"high{k}": F.when(flat & inside, F.lit(1e18)).when(~flat, F.greatest(f"from{k}", f"to{k}")),
        })
    met = met.withColumns({"low4": F.greatest("low2", "low3"), "high4": F.least("high2", "high3")})
    strip = F.col("low2").isNotNull() & F.col("low3").isNotNull() & (F.col("low4") <= F.col("high4")) & (F.col("wide") > 0)
    met = met.withColumns({"low": F.least("low0", "low1", F.when(strip, F.col("low4"))), "high": F.greatest("high0", "high1", F.when(strip, F.col("high4")))})
    # Pairs without a stretch have an empty one. A filter on it would be pushed down, formula and all, below the steps above.
    clipped = met.select(line_id, "__id", F.sqrt("size").alias("long"), F.greatest("low", F.lit(0.0)).alias("t0"), F.when(F.col("high").isNull(), F.lit(0.0)).otherwise(F.least("high", F.lit(1.0))).alias("t1"))
    so_far = Window.partitionBy("__id").orderBy("t0", "t1").rowsBetween(Window.unboundedPreceding, -1)
    new = clipped.withColumn("__seen", F.coalesce(F.max("t1").over(so_far), F.lit(0.0)))
    parts = new.select(line_id, (F.col("long") * F.greatest(F.col("t1") - F.greatest("t0", "__seen"), F.lit(0.0))).alias("near"))
    parts = parts if whole is None else parts.unionByName(whole.select(line_id, F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")).alias("near")))
    covered = parts.groupBy(line_id).agg(F.sum("near").alias("near"))
    total = pieces.groupBy(line_id).agg(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("total"))
    return total.join(covered, line_id, "left").select(line_id, F.when(F.col("total") > 0, F.coalesce("near", F.lit(0.0)) / F.col("total")).alias("share"))


def _within_full_cells(own: DataFrame, other: DataFrame, size: float) -> tuple[DataFrame, DataFrame]:
    """``own`` (with ``__id``) in two: the rest, and pieces of which every cell holds a place of ``other``."""
    n = F.ceil(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) / size).cast("long")
    along = other.select("x0", "y0", "x1", "y1").withColumn("__n", F.greatest(n, F.lit(1))).withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n"))))
    share = F.col("__k") / F.col("__n")
    full = along.select(_cell(F.col("x0") + (F.col("x1") - F.col("x0")) * share, size).alias("cx"), _cell(F.col("y0") + (F.col("y1") - F.col("y0")) * share, size).alias("cy")).distinct()
    held = cover(own, 0.0, size).select("__id", "cx", "cy").join(full.withColumn("__full", F.lit(True)).hint("merge"), ["cx", "cy"], "left")
    sure = checkpoint(held.groupBy("__id").agg(F.bool_and(F.coalesce("__full", F.lit(False))).alias("__sure")).where("__sure").select("__id"))
    return own.join(sure.hint("merge"), "__id", "left_anti"), own.join(sure.hint("merge"), "__id", "left_semi")


def parallel_share(pieces: DataFrame, other: DataFrame, reach: float = 60.0, tangent: float = 0.5773502691896257, line_id: str = "lid", other_id: str = "oid") -> DataFrame:
    """``lid, share``: the share of a line's length in pieces whose nearest other piece within reach runs in parallel.

    The tangent is that of the largest angle (30 degrees). Of other pieces at equal distance the least (oid, piece) counts.
    """
    own = pieces.withColumn("__id", F.struct(line_id, "piece"))
    cols = lambda s: tuple(F.col(f"{s}{c}") for c in ("x0", "y0", "x1", "y1"))

    def won(own: DataFrame, radius: float, width: float, last: bool) -> DataFrame:
        a = cover(own, 0.0, width).select(line_id, "__id", "cx", "cy", *_ends("a"))
        b = cover(other, radius, width).select(other_id, F.col("piece").alias("__p"), "cx", "cy", *_ends("b"))
        met = _within(a.join(b.hint("merge"), ["cx", "cy"]), radius)
        met = met.withColumn("runs", g.parallel_within(cols("a"), cols("b"), tangent)).withColumn("long", F.hypot(F.col("ax1") - F.col("ax0"), F.col("ay1") - F.col("ay0")))
        return met.groupBy(line_id, "__id").agg(F.min(F.struct("d2", other_id, "__p", "runs", "long")).alias("best"))

    best = _widening(own, other, reach, won, "__id", reach)
    got = best.where("best.runs").groupBy(line_id).agg(F.sum("best.long").alias("matched"))
    total = pieces.groupBy(line_id).agg(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))).alias("total"))
    return total.join(got, line_id, "left").select(line_id, F.when(F.col("total") > 0, F.coalesce("matched", F.lit(0.0)) / F.col("total")).alias("share"))


def side_shares(samples: DataFrame, other: DataFrame, reach_bound: float, line_id: str = "lid") -> DataFrame:
    """``lid, left_share, right_share``: how many sample points have a piece of the other layer on each side within reach.

    ``samples``: lid, k, px, py, dx, dy (direction of the line), reach (at most reach_bound). A piece is on the left if
    the nearest point of it is not to the right of the direction.
    """

    def won(points: DataFrame, radius: float, width: float, last: bool) -> DataFrame:
        pairs = near_pairs(points, other, radius, width).where("d2 <= reach * reach")
        q = g.nearest_on_piece(F.col("px"), F.col("py"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
        sided = pairs.withColumn("__q", q).withColumn("left", F.col("dx") * (F.col("__q.y") - F.col("py")) - F.col("dy") * (F.col("__q.x") - F.col("px")) >= 0)
        point = sided.groupBy("pid").agg(F.bool_or("left").alias("l"), F.bool_or(~F.col("left")).alias("r"))
        return point if last else point.where("l and r")

    point = _widening(samples.withColumn("pid", F.struct(line_id, "k")), other, reach_bound, won, "pid", reach_bound).select(f"pid.{line_id}", "l", "r")
    got = point.groupBy(line_id).agg(F.count_if("l").alias("l"), F.count_if("r").alias("r"))
    n = samples.groupBy(line_id).agg(F.count("*").alias("n"))
    share = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0)) / F.col("n"), 2)
    return n.join(got, line_id, "left").select(line_id, share("l").alias("left_share"), share("r").alias("right_share"))


def area_weighted_neighbours(pieces: DataFrame, zones: DataFrame, edges: DataFrame, reach: float, category: str, line_id: str = "lid", zone_id: str = "zone_id") -> DataFrame:
    """``lid, zone_id, category, area`` of all zones (zone_id, category, area) that come within reach of a line.

    Lines meet the boxes of zones first, a row for each cell of a box; the edges of the pairs whose boxes come within
    reach follow, and a line's start inside a zone counts also where no edge is near.
    """
    boxes = edges.groupBy(zone_id).agg(F.min(F.least("x0", "x1")).alias("x0"), F.min(F.least("y0", "y1")).alias("y0"), F.max(F.greatest("x0", "x1")).alias("x1"), F.max(F.greatest("y0", "y1")).alias("y1"))
    size = max(4 * reach, 1.0)
    grid = lambda df, by: df.withColumn("cx", F.explode(F.sequence(_cell(F.least("x0", "x1") - by, size), _cell(F.greatest("x0", "x1") + by, size)))).withColumn("cy", F.explode(F.sequence(_cell(F.least("y0", "y1") - by, size), _cell(F.greatest("y0", "y1") + by, size))))
    b = grid(boxes, reach).select(zone_id, "cx", "cy", *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    met = cover(pieces.select(line_id, "x0", "y0", "x1", "y1"), 0.0, size).join(b.hint("merge"), ["cx", "cy"])
    apart = [F.greatest(F.least(f"{c}0", f"{c}1") - F.col(f"b{c}1"), F.col(f"b{c}0") - F.greatest(f"{c}0", f"{c}1"), F.lit(0.0)) for c in "xy"]
    near = met.where(apart[0] * apart[0] + apart[1] * apart[1] <= reach * reach).select(line_id, zone_id, *(F.col(c).alias(f"a{c}") for c in ("x0", "y0", "x1", "y1"))).distinct()
    sides = edges.select(zone_id, *(F.col(c).alias(f"b{c}") for c in ("x0", "y0", "x1", "y1")))
    cols = lambda s: tuple(F.col(f"{s}{c}") for c in ("x0", "y0", "x1", "y1"))
    close = near.join(sides.hint("merge"), zone_id).where(g.piece_piece_d2(cols("a"), cols("b")) <= reach * reach).select(line_id, zone_id)
    starts = pieces.groupBy(line_id).agg(F.min_by(F.struct("x0", "y0"), "piece").alias("p")).select(line_id, F.col("p.x0").alias("px"), F.col("p.y0").alias("py"))
    inside = zones_of_points(starts, edges, reach, line_id, zone_id)
    return close.unionByName(inside).distinct().join(zones.select(zone_id, category, "area").hint("merge"), zone_id)
