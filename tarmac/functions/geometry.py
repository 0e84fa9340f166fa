"""Geometry as column expressions.

A line is ``array<struct<x: double, y: double>>`` in projected feet; a straight piece is four columns ``x0, y0, x1, y1``;
a polygon is a table of ring edges with the same four columns. Nothing here is a UDF.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEET_A_MILE = 5280.0


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def line(*points: tuple[Column, Column]) -> Column:
    return F.array(*(point(x, y) for x, y in points))


def _let(value: Column, body) -> Column:
    """``body`` of a value worked out once."""
    return F.get(F.transform(F.array(value), body), 0)


def piece_lengths(points: Column) -> Column:
    """The length of each straight piece of a line."""
    n = F.size(points)
    head, tail = F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0)))
    return F.zip_with(head, tail, lambda a, b: F.hypot(b["x"] - a["x"], b["y"] - a["y"]))


def length(points: Column) -> Column:
    """Length of a line; 0 for a line of fewer than two points."""
    return F.aggregate(piece_lengths(points), F.lit(0.0), lambda a, d: a + d)


def compass_bearing(points: Column) -> Column:
    """Bearing of the chord from end to end, 0 to 360, 0 to the north."""
    a, b = F.get(points, 0), F.element_at(points, -1)
    return F.pmod(F.degrees(F.atan2(b["x"] - a["x"], b["y"] - a["y"])), F.lit(360.0))


def piece_bearing(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Direction of a piece without sense, 0 to 180, 0 to the east."""
    return F.pmod(F.degrees(F.atan2(y1 - y0, x1 - x0)), F.lit(180.0))


def interpolate(points: Column, fraction: Column) -> Column:
    """The point at a share (0 to 1) of a line's length."""

    def along(lengths: Column) -> Column:
        target = fraction * F.aggregate(lengths, F.lit(0.0), lambda a, d: a + d)
        walk = F.aggregate(
            lengths,
            F.struct(F.lit(0.0).alias("done"), F.lit(0).alias("at"), F.lit(-1.0).alias("t")),
            lambda s, d: F.when(s["t"] >= 0, s).otherwise(
                F.when((s["done"] + d >= target) & (d > 0), F.struct(s["done"].alias("done"), s["at"].alias("at"), ((target - s["done"]) / d).alias("t"))).otherwise(
                    F.struct((s["done"] + d).alias("done"), (s["at"] + 1).alias("at"), F.lit(-1.0).alias("t"))
                )
            ),
        )

        def place(s: Column) -> Column:
            a, b = F.get(points, s["at"]), F.get(points, s["at"] + 1)
            inside = F.struct((a["x"] + s["t"] * (b["x"] - a["x"])).alias("x"), (a["y"] + s["t"] * (b["y"] - a["y"])).alias("y"))
            return F.when(s["t"] >= 0, inside).otherwise(F.element_at(points, -1))

        return _let(walk, place)

    return _let(piece_lengths(points), along)


def midpoint(points: Column) -> Column:
    return interpolate(points, F.lit(0.5))


def representative_point(points: Column) -> Column:
    """The inner vertex nearest to the mean of the line's pieces, else the end nearest to it; the first of equals."""

    def chosen(lengths: Column) -> Column:
        total = F.aggregate(lengths, F.lit(0.0), lambda a, d: a + d)
        n = F.size(points)
        middle = lambda axis: F.aggregate(
            F.arrays_zip(lengths.alias("d"), F.slice(points, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(points, 2, F.greatest(n - 1, F.lit(0))).alias("b")),
            F.lit(0.0), lambda s, z: s + z["d"] * (z["a"][axis] + z["b"][axis]) / 2,
        ) / total
        pool = F.when(n > 2, F.slice(points, 2, F.greatest(n - 2, F.lit(0)))).otherwise(points)
        return _let(F.struct(middle("x").alias("x"), middle("y").alias("y")), lambda c: F.array_min(
            F.transform(pool, lambda p, i: F.struct(((p["x"] - c["x"]) * (p["x"] - c["x"]) + (p["y"] - c["y"]) * (p["y"] - c["y"])).alias("d"), i.alias("i"), p.alias("p")))
        )["p"])

    return _let(piece_lengths(points), chosen)


def explode_pieces(df: DataFrame, points: str = "geometry") -> DataFrame:
    """A row for each straight piece: the other columns, ``piece`` (from 0), ``x0, y0, x1, y1``."""
    p = F.col(points)
    n = F.greatest(F.size(p) - 1, F.lit(0))
    zipped = F.arrays_zip(F.slice(p, 1, n).alias("a"), F.slice(p, 2, n).alias("b"))
    rest = [c for c in df.columns if c != points]
    flat = df.select(*rest, F.posexplode(zipped).alias("piece", "ends"))
    return flat.select(*rest, "piece", *(F.col(f"ends.{e}.{c}").alias(f"{c}{k}") for e, k in (("a", 0), ("b", 1)) for c in ("x", "y")))


def point_piece_d2(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Squared distance of a point from a piece."""
    dx, dy, ax, ay = x1 - x0, y1 - y0, px - x0, py - y0
    size, dot, cross = dx * dx + dy * dy, ax * dx + ay * dy, ax * dy - ay * dx
    return F.when(dot <= 0, ax * ax + ay * ay).when(dot >= size, (px - x1) * (px - x1) + (py - y1) * (py - y1)).otherwise(cross * cross / size)


def nearest_on_piece(px: Column, py: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The point of a piece nearest to a point."""
    dx, dy = x1 - x0, y1 - y0
    size = dx * dx + dy * dy
    t = F.when(size > 0, F.least(F.greatest(((px - x0) * dx + (py - y0) * dy) / size, F.lit(0.0)), F.lit(1.0))).otherwise(F.lit(0.0))
    return F.struct((x0 + t * dx).alias("x"), (y0 + t * dy).alias("y"))


def pieces_cross(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether two pieces have a point in common (touching counts)."""
    side = lambda x0, y0, x1, y1, x, y: F.signum((x1 - x0) * (y - y0) - (y1 - y0) * (x - x0))
    s1, s2 = side(*a, b[0], b[1]), side(*a, b[2], b[3])
    s3, s4 = side(*b, a[0], a[1]), side(*b, a[2], a[3])
    boxes = (F.least(a[0], a[2]) <= F.greatest(b[0], b[2])) & (F.least(b[0], b[2]) <= F.greatest(a[0], a[2])) & (F.least(a[1], a[3]) <= F.greatest(b[1], b[3])) & (F.least(b[1], b[3]) <= F.greatest(a[1], a[3]))
    return boxes & (s1 * s2 <= 0) & (s3 * s4 <= 0)


def piece_piece_d2(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Squared distance of two pieces: 0 if they cross, else the least from an end of one to the other."""
    ends = [point_piece_d2(a[0], a[1], *b), point_piece_d2(a[2], a[3], *b), point_piece_d2(b[0], b[1], *a), point_piece_d2(b[2], b[3], *a)]
    return F.when(pieces_cross(a, b), F.lit(0.0)).otherwise(F.least(*ends))


def parallel_within(a: tuple[Column, ...], b: tuple[Column, ...], tangent: float) -> Column:
    """Whether the directions without sense of two pieces differ by an angle of at most the given tangent (below 90 degrees)."""
    dx, dy, ex, ey = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    return F.abs(dx * ey - dy * ex) <= tangent * F.abs(dx * ex + dy * ey)


def opposed(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Whether the directions of two chords differ by 135 to 225 degrees."""
    dx, dy, ex, ey = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    dot = dx * ex + dy * ey
    return (dot < 0) & (2 * dot * dot >= (dx * dx + dy * dy) * (ex * ex + ey * ey))


def signed_ring_area(points: Column) -> Column:
    """Area of a ring by the shoelace rule, negative if it runs clockwise; the last point need not repeat the first."""
    n = F.size(points)
    shifted = F.concat(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), F.slice(points, 1, 1))
    return F.aggregate(F.zip_with(points, shifted, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"]), F.lit(0.0), lambda s, z: s + z) / 2


def ring_area(points: Column) -> Column:
    """Area of a ring, whatever its direction."""
    return F.abs(signed_ring_area(points))


def merge_touching(a: Column, b: Column) -> Column:
    """Two lines that share an end as one line; null if they share none."""
    first, last = lambda p: F.get(p, 0), lambda p: F.element_at(p, -1)
    rest = lambda p: F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0)))
    options = [(last(a) == first(b), F.concat(a, rest(b))), (last(a) == last(b), F.concat(a, rest(F.reverse(b)))), (first(a) == last(b), F.concat(b, rest(a))), (first(a) == first(b), F.concat(F.reverse(b), rest(a)))]
    return reduce(lambda c, x: c.when(*x), options[1:], F.when(*options[0]))


def bounding_box(df: DataFrame, lon: str, lat: str, pad: float = 0.01) -> DataFrame:
    """One row ``xmin, ymin, xmax, ymax``, padded and rounded to four decimals."""
    return df.agg(
        *(F.bround(F.min(c) - pad, 4).alias(k) for c, k in ((lon, "xmin"), (lat, "ymin"))),
        *(F.bround(F.max(c) + pad, 4).alias(k) for c, k in ((lon, "xmax"), (lat, "ymax"))),
    )
