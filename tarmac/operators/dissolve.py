"""Zones of a group made one area: borders between its members go, the rest is chained into rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import geometry as g
from tarmac.operators.graph import stored
from tarmac.operators.outlines import _POINTS, _open
from tarmac.operators.spatial import near_pairs


def _from_least(points: Column) -> Column:
    """An open ring turned so that it begins at its least point."""
    at = F.array_position(points, F.array_min(points)).cast("int")
    return F.concat(F.slice(points, at, F.size(points)), F.slice(points, F.lit(1), at - 1))


def _bent(points: Column) -> Column:
    """An open ring without the points on which it runs straight."""
    n = F.size(points)

    def turns(p: Column, i: Column) -> Column:
        a, b = F.get(points, F.pmod(i - 1, n)), F.get(points, F.pmod(i + 1, n))
        return (p["x"] - a["x"]) * (b["y"] - p["y"]) != (p["y"] - a["y"]) * (b["x"] - p["x"])

    return F.filter(points, turns)


def _edges(rings: DataFrame, band: float) -> DataFrame:
    """``g, rid, no, x0, y0, x1, y1``: edges with the zone on their left, rings being counter-clockwise as they come.

    A ring inside an odd number of other rings of its zone is a hole, and its edges are turned. The middle of its first
    edge stands for it; only zones of several rings are looked at, in bands of y.
    """
    shifted = F.concat(F.slice("pts", F.lit(2), F.size("pts")), F.slice("pts", F.lit(1), F.lit(1)))
    each = rings.select("g", "z", "rid", F.posexplode(F.arrays_zip(F.col("pts").alias("a"), shifted.alias("b"))).alias("no", "e"))
    edges = each.select("g", "z", "rid", "no", *(F.col(f"e.{e}.{c}").alias(f"{c}{k}") for e, k in (("a", 0), ("b", 1)) for c in "xy"))
    several = rings.groupBy("g", "z").agg(F.count("*").alias("n")).where("n > 1").select("g", "z")
    cell = lambda v: F.floor(v / band).cast("long")
    middle = lambda c: (F.col("pts")[0][c] + F.col("pts")[1][c]) / 2
    at = rings.join(several, ["g", "z"], "left_semi").select("g", "z", F.col("rid").alias("own"), middle("x").alias("px"), middle("y").alias("py")).withColumn("band", cell(F.col("py")))
    sides = edges.where("y0 <> y1").join(several, ["g", "z"], "left_semi").withColumn("band", F.explode(F.sequence(cell(F.least("y0", "y1")), cell(F.greatest("y0", "y1")))))
    px, py, x0, y0, x1, y1 = (F.col(c) for c in ("px", "py", "x0", "y0", "x1", "y1"))
    right = ((y0 <= py) != (y1 <= py)) & (px < (x1 - x0) * (py - y0) / F.nullif(y1 - y0, F.lit(0.0)) + x0)
    crossed = at.join(sides, ["g", "z", "band"]).where((F.col("own") != F.col("rid")) & right).groupBy("own").agg(F.count("*").alias("n"))
    holes = crossed.where("n % 2 = 1").select(F.col("own").alias("rid"), F.lit(True).alias("hole"))
    marked = edges.join(holes, "rid", "left")
    ends = [F.when(F.col("hole"), F.col(f"{c}{1 - k}")).otherwise(F.col(f"{c}{k}")).alias(f"{c}{k}") for k in (0, 1) for c in "xy"]
    return marked.select("g", "rid", "no", *ends)


def _split(edges: DataFrame, size: float) -> DataFrame:
    """``g, x0, y0, x1, y1``: edges cut at the corners of the same group that lie on them."""
    corners = edges.select(F.col("g").alias("of"), F.col("x0").alias("px"), F.col("y0").alias("py")).distinct()
    apart = "(px <> x0 or py <> y0) and (px <> x1 or py <> y1)"
    on = near_pairs(corners, edges, 0.0, size).where("of = g").where(apart).drop("of", "d2").distinct()
    rows = edges.withColumns({"px": F.col("x0"), "py": F.col("y0")}).unionByName(on)
    dx, dy = F.col("px") - F.col("x0"), F.col("py") - F.col("y0")
    along = Window.partitionBy("rid", "no").orderBy(dx * dx + dy * dy)
    until = [F.coalesce(F.lead(f"p{c}").over(along), F.col(f"{c}1")).alias(f"{c}1") for c in "xy"]
    return rows.select("g", F.col("px").alias("x0"), F.col("py").alias("y0"), *until)


def _outer(parts: DataFrame) -> DataFrame:
    """``id, g, x0, y0, x1, y1``: the edges that are left when those that run both ways have cancelled each other."""
    a, b = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    way = F.when(a < b, 1).otherwise(-1)
    net = parts.groupBy("g", F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(F.sum(way).alias("net")).where("net <> 0")
    ends = [F.when(F.col("net") > 0, F.col(f"{p}.{c}")).otherwise(F.col(f"{q}.{c}")).alias(f"{c}{k}") for k, p, q in ((0, "a", "b"), (1, "b", "a")) for c in "xy"]
    left = stored(net.select(F.monotonically_increasing_id().alias("id"), "g", *ends, "net"))
    if not left.where("abs(net) > 1").isEmpty():
        raise ValueError("zones of a group overlap: an edge has two of them on one side")
    return left.drop("net")


def _following(edges: DataFrame) -> DataFrame:
    """``id, next``: the edge that goes on round the same piece of area, the leftmost one where several begin."""
    ray = lambda out, v, w: F.struct(F.lit(out).alias("out"), *(F.col(f"{c}{v}").alias(c) for c in "xy"), F.atan2(F.col(f"y{w}") - F.col(f"y{v}"), F.col(f"x{w}") - F.col(f"x{v}")).alias("turn"))
    rays = edges.select("id", "g", F.explode(F.array(ray(True, 0, 1), ray(False, 1, 0))).alias("r")).select("id", "g", "r.*")
    here = Window.partitionBy("g", "x", "y").orderBy("turn")
    whole = here.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = F.struct("id", "out")
    before = rays.withColumn("b", F.coalesce(F.lag(found).over(here), F.last(found).over(whole)))
    links = stored(before.where("not out").select("id", F.col("b.id").alias("next"), F.col("b.out").alias("fits")))
    if not links.where("not fits").isEmpty():
        raise ValueError("zones of a group overlap: their borders cross")
    return links.select("id", "next")


def _places(links: DataFrame) -> DataFrame:
    """``id, low, steps``: the least edge of the ring of each edge, and how many steps on it lies.

    Pointers are doubled: after k rounds an edge knows the least of the next 2^k ones. The first round in which no edge
    learns anything ends it, as all of a ring then agree, so rounds grow with the logarithm of the longest ring.
    """
    state, step = links.select("id", "next", F.col("id").alias("low"), F.lit(0).cast("long").alias("steps")), 1
    while True:
        ahead = state.select(F.col("id").alias("at"), F.col("next").alias("then"), F.col("low").alias("other"), F.col("steps").alias("more"))
        less = F.col("other") < F.col("low")
        moved = state.join(ahead, state.next == ahead["at"]).select(
            "id", F.col("then").alias("next"), F.when(less, F.col("other")).otherwise(F.col("low")).alias("low"), F.when(less, F.col("more") + step).otherwise(F.col("steps")).alias("steps"), less.alias("learnt")
        )
        moved, step = stored(moved), 2 * step
        state = moved.drop("learnt")
        if moved.where("learnt").isEmpty():
            return state.select("id", "low", "steps")


def dissolve(rings: DataFrame, group: str, key: str = "zone_id", points: str = "geometry", size: float = 1000.0) -> DataFrame:
    """``group, geometry, area``: a row for each ring about the union of the zones of a group.

    ``rings`` has a row for each ring of each zone, in any direction, closed or not; a ring inside another of its zone is
    a hole. Edges are cut where corners of the same group lie on them; those with a zone on each side cancel; at each
    corner that is left an edge finds the one that goes on round the same area, and rings are put in order by doubling
    these pointers. Outer rings run counter-clockwise and have a positive area, holes the other way and a negative one, so
    that the areas of a group add up to that of its zones. Rings are closed, begin at their least point and have no points
    on which they run straight; where areas only touch in a point, rings part.

    Zones of a group must not overlap; where that shows at an edge or a corner, it is refused with an error. Repeated rows
    are one. Rings without three different points or without area, and null ones, are left out. A null group is a group, a null
    key a zone. ``size`` is the width of the cells in which corners meet edges, about the usual length of an edge; it has
    no influence on the result. A corner is on an edge by the arithmetic of doubles. A task holds one ring at most.
    """
    kept = rings.select(F.struct(F.col(group).alias("v")).alias("g"), F.struct(F.col(key).alias("v")).alias("z"), _open(F.col(points).cast(_POINTS)).alias("pts")).where(F.size(F.array_distinct("pts")) > 2)
    kept = kept.withColumn("turn", g.signed_ring_area(F.col("pts"))).where("turn <> 0")
    kept = kept.select("g", "z", F.when(F.col("turn") < 0, F.reverse("pts")).otherwise(F.col("pts")).alias("pts"))
    numbered = stored(kept.withColumn("pts", _from_least(F.col("pts"))).distinct().withColumn("rid", F.monotonically_increasing_id()))
    edges = _outer(_split(stored(_edges(numbered, size)), size))
    placed = edges.join(_places(_following(edges)), "id")
    lined = placed.groupBy("g", "low").agg(F.array_sort(F.collect_list(F.struct((-F.col("steps")).alias("at"), F.col("x0").alias("x"), F.col("y0").alias("y")))).alias("v"))
    made = lined.select("g", F.transform("v", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("pts"))
    made = made.withColumn("pts", _from_least(_bent(F.col("pts"))))
    return made.select(F.col("g.v").alias(group), F.concat("pts", F.slice("pts", 1, 1)).alias("geometry"), g.signed_ring_area(F.col("pts")).alias("area"))
