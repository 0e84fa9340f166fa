"""Areas made of zones, tables stored by place, and contracts of parts of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarmac.functions import geometry as g
from tarmac.operators import contract as dq
from tarmac.operators import spatial as s
from tarmac.operators.dissolve import dissolve
from tarmac.operators.graph import shared_folder
from tarmac.plans.registry import query
from tarmac.plans.spatial_queries import _INSIDE
from tarmac.plans.sql import sql
from tarmac.sources import adapters as fx
from tarmac.sources import readers, writers

#: The tiles as cells, and the cells around each corner: a bit for each of the four.
_TILES = "WITH t AS (SELECT DISTINCT c_mktsegment AS grp, (c_custkey * 3301) % 10007 // 200 AS i, (c_custkey * 5417) % 10009 // 200 AS j FROM customer)"
_CORNERS = """, k AS (SELECT unnest([0, 1]) AS k), v AS (SELECT grp, i + a.k AS x, j + b.k AS y, CAST(sum(1 << (2 * a.k + b.k)) AS INT) AS mask FROM t, k a, k b GROUP BY ALL),
w AS (SELECT grp, x, y, CASE WHEN bit_count(mask) = 1 THEN 1 WHEN mask IN (6, 9) THEN 2 ELSE 0 END AS convex, CASE WHEN bit_count(mask) = 3 THEN 1 ELSE 0 END AS hollow FROM v)"""


def _dissolved(spark, d):
    return dissolve(fx.tiles(spark, d), "grp", size=200.0)


@query("geo10_dissolved_areas", _TILES + _CORNERS + """, c AS (SELECT grp, CAST(sum(convex + hollow) AS BIGINT) AS corners, CAST(sum(convex - hollow) // 4 AS BIGINT) AS outer_less_holes FROM w GROUP BY grp),
s AS (SELECT a.grp, count(*) AS pairs FROM t a JOIN t b ON a.grp = b.grp AND ((a.i + 1 = b.i AND a.j = b.j) OR (a.i = b.i AND a.j + 1 = b.j)) GROUP BY a.grp), n AS (SELECT grp, count(*) AS n FROM t GROUP BY grp)
SELECT grp, 40000.0 * n AS area, 200.0 * (4 * n - 2 * coalesce(pairs, 0)) AS length, corners, outer_less_holes FROM n JOIN c USING (grp) LEFT JOIN s USING (grp)""")
def dissolved_areas(spark, d):
    """Area, length of the border, corners, and outer rings less holes of each group of tiles, dissolved."""
    return _dissolved(spark, d).groupBy("grp").agg(
        F.sum("area").alias("area"), F.sum(g.length(F.col("geometry"))).alias("length"), F.sum(F.size("geometry") - 1).alias("corners"), F.sum(F.signum("area")).cast("long").alias("outer_less_holes")
    )


@query("geo10_border_points", _TILES + _CORNERS + " SELECT grp, CAST(200 * x AS DOUBLE) AS x, CAST(200 * y AS DOUBLE) AS y, CAST(convex + hollow AS BIGINT) AS rings FROM w WHERE convex + hollow > 0")
def border_points(spark, d):
    """The corners of the dissolved outlines, with the number of rings that bend there."""
    each = _dissolved(spark, d).select("grp", F.explode(F.slice("geometry", F.lit(2), F.size("geometry") - 1)).alias("p"))
    return each.groupBy("grp", "p.x", "p.y").agg(F.count("*").alias("rings"))


@query("geo10_points_in_dissolved", sql(_TILES + " SELECT t.grp, count(*) AS n FROM t JOIN pts p ON p.px >= 200 * i AND p.px < 200 * i + 200 AND p.py >= 200 * j AND p.py < 200 * j + 200 GROUP BY t.grp", "pts"))
def points_in_dissolved(spark, d):
    """Crashes in the dissolved area of each group: the borders between its members count for nothing."""
    rings = _dissolved(spark, d).select("grp", F.array("geometry").alias("rings"))
    edges = s.checkpoint(readers.ring_edges(rings, "grp"))
    found = s.zones_of_points(fx.points(spark, d).select("pid", "px", "py"), edges, 200.0, zone_id="grp")
    return found.groupBy("grp").agg(F.count("*").alias("n"))


def _stored(spark, df, **columns) -> str:
    folder = f"{shared_folder(spark)}/placed-{uuid.uuid4().hex}"
    writers.write_by_place(df, folder, **columns)
    return folder


@query("flt7_points_in_box", sql("SELECT pid, px, py FROM pts WHERE px BETWEEN 2000 AND 4500 AND py BETWEEN 6000 AND 7500", "pts"))
def points_in_box(spark, d):
    """Crashes stored by place and read again in a box, which the scan of the files is asked for."""
    return readers.stored_in_box(spark, _stored(spark, fx.points(spark, d).select("pid", "px", "py")), (2000, 6000, 4500, 7500))


@query("flt7_lines_in_box", sql("SELECT lid FROM lns WHERE greatest(x0, x1) >= 2000 AND least(x0, x1) <= 4500 AND greatest(y0, y1) >= 6000 AND least(y0, y1) <= 7500", "lns"))
def lines_in_box(spark, d):
    """Streets whose boxes meet a box, stored with their bounds."""
    bounds = {f"{f}_{c}": (F.least if f == "min" else F.greatest)(f"{c}0", f"{c}1") for f in ("min", "max") for c in "xy"}
    of = {"x": ("min_x", "max_x"), "y": ("min_y", "max_y")}
    return readers.stored_in_box(spark, _stored(spark, fx.lines(spark, d).select("lid", *(v.alias(k) for k, v in bounds.items())), **of), (2000, 6000, 4500, 7500), **of).select("lid")


@query("sj1_stored_clip", sql(f"SELECT p.pid, z.zone_id FROM pts p JOIN zns z ON {_INSIDE} WHERE z.district = 2", "pts", "zns"))
def stored_clip(spark, d):
    """Crashes strictly inside the zones of a district, of a table stored by place: only those in its box are read."""
    zones = fx.zones(spark, d).where("district = 2")
    box = zones.agg(F.min("xa"), F.min("ya"), F.max("xb"), F.max("yb")).first()
    points = readers.stored_in_box(spark, _stored(spark, fx.points(spark, d).select("pid", "px", "py")), tuple(box))
    return s.zones_of_points(points, fx.rectangle_edges(zones), 500.0, boundary="outside")


@query("dq10_status_by_station", sql("""WITH t AS (SELECT station_id, count(*) AS n, count(*) FILTER (op_speed IS NULL) AS unknown, avg(CAST(coalesce(ok, false) AS DOUBLE)) AS fine, count(*) FILTER (adt > 100000) AS high FROM rdg GROUP BY station_id)
SELECT station_id, CAST(CASE WHEN fine < 0.3 THEN 1 ELSE 0 END + CASE WHEN n < 500 THEN 1 ELSE 0 END AS BIGINT) AS errors, CAST(CASE WHEN unknown > 0 THEN 1 ELSE 0 END + CASE WHEN high > 0 THEN 1 ELSE 0 END AS BIGINT) AS warnings, fine >= 0.3 AND n >= 500 AS passed FROM t""", "rdg"))
def status_by_station(spark, d):
    """Whether the readings of each station hold their contract: errors fail it, warnings do not."""
    listed = [dq.row_count(500, 10_000_000), dq.share("fine", F.col("ok"), 0.3), dq.none_where("no speed", F.col("op_speed").isNull(), "warning"), dq.none_where("high", F.col("adt") > 100000, "warning")]
    return dq.statuses(dq.run_checks_by(fx.readings(spark, d), ["station_id"], listed), ["station_id"])
