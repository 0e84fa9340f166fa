"""Network jobs and published files over the adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import geometry as g
from tarmac.operators import network as n
from tarmac.operators.graph import connected_components
from tarmac.operators.simplify import simplify
from tarmac.plans.registry import query
from tarmac.plans.sql import near_box, piece_d2, point_d2, sql
from tarmac.sources import adapters as fx
from tarmac.sources import writers

_TWINS = f"""WITH t AS (SELECT a.lid AS src, b.lid AS dst FROM lns a JOIN lns b ON a.lid < b.lid AND a.name = b.name AND {near_box('a', 'b', 150)}
 WHERE (a.x1 - a.x0) * (b.x1 - b.x0) + (a.y1 - a.y0) * (b.y1 - b.y0) < 0 AND 2 * power((a.x1 - a.x0) * (b.x1 - b.x0) + (a.y1 - a.y0) * (b.y1 - b.y0), 2) >= (power(a.x1 - a.x0, 2) + power(a.y1 - a.y0, 2)) * (power(b.x1 - b.x0, 2) + power(b.y1 - b.y0, 2)) AND {piece_d2('a', 'b')} <= 22500)"""


def _chords(spark, d):
    return fx.lines(spark, d).withColumns({"ax": F.col("x0"), "ay": F.col("y0"), "bx": F.col("x1"), "by": F.col("y1")})


def _edges(spark, d):
    """Edges between numbered nodes, with list tags."""
    return fx.lines(spark, d).selectExpr("lid as key", "(lid * 7) % 331 as u", "(lid * 13 + lid div 3) % 331 as v", "array(highway) as highway", "array(name) as name", "length_ft", "array(struct(x0 as x, y0 as y), struct(x1 as x, y1 as y)) as geometry")


_EDGES = "e AS (SELECT lid AS key, (lid * 7) % 331 AS u, (lid * 13 + lid // 3) % 331 AS v, highway, name FROM lns)"


@query("sj15_twin_pairs", sql(_TWINS + " SELECT src, dst FROM t", "lns"))
def twins(spark, d):
    return n.twin_pairs(_chords(spark, d))


@query("sj15_bent_twins", sql(f"""WITH c AS (SELECT b.*, l.name, l.x1 - l.x0 AS dx, l.y1 - l.y0 AS dy FROM bls b JOIN lns l USING (lid))
SELECT DISTINCT a.lid AS src, b.lid AS dst FROM c a JOIN c b ON a.lid < b.lid AND a.name = b.name AND {near_box('a', 'b', 150)} WHERE a.dx * b.dx + a.dy * b.dy < 0 AND 2 * power(a.dx * b.dx + a.dy * b.dy, 2) >= (a.dx * a.dx + a.dy * a.dy) * (b.dx * b.dx + b.dy * b.dy) AND {piece_d2('a', 'b')} <= 22500""", "lns", "bls"))
def bent_twins(spark, d):
    """Twins by the directions of their chords and the distance of their nearest pieces."""
    return n.twin_pairs(fx.bent_lines(spark, d).join(_chords(spark, d).select("lid", "name", "oneway", "ax", "ay", "bx", "by"), "lid"))


@query("net3_twin_candidates", sql(_TWINS + " SELECT src AS lid FROM t UNION SELECT dst FROM t", "lns"))
def candidates(spark, d):
    return n.twin_pairs(_chords(spark, d)).select(F.explode(F.array("src", "dst")).alias("lid")).distinct()


@query("net4_components", sql(_TWINS.replace("WITH t AS", "WITH RECURSIVE t AS") + ", b AS (SELECT src AS a, dst AS b FROM t UNION SELECT dst, src FROM t), r AS (SELECT DISTINCT a AS node, a AS seen FROM b UNION SELECT r.node, b.b FROM r JOIN b ON r.seen = b.a) SELECT node, min(seen) AS component FROM r GROUP BY node", "lns").replace("WITH lns", "WITH RECURSIVE lns").replace("RECURSIVE t AS", "t AS"))
def components(spark, d):
    return connected_components(n.twin_pairs(_chords(spark, d)))


def _sides(spark, d):
    return n.two_sides(n.twin_pairs(_chords(spark, d)))


_WALKS = _TWINS + """, b AS (SELECT src AS a, dst AS b FROM t UNION SELECT dst, src FROM t), w AS (SELECT DISTINCT a AS start, a AS node, 0 AS k FROM b UNION SELECT w.start, b.b, w.k + 1 FROM w JOIN b ON w.node = b.a WHERE w.k < 24),
c AS (SELECT node, min(start) AS component FROM w GROUP BY node), sides AS (SELECT w.node, c.component, CAST(min(k) % 2 AS INT) AS side, min(k % 2) <> max(k % 2) AS conflict FROM w JOIN c ON c.node = w.node AND c.component = w.start GROUP BY 1, 2)"""


@query("net5_two_sides", sql(_WALKS + " SELECT node, component, side, conflict FROM sides", "lns", recursive=True))
def sides(spark, d):
    return _sides(spark, d)


def _pointers(spark, d):
    lines = fx.lines(spark, d).withColumns({"mx": (F.col("x0") + F.col("x1")) / 2, "my": (F.col("y0") + F.col("y1")) / 2})
    return n.representatives(_sides(spark, d), lines)


_REPS = _WALKS + f""", p AS (SELECT s.*, l.length_ft, (l.x0 + l.x1) / 2 AS mx, (l.y0 + l.y1) / 2 AS my FROM sides s JOIN lns l ON l.lid = s.node), len AS (SELECT component, side, round(sum(length_ft), 6) AS long FROM p GROUP BY 1, 2), kept AS (SELECT component, arg_min(side, struct_pack(a := -long, b := side)) AS kept FROM len GROUP BY 1),
ptr AS (SELECT d.node AS lid, d.component, arg_min(r.node, struct_pack(a := {point_d2('d.mx', 'd.my', 'l')}, b := r.node)) AS rep_lid FROM p d JOIN kept k ON k.component = d.component AND d.side <> k.kept JOIN p r ON r.component = d.component AND r.side = k.kept JOIN lns l ON l.lid = r.node GROUP BY 1, 2)"""


@query("sj16_representatives", sql(_REPS + " SELECT lid, component, rep_lid FROM ptr", "lns", recursive=True))
def representatives(spark, d):
    return _pointers(spark, d)


@query("agg8_merged_attributes", sql(_REPS + """, got AS (SELECT rep_lid, sum(lanes * length_ft) / sum(CASE WHEN lanes IS NOT NULL THEN length_ft END) AS half, count(*) AS n, string_agg(CAST(lid AS VARCHAR), '|' ORDER BY lid) AS ids FROM ptr JOIN lns USING (lid) GROUP BY 1)
SELECT l.lid, g.rep_lid IS NOT NULL AS merged_dual, coalesce(n, 0) AS n_twins_merged, ids AS twin_ids, round(CASE WHEN g.rep_lid IS NOT NULL THEN lanes + half ELSE lanes END, 6) AS lanes FROM lns l LEFT JOIN got g ON g.rep_lid = l.lid WHERE l.lid NOT IN (SELECT lid FROM ptr)""", "lns", recursive=True))
def merged(spark, d):
    base = fx.lines(spark, d).select("lid", "length_ft", "lanes", "highway", F.lit(None).cast("double").alias("maxspeed_mph"))
    out = n.merged_attributes(base, _pointers(spark, d).drop("component"), prefer=["highway"])
    return out.select("lid", "merged_dual", "n_twins_merged", "twin_ids", F.round("lanes", 6).alias("lanes"))


def _segments(spark, d):
    return fx.lines(spark, d).selectExpr("lid as seg_id", "(lid * 7) % 61 as u", "(lid * 13 + lid div 3) % 61 as v", "name", "highway", "length_ft")


#: Segments between numbered nodes, and the merge of short ones in sequence: a row a street and step, which holds the live
#: pieces, those still to be looked at in this pass, and where the others went.
_SEGS = "seg AS (SELECT lid AS seg_id, (lid * 7) % 61 AS u, (lid * 13 + lid // 3) % 61 AS v, name, highway, length_ft FROM lns)"
_ABSORB = """w AS (
SELECT name, 0 AS k, 0 AS pass, true AS changed, CAST([] AS BIGINT[]) AS todo, list(struct_pack(s := seg_id, u := u, v := v, d := length_ft) ORDER BY seg_id) AS live, CAST([] AS STRUCT(s BIGINT, b BIGINT)[]) AS gone
FROM {source} WHERE name IS NOT NULL GROUP BY name
UNION ALL
SELECT name, k + 1, CASE WHEN len(todo) = 0 THEN pass + 1 ELSE pass END, len(todo) > 0 AND (changed OR best IS NOT NULL),
 CASE WHEN len(todo) > 0 THEN todo[2:] ELSE list_transform(list_sort(list_transform(list_filter(live, lambda x: x.d < 100), lambda x: struct_pack(d := x.d, s := x.s))), lambda x: x.s) END,
 CASE WHEN best IS NULL THEN live ELSE list_transform(list_filter(live, lambda x: x.s <> me.s), lambda x: CASE WHEN x.s <> best.s THEN x
   ELSE struct_pack(s := x.s, u := CASE WHEN len(ends) = 2 THEN ends[1] ELSE x.u END, v := CASE WHEN len(ends) = 2 THEN ends[2] ELSE x.v END, d := x.d + me.d) END) END,
 CASE WHEN best IS NULL THEN gone ELSE list_append(gone, struct_pack(s := me.s, b := best.s)) END
FROM (SELECT *, list_sort(list_distinct(list_concat(list_filter([best.u, best.v], lambda x: x <> me.u AND x <> me.v), list_filter([me.u, me.v], lambda x: x <> best.u AND x <> best.v)))) AS ends
 FROM (SELECT *, list_sort(list_transform(list_filter(live, lambda x: x.s <> me.s AND x.d >= me.d AND (x.u = me.u OR x.u = me.v OR x.v = me.u OR x.v = me.v)), lambda x: struct_pack(less := -x.d, s := x.s, u := x.u, v := x.v)))[1] AS best
  FROM (SELECT *, list_filter(live, lambda x: x.s = todo[1])[1] AS me FROM w WHERE len(todo) > 0 OR (changed AND pass < 5)))))
, z AS (SELECT name, arg_max(live, k) AS live, arg_max(gone, k) AS gone FROM w GROUP BY name),
kept AS (SELECT x.s AS seg_id, x.d AS length_ft FROM (SELECT unnest(live) AS x FROM z) UNION ALL SELECT seg_id, length_ft FROM {source} WHERE name IS NULL),
went AS (SELECT x.s AS seg_id, x.b AS absorbed_into FROM (SELECT unnest(gone) AS x FROM z))"""


@query("net6_absorb_short", sql(f"WITH {_SEGS}, {_ABSORB.format(source='seg')} SELECT seg_id, round(length_ft, 4) AS length_ft, NULL AS absorbed_into FROM kept UNION ALL SELECT seg_id, NULL, absorbed_into FROM went", "lns", recursive=True))
def absorbed(spark, d):
    kept, into = n.absorb_short(_segments(spark, d))
    return kept.select("seg_id", F.round("length_ft", 4).alias("length_ft"), F.lit(None).cast("long").alias("absorbed_into")).unionByName(into.select("seg_id", F.lit(None).cast("double").alias("length_ft"), "absorbed_into"))


_CLEANED = f"""WITH {_SEGS}, links AS (SELECT * FROM seg WHERE ends_with(highway, '_link')), rest AS (SELECT * FROM seg WHERE NOT ends_with(highway, '_link')), {_ABSORB.format(source='rest')},
c AS (SELECT seg_id AS first, absorbed_into AS last FROM went UNION ALL SELECT c.first, went.absorbed_into FROM c JOIN went ON went.seg_id = c.last), e AS (SELECT first, last FROM c WHERE last NOT IN (SELECT seg_id FROM went)),
junk AS (SELECT k.* FROM kept k JOIN seg USING (seg_id) WHERE seg.name IS NULL AND k.length_ft < 50), removed AS (SELECT seg_id, length_ft FROM links UNION ALL SELECT seg_id, length_ft FROM junk),
away AS (SELECT coalesce(e.last, lid - 1) AS rep FROM lns LEFT JOIN e ON e.first = lid - 1 WHERE lid % 2 = 1)"""


@query("net7_clean_slivers", sql(_CLEANED + """ SELECT 'segments' AS layer, seg_id, round(length_ft, 4) AS length_ft, NULL AS orphan FROM kept WHERE seg_id NOT IN (SELECT seg_id FROM junk)
UNION ALL SELECT 'removed', seg_id, round(length_ft, 4), NULL FROM removed UNION ALL SELECT 'away', rep, NULL, rep IN (SELECT seg_id FROM removed) FROM away""", "lns", recursive=True))
def slivers(spark, d):
    away = fx.lines(spark, d).where("lid % 2 = 1").select("lid", (F.col("lid") - 1).alias("rep_seg_id"))
    tables = n.clean_slivers(_segments(spark, d), away)
    rows = [t.select(F.lit(k).alias("layer"), "seg_id", F.round("length_ft", 4).alias("length_ft"), F.lit(None).cast("boolean").alias("orphan")) for k, t in tables.items() if k != "away"]
    away = tables["away"].select(F.lit("away").alias("layer"), F.col("rep_seg_id").alias("seg_id"), F.lit(None).cast("double").alias("length_ft"), "orphan")
    return rows[0].unionByName(rows[1]).unionByName(away)


@query("net2_node_context", sql(f"WITH {_EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node) SELECT key, a.degree AS deg_u, b.degree AS deg_v, CAST(u % 5 = 0 AS INT) + CAST(v % 5 = 0 AS INT) AS n_signals FROM e JOIN d a ON a.node = u JOIN d b ON b.node = v", "lns"))
def context(spark, d):
    edges = _edges(spark, d)
    signals = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().where("node % 5 = 0")
    return n.with_node_context(edges, signals).select("key", "deg_u", "deg_v", "n_signals")


@query("net1_undirected", sql(f"WITH {_EDGES} SELECT key, least(u, v) AS a, greatest(u, v) AS b FROM e", "lns"))
def undirected(spark, d):
    edges = _edges(spark, d)
    back = edges.select("key", F.col("v").alias("u"), F.col("u").alias("v"), F.reverse("geometry").alias("geometry"))
    both = edges.select("key", "u", "v", "geometry").unionByName(back)
    return n.undirected(both).select("key", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))


@query("flt1_without_limited_access", sql("SELECT lid AS key FROM lns WHERE highway <> 'primary' AND (name IS NULL OR name NOT LIKE 'Street 9%')", "lns"))
def surface(spark, d):
    return n.without_limited_access(_edges(spark, d), ["primary"], "street 9").select("key")


@query("flt2_nodes_after_removal", sql(f"WITH {_EDGES}, k AS (SELECT * FROM e WHERE highway <> 'primary' AND (name IS NULL OR name NOT LIKE 'Street 9%')) SELECT DISTINCT osmid FROM (SELECT u AS osmid FROM k UNION SELECT v FROM k)", "lns"))
def left_nodes(spark, d):
    edges = _edges(spark, d)
    nodes = edges.select(F.explode(F.array("u", "v")).alias("osmid")).distinct()
    return n.used_nodes(nodes, n.without_limited_access(edges, ["primary"], "street 9"))


@query("flt9_link_rule", sql("SELECT lid, CASE WHEN highway = 'secondary_link' THEN 'link class' ELSE 'kept' END AS outcome FROM lns", "lns"))
def link_rule(spark, d):
    kept, gone = n.split_by(fx.lines(spark, d), F.col("highway").endswith("_link"), n.LINK_REASON)
    return kept.select("lid", F.lit("kept").alias("outcome")).unionByName(gone.select("lid", F.col("removal_reason").alias("outcome")))


@query("flt10_fragment_rule", sql("SELECT lid FROM lns WHERE name IS NULL AND length_ft < 50", "lns"))
def fragment_rule(spark, d):
    return n.split_by(fx.lines(spark, d), (F.col("length_ft") < 50) & F.col("name").isNull(), n.FRAGMENT_REASON)[1].select("lid")


@query("jn8_follow_pointers", sql("SELECT lid AS seg_id, CAST(lid % 10 AS BIGINT) AS absorbed_into FROM lns WHERE lid >= 10", "lns"))
def pointers(spark, d):
    return n.follow_pointers(fx.lines(spark, d).where("lid >= 10").select(F.col("lid").alias("seg_id"), (F.col("lid") - 10).alias("absorbed_into")))


def _shapes(spark, d):
    """Bent lines from customer, each of three points."""
    v = fx.value_lines(spark, d)
    bent = g.line((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0")), (F.col("x1"), F.col("y1")))
    return v.select("sid", bent.alias("geometry"), "speed", "median_type")


@query("geo2_lengths", sql("SELECT sid, abs(x1 - x0) + abs(y1 - y0) AS length, round(CASE WHEN (x1 = x0 AND y1 = y0) THEN 0 ELSE (degrees(atan2(x1 - x0, y1 - y0)) + 360) % 360 END, 6) AS bearing FROM vls", "vls"))
def lengths(spark, d):
    return _shapes(spark, d).select("sid", g.length(F.col("geometry")).alias("length"), F.round(g.compass_bearing(F.col("geometry")), 6).alias("bearing"))


@query("geo4_midpoints", sql("""WITH s AS (SELECT sid, x0, y0, x1, y1, abs(x1 - x0) AS a, abs(y1 - y0) AS b FROM vls WHERE x0 <> x1 OR y0 <> y1)
SELECT sid, round(CASE WHEN a >= b AND a > 0 THEN x0 + (x1 - x0) * ((a + b) / 2) / a ELSE x1 END, 6) AS x, round(CASE WHEN a >= b AND a > 0 THEN y0 ELSE y0 + (y1 - y0) * ((a + b) / 2 - a) / b END, 6) AS y FROM s""", "vls"))
def midpoints(spark, d):
    m = _shapes(spark, d).where(g.length(F.col("geometry")) > 0).select("sid", g.midpoint(F.col("geometry")).alias("m"))
    return m.select("sid", F.round("m.x", 6).alias("x"), F.round("m.y", 6).alias("y"))


@query("geo5_pieces", sql("SELECT sid, piece, x0, y0, x1, y1 FROM (SELECT sid, 0 AS piece, x0, y0, x1, y0 AS y1 FROM vls UNION ALL SELECT sid, 1, x1, y0, x1, y1 FROM vls)", "vls"))
def pieces(spark, d):
    return g.explode_pieces(_shapes(spark, d).select("sid", "geometry")).select("sid", "piece", "x0", "y0", "x1", "y1")


@query("geo9_ring_areas", sql("SELECT zone_id, area FROM pcl", "pcl"))
def areas(spark, d):
    p = fx.parcels(spark, d)
    ring = g.line((F.col("xa"), F.col("ya")), (F.col("xb"), F.col("ya")), (F.col("xb"), F.col("yb")), (F.col("xa"), F.col("yb")))
    return p.select("zone_id", g.ring_area(ring).alias("area"))


@query("geo13_bounding_box", sql("SELECT round_even(min(px) - 0.01, 4) AS xmin, round_even(min(py) - 0.01, 4) AS ymin, round_even(max(px) + 0.01, 4) AS xmax, round_even(max(py) + 0.01, 4) AS ymax FROM pts", "pts"))
def box(spark, d):
    return g.bounding_box(fx.points(spark, d), "px", "py")


@query("geo1_projection_round_trip", sql("SELECT pid, round(px / 10000, 7) AS lon, round(py / 10000, 7) AS lat FROM pts", "pts"))
def round_trip(spark, d):
    from tarmac.functions.projection import to_degrees, to_feet

    p = fx.points(spark, d)
    x, y = to_feet(F.col("px") / 10000 - 95.9, F.col("py") / 10000 + 29.4)
    lon, lat = to_degrees(F.col("x"), F.col("y"))
    return p.withColumns({"x": x, "y": y}).select("pid", F.round(lon + 95.9, 7).alias("lon"), F.round(lat - 29.4, 7).alias("lat"))


@query("geo14_simplified", sql("SELECT sid, CASE WHEN x0 = x1 OR y0 = y1 OR abs((x1 - x0) * (y1 - y0)) / sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) <= 25 THEN 2 ELSE 3 END AS n FROM vls", "vls"))
def simplified(spark, d):
    return simplify(_shapes(spark, d).select("sid", "geometry"), 25.0).select("sid", F.size("geometry").alias("n"))


@query("snk4_geojson_lines", sql("""SELECT '{"type":"Feature","properties":{"sid":' || CAST(sid AS VARCHAR) || ',"median_type":"' || median_type || '"},"geometry":{"type":"LineString","coordinates":[[' || CAST(x0 AS VARCHAR) || ',' || CAST(y0 AS VARCHAR) || '],[' || CAST(x1 AS VARCHAR) || ',' || CAST(y0 AS VARCHAR) || '],[' || CAST(x1 AS VARCHAR) || ',' || CAST(y1 AS VARCHAR) || ']]}}' AS value FROM vls""", "vls"))
def geojson(spark, d):
    return writers.geojson_lines(_shapes(spark, d), ["sid", "median_type"])


@query("snk5_positional_rows", sql("SELECT '[' || CAST(pid AS VARCHAR) || ',' || CASE WHEN severe THEN '1' ELSE '0' END || ',' || CASE WHEN user_id % 5 = 0 THEN 'null' ELSE '\"d' || CAST(user_id % 5 AS VARCHAR) || '\"' END || ']' AS value FROM pts", "pts"))
def positional(spark, d):
    p = fx.points(spark, d).select("pid", "severe", F.expr("case when user_id % 5 <> 0 then concat('d', user_id % 5) end").alias("district"))
    return writers.positional_rows(p, ["pid", "severe", "district"])


@query("snk7_summary", sql("SELECT '{\"toll\":{\"n\":' || CAST(count(*) AS VARCHAR) || ',\"severe\":' || CAST(count(*) FILTER (severe) AS VARCHAR) || '},\"ped\":' || CAST(count(*) FILTER (ped) AS VARCHAR) || '}' AS value FROM pts", "pts"))
def summary(spark, d):
    one = fx.points(spark, d).agg(F.struct(F.count("*").alias("n"), F.count_if("severe").alias("severe")).alias("toll"), F.count_if("ped").alias("ped"))
    return writers.summary_document(one)
