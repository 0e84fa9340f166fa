"""Whole jobs: assignment with merged-away halves, edge normalisation, clipped overlays and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.functions import geometry as g
from tarmac.functions import projection, tags
from tarmac.operators import concentration as c
from tarmac.operators import conflate, facets, records
from tarmac.operators import contract as dq
from tarmac.operators import network as n
from tarmac.operators import spatial as s
from tarmac.operators.simplify import simplify
from tarmac.plans.analysis_queries import _FACTS, facts
from tarmac.plans.registry import query
from tarmac.plans.spatial_queries import _COUNTS, _HELD, _NEAREST, _SAMPLES, REACH, _pieces, _zone_edges, assigned, counted
from tarmac.plans.sql import degrees, near_box, piece_d2, point_d2, sql
from tarmac.sources import adapters as fx
from tarmac.sources import writers

# Odd lines are halves that were merged away into their even twins.
_HALVES = _NEAREST.replace(
    "b AS (SELECT pid, arg_min(lid, struct_pack(d2 := d2, lid := lid)) AS lid, min(d2) AS d2 FROM m WHERE d2 <= 40000 GROUP BY pid)",
    """s AS (SELECT * FROM lns WHERE lid % 2 = 0), b AS (SELECT pid, arg_min(lid - lid % 2, struct_pack(d2 := d2, lid := lid)) AS lid, min(d2) AS d2 FROM m WHERE d2 <= 40000 AND lid - lid % 2 IN (SELECT lid FROM s) GROUP BY pid)""",
)


def _merged(spark, d):
    """(segments, merged-away halves with rep_seg_id)."""
    lines = fx.lines(spark, d)
    return lines.where("not lid % 2 = 1"), lines.where("lid % 2 = 1").withColumn("rep_seg_id", F.col("lid") - 1)


def _credited(spark, d):
    segments, away = _merged(spark, d)
    p = fx.points(spark, d)
    return segments, p.join(s.assign(p.select("pid", "px", "py"), segments, away, REACH).hint("merge"), "pid")


@query("sj4_assignment_with_halves", sql(_HALVES + " SELECT pid, lid, round(d2, 6) AS d2 FROM b", "pts", "lns"))
def assignment(spark, d):
    return _credited(spark, d)[1].select("pid", "lid", F.round("d2", 6).alias("d2"))


_CREDITED = _HALVES + """, c AS (SELECT lid, count(*) AS n_crash, count(*) FILTER (any_injury) AS n_injury, count(*) FILTER (severe) AS n_severe, count(*) FILTER (fatal) AS n_fatal, count(*) FILTER (ped) AS n_ped, count(*) FILTER (bike) AS n_bike,
 count(*) FILTER (ped AND severe) AS n_ped_severe, count(*) FILTER (bike AND severe) AS n_bike_severe FROM b JOIN pts USING (pid) GROUP BY lid),
g AS (SELECT s.lid, s.name, s.length_ft, """ + ", ".join(f"coalesce({x}, 0) AS {x}" for x in ("n_crash", "n_injury", "n_severe", "n_fatal", "n_ped", "n_bike", "n_ped_severe", "n_bike_severe")) + " FROM s LEFT JOIN c USING (lid))"


@query("agg1_counts_with_halves", sql(_CREDITED + " SELECT lid, n_crash, n_injury, n_severe, n_fatal, n_ped, n_bike, n_ped_severe, n_bike_severe FROM g", "pts", "lns"))
def counts_with_halves(spark, d):
    segments, crashes = _credited(spark, d)
    return records.with_counts(segments.select("lid"), records.counts_per_segment(crashes))


@query("rpt3_assignment_report", sql(_CREDITED + """, a AS (SELECT count(*) AS assigned, count(*) FILTER (severe) AS severe, count(*) FILTER (ped) AS ped, round(quantile_cont(sqrt(d2), 0.5), 4) AS p50, round(quantile_cont(sqrt(d2), 0.95), 4) AS p95, round(max(sqrt(d2)), 4) AS farthest FROM b JOIN pts USING (pid)),
t AS (SELECT CAST(sum(n_crash) AS BIGINT) AS c, CAST(sum(n_severe) AS BIGINT) AS v, CAST(sum(n_ped) AS BIGINT) AS w, count(*) FILTER (n_severe > 0) AS with_severe, max(n_severe) AS most FROM g)
SELECT assigned, (SELECT count(*) FROM pts) - assigned AS unassigned, p50, p95, farthest, assigned = c AS crashes_agree, severe = v AS severe_agree, ped = w AS ped_agree, with_severe, most FROM a, t""", "pts", "lns"))
def assignment_report(spark, d):
    segments, crashes = _credited(spark, d)
    crashes = s.checkpoint(crashes.select("pid", "lid", F.sqrt("d2").alias("feet"), "any_injury", "severe", "fatal", "ped", "bike"))
    quantiles = c.exact_quantiles(crashes, "feet", {"p50": 0.5, "p95": 0.95})
    left = crashes.agg(F.count("*").alias("assigned"), F.count_if("severe").alias("severe"), F.count_if("ped").alias("ped"), F.round(F.max("feet"), 4).alias("farthest"))
    right = records.with_counts(segments.select("lid"), records.counts_per_segment(crashes)).agg(
        F.sum("n_crash").alias("c"), F.sum("n_severe").alias("v"), F.sum("n_ped").alias("w"), F.count_if(F.col("n_severe") > 0).alias("with_severe"), F.max("n_severe").alias("most")
    )
    every = fx.points(spark, d).agg(F.count("*").alias("n"))
    one = left.crossJoin(right).crossJoin(every).crossJoin(quantiles)  # a row each
    return one.select(
        "assigned", (F.col("n") - F.col("assigned")).alias("unassigned"), F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "farthest",
        (F.col("assigned") == F.col("c")).alias("crashes_agree"), (F.col("severe") == F.col("v")).alias("severe_agree"), (F.col("ped") == F.col("w")).alias("ped_agree"), "with_severe", "most",
    )


@query("top1_merged_corridors", sql("SELECT name, round(sum(length_ft) / 5280, 6) AS miles FROM lns a WHERE lid % 2 = 0 AND name IS NOT NULL AND EXISTS (SELECT 1 FROM lns b WHERE b.lid = a.lid + 1) GROUP BY name ORDER BY 2 DESC, 1 LIMIT 15", "lns"))
def merged_corridors(spark, d):
    segments, away = _merged(spark, d)
    merged = segments.join(away.select(F.col("rep_seg_id").alias("lid")), "lid", "left_semi").where("name is not null")
    return facets.top(merged, ["name"], F.round(F.sum("length_ft") / 5280, 6), 15, "miles")


# Tags of edges by part: two values, one, or none.
_TAGS = "CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN '{a}' ELSE '{b}' END"


@query("net8_normalised_edges", """SELECT p_partkey AS key, CASE WHEN p_size % 3 = 0 THEN CAST(p_partkey AS VARCHAR) || '|7' ELSE CAST(p_partkey AS VARCHAR) END AS osmid, CASE WHEN p_size % 5 <> 0 THEN p_name END AS name,
 CASE WHEN p_size % 2 = 0 THEN 'primary' ELSE 'residential' END AS highway, CASE WHEN p_size % 2 = 0 THEN 'primary|secondary' ELSE 'residential' END AS highway_all, p_size % 3 = 1 AS oneway,
 CASE p_size % 4 WHEN 1 THEN 2.0 WHEN 2 THEN 4.0 END AS lanes, CASE p_size % 3 WHEN 0 THEN 35.0 WHEN 1 THEN 45.0 END AS maxspeed_mph, CASE p_size % 3 WHEN 0 THEN 24.0 WHEN 1 THEN 10 * 3.28084 END AS width_ft, CAST(NULL AS VARCHAR) AS surface,
 CASE p_size % 3 WHEN 0 THEN 'yes' WHEN 1 THEN 'no' END AS lit, CASE p_size % 7 WHEN 0 THEN 'both' WHEN 1 THEN 'one_side' WHEN 2 THEN 'none' WHEN 3 THEN 'both' WHEN 4 THEN 'none' WHEN 5 THEN 'one_side' END AS sidewalk,
 CASE p_size % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'lane|track' WHEN 2 THEN 'lane' END AS cycleway, CASE p_size % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'present' END AS parking FROM part""")
def normalised(spark, d):
    raw = spark.read.parquet(f"{d}/part.parquet").selectExpr(
        "p_partkey as u", "p_partkey + 1 as v", "p_partkey as key", "case when p_size % 3 = 0 then array(cast(p_partkey as string), '7') else array(cast(p_partkey as string)) end as osmid", "case when p_size % 5 <> 0 then array(p_name, 'Other') end as name",
        "case when p_size % 2 = 0 then array('primary', 'secondary') else array('residential') end as highway", "array(case when p_size % 3 = 1 then 'yes' else 'no' end) as oneway", "case p_size % 4 when 1 then array('2') when 2 then array('4;3', '2') when 3 then array('many') end as lanes",
        "case p_size % 3 when 0 then array('35 mph') when 1 then array('45', '30') else array('signals') end as maxspeed", "case p_size % 3 when 0 then array('24 ft') when 1 then array('10 m') else array() end as width", "case p_size % 3 when 0 then array('Yes') when 1 then array('limited') end as lit",
        "case p_size % 7 when 0 then array('separate') when 1 then array('left') when 2 then array('no') when 5 then array('yes') end as sidewalk", "case p_size % 7 when 3 then array('yes') when 4 then array('none') end as `sidewalk:left`", "case p_size % 7 when 3 then array('yes') when 4 then array('no') end as `sidewalk:right`",
        "case p_size % 4 when 0 then array('no') when 1 then array('track') when 2 then array('none') end as cycleway", "case p_size % 4 when 1 then array('lane') when 2 then array('lane', 'track') end as `cycleway:right`", "case p_size % 3 when 0 then array('no_parking') when 1 then array('parallel') end as `parking:lane:both`",
    )
    return n.normalised_edges(raw, ["key"])


@query("str9_text_codes", "SELECT c_custkey AS id, c_mktsegment AS code FROM customer")
def text_codes(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey as id", "concat(repeat(' ', c_custkey % 3), c_mktsegment, repeat(' ', c_custkey % 4)) as code")
    return c.select("id", tags.text_code(F.col("code")).alias("code"))


_SNAPPED = _SAMPLES + f""", m AS (SELECT s.lid, s.k, v.sid, v.speed, v.city_name, round({point_d2('s.px', 's.py', 'v')}, 4) AS d2 FROM s JOIN vls v ON abs(s.px - v.x0) <= 250 AND abs(s.py - v.y0) <= 250),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lid, k ORDER BY d2, sid) AS r FROM m WHERE d2 <= 3600) WHERE r = 1), a AS (SELECT lid, count(*) AS n FROM b GROUP BY lid),
v1 AS (SELECT lid, arg_min(speed, struct_pack(a := -k, b := speed)) AS speed FROM (SELECT lid, speed, count(*) AS k FROM b WHERE speed IS NOT NULL GROUP BY 1, 2) GROUP BY lid),
v2 AS (SELECT lid, arg_min(city_name, struct_pack(a := -k, b := city_name)) AS city_name FROM (SELECT lid, city_name, count(*) AS k FROM b GROUP BY 1, 2) GROUP BY lid)"""


@query("sj8_speed_and_name", sql(_SNAPPED + " SELECT l.lid, round_even(coalesce(n, 0) / 5, 3) AS match_frac, CASE WHEN n >= 2 THEN v1.speed END AS speed, CASE WHEN n >= 2 THEN v2.city_name END AS city_name FROM lns l LEFT JOIN a USING (lid) LEFT JOIN v1 USING (lid) LEFT JOIN v2 USING (lid)", "lns", "vls"))
def speed_and_name(spark, d):
    lines = fx.lines(spark, d).withColumn("geometry", g.line((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y1"))))
    return s.snap_match(lines, fx.value_lines(spark, d), {"speed": "mode", "city_name": "mode"})


@query("snk3_flat_file", sql("WITH q AS (SELECT lid, name, lanes, (x0 + x1) / 2 + 3000000 AS x, (y0 + y1) / 2 + 13800000 AS y FROM lns), p AS (" + degrees("q") + ") SELECT lid, name, lanes, round(lat, 6) AS lat, round(lon, 6) AS lon, true AS url_agrees FROM p", "lns"))
def flat_file(spark, d):
    """The URL must hold the very coordinates of its row."""
    lines = fx.lines(spark, d).withColumn("geometry", g.line((F.col("x0") + 3_000_000, F.col("y0") + 13_800_000), (F.col("x1") + 3_000_000, F.col("y1") + 13_800_000)))
    flat = writers.flat_rows(lines.select("lanes", "lid", "name", "geometry"), ["lid", "name"])
    at = F.split(F.substring_index("map_url", "=", -1), ",")
    same = (F.abs(at[0].cast("double") - F.col("lat")) < 1e-6) & (F.abs(at[1].cast("double") - F.col("lon")) < 1e-6)
    return flat.select("lid", "name", "lanes", "lat", "lon", same.alias("url_agrees"))


@query("snk6_outline_points", sql("WITH c AS (SELECT zone_id, unnest([0, 1, 2, 3]) AS k, unnest([xa, xb, xb, xa]) AS x, unnest([ya, ya, yb, yb]) AS y FROM zns) SELECT zone_id, k, x, y FROM c", "zns"))
def outline_points(spark, d):
    z = fx.zones(spark, d)
    ring = g.line((F.col("xa"), F.col("ya")), (F.col("xb"), F.col("ya")), (F.col("xb"), F.col("ya") + 20), (F.col("xb"), F.col("yb")), (F.col("xa"), F.col("yb")))
    return simplify(z.select("zone_id", ring.alias("geometry")), 100.0).select("zone_id", F.posexplode("geometry").alias("k", "p")).select("zone_id", "k", "p.x", "p.y")


_CLIP = f"""WITH z AS (SELECT * FROM zns WHERE zone_id = 12), e AS (SELECT unnest([xa, xb, xb, xa]) AS x0, unnest([ya, ya, yb, yb]) AS y0, unnest([xb, xb, xa, xa]) AS x1, unnest([ya, yb, yb, ya]) AS y1 FROM z),
bent AS (SELECT sid, x0, y0, x1, y0 AS y1 FROM vls UNION ALL SELECT sid, x1, y0, x1, y1 FROM vls), h AS (SELECT l.sid FROM bent l, e WHERE {near_box('l', 'e', 0)} AND {piece_d2('l', 'e')} = 0 UNION
 SELECT l.sid FROM bent l, z WHERE (l.x0 >= z.xa AND l.x0 < z.xb AND l.y0 >= z.ya AND l.y0 < z.yb) OR (l.x1 >= z.xa AND l.x1 < z.xb AND l.y1 >= z.ya AND l.y1 < z.yb)),
c AS (SELECT sid, CASE WHEN x0 = x1 OR y0 = y1 OR abs((x1 - x0) * (y1 - y0)) / sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) <= 15 THEN [[x0, y0], [x1, y1]] ELSE [[x0, y0], [x1, y0], [x1, y1]] END AS pts_ FROM vls JOIN h USING (sid)),
q AS (SELECT sid, k - 1 AS k, pts_[k][1] + 3000000 AS x, pts_[k][2] + 13800000 AS y FROM c, LATERAL (SELECT unnest(generate_series(1, len(pts_))) AS k)), p AS ({degrees('q')})"""


@query("snk8_overlay_points", sql(_CLIP + " SELECT sid, k, round(lon, 5) AS lon, round(lat, 5) AS lat FROM p", "vls", "zns"))
def overlay_points(spark, d):
    """Lines that meet the area, simplified to 15 feet, in degrees."""
    v = fx.value_lines(spark, d)
    bent = v.select("sid", g.line((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0")), (F.col("x1"), F.col("y1"))).alias("geometry"))
    area = _zone_edges(spark, d).where("zone_id = 12")
    held = s.lines_in_zones(g.explode_pieces(bent).select("sid", "x0", "y0", "x1", "y1"), area, 500.0, "sid").select("sid")
    moved = simplify(bent.join(held, "sid", "left_semi"), 15.0).withColumn("geometry", F.transform("geometry", lambda p: F.struct((p["x"] + 3_000_000).alias("x"), (p["y"] + 13_800_000).alias("y"))))
    at = moved.select("sid", F.posexplode(projection.project_line(F.col("geometry"), inverse=True)).alias("k", "p"))
    return at.select("sid", "k", F.round("p.x", 5).alias("lon"), F.round("p.y", 5).alias("lat"))


_CLASSES = ("primary", "secondary", "tertiary", "primary_link", "secondary_link", "tertiary_link")
_ARTERIAL = "highway IN (" + ", ".join(f"'{x}'" for x in _CLASSES) + ")"


def _rows(frames):
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


@query("rpt1_coverage_report", sql(" UNION ALL ".join([
    "SELECT 'class' AS section, highway AS item, CAST(count(*) AS DOUBLE) AS a, round(sum(length_ft) / 5280, 4) AS b, CAST(NULL AS DOUBLE) AS c FROM lns GROUP BY highway",
    *(f"SELECT 'quantile', 'p{k}', round(quantile_cont(length_ft, {k / 100}), 4), NULL, NULL FROM lns" for k in (5, 25, 50, 75, 95)),
    *(f"SELECT 'coverage', '{x}', round(100 * avg(CAST({x} IS NOT NULL AS INT)), 6), round(100 * avg(CAST({x} IS NOT NULL AS INT)) FILTER ({_ARTERIAL}), 6), round(100 * avg(CAST({x} IS NOT NULL AS INT)) FILTER (NOT {_ARTERIAL}), 6) FROM lns" for x in ("name", "lanes")),
    "SELECT 'total', 'all', CAST(count(*) AS DOUBLE), round(sum(length_ft) / 5280, 4), NULL FROM lns",
]), "lns"))
def coverage_report(spark, d):
    """Rows of a table of classes (n, miles), quantiles of lengths, and shares of known values: overall, arterial, local."""
    lines = fx.lines(spark, d)
    none = F.lit(None).cast("double")
    sizes = [F.count("*").cast("double").alias("a"), F.round(F.sum("length_ft") / 5280, 4).alias("b")]
    names = {f"p{k}": k / 100 for k in (5, 25, 50, 75, 95)}
    quantiles = c.exact_quantiles(lines, "length_ft", names).select(F.explode(F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*names))).alias("item", "a"))
    arterial = F.col("highway").isin(*_CLASSES)
    cover = []
    for x in ("name", "lanes"):
        known = F.col(x).isNotNull().cast("int")
        share = lambda where: F.round(100 * F.avg(F.when(where, known)), 6)  # noqa: B023, E731
        cover.append(lines.agg(share(F.lit(True)).alias("a"), share(arterial).alias("b"), share(~arterial).alias("c")).select(F.lit("coverage").alias("section"), F.lit(x).alias("item"), "a", "b", "c"))
    return _rows([
        lines.groupBy(F.col("highway").alias("item")).agg(*sizes).select(F.lit("class").alias("section"), "item", "a", "b", none.alias("c")),
        quantiles.select(F.lit("quantile").alias("section"), "item", F.round("a", 4).alias("a"), none.alias("b"), none.alias("c")), *cover,
        lines.agg(*sizes).select(F.lit("total").alias("section"), F.lit("all").alias("item"), "a", "b", none.alias("c")),
    ])


# Crash extracts by customer: every fifth row stands twice; some lack a place, lie outside all zones or on a freeway.
_RAW = f"""WITH u AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 3 <> 0 THEN 'cris' ELSE 'reported' END AS coord_source, CAST((c_custkey * 3301) % 10007 AS DOUBLE) AS px, CAST((c_custkey * 5417) % 10009 AS DOUBLE) AS py, c_nationkey IN (1, 6, 8, 9) OR c_custkey % 11 IN (2, 3, 4, 5) AS freeway FROM customer),
i AS (SELECT p.id FROM u p WHERE EXISTS (SELECT 1 FROM zns z WHERE {_HELD})), a AS (SELECT u.*, i.id IS NOT NULL AS inside FROM u LEFT JOIN i USING (id))"""


@query("rpt2_build_funnel", sql(_RAW + """ SELECT count(*) AS unique_crashes, count(coord_source) AS geocoded, count(*) FILTER (coord_source IS NOT NULL AND inside) AS in_area, count(*) FILTER (coord_source IS NOT NULL AND inside AND freeway) AS excluded, count(*) FILTER (coord_source IS NOT NULL AND inside AND NOT freeway) AS kept,
 count(*) FILTER (coord_source = 'cris' AND inside AND NOT freeway) AS from_cris, count(*) FILTER (coord_source = 'reported' AND inside AND NOT freeway) AS from_reported FROM a""", "zns"))
def build_funnel(spark, d):
    raw = spark.read.parquet(f"{d}/customer.parquet").selectExpr(
        "c_custkey as id", "explode(sequence(0, case when c_custkey % 5 = 0 then 1 else 0 end)) as copy", "case when c_custkey % 13 <> 0 and c_custkey % 3 <> 0 then '29.5' end as Latitude", "case when c_custkey % 13 <> 0 then '29.6' end as Rpt_Latitude", "'-95.0' as Longitude", "cast(null as string) as Rpt_Longitude",
        "cast((c_custkey * 3301) % 10007 as double) as px", "cast((c_custkey * 5417) % 10009 as double) as py", "cast(c_nationkey as string) as Road_Cls_ID", "cast(c_custkey % 11 as string) as Rpt_Road_Part_ID", "cast(null as string) as Rpt_Street_Name",
    )
    unique = records.keep_first(raw, ["id"], ["copy"])
    located = records.in_box(records.with_coordinates(unique))
    inside = located.join(s.zones_of_points(located.select(F.col("id").alias("pid"), "px", "py"), _zone_edges(spark, d), 500.0).select(F.col("pid").alias("id")), "id", "left_semi")
    kept = records.without_limited_access(inside)
    steps = unique.select("id").join(located.select("id", F.lit(True).alias("located")), "id", "left").join(inside.select("id", F.lit(True).alias("inside")), "id", "left").join(kept.select("id", "coord_source"), "id", "left")
    return steps.agg(
        F.count("*").alias("unique_crashes"), F.count("located").alias("geocoded"), F.count("inside").alias("in_area"), F.count_if(F.col("inside") & F.col("coord_source").isNull()).alias("excluded"), F.count("coord_source").alias("kept"),
        F.count_if(F.col("coord_source") == "cris").alias("from_cris"), F.count_if(F.col("coord_source") == "reported").alias("from_reported"),
    )


@query("rpt4_merge_report", sql(" UNION ALL ".join(f"SELECT '{name}' AS step, count(*) AS n, round(coalesce(sum(length_ft), 0) / 5280, 4) AS miles FROM lns WHERE {where}" for name, where in (
    ("before", "true"), ("merged away", "lid % 2 = 1"), ("links removed", "lid % 2 = 0 AND highway = 'secondary_link'"), ("fragments removed", "lid % 2 = 0 AND highway <> 'secondary_link' AND length_ft < 50 AND name IS NULL"),
    ("after", "lid % 2 = 0 AND highway <> 'secondary_link' AND NOT (length_ft < 50 AND name IS NULL)"), ("orphaned halves", "lid % 2 = 1 AND EXISTS (SELECT 1 FROM lns r WHERE r.lid = lns.lid - 1 AND (r.highway = 'secondary_link' OR (r.length_ft < 50 AND r.name IS NULL)))"),
)), "lns"))
def merge_report(spark, d):
    segments, away = _merged(spark, d)
    kept, links = n.split_by(segments, F.col("highway").endswith("_link"), n.LINK_REASON)
    kept, junk = n.split_by(kept, (F.col("length_ft") < 50) & F.col("name").isNull(), n.FRAGMENT_REASON)
    removed = links.select("lid").unionByName(junk.select("lid"))
    orphans = away.join(removed.select(F.col("lid").alias("rep_seg_id")), "rep_seg_id", "left_semi")
    steps = {"before": fx.lines(spark, d), "merged away": away, "links removed": links, "fragments removed": junk, "after": kept, "orphaned halves": orphans}
    return _rows(df.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("length_ft"), F.lit(0.0)) / 5280, 4).alias("miles")).select(F.lit(k).alias("step"), "n", "miles") for k, df in steps.items())


_LOCAL = "highway IN ('residential', 'unclassified', 'living_street')"
#: attribute: the source of its value by SQL.
_SOURCES = {
    "speed": f"CASE WHEN lid % 3 = 0 THEN 'city' WHEN lid % 4 = 1 THEN 'osm' WHEN {_LOCAL} THEN 'default_30_local' ELSE 'default_30_unposted' END",
    "lanes": f"CASE WHEN lid % 3 = 0 THEN 'city' WHEN lanes IS NOT NULL THEN 'osm' WHEN {_LOCAL} THEN 'default_local_2' ELSE 'none' END",
    "width": f"CASE WHEN lid % 3 <> 0 AND lanes IS NULL AND NOT {_LOCAL} THEN 'none' WHEN lid % 3 = 0 THEN 'city_lanes_x_width' ELSE 'lanes_x_12ft_assumed' END",
    "median": f"CASE WHEN lid % 5 = 0 THEN 'city' WHEN lid % 7 = 0 THEN 'merged_dual' WHEN {_LOCAL} THEN 'default_local_undivided' ELSE 'none' END",
    "adt": "CASE WHEN lid % 4 = 0 THEN 'measured' WHEN name IN (SELECT name FROM lns WHERE lid % 4 = 0) THEN 'street_median' ELSE 'none' END",
    "sidewalks": "CASE WHEN lid % 4 = 0 THEN 'none' WHEN lid % 5 = 4 AND lid % 3 = 2 THEN 'both' WHEN lid % 5 = 4 OR lid % 3 = 2 THEN 'one_side' ELSE 'partial' END",
    "land use": "CASE p_ WHEN 0 THEN 'Residential' WHEN 1 THEN 'Commercial' WHEN 2 THEN 'Parks/Open' ELSE 'Unknown' END",
}


@query("rpt5_coverage_by_source", sql("WITH l2 AS (SELECT *, lid % 4 AS p_ FROM lns) " + " UNION ALL ".join(f"SELECT '{k}' AS attribute, {v} AS source, {_ARTERIAL} AS arterial, count(*) AS n, round(sum(length_ft) / 5280, 4) AS miles FROM l2 GROUP BY 2, 3" for k, v in _SOURCES.items()), "lns"))
def coverage_by_source(spark, d):
    """Where the values of each attribute come from: segments and miles, on arterials and on other streets."""
    lines = fx.lines(spark, d).withColumns({
        "speed_city": F.expr("case when lid % 3 = 0 then 40.0d end"), "maxspeed_mph": F.expr("case when lid % 4 = 1 then 25.0d end"), "lanes_city": F.expr("case when lid % 3 = 0 then 3.0d end"), "lane_width_city": F.expr("case when lid % 3 = 0 then 11.0d end"),
        "median_city": F.expr("case when lid % 5 = 0 then 'Raised' end"), "merged_dual": F.expr("lid % 7 = 0"), "adt": F.expr("case when lid % 4 = 0 then 900.0d end"),
    })
    held = conflate.with_median(conflate.with_lanes(conflate.with_speed(lines)))
    held = records.filled_by_group(held, "name", "adt", "adt_filled", "adt_source")
    left, right = F.expr("case when lid % 4 = 0 then 0.0d when lid % 5 = 4 then 1.0d else 0.25d end"), F.expr("case when lid % 4 = 0 then 0.0d when lid % 3 = 2 then 1.0d else 0.25d end")
    group = F.expr("case lid % 4 when 0 then 'Multi-Family Residential' when 1 then 'Office' when 2 then 'Park & Open Spaces' else 'Moon' end")
    sources = {"speed": F.col("speed_source"), "lanes": F.col("lanes_source"), "width": F.col("width_source"), "median": F.col("median_source"), "adt": F.coalesce("adt_source", F.lit("none")), "sidewalks": tags.side_class(left, right), "land use": tags.land_use(group)}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("attribute"), v.alias("source")) for k, v in sources.items())))
    return held.select(each.alias("x"), F.col("highway").isin(*_CLASSES).alias("arterial"), "length_ft").groupBy("x.attribute", "x.source", "arterial").agg(F.count("*").alias("n"), F.round(F.sum("length_ft") / 5280, 4).alias("miles"))


@query("rpt5_demographic_ranges", "WITH r AS (SELECT CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer) SELECT count(v) AS known, round(min(v), 2) AS least, round(quantile_cont(v, 0.5), 4) AS middle, round(max(v), 2) AS most FROM r")
def demographic_ranges(spark, d):
    v = spark.read.parquet(f"{d}/customer.parquet").select(tags.no_sentinel(F.col("c_acctbal")).alias("v")).where("v is not null")
    ends = v.agg(F.count("v").alias("known"), F.round(F.min("v"), 2).alias("least"), F.round(F.max("v"), 2).alias("most"))
    return ends.crossJoin(c.exact_quantiles(v, "v", {"middle": 0.5})).select("known", "least", F.round("middle", 4).alias("middle"), "most")


@query("q3_stacked_facets", sql(_FACTS + " " + " UNION ALL ".join(f"SELECT '{b}' AS facet, '{m}' AS shown, {b} AS bucket, count(*) FILTER ({lo}) AS lower, count(*) FILTER ({hi}) AS upper FROM f GROUP BY {b}" for b in ("year", "month", "hour", "weekday") for m, lo, hi in (("ksi", "fatal", "severe AND NOT fatal"), ("all", "severe", "NOT severe"))), "pts"))
def stacked_facets(spark, d):
    held = facts(spark, d)
    return _rows(facets.stacked(held, b, m == "ksi").select(F.lit(b).alias("facet"), F.lit(m).alias("shown"), "bucket", "lower", "upper") for b in ("year", "month", "hour", "weekday") for m in ("ksi", "all"))


_OWNED = ", o AS (SELECT *, CASE WHEN ped THEN 'pedestrian' WHEN bike THEN 'bicycle' ELSE 'motor vehicle' END AS mode, CASE WHEN state_owned THEN 'state' ELSE 'city' END AS owner FROM f)"


@query("q6_breakdowns", sql(_FACTS + _OWNED + " " + " UNION ALL ".join(f"SELECT '{b}' AS facet, CAST({b} AS VARCHAR) AS bucket, count(*) AS n, count(*) FILTER (severe) AS n_severe, round_even(100.0 * count(*) / (SELECT count(*) FROM o WHERE {w}), 1) AS share FROM o WHERE {w} GROUP BY {b}" for b, w in (("mode", "state_owned"), ("tier", "state_owned"), ("state_owned", "true"))), "pts"))
def breakdowns(spark, d):
    """By mode and income tier on state roads; by owner the owner filter is left out."""
    held = facts(spark, d).withColumn("mode", tags.travel_mode(F.col("ped"), F.col("bike")))
    chosen = facets.Selection(owner="state")
    return _rows(facets.breakdown(held, b, chosen).select(F.lit(b).alias("facet"), F.col("bucket").cast("string").alias("bucket"), "n", "n_severe", "share") for b in ("mode", "tier", "state_owned"))


@query("q14_segment_years", sql(_NEAREST + ", y AS (SELECT lid, CAST(2016 + user_id % 10 AS INT) AS year, any_injury, severe, fatal, ped, bike FROM b JOIN pts USING (pid)) SELECT lid, year, count(*) AS n_crash, count(*) FILTER (any_injury) AS n_injury, count(*) FILTER (severe) AS n_severe, count(*) FILTER (fatal) AS n_fatal, count(*) FILTER (ped) AS n_ped, count(*) FILTER (bike) AS n_bike FROM y GROUP BY lid, year", "pts", "lns"))
def segment_years(spark, d):
    rows = assigned(spark, d).withColumn("year", F.expr("cast(2016 + user_id % 10 as int)"))
    return rows.groupBy("lid", "year").agg(F.count("*").alias("n_crash"), *(F.count_if(c).alias(k) for k, c in (("n_injury", "any_injury"), ("n_severe", "severe"), ("n_fatal", "fatal"), ("n_ped", "ped"), ("n_bike", "bike"))))


_TIER = "CASE WHEN {x} < 50000 THEN 0 WHEN {x} < 100000 THEN 1 WHEN {x} < 150000 THEN 2 WHEN {x} >= 150000 THEN 3 END"


@query("q16_severe_tier_audit", sql(_NEAREST + f""", own AS (SELECT p.pid, min(z.income) AS income FROM pts p LEFT JOIN zns z ON {_HELD} WHERE p.severe GROUP BY p.pid), st AS (SELECT l.lid, min(z.income) AS income FROM lns l LEFT JOIN zns z ON l.x0 >= z.xa AND l.x0 < z.xb AND l.y0 >= z.ya AND l.y0 < z.yb GROUP BY l.lid),
t AS (SELECT {_TIER.format(x='own.income')} AS a, {_TIER.format(x='st.income')} AS b FROM b JOIN own USING (pid) JOIN st USING (lid))
SELECT count(*) AS n, round(avg(CAST(a IS DISTINCT FROM b AS INT)), 6) AS share_differing, round(avg(CAST((a < 2) IS DISTINCT FROM (b < 2) AS INT)), 6) AS share_crossing FROM t""", "pts", "lns", "zns"))
def severe_tier_audit(spark, d):
    """Of severe crashes, how many have another income tier by their own place than by their street, and across 100,000."""
    severe, income = fx.points(spark, d).where("severe").select("pid", "px", "py"), fx.zones(spark, d).select("zone_id", "income")
    tier = lambda df, key, name: s.zone_of_point(df, _zone_edges(spark, d), 500.0).join(income, "zone_id", "left").select(F.col("pid").alias(key), tags.income_tier(F.col("income")).alias(name))
    starts = _pieces(spark, d).select(F.col("lid").alias("pid"), F.col("x0").alias("px"), F.col("y0").alias("py"))
    both = assigned(spark, d).where("severe").select("pid", "lid").join(tier(severe, "pid", "a"), "pid").join(tier(starts, "lid", "b"), "lid")
    share = lambda x, y: F.round(F.avg((~x.eqNullSafe(y)).cast("int")), 6)
    return both.agg(F.count("*").alias("n"), share(F.col("a"), F.col("b")).alias("share_differing"), share(F.col("a") < 2, F.col("b") < 2).alias("share_crossing"))


@query("q18_log_classes", sql(_COUNTS + " SELECT lid, CAST(least(floor(ln(1 + n_crash) / ln(1 + (SELECT max(n_crash) FROM g)) * 5 + 1e-9), 4) AS INT) AS class FROM g", "pts", "lns"))
def log_breaks(spark, d):
    return facets.log_classes(counted(spark, d), "n_crash").select("lid", "class")


@query("dq8_equity_checks", sql(_FACTS + """, v AS (SELECT *, CASE WHEN user_id_ THEN NULL ELSE tier END AS t FROM (SELECT *, pid % 9 = 0 AS user_id_ FROM f)), c AS (SELECT count(*) FILTER (t NOT IN (0, 1, 2, 3)) AS bad, avg(CAST(t IS NOT NULL AS INT)) AS known, avg(CAST(t < 2 AS INT)) FILTER (severe AND t IS NOT NULL) AS low FROM v)
SELECT 'tier domain' AS "check", 'error' AS level, CAST(bad AS DOUBLE) AS value, bad = 0 AS ok FROM c UNION ALL SELECT 'known tiers', 'error', round(known, 9), known >= 0.8 FROM c UNION ALL SELECT 'severe crashes under 100000', 'error', round(low, 9), low BETWEEN 0.7 AND 0.9 FROM c""", "pts"))
def equity_checks(spark, d):
    rows = facts(spark, d).withColumn("tier", F.expr("case when pid % 9 <> 0 then tier end"))
    known = F.col("tier").isNotNull()
    low = F.avg(F.when(F.col("severe") & known, (F.col("tier") < 2).cast("int")))
    listed = [dq.Check("tier domain", F.count_if(~F.col("tier").isin(0, 1, 2, 3)), 0, 0), dq.share("known tiers", known, 0.8, 1.0), dq.Check("severe crashes under 100000", low, 0.7, 0.9)]
    return dq.run_checks(rows, listed).withColumn("value", F.round("value", 9))
