"""Single rules and compositions over the adapters."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarmac.functions import geometry as g
from tarmac.functions import tags
from tarmac.operators import conflate, records
from tarmac.operators import contract as dq
from tarmac.operators import network as n
from tarmac.operators import spatial as s
from tarmac.operators.concentration import grouped_medians
from tarmac.operators.graph import shared_folder
from tarmac.operators.outlines import shared_outlines
from tarmac.operators.simplify import simplify
from tarmac.plans.analysis_queries import facts
from tarmac.plans.registry import query
from tarmac.plans.spatial_queries import _HELD, _zone_edges
from tarmac.plans.sql import piece_d2, sql
from tarmac.sources import adapters as fx
from tarmac.sources import writers


def _part(spark, d):
    return spark.read.parquet(f"{d}/part.parquet")


@query("prj2_list_tags", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_type END AS first, CASE p_size % 3 WHEN 1 THEN p_type WHEN 2 THEN p_type || '|' || p_brand END AS joined FROM part")
def list_tags(spark, d):
    t = _part(spark, d).select(F.col("p_partkey").alias("id"), F.expr("case p_size % 3 when 1 then array(p_type) when 2 then array(p_type, p_brand) end").alias("t"))
    return t.select("id", tags.first_value(F.col("t")).alias("first"), tags.all_values(F.col("t")).alias("joined"))


@query("prj3_fallback_coordinates", "SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 29.5 ELSE 29.6 END AS lat, CASE WHEN c_custkey % 3 = 0 THEN -95.1 ELSE -95.2 END AS lon, CASE WHEN c_custkey % 2 = 0 THEN 'cris' ELSE 'reported' END AS coord_source FROM customer")
def fallback(spark, d):
    raw = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey as id", "case when c_custkey % 2 = 0 then '29.5' end as Latitude", "'29.6' as Rpt_Latitude", "case when c_custkey % 3 = 0 then '-95.1' else 'x' end as Longitude", "'-95.2' as Rpt_Longitude")
    return records.with_coordinates(raw).select("id", "lat", "lon", "coord_source")


@query("prj8_agreement", sql("SELECT lid, CASE WHEN lanes IS NOT NULL AND lid % 2 = 0 THEN abs(lanes - 3) <= 1 END AS agree FROM lns", "lns"))
def agreement(spark, d):
    return fx.lines(spark, d).select("lid", tags.agree_within(F.col("lanes"), F.expr("case when lid % 2 = 0 then 3.0d end")).alias("agree"))


@query("prj9_tag_fallback", sql("SELECT lid, CASE WHEN lid % 4 = 0 AND lid % 3 = 0 THEN 'both' WHEN lid % 4 = 0 THEN 'none' ELSE 'one_side' END AS presence FROM lns", "lns"))
def tag_fallback(spark, d):
    left, tag = F.expr("case when lid % 4 = 0 then 0.0d else 0.7d end"), F.expr("case when lid % 3 = 0 then 'both' end")
    side = tags.side_class(left, F.lit(0.0))
    return fx.lines(spark, d).select("lid", F.when((side == "none") & tag.isNotNull(), tag).otherwise(side).alias("presence"))


@query("jn5_station_readings", sql("SELECT station_id, count(*) AS n FROM stn JOIN rdg USING (station_id) WHERE ok GROUP BY station_id", "stn", "rdg"))
def station_readings(spark, d):
    return fx.stations(spark, d).join(fx.readings(spark, d).where("ok"), "station_id").groupBy("station_id").agg(F.count("*").alias("n"))


@query("jn10_not_absorbed", sql("SELECT lid FROM lns WHERE lid NOT IN (SELECT lid FROM lns WHERE length_ft < 40)", "lns"))
def not_absorbed(spark, d):
    lines = fx.lines(spark, d)
    return lines.join(lines.where("length_ft < 40").select("lid"), "lid", "left_anti").select("lid")


@query("agg2_sum_or_zero", sql("SELECT id AS Crash_ID, coalesce(sum(greatest(75 - age, 0)), 0.0) AS years FROM prs WHERE killed GROUP BY id", "prs"))
def sum_or_zero(spark, d):
    killed = fx.persons(spark, d).where("killed")
    return killed.groupBy("Crash_ID").agg(F.coalesce(F.sum(tags.years_lost(F.col("age"))), F.lit(0.0)).alias("years"))


@query("agg3_lowest_mode", sql("WITH c AS (SELECT name, lanes, count(*) AS n FROM lns WHERE name IS NOT NULL AND lanes IS NOT NULL GROUP BY name, lanes) SELECT name, arg_min(lanes, struct_pack(a := -n, b := lanes)) AS lanes FROM c GROUP BY name", "lns"))
def lowest_mode(spark, d):
    return fx.lines(spark, d).where("name is not null and lanes is not null").groupBy("name").agg(F.mode("lanes", True).alias("lanes"))


@query("agg4_median_mean", sql("SELECT highway, round(median(length_ft), 6) AS mid, round(avg(length_ft), 6) AS mean FROM lns GROUP BY highway", "lns"))
def median_mean(spark, d):
    lines = fx.lines(spark, d)
    means = lines.groupBy("highway").agg(F.round(F.avg("length_ft"), 6).alias("mean"))
    return grouped_medians(lines, "highway", "length_ft", "mid").select("highway", F.round("mid", 6).alias("mid")).join(means, "highway")


@query("mth5_tolerance", sql("SELECT lid, least(greatest(coalesce(lanes * 12, 24) / 2 + 25, 30), 60) AS reach FROM lns", "lns"))
def tolerance(spark, d):
    return fx.lines(spark, d).select("lid", tags.sidewalk_tolerance(F.col("lanes") * 12).alias("reach"))


@query("mth6_side_class", sql("SELECT lid, CASE WHEN lid % 5 / 4.0 >= 0.5 AND lid % 3 / 2.0 >= 0.5 THEN 'both' WHEN lid % 5 / 4.0 >= 0.5 OR lid % 3 / 2.0 >= 0.5 THEN 'one_side' WHEN lid % 5 = 0 AND lid % 3 = 0 THEN 'none' ELSE 'partial' END AS side FROM lns", "lns"))
def side_class(spark, d):
    return fx.lines(spark, d).select("lid", tags.side_class(F.col("lid") % 5 / 4, F.col("lid") % 3 / 2).alias("side"))


@query("mth7_crash_cost", sql("SELECT pid, CAST(CASE WHEN fatal THEN 1606644 ELSE 0 END + pid % 3 * 44490 AS BIGINT) AS economic FROM pts", "pts"))
def cost(spark, d):
    zero = F.lit(0)
    counts = {"k": F.col("n_k"), "a": zero, "b": F.col("n_b"), "c": zero, "o": F.lit(None).cast("int")}
    return facts(spark, d).select("pid", tags.crash_cost(counts, tags.ECONOMIC_COST).alias("economic"))


@query("geo6_nearest_point_on_line", sql("SELECT sid, round(CASE WHEN t <= 0 THEN x0 WHEN t >= 1 THEN x1 ELSE x0 + t * (x1 - x0) END, 5) AS x FROM (SELECT *, ((5000 - x0) * (x1 - x0) + (5000 - y0) * (y1 - y0)) / nullif((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0), 0) AS t FROM vls) WHERE t IS NOT NULL", "vls"))
def nearest_point(spark, d):
    v = fx.value_lines(spark, d).where("x0 <> x1 or y0 <> y1")
    q = g.nearest_on_piece(F.lit(5000.0), F.lit(5000.0), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    return v.select("sid", q.alias("q")).select("sid", F.round("q.x", 5).alias("x"))


@query("geo7_lines_within", sql(f"SELECT a.lid AS src, b.lid AS dst FROM lns a JOIN lns b ON a.lid < b.lid AND a.name = b.name WHERE {piece_d2('a', 'b')} <= 10000", "lns"))
def lines_within(spark, d):
    a = fx.lines(spark, d).select("lid", "piece", "name", "x0", "y0", "x1", "y1")
    return s.piece_pairs(a.withColumnRenamed("lid", "src"), a.withColumnRenamed("lid", "dst"), 100.0, 100.0, "src", "dst", ["name"]).where("src < dst").select("src", "dst")


@query("geo10_any_member", sql(f"SELECT p.pid FROM pts p WHERE EXISTS (SELECT 1 FROM zns z WHERE z.zone_id IN (0, 1, 6) AND {_HELD})", "pts", "zns"))
def any_member(spark, d):
    some = _zone_edges(spark, d).where("zone_id in (0, 1, 6)")
    return s.zones_of_points(fx.points(spark, d).select("pid", "px", "py"), some, 500.0).select("pid").distinct()


@query("geo11_representative_points", sql("SELECT sid, x1 AS x, y0 AS y FROM vls", "vls"))
def representative(spark, d):
    bent = g.line((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0")), (F.col("x1"), F.col("y1")))
    return fx.value_lines(spark, d).select("sid", g.representative_point(bent).alias("p")).select("sid", "p.x", "p.y")


@query("geo12_merged_lines", sql("SELECT sid, abs(x1 - x0) + abs(y1 - y0) AS length FROM vls", "vls"))
def merged_lines(spark, d):
    a, b = g.line((F.col("x0"), F.col("y0")), (F.col("x1"), F.col("y0"))), g.line((F.col("x1"), F.col("y1")), (F.col("x1"), F.col("y0")))
    return fx.value_lines(spark, d).select("sid", g.length(g.merge_touching(a, b)).alias("length"))


@query("sj17_overlay_zones", sql("SELECT v.sid, min(z.zone_id) AS zone_id FROM (SELECT sid, (x0 + x1) / 2 AS px, (y0 + y1) / 2 AS py FROM vls) v LEFT JOIN zns z ON v.px >= z.xa AND v.px < z.xb AND v.py >= z.ya AND v.py < z.yb GROUP BY v.sid", "vls", "zns"))
def overlay_zones(spark, d):
    mids = fx.value_lines(spark, d).selectExpr("sid as pid", "(x0 + x1) / 2 as px", "(y0 + y1) / 2 as py")
    return s.zone_of_point(mids, _zone_edges(spark, d), 500.0).select(F.col("pid").alias("sid"), "zone_id")


@query("snk3_flat_rows", sql("SELECT lid, name, lanes FROM lns", "lns"))
def flat(spark, d):
    lines = fx.lines(spark, d).withColumn("geometry", g.line((F.col("x0") + 3_000_000, F.col("y0") + 13_800_000), (F.col("x1") + 3_000_000, F.col("y1") + 13_800_000)))
    return writers.flat_rows(lines.select("lanes", "lid", "name", "geometry"), ["lid", "name"]).where("lat between 29 and 31 and lon between -97 and -94").select("lid", "name", "lanes")


@query("snk6_outlines", sql("SELECT zone_id, 4 AS corners FROM zns", "zns"))
def outlines(spark, d):
    z = fx.zones(spark, d)
    ring = g.line((F.col("xa"), F.col("ya")), (F.col("xb"), F.col("ya")), (F.col("xb"), F.col("ya") + 20), (F.col("xb"), F.col("yb")), (F.col("xa"), F.col("yb")))
    return simplify(z.select("zone_id", ring.alias("geometry")), 100.0).select("zone_id", F.size("geometry").alias("corners"))


@query("snk8_clipped_overlay", sql("SELECT count(*) AS n FROM vls WHERE x0 >= 4004 AND x0 < 5904 AND y0 >= 4004 AND y0 < 5904", "vls"))
def clipped(spark, d):
    starts = fx.value_lines(spark, d).select(F.col("sid").alias("pid"), F.col("x0").alias("px"), F.col("y0").alias("py"))
    return s.zones_of_points(starts, _zone_edges(spark, d).where("zone_id = 12"), 500.0).agg(F.count("*").alias("n"))


@query("rpt1_network_coverage", sql("SELECT count(*) AS segments, round(sum(length_ft) / 5280, 4) AS miles, round(avg(CAST(name IS NOT NULL AS INT)), 6) AS named, round(avg(CAST(lanes IS NOT NULL AS INT)), 6) AS lanes FROM lns", "lns"))
def network_coverage(spark, d):
    share = lambda c: F.round(F.avg(F.col(c).isNotNull().cast("int")), 6)
    return fx.lines(spark, d).agg(F.count("*").alias("segments"), F.round(F.sum("length_ft") / 5280, 4).alias("miles"), share("name").alias("named"), share("lanes").alias("lanes"))


@query("rpt4_before_and_after", sql("SELECT count(*) AS before, count(*) FILTER (highway NOT LIKE '%!_link' ESCAPE '!' AND NOT (length_ft < 50 AND name IS NULL)) AS after FROM lns", "lns"))
def before_after(spark, d):
    lines = fx.lines(spark, d)
    kept, _ = n.split_by(lines, F.col("highway").endswith("_link"), n.LINK_REASON)
    kept, _ = n.split_by(kept, (F.col("length_ft") < 50) & F.col("name").isNull(), n.FRAGMENT_REASON)
    return lines.agg(F.count("*").alias("before")).crossJoin(kept.agg(F.count("*").alias("after")))


@query("dq2_required_values", sql("""SELECT 'null lid' AS "check", 'error' AS level, 0.0 AS value, true AS ok UNION ALL SELECT 'null lanes', 'error', CAST(count(*) FILTER (lanes IS NULL) AS DOUBLE), count(*) FILTER (lanes IS NULL) = 0 FROM lns""", "lns"))
def required(spark, d):
    return dq.run_checks(fx.lines(spark, d), dq.no_nulls(["lid", "lanes"]))


@query("dq5_summary_identities", sql("""WITH t AS (SELECT count(*) FILTER (severe) AS ksi, count(*) FILTER (fatal) AS k, count(*) FILTER (severe AND NOT fatal) AS a FROM pts)
SELECT 'ksi is killed and serious' AS "check", 'error' AS level, CAST(ksi - k - a AS DOUBLE) AS value, ksi = k + a AS ok FROM t UNION ALL SELECT 'some killed', 'error', CAST(k AS DOUBLE), k >= 1 FROM t""", "pts"))
def identities(spark, d):
    off = F.count_if("severe") - F.count_if("fatal") - F.count_if(F.col("severe") & ~F.col("fatal"))
    return dq.run_checks(fx.points(spark, d), [dq.Check("ksi is killed and serious", off, 0, 0), dq.Check("some killed", F.count_if("fatal"), low=1)])


@query("dq10_exit_status", sql("SELECT true AS passed, false AS strict", "lns"))
def exit_status(spark, d):
    results = dq.run_checks(fx.lines(spark, d), [dq.unique("lid"), dq.none_where("unnamed", F.col("name").isNull(), "warning")])
    return results.agg(F.bool_and((F.col("level") != "error") | F.col("ok")).alias("passed"), F.bool_and("ok").alias("strict"))


@query("agg_demographic_sentinels", "SELECT count(*) FILTER (c_acctbal < 0) AS missing, round(avg(CASE WHEN c_acctbal >= 0 THEN c_acctbal END), 4) AS mean FROM customer")
def sentinels(spark, d):
    v = spark.read.parquet(f"{d}/customer.parquet").select(tags.no_sentinel(F.col("c_acctbal")).alias("v"))
    return v.agg(F.count_if(F.col("v").isNull()).alias("missing"), F.round(F.avg("v"), 4).alias("mean"))


@query("prj6_width_source", sql("SELECT lid, CASE WHEN lanes IS NULL AND highway NOT IN ('residential', 'unclassified') THEN 'none' ELSE 'lanes_x_12ft_assumed' END AS width_source FROM lns", "lns"))
def width_source(spark, d):
    base = fx.lines(spark, d).withColumns({"lanes_city": F.lit(None).cast("double"), "lane_width_city": F.lit(None).cast("double")})
    return conflate.with_lanes(base).select("lid", "width_source")


def _bordering(spark, d):
    """Zones side by side in a grid, from nation: every border has a bend in the middle that both its zones have."""
    n = spark.read.parquet(f"{d}/nation.parquet").selectExpr("n_nationkey as zone_id", "n_nationkey % 5 as c", "n_nationkey div 5 as r")
    up = lambda c: f"((({c}) * 7 + r * 3) % 5 - 2) * 60"  # noqa: E731  an upright border's bend
    flat = lambda r: f"((c * 5 + ({r}) * 2) % 7 - 3) * 45"
    ring = [("c * 2000", "r * 2000"), ("c * 2000 + 1000", f"r * 2000 + {flat('r')}"), ("c * 2000 + 2000", "r * 2000"), (f"c * 2000 + 2000 + {up('c + 1')}", "r * 2000 + 1000"), ("c * 2000 + 2000", "r * 2000 + 2000"), ("c * 2000 + 1000", f"r * 2000 + 2000 + {flat('r + 1')}"), ("c * 2000", "r * 2000 + 2000"), (f"c * 2000 + {up('c')}", "r * 2000 + 1000")]
    start = "cast(zone_id * 3 % 8 as int)"  # each zone's ring begins elsewhere
    points = "array(" + ", ".join(f"struct(cast({x} as double) as x, cast({y} as double) as y)" for x, y in ring) + ")"
    return n.selectExpr("zone_id", "0 as ring", f"{points} as p").selectExpr("zone_id", "ring", f"concat(slice(p, {start} + 1, 8), slice(p, 1, {start})) as geometry")


@query("geo14_shared_outlines", """WITH n AS (SELECT n_nationkey AS zone_id, n_nationkey % 5 AS c, n_nationkey // 5 AS r FROM nation), k AS (SELECT unnest([0, 1]) AS k),
b AS (SELECT zone_id, 'upright' AS kind, (c + k) * 2000 AS x, r * 2000 + 1000 AS y, (((c + k) * 7 + r * 3) % 5 - 2) * 60 AS bend FROM n, k UNION ALL SELECT zone_id, 'flat', c * 2000 + 1000, (r + k) * 2000, ((c * 5 + (r + k) * 2) % 7 - 3) * 45 FROM n, k)
SELECT zone_id, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM (SELECT zone_id, (c + k.k) * 2000 AS x, (r + l.k) * 2000 AS y FROM n, k, k AS l
 UNION ALL SELECT zone_id, CASE kind WHEN 'upright' THEN x + bend ELSE x END, CASE kind WHEN 'flat' THEN y + bend ELSE y END FROM b WHERE abs(bend) > 100)""")
def shared_borders(spark, d):
    made = shared_outlines(_bordering(spark, d), 100.0)
    return made.select("zone_id", F.explode(F.array_distinct("geometry")).alias("p")).select("zone_id", "p.x", "p.y")


@query("snk2_published_versions", sql("SELECT lid, CASE WHEN lid % 7 = 0 THEN 'added' WHEN lid % 5 = 0 THEN 'removed' ELSE 'changed' END AS change FROM lns WHERE (lid % 7 = 0) <> (lid % 5 = 0) OR (lid % 7 <> 0 AND lanes >= 4)", "lns"))
def published_versions(spark, d):
    """Two versions published one after the other, read back, and compared row by row."""
    folder = f"{shared_folder(spark)}/published-{uuid.uuid4().hex}"
    lines = fx.lines(spark, d).select("lid", "name", "lanes")
    old = lines.where("lid % 7 <> 0")
    new = lines.where("lid % 5 <> 0").withColumn("lanes", F.expr("case when lanes >= 4 then lanes - 1 else lanes end"))
    writers.publish({"segments": old, "streets": old.select("name").distinct()}, folder)
    writers.publish({"segments": new}, folder)
    return dq.row_changes(writers.published(spark, folder, 1)["segments"], writers.published(spark, folder)["segments"], "lid")
