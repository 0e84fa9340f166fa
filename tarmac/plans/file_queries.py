"""Landed files: tables written as extracts, feature pages, header arrays and layers, and read again by the readers."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tarmac.functions import tags
from tarmac.operators import network as n
from tarmac.operators.graph import shared_folder
from tarmac.plans.network_queries import _EDGES, _edges
from tarmac.plans.registry import query
from tarmac.plans.sql import sql
from tarmac.sources import adapters as fx
from tarmac.sources import readers, writers


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/landed-{uuid.uuid4().hex}"


@query("src1_csv_extracts", sql("SELECT CAST(id AS VARCHAR) AS Crash_ID, CAST(date AS VARCHAR) AS Crash_Date, CASE WHEN id % 2 = 0 THEN '29.5' END AS Latitude FROM crs", "crs"))
def extracts(spark, d):
    """Two folders of CSV files, of which the second lacks a column and has others in another order."""
    folder = _folder(spark)
    c = fx.crashes(spark, d).select("Crash_ID", F.substring("Crash_Date", 1, 10).alias("Crash_Date"), F.lit("29.5").alias("Latitude"), F.lit("more, \"quoted\"").alias("Other"))
    writers.write_csv(c.where("Crash_ID % 2 = 0"), f"{folder}/a")
    writers.write_csv(c.where("Crash_ID % 2 <> 0").select("Other", "Crash_Date", "Crash_ID"), f"{folder}/b")
    return readers.csv_extracts(spark, [f"{folder}/a", f"{folder}/b"], ["Crash_ID", "Crash_Date", "Latitude"]).drop("file")


@query("src2_person_kinds", "SELECT CAST(l_orderkey AS VARCHAR) AS Crash_ID, CAST(l_linenumber AS VARCHAR) AS Prsn_Nbr, CAST(l_quantity AS BIGINT) AS age, CASE l_linestatus WHEN 'F' THEN 'primaryperson' ELSE 'person' END AS kind FROM lineitem")
def person_kinds(spark, d):
    """Both person tables and the units' in one folder, told apart by the names of their files, which hold each other."""
    folder = _folder(spark)
    rows = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey as Crash_ID", "l_linenumber as Prsn_Nbr", "1 as Prsn_Type_ID", "2 as Prsn_Injry_Sev_ID", "cast(l_quantity as long) as Prsn_Age", "l_linestatus")
    for name, some in (("extract_primaryperson_1", rows.where("l_linestatus = 'F'")), ("extract_person_1", rows.where("l_linestatus <> 'F'")), ("extract_unit_1", rows)):
        writers.write_csv(some.drop("l_linestatus"), folder, name)
    return readers.persons(spark, folder).select("Crash_ID", "Prsn_Nbr", F.col("Prsn_Age").cast("long").alias("age"), "kind")


@query("src9_column_case", sql("SELECT CAST(id AS VARCHAR) AS Crash_ID, o_orderstatus AS Status FROM crs", "crs"))
def column_case(spark, d):
    """Extracts whose headers spell the columns each in another case."""
    folder = _folder(spark)
    c = fx.crashes(spark, d).select("Crash_ID", F.col("o_orderstatus").alias("Status"))
    for k, spell in enumerate((str.upper, str.lower, str.title)):
        writers.write_csv(c.where(F.col("Crash_ID") % 3 == k).toDF(*map(spell, c.columns)), f"{folder}/{k}")
    return readers.csv_extracts(spark, [f"{folder}/{k}" for k in range(3)], ["Crash_ID", "Status"]).drop("file")


_PAGES = "WITH c AS (SELECT c_custkey AS k, c_custkey // 100 AS page FROM customer)"


@query("src5_feature_pages", "SELECT CAST(c_custkey AS VARCHAR) AS OBJECTID, c_mktsegment AS kind FROM customer")
def feature_pages(spark, d):
    """Pages of a feature service, of which some repeat rows of the one before, as a table with each feature once."""
    return readers.feature_pages(spark, _landed_pages(spark, d), ["OBJECTID", "kind"], "OBJECTID").select("OBJECTID", "kind")


@query("src5_page_completeness", _PAGES + " SELECT 'all' AS pages, count(*) AS expected, count(*) AS found, true AS complete FROM c UNION ALL SELECT 'without one', count(*), count(*) FILTER (page <> 1 OR k % 10 = 0), count(*) FILTER (page <> 1 OR k % 10 = 0) >= count(*) FROM c")
def completeness(spark, d):
    """Whether all ids came: of all pages, and of those that are left when one is lost."""
    folder, n = _landed_pages(spark, d), spark.read.parquet(f"{d}/customer.parquet").count()
    check = lambda name, path: readers.page_completeness(readers.feature_pages(spark, path, ["OBJECTID"], "OBJECTID"), "OBJECTID", n).select(F.lit(name).alias("pages"), F.col("expected").cast("long").alias("expected"), "found", "complete")
    return check("all", folder).unionByName(check("without one", f"{folder}/page={{[02-9],[1-9][0-9]*}}"))


def _landed_pages(spark, d):
    """A file for each hundred features, every tenth of them on the next page also."""
    c = spark.read.parquet(f"{d}/customer.parquet").selectExpr("c_custkey as k", "c_mktsegment as kind", "explode(case when c_custkey % 10 = 0 then array(c_custkey div 100, c_custkey div 100 + 1) else array(c_custkey div 100) end) as page")
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.col("k").alias("OBJECTID"), "kind").alias("properties")))
    pages = c.groupBy("page").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list(feature)), F.lit("]}")).alias("value"))
    folder = _folder(spark)
    pages.write.partitionBy("page").text(folder)
    return folder


@query("str10_geoid", "SELECT n_nationkey, lpad(CAST(n_regionkey AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || lpad(CAST(n_nationkey * 100 AS VARCHAR), 6, '0') || CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey % 4 AS VARCHAR) END AS geoid FROM nation")
def geoids(spark, d):
    """Ids of block groups from their four parts; null where one is missing."""
    at = lambda e, n: F.lpad(F.expr(e).cast("string"), n, "0")
    group = F.expr("case when n_nationkey % 4 <> 0 then cast(n_nationkey % 4 as string) end")
    return spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", tags.geoid(at("n_regionkey", 2), at("n_nationkey", 3), at("n_nationkey * 100", 6), group).alias("geoid"))


@query("src3_injury_counts", sql("SELECT CAST(id AS VARCHAR) AS Crash_ID, CAST(CASE WHEN id % 3 = 0 THEN 0 ELSE id % 5 END AS INT) AS Death_Cnt, 0 AS Non_Injry_Cnt FROM crs", "crs"))
def injuries(spark, d):
    folder = _folder(spark)
    c = fx.crashes(spark, d).select("Crash_ID", F.expr("case when Crash_ID % 3 = 0 then 'none' else cast(Crash_ID % 5 as string) end").alias("Death_Cnt"))
    writers.write_csv(c, folder)
    names = ["Death_Cnt", "Non_Injry_Cnt"]
    return readers.injury_counts(readers.csv_extracts(spark, folder, ["Crash_ID", *names]), names).drop("file")


@query("src4_zone_edges", sql("SELECT CAST(zone_id AS VARCHAR) AS zone_id, unnest([xa, xb, xb, xa]) AS x0, unnest([ya, ya, yb, yb]) AS y0, unnest([xb, xb, xa, xa]) AS x1, unnest([ya, yb, yb, ya]) AS y1 FROM zns", "zns"))
def zone_edges(spark, d):
    """Zones as pages of features, polygons and multipolygons, one page a district and some features on two pages."""
    z = fx.zones(spark, d)
    ring = "array(array(xa, ya), array(xb, ya), array(xb, yb), array(xa, yb), array(xa, ya))"
    kind = F.expr("case when zone_id % 2 = 0 then 'Polygon' else 'MultiPolygon' end")
    shape = F.expr(f"case when zone_id % 2 = 0 then to_json(array({ring})) else to_json(array(array({ring}))) end")
    feature = F.concat(F.lit('{"type":"Feature","properties":{"zone_id":'), F.col("zone_id"), F.lit('},"geometry":{"type":"'), kind, F.lit('","coordinates":'), shape, F.lit("}}"))
    twice = z.select(feature.alias("f"), F.explode(F.expr("case when zone_id % 3 = 0 then array(district, -1) else array(district) end")).alias("page"))
    pages = twice.groupBy("page").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.concat_ws(",", F.collect_list("f")), F.lit("]}")).alias("value"))  # a document is a page of a service
    folder = _folder(spark)
    writers.write_text(pages.repartition(6, "page").select("value"), folder)
    rows = spark.read.text(folder)  # a document a line
    features = readers.features_of(rows, ["zone_id"]).dropDuplicates(["zone_id"])
    return readers.ring_edges(readers.polygon_rings(features), "zone_id")


@query("src6_header_arrays", "SELECT CAST(n_nationkey AS VARCHAR) AS tract, CASE WHEN n_nationkey % 7 <> 0 THEN CAST(n_nationkey * 1000 AS VARCHAR) END AS income, CAST(NULL AS VARCHAR) AS missing FROM nation")
def header_arrays(spark, d):
    """Tables as JSON arrays whose first row is the header, one file a region."""
    c = spark.read.parquet(f"{d}/nation.parquet")
    row = F.expr("array(case when n_nationkey % 7 <> 0 then cast(n_nationkey * 1000 as string) end, cast(n_nationkey as string))")
    tables = c.groupBy("n_regionkey").agg(F.to_json(F.concat(F.array(F.array(F.lit("income"), F.lit("tract"))), F.collect_list(row))).alias("value"))
    folder = _folder(spark)
    tables.write.partitionBy("n_regionkey").text(folder)
    return readers.header_array(spark, f"{folder}/*", ["tract", "income", "missing"])


@query("src9_street_graph", sql(f"WITH {_EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT u AS node FROM e UNION ALL SELECT v FROM e) GROUP BY node) SELECT node, degree FROM d", "lns"))
def street_graph(spark, d):
    """A street graph written as layers of nodes and edges, read again, with the degree of each node."""
    edges, folder = _edges(spark, d), _folder(spark)
    nodes = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    writers.write_layers({"nodes": nodes, "edges": edges}, folder)
    nodes, edges = readers.street_graph(spark, folder)
    return nodes.join(n.node_degrees(edges), "node")


@query("snk1_layers", sql("SELECT 'kept' AS layer, lid, highway FROM lns WHERE highway <> 'secondary_link' UNION ALL SELECT 'removed', lid, highway FROM lns WHERE highway = 'secondary_link'", "lns"))
def layers(spark, d):
    folder = _folder(spark)
    kept, removed = n.split_by(fx.lines(spark, d).select("lid", "highway"), F.col("highway").endswith("_link"), n.LINK_REASON)
    writers.write_layers({"kept": kept, "removed": removed}, folder)
    again = lambda k: spark.read.parquet(f"{folder}/{k}").select(F.lit(k).alias("layer"), "lid", "highway")
    return again("kept").unionByName(again("removed"))
