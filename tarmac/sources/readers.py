"""Landed files as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The columns of a crash extract that are read.
CRASH_COLUMNS = ("Crash_ID", "Crash_Date", "Crash_Time", "Crash_Fatal_Fl", "Crash_Sev_ID", "Latitude", "Longitude", "Rpt_Latitude", "Rpt_Longitude", "Sus_Serious_Injry_Cnt", "Tot_Injry_Cnt", "Crash_Speed_Limit", "Road_Cls_ID", "Rpt_Road_Part_ID", "Rpt_Street_Name")
INJURY_COUNTS = ("Death_Cnt", "Sus_Serious_Injry_Cnt", "Nonincap_Injry_Cnt", "Poss_Injry_Cnt", "Non_Injry_Cnt")


def csv_extracts(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Union of the CSV files of several folders: the wanted columns as text (null where a file lacks one) and ``file``.

    Files of one header are read together; each folder may have its own. Only the wanted columns are parsed.
    """
    out = None
    for path in [paths] if isinstance(paths, str) else paths:
        df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
        held = {c.lower(): c for c in df.columns}
        part = df.select(*(F.col(held[c.lower()]).alias(c) if c.lower() in held else F.lit(None).cast("string").alias(c) for c in columns), F.col("_metadata.file_path").alias("file"))
        out = part if out is None else out.unionByName(part)
    return out


def person_kind(file: Column) -> Column:
    """Which of the two person tables a file is: their names contain each other."""
    name = F.element_at(F.split(file, "/"), -1)
    return F.when(name.contains("primaryperson_"), "primaryperson").when(name.contains("person_"), "person")


def persons(spark: SparkSession, paths: str | Sequence[str], columns: Sequence[str] = ("Crash_ID", "Prsn_Nbr", "Prsn_Type_ID", "Prsn_Injry_Sev_ID", "Prsn_Age")) -> DataFrame:
    """Both person tables with ``kind``; a person's number is unique within its kind and crash alone."""
    return csv_extracts(spark, paths, columns).withColumn("kind", person_kind(F.col("file"))).where("kind is not null")


def injury_counts(df: DataFrame, columns: Sequence[str] = INJURY_COUNTS) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c).try_cast("int"), F.lit(0)) for c in columns})


_POSITION = T.ArrayType(T.DoubleType())
_FEATURE = T.StructType([T.StructField("properties", T.MapType(T.StringType(), T.StringType())), T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())]))])


def geojson_features(spark: SparkSession, path: str, properties: Sequence[str]) -> DataFrame:
    """Features of GeoJSON documents: the properties as text, ``type``, and ``coordinates`` as JSON text."""
    return features_of(spark.read.text(path, wholetext=True), properties)


def features_of(documents: DataFrame, properties: Sequence[str]) -> DataFrame:
    """The same of documents that are rows (``value``)."""
    parsed = documents.select(F.from_json("value", T.StructType([T.StructField("features", T.ArrayType(_FEATURE))])).alias("d"))
    flat = parsed.select(F.explode("d.features").alias("f"))
    return flat.select(*(F.try_element_at("f.properties", F.lit(p)).alias(p) for p in properties), F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("coordinates"))


def polygon_rings(features: DataFrame) -> DataFrame:
    """``rings``: an array of rings (arrays of x, y), for polygons and multipolygons alike."""
    ring = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    one = F.from_json("coordinates", T.ArrayType(T.ArrayType(_POSITION)))
    many = F.from_json("coordinates", T.ArrayType(T.ArrayType(T.ArrayType(_POSITION))))
    rings = F.when(F.col("type") == "MultiPolygon", F.flatten(many)).otherwise(one)
    return features.withColumn("rings", F.transform(rings, ring)).drop("coordinates")


def ring_edges(zones: DataFrame, zone_id: str) -> DataFrame:
    """``zone_id, x0, y0, x1, y1`` of all rings; a ring need not be closed."""
    ring = zones.select(zone_id, F.posexplode("rings").alias("ring", "p")).where(F.size("p") > 2)
    shifted = F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1))
    ends = ring.select(zone_id, F.explode(F.arrays_zip(F.col("p").alias("a"), shifted.alias("b"))).alias("e"))
    edges = ends.select(zone_id, F.col("e.a.x").alias("x0"), F.col("e.a.y").alias("y0"), F.col("e.b.x").alias("x1"), F.col("e.b.y").alias("y1"))
    return edges.where("x0 <> x1 or y0 <> y1")


def feature_pages(spark: SparkSession, path: str, properties: Sequence[str], key: str) -> DataFrame:
    """Landed pages of a feature service, each feature once: paging may repeat or skip rows."""
    return geojson_features(spark, path, properties).dropDuplicates([key])


def page_completeness(features: DataFrame, key: str, expected: int) -> DataFrame:
    """One row ``expected, found, complete``: whether all ids came."""
    return features.agg(F.lit(expected).alias("expected"), F.count_distinct(key).alias("found")).withColumn("complete", F.col("found") >= F.col("expected"))


def header_array(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Tables that come as a JSON array of arrays of text, the first being the header."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", T.ArrayType(T.ArrayType(T.StringType()))).alias("t"))
    each = rows.select(F.get("t", 0).alias("head"), F.posexplode("t").alias("n", "row")).where("n > 0")
    at = lambda c: F.get("row", (F.array_position("head", c) - 1).cast("int"))
    return each.select(*(F.when(F.array_position("head", c) > 0, at(c)).alias(c) for c in columns))


def street_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a landed street graph."""
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def stored_in_box(spark: SparkSession, path: str, box: tuple[float, float, float, float], x: tuple[str, str] = ("px", "px"), y: tuple[str, str] = ("py", "py")) -> DataFrame:
    """Rows of a stored table that meet a box (x0, y0, x1, y1), its rim included.

    The comparisons reach the scan, which skips the row groups whose least and greatest coordinates lie beyond the box:
    most of them, if the table was written by ``writers.write_by_place``.
    """
    meets = (F.col(x[1]) >= box[0]) & (F.col(x[0]) <= box[2]) & (F.col(y[1]) >= box[1]) & (F.col(y[0]) <= box[3])
    return spark.read.parquet(path).where(meets)
