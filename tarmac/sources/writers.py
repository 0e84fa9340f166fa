"""Published files."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.functions import curve
from tarmac.functions import geometry as g
from tarmac.functions import projection

CRASH_FIELDS = ("lat", "lon", "sev", "fatal", "ped", "bike", "year", "date", "hour", "yll", "district", "inc_tier", "on_hin", "on_txdot", "seg_id", "sn", "n_k", "n_a", "n_b", "n_c", "n_noinj")


def write_layers(layers: Mapping[str, DataFrame], folder: str) -> None:
    for name, df in layers.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_version(layers: Mapping[str, DataFrame], folder: str) -> str:
    """Writes all layers beside the earlier versions and gives the new one's name; readers do not see it yet."""
    version = uuid.uuid4().hex
    for name, df in layers.items():
        df.write.parquet(f"{folder}/data/{version}/{name}")
    return version


def versions(spark: SparkSession, folder: str) -> DataFrame:
    """``number, version, layers`` of what was published in a folder; no rows if nothing was."""
    kind = "number long, version string, layers array<string>"
    try:
        return spark.read.schema(kind).parquet(f"{folder}/manifest")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def switch_to(spark: SparkSession, folder: str, version: str, layers: Sequence[str]) -> None:
    """Lets readers see a version: one row in one file, which the committer of the write renames into place at once."""
    last = versions(spark, folder).agg(F.max("number")).first()[0]
    row = spark.createDataFrame([((last or 0) + 1, version, list(layers))], "number long, version string, layers array<string>")
    row.coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def publish(layers: Mapping[str, DataFrame], folder: str) -> str:
    """All layers as one version: a job that ends early leaves the version before, whole."""
    version = write_version(layers, folder)
    switch_to(next(iter(layers.values())).sparkSession, folder, version, list(layers))
    return version


def published(spark: SparkSession, folder: str, back: int = 0) -> dict[str, DataFrame]:
    """The layers of the newest version, or of the one published ``back`` times before it."""
    found = versions(spark, folder).orderBy(F.desc("number"), F.desc("version")).limit(back + 1).collect()
    if len(found) <= back:
        raise ValueError("no such version")
    return {name: spark.read.parquet(f"{folder}/data/{found[back].version}/{name}") for name in found[back].layers}


def rounded(df: DataFrame, digits: Mapping[str, int | None]) -> DataFrame:
    """The listed columns, rounded half to even; 0 digits gives integers, None leaves a column as it is."""
    return df.select(*(F.col(c) if n is None else (F.bround(c, n).cast("long") if n == 0 else F.bround(c, n)).alias(c) for c, n in digits.items()))


def flat_rows(df: DataFrame, front: Sequence[str], points: str = "geometry") -> DataFrame:
    """Without geometry: midpoint ``lat, lon`` (six decimals) and ``map_url``, the columns of ``front`` first."""
    lon, lat = projection.to_degrees(F.col("__m.x"), F.col("__m.y"))
    placed = df.withColumn("__m", g.midpoint(F.col(points))).withColumns({"lat": F.bround(lat, 6), "lon": F.bround(lon, 6)})
    placed = placed.withColumn("map_url", F.format_string("https://www.google.com/maps?q=%.6f,%.6f", "lat", "lon"))
    rest = [c for c in df.columns if c != points and c not in front]
    return placed.select(*front, *rest, "lat", "lon", "map_url")


def write_csv(df: DataFrame, path: str, name: str | None = None) -> None:
    """CSV with a header, in files whose names begin with ``name`` if it is given; then they join those in the folder."""
    to = df.write.mode("overwrite" if name is None else "append").option("header", True)
    (to if name is None else to.option("mapreduce.output.basename", name)).csv(path)


def _coordinates(points: Column, digits: int) -> Column:
    return F.transform(points, lambda p: F.array(F.bround(p["x"], digits), F.bround(p["y"], digits)))


def geojson_lines(df: DataFrame, properties: Sequence[str], points: str = "geometry", digits: int = 5) -> DataFrame:
    """``value``: one compact GeoJSON feature a row, from lines in degrees; null properties are left out."""
    feature = F.struct(
        F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"),
        F.struct(F.lit("LineString").alias("type"), _coordinates(F.col(points), digits).alias("coordinates")).alias("geometry"),
    )
    return df.select(F.to_json(feature).alias("value"))


def positional_rows(df: DataFrame, fields: Sequence[str] = CRASH_FIELDS) -> DataFrame:
    """``value``: one JSON array a row, nulls kept, booleans as 0 and 1."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        v = F.col(c).cast("int") if kinds[c] == "boolean" else F.col(c)
        if kinds[c] in ("string", "date"):
            v = F.regexp_replace(F.to_json(F.array(v.cast("string"))), r"^\[|\]$", "")
            return F.when(F.col(c).isNull(), "null").otherwise(v)
        return F.coalesce(v.cast("string"), F.lit("null"))

    return df.select(F.concat(F.lit("["), F.concat_ws(",", *map(text, fields)), F.lit("]")).alias("value"))


def write_text(df: DataFrame, path: str) -> None:
    df.select("value").write.mode("overwrite").text(path)


def summary_document(df: DataFrame) -> DataFrame:
    """``value``: each row (usually one, of nested structs and maps) as a JSON document."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_by_place(df: DataFrame, path: str, x: tuple[str, str] = ("px", "px"), y: tuple[str, str] = ("py", "py"), files: int | None = None) -> None:
    """Rows as Parquet in the order of a curve over the map: each row group covers a small part of it, and says which.

    ``x`` and ``y`` name the columns of a row's least and greatest coordinates (for points the same one twice); the curve
    goes by the middle. Readers that ask for a box (``readers.stored_in_box``) skip the row groups beyond it. Rows without
    coordinates come first. Rows are range-partitioned, so no task gets more than its share, and not more than ``files``
    files are written (the session's shuffle partitions if not said).
    """
    mid = [(F.col(a) + F.col(b)) / 2 for a, b in (x, y)]
    low_x, low_y, high_x, high_y = df.agg(F.min(mid[0]), F.min(mid[1]), F.max(mid[0]), F.max(mid[1])).first()
    box = (0.0, 0.0, 1.0, 1.0) if low_x is None or low_y is None else (low_x, low_y, high_x, high_y)
    placed = df.withColumn("__place", curve.place(*mid, box))
    spread = placed.repartitionByRange("__place") if files is None else placed.repartitionByRange(files, "__place")
    spread.sortWithinPartitions("__place").drop("__place").write.parquet(path)
