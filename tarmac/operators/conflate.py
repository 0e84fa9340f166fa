"""Attributes of outside layers carried onto segments, with the source of each value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.functions import tags
from tarmac.operators.graph import checkpoint
from tarmac.operators.spatial import nearest_with_ties, snap_match

LOCAL = ("residential", "unclassified", "living_street")


def local() -> Column:
    return F.coalesce(F.col("highway").isin(*LOCAL), F.lit(False))


def with_speed(df: DataFrame, city: str = "speed_city", tagged: str = "maxspeed_mph", default: float = 30.0) -> DataFrame:
    """``posted_speed_mph`` and ``speed_source``: city, osm, the default on local streets, else the default unposted."""
    always = F.lit(True)
    value, source = tags.fill_in_order([(always, F.col(city), "city"), (always, F.col(tagged), "osm"), (local(), F.lit(default), "default_30_local")], "default_30_unposted")
    return df.withColumns({"posted_speed_mph": value.otherwise(F.lit(default)), "speed_source": source})


def with_lanes(df: DataFrame, city: str = "lanes_city", tagged: str = "lanes") -> DataFrame:
    """``lanes_final, lanes_source`` (city, osm, 2 on local streets), ``lanes_agree``, ``roadway_width_ft, width_source``."""
    always = F.lit(True)
    value, source = tags.fill_in_order([(always, F.col(city), "city"), (always, F.col(tagged), "osm"), (local(), F.lit(2.0), "default_local_2")], "none")
    out = df.withColumns({"lanes_final": value, "lanes_source": source, "lanes_agree": tags.agree_within(F.col(city), F.col(tagged))})
    wide = F.col("lane_width_city")
    return out.withColumns({
        "roadway_width_ft": F.col("lanes_final") * F.coalesce(wide, F.lit(12.0)),
        "width_source": F.when(F.col("lanes_final").isNull(), "none").when(wide.isNotNull(), "city_lanes_x_width").otherwise("lanes_x_12ft_assumed"),
    })


def with_median(df: DataFrame, city: str = "median_city") -> DataFrame:
    """``median_type, median_source``: city, divided where halves were merged, undivided on local streets."""
    value, source = tags.fill_in_order([(F.lit(True), F.col(city), "city"), (F.coalesce(F.col("merged_dual"), F.lit(False)), F.lit("Divided (unspecified)"), "merged_dual"), (local(), F.lit("Undivided"), "default_local_undivided")], "none")
    return df.withColumns({"median_type": value, "median_source": source})


def city_layer(lines: DataFrame, source: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Several attributes of one layer in a single snap, so that it is joined once for all steps that use it."""
    return snap_match(lines, source, fields)


def station_volumes(stations: DataFrame, readings: DataFrame, lines: DataFrame, reach: float = 150.0) -> DataFrame:
    """``lid, adt, adt_year, n_stations, op_speed``: the latest valid readings of stations, on all their nearest lines.

    Volume and speed each come from the latest reading that has them; mean over a line's stations.
    """
    order = F.struct("date", "order_key", "line_no", "part_key", "adt")
    newest = readings.where("ok and adt > 0").groupBy("station_id").agg(F.max_by("adt", order).alias("adt"), F.max_by(F.year("date"), order).alias("year"), F.max_by("op_speed", F.when(F.col("op_speed").isNotNull(), order)).alias("op_speed"))
    at = checkpoint(stations.join(newest.hint("merge"), "station_id"))  # read in every round of the search
    won = nearest_with_ties(at.select(F.col("station_id").alias("pid"), "px", "py"), lines, reach).select(F.col("pid").alias("station_id"), "lid")
    return won.join(at.drop("px", "py").hint("merge"), "station_id").groupBy("lid").agg(F.bround(F.avg("adt"), 0).alias("adt"), F.max("year").alias("adt_year"), F.count("*").alias("n_stations"), F.bround(F.avg("op_speed"), 2).alias("op_speed"))


def demographic_rates(df: DataFrame) -> DataFrame:
    """Rates of a table of counts (pop, poor, poverty_base, land_m2, income with negative codes for missing)."""
    return df.withColumns({
        "median_hh_income": tags.no_sentinel(F.col("income")), "pct_poverty": tags.percent(tags.no_sentinel(F.col("poor")), tags.no_sentinel(F.col("poverty_base"))),
        "pop_density_sqmi": tags.density_per_square_mile(tags.no_sentinel(F.col("pop")), F.col("land_m2")),
    })


def land_use_profile(lines: DataFrame, hits: DataFrame, category: str = "lu", line_id: str = "lid") -> DataFrame:
    """``dominant`` (largest area among known categories, ties by name), shares of known area, ``n_parcels`` of all hits.

    A row of ``hits`` is a parcel or, where they have a column ``n``, stands for so many with their summed area.
    """
    each = hits.groupBy(line_id, category).agg(F.sum("area").alias("area"), (F.sum("n") if "n" in hits.columns else F.count("*")).alias("n"))
    named = {"pct_residential": "Residential", "pct_commercial": "Commercial", "pct_industrial": "Industrial"}
    known = F.col(category) != "Unknown"
    total = F.sum(F.when(known, F.col("area")))
    got = each.groupBy(line_id).agg(F.min_by(category, F.when(known, F.struct(-F.col("area"), F.col(category)))).alias("dominant"), *(F.bround(100 * F.coalesce(F.sum(F.when(F.col(category) == v, F.col("area"))), F.lit(0.0)) / total, 1).alias(k) for k, v in named.items()), F.sum("n").alias("n_parcels"))
    return lines.select(line_id).join(got.hint("merge"), line_id, "left").na.fill(0, ["n_parcels"])
