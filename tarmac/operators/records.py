"""Crash-record cleaning: dedupe, coordinates, exclusion, flags from child tables, years of life lost."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import tags
from tarmac.operators.concentration import grouped_medians

#: The coordinate box of valid records, inclusive.
LAT_MIN, LAT_MAX, LON_MIN, LON_MAX = 29.4, 30.2, -95.9, -94.9


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row for each key: the first in a stated order, so that overlapping extracts always resolve alike."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def with_coordinates(df: DataFrame, lat: str = "Latitude", lon: str = "Longitude", other_lat: str = "Rpt_Latitude", other_lon: str = "Rpt_Longitude") -> DataFrame:
    """``lat, lon`` (each falls back by itself) and ``coord_source``, which looks at the latitude alone."""
    number = lambda c: F.col(c).try_cast("double")
    return df.withColumns({
        "lat": F.coalesce(number(lat), number(other_lat)), "lon": F.coalesce(number(lon), number(other_lon)),
        "coord_source": F.when(number(lat).isNotNull(), "cris").otherwise("reported"),
    })


def in_box(df: DataFrame, box: tuple[float, float, float, float] = (LAT_MIN, LAT_MAX, LON_MIN, LON_MAX)) -> DataFrame:
    return df.where(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]))


def without_limited_access(df: DataFrame) -> DataFrame:
    number = lambda c: F.col(c).try_cast("int")
    return df.where(~tags.on_limited_access(number("Road_Cls_ID"), number("Rpt_Road_Part_ID"), F.col("Rpt_Street_Name")))


def of_parents(child: DataFrame, parents: DataFrame, key: str = "Crash_ID") -> DataFrame:
    return child.join(parents.select(key).distinct(), key, "left_semi")


def flags_of_either(parents: DataFrame, sources: Sequence[tuple[DataFrame, str, dict[str, int]]], key: str = "Crash_ID") -> DataFrame:
    """``parents`` with a boolean for each flag: any row of any source (table, code column, flag -> code) has its code."""
    names = list(sources[0][2])
    marks = None
    for table, code, codes in sources:
        rows = table.select(key, *(F.coalesce(F.col(code).try_cast("int") == codes[n], F.lit(False)).alias(n) for n in names))
        marks = rows if marks is None else marks.unionByName(rows)
    held = marks.groupBy(key).agg(*(F.bool_or(n).alias(n) for n in names))
    return parents.drop(*names).join(held, key, "left").withColumns({n: F.coalesce(F.col(n), F.lit(False)) for n in names})


def with_years_lost(crashes: DataFrame, killed: DataFrame, key: str = "Crash_ID", fatal: str = "fatal") -> DataFrame:
    """``yll``: years lost before 75 of the persons killed; fatal crashes without such a person get the recorded mean.

    ``killed``: key, age. A crash whose persons all lack an age counts as recorded, with 0 years.
    """
    by_crash = killed.groupBy(key).agg(F.coalesce(F.sum(tags.years_lost(F.col("age").try_cast("double"))), F.lit(0.0)).alias("__years"))
    joined = crashes.join(by_crash, key, "left")
    mean = joined.where(F.col(fatal) & F.col("__years").isNotNull()).agg(F.avg("__years").alias("__mean"))
    held = joined.crossJoin(F.broadcast(mean))  # one row
    value = F.when(F.col(fatal), F.coalesce("__years", "__mean")).otherwise(F.lit(0.0))
    return held.withColumn("yll", F.bround(value, 1)).drop("__years", "__mean")


def decoded(df: DataFrame) -> DataFrame:
    """Severity, its flags, dates and speed limit from the raw columns."""
    letter = tags.severity_letter(F.col("Crash_Sev_ID").try_cast("int"))
    date = tags.day(F.col("Crash_Date"))
    return df.withColumns({
        "date": date, "year": F.year(date), "month": F.month(date), "hour": tags.clock_hour(F.col("Crash_Time")), "kabco": letter,
        "fatal": letter == "K", "serious": letter == "A", "severe": letter.isin("K", "A"),
        "any_injury": F.coalesce(F.col("Tot_Injry_Cnt").try_cast("double"), F.lit(0.0)) > 0,
        "speed_limit": F.col("Crash_Speed_Limit").try_cast("double"),
    })


def year_gaps(crashes: DataFrame, year: str = "year") -> DataFrame:
    """``year`` without records between the first and the last."""
    span = crashes.agg(F.min(year).alias("a"), F.max(year).alias("b"), F.collect_set(year).alias("seen"))  # one set of years
    return span.where("a is not null").select(F.explode(F.array_except(F.sequence("a", "b"), "seen")).alias(year))


def counts_per_segment(crashes: DataFrame, seg_id: str = "lid") -> DataFrame:
    """Eight conditional counts in one pass."""
    is_in = {"n_crash": "true", "n_injury": "any_injury", "n_severe": "severe", "n_fatal": "fatal", "n_ped": "ped", "n_bike": "bike", "n_ped_severe": "ped and severe", "n_bike_severe": "bike and severe"}
    return crashes.groupBy(seg_id).agg(*(F.count_if(F.expr(e)).alias(n) for n, e in is_in.items()))


def with_counts(segments: DataFrame, counts: DataFrame, seg_id: str = "lid") -> DataFrame:
    names = [c for c in counts.columns if c != seg_id]
    return segments.drop(*names).join(counts.hint("merge"), seg_id, "left").na.fill(0, names)


def enrich(base: DataFrame, new: DataFrame, owned: Sequence[str], key: str = "seg_id") -> DataFrame:
    """Replace the columns that a step owns: running it again gives the same table."""
    return base.drop(*owned).join(new.select(key, *owned), key, "left")


def latest(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The values of the row that is last in a stated order, for each key."""
    return df.groupBy(key).agg(*(F.max_by(v, F.struct(*order)).alias(v) for v in values))


def filled_by_group(df: DataFrame, group: str, value: str, filled: str, source: str) -> DataFrame:
    """``filled``: the value, else the median of the group's values; ``source``: measured, street_median, or null."""
    medians = grouped_medians(df.where(F.col(group).isNotNull()).select(group, value), group, value, "__median")
    joined = df.join(medians, group, "left")
    where = F.when(F.col(value).isNotNull(), "measured").when(F.col("__median").isNotNull(), "street_median")
    return joined.withColumns({filled: F.coalesce(F.col(value), F.bround("__median", 0)), source: where}).drop("__median")
