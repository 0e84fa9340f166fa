"""Shares, Lorenz curves and Gini coefficients over a distributed prefix sum."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.operators.graph import checkpoint


def running_sums(df: DataFrame, order: list[Column], values: list[str], blocks: int | None = None) -> DataFrame:
    """``df`` with ``cum_<value>``: sums over all rows up to each one in the given (total) order.

    Rows are range-partitioned by the order; sums run inside partitions, and the partitions' totals, one row each, are
    added up and joined back. No window spans the table.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parted = checkpoint(df.repartitionByRange(n, *order).withColumn("__block", F.spark_partition_id()))
    inside = Window.partitionBy("__block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    totals = parted.groupBy("__block").agg(*(F.sum(v).alias(f"__{v}") for v in values))
    starts = totals.select("__block", *(F.coalesce(F.sum(f"__{v}").over(before), F.lit(0)).alias(f"__{v}") for v in values))
    summed = parted.withColumns({f"cum_{v}": F.sum(v).over(inside) for v in values}).join(F.broadcast(starts), "__block")  # a row a partition
    return summed.withColumns({f"cum_{v}": F.col(f"cum_{v}") + F.col(f"__{v}") for v in values}).drop("__block", *(f"__{v}" for v in values))


def lorenz(df: DataFrame, weight: str, value: str) -> DataFrame:
    """``weight, value, cum_weight, cum_value`` by density (value over weight, 0 without weight), the densest first.

    Rows of equal density are one point: the curve is straight between its ends, and rows without value, mostly the
    bulk, are one row.
    """
    density = F.when(F.col(weight) > 0, F.col(value) / F.col(weight)).otherwise(F.lit(0.0))
    points = df.select(density.alias("density"), F.col(weight).alias("weight"), F.col(value).alias("value"))
    points = points.groupBy("density").agg(F.sum("weight").alias("weight"), F.sum("value").alias("value"))
    return running_sums(points, [F.col("density").desc()], ["weight", "value"])


def gini(df: DataFrame, weight: str, value: str) -> DataFrame:
    """One row ``gini``: twice the area under the Lorenz curve less one; null if a total is not positive."""
    curve = lorenz(df, weight, value)
    strips = F.sum(F.col("weight") * (2 * F.col("cum_value") - F.col("value")))
    w, v = F.sum("weight"), F.sum("value")
    return curve.agg(F.when((w > 0) & (v > 0), strips / (w * v) - 1).alias("gini"))


def share_at(df: DataFrame, weight: str, value: str, share: float, order: list[Column]) -> DataFrame:
    """One row ``share``: the share of the value at the first row where the weight's share reaches the given one."""
    summed = running_sums(df.select("*"), order, [weight, value])
    total = df.agg(F.sum(weight).alias("__w"), F.sum(value).alias("__v"))
    reached = summed.crossJoin(F.broadcast(total)).where(F.col(f"cum_{weight}") >= share * F.col("__w"))
    return reached.agg(F.min(F.struct(F.col(f"cum_{weight}"), (F.col(f"cum_{value}") / F.col("__v")).alias("share"))).alias("x")).select(F.col("x.share").alias("share"))


def weight_holding(df: DataFrame, weight: str, value: str, share: float) -> DataFrame:
    """One row ``share``: the least share of the weight, densest first, that holds the given share of the value."""
    curve = checkpoint(lorenz(df, weight, value))
    total = curve.agg(F.sum("weight").alias("__w"), F.sum("value").alias("__v"))
    reached = curve.crossJoin(F.broadcast(total)).where(F.col("cum_value") >= share * F.col("__v"))
    return reached.agg((F.min(F.col("cum_weight") / F.col("__w"))).alias("share"))


def exact_quantiles(df: DataFrame, value: str, wanted: dict[str, float]) -> DataFrame:
    """One row with the interpolated quantile of the known values for each name of ``wanted``; nulls for an empty table.

    Values are counted and range-partitioned, so that no task holds them all: a rank is found by the running counts.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    summed = checkpoint(running_sums(counts, [F.col("v")], ["n"]))
    total = summed.agg(F.sum("n").alias("total"))
    held = summed.crossJoin(F.broadcast(total))  # one row
    at = lambda rank: F.min(F.when(F.col("cum_n") > rank, F.col("v")))
    ends = held.agg(*(at(f(q * (F.col("total") - 1))).alias(f"{k}_{n}") for k, q in wanted.items() for n, f in (("low", F.floor), ("high", F.ceil))), F.first("total").alias("total"))
    part = lambda q: q * (F.col("total") - 1) - F.floor(q * (F.col("total") - 1))
    return ends.select(*((F.col(f"{k}_low") + (F.col(f"{k}_high") - F.col(f"{k}_low")) * part(F.lit(q))).alias(k) for k, q in wanted.items()))


def grouped_medians(df: DataFrame, by: str, value: str, name: str = "median", blocks: int | None = None) -> DataFrame:
    """``by, name``: the exact median (mean of the middle two) of the known values of each group; groups without any are absent.

    Values are counted, then range-partitioned by group and value, so that a group with most rows lies over many tasks.
    Counts run up inside the blocks; each block's total of a group, one row for both, places it among the others. A null
    group is a group.
    """
    n = blocks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))
    parted = checkpoint(counts.repartitionByRange(n, "g", "v").withColumn("block", F.spark_partition_id()))
    group = Window.partitionBy("g")
    before = group.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    parts = parted.groupBy("block", "g").agg(F.sum("n").alias("part"))
    parts = parts.select(F.col("block").alias("b"), F.col("g").alias("h"), F.coalesce(F.sum("part").over(before), F.lit(0)).alias("start"), F.sum("part").over(group).alias("total"))
    upto = parted.withColumn("cum", F.sum("n").over(Window.partitionBy("block", "g").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)))
    ranked = upto.join(parts, (F.col("block") == F.col("b")) & F.col("g").eqNullSafe(F.col("h")))
    at = lambda rank: F.min(F.when(F.col("start") + F.col("cum") > rank, F.col("v")))
    return ranked.groupBy("g").agg(((at(F.floor((F.col("total") - 1) / 2)) + at(F.ceil((F.col("total") - 1) / 2))) / 2).alias(name)).withColumnRenamed("g", by)
