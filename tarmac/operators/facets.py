"""Faceted queries over crash facts: filters, counts with self-exclusion, trends and rankings."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarmac.functions import tags


def cyclic(value: Column, first: int, last: int) -> Column:
    """Inside a range that may wrap, such as 18 to 6 o'clock or November to February."""
    return value.between(first, last) if first <= last else (value >= first) | (value <= last)


@dataclass(frozen=True)
class Selection:
    """What is chosen; an empty set is everything. A range of months (year * 12 + month - 1) stands in place of years and
    months. District and neighbourhood exclude each other."""

    years: frozenset[int] = frozenset()
    months: frozenset[int] = frozenset()
    weekdays: frozenset[int] = frozenset()
    hours: frozenset[int] = frozenset()
    month_range: tuple[int, int] | None = None
    mode: str = "all"
    owner: str = "all"
    severe_only: bool = False
    district: str | None = None
    neighbourhood: int | None = None
    streets: frozenset[str] = frozenset()
    segments: frozenset = frozenset()

    def __post_init__(self) -> None:
        if self.district is not None and self.neighbourhood is not None:
            raise ValueError("either a district or a neighbourhood")

    def predicate(self, skip: str | None = None) -> Column:
        """All chosen conditions but that of the facet ``skip``."""
        out = F.lit(True)
        sets = {"year": self.years, "month": self.months, "weekday": self.weekdays, "hour": self.hours}
        if self.month_range and skip not in ("year", "month"):
            index = F.col("year") * 12 + F.col("month") - 1
            out = out & index.between(*self.month_range)
            sets = {k: v for k, v in sets.items() if k not in ("year", "month")}
        for name, chosen in sets.items():
            if chosen and name != skip:
                out = out & F.col(name).isin(sorted(chosen))
        modes = {"all": F.lit(True), "driving": ~F.col("ped") & ~F.col("bike"), "walking": F.col("ped"), "biking": F.col("bike")}
        out = out & modes[self.mode]
        if self.owner != "all" and skip != "owner":
            out = out & (F.col("state_owned") == (self.owner == "state"))
        if self.severe_only:
            out = out & F.col("severe")
        for name, one in (("district", self.district), ("neighbourhood", self.neighbourhood)):
            if one is not None:
                out = out & (F.col(name) == one)
        for name, chosen in (("street", self.streets), ("seg_id", self.segments)):
            if chosen:
                out = out & F.col(name).isin(sorted(chosen))
        return out

    def with_(self, **changes) -> Selection:
        return replace(self, **changes)


def filtered(facts: DataFrame, chosen: Selection) -> DataFrame:
    return facts.where(chosen.predicate())


def facet_counts(facts: DataFrame, chosen: Selection, facets: Sequence[str] = ("year", "month", "weekday", "hour")) -> DataFrame:
    """``facet, bucket, n, n_severe``: each time chart ignores its own filter.

    One scan: a row counts for each facet whose own filter is the only one that it may fail.
    """
    if not facets:
        raise ValueError("no facets")
    one = lambda name: F.when(chosen.predicate(skip=name), F.struct(F.lit(name).alias("facet"), F.col(name).cast("int").alias("bucket")))
    counted = facts.select("severe", F.explode(F.array_compact(F.array(*map(one, facets)))).alias("f"))
    return counted.groupBy("f.facet", "f.bucket").agg(F.count("*").alias("n"), F.count_if("severe").alias("n_severe"))


def stacked(facts: DataFrame, bucket: str, severe_mode: bool) -> DataFrame:
    """``bucket, lower, upper``: killed and serious crashes, or severe and other ones."""
    lower, upper = (F.col("fatal"), F.col("severe") & ~F.col("fatal")) if severe_mode else (F.col("severe"), ~F.col("severe"))
    return facts.groupBy(F.col(bucket).alias("bucket")).agg(F.count_if(lower).alias("lower"), F.count_if(upper).alias("upper"))


def trend(by_year: DataFrame, year: str, value: str, partial_year: int | None = None, span: int = 3) -> DataFrame:
    """One row ``slope, intercept, change``: a line through the yearly values, and the change in percent of the mean of
    the last ``span`` full years against that of the first ones."""
    full = by_year if partial_year is None else by_year.where(F.col(year) != partial_year)
    ends = full.agg(F.min(year).alias("a"), F.max(year).alias("b"))
    held = full.crossJoin(F.broadcast(ends))
    old, new = (F.avg(F.when(c, F.col(value))) for c in (F.col(year) < F.col("a") + span, F.col(year) > F.col("b") - span))
    return held.agg(F.regr_slope(value, year).alias("slope"), F.regr_intercept(value, year).alias("intercept"), (100 * (new / old - 1)).alias("change"))


def tally(facts: DataFrame, counts: Sequence[str] = ("n_k", "n_a", "n_b", "n_c", "n_noinj")) -> DataFrame:
    """One row: killed, serious, KSI, years lost, economic and comprehensive cost."""
    held = dict(zip("kabco", (F.col(c) for c in counts)))
    return facts.agg(
        F.count_if("fatal").alias("killed"), F.count_if(F.col("severe") & ~F.col("fatal")).alias("serious"), F.count_if("severe").alias("ksi"), F.bround(F.sum("yll"), 1).alias("yll"),
        F.sum(tags.crash_cost(held, tags.ECONOMIC_COST)).alias("economic"), F.sum(tags.crash_cost(held, tags.COMPREHENSIVE_COST)).alias("comprehensive"),
    )


def breakdown(facts: DataFrame, by: str, chosen: Selection = Selection()) -> DataFrame:
    """``bucket, n, n_severe, share``; a breakdown by owner ignores the owner filter."""
    got = facts.where(chosen.predicate(skip="owner" if by == "state_owned" else None)).groupBy(F.col(by).alias("bucket")).agg(F.count("*").alias("n"), F.count_if("severe").alias("n_severe"))
    return got.crossJoin(F.broadcast(got.agg(F.sum("n").alias("__n")))).withColumn("share", F.bround(100.0 * F.col("n") / F.col("__n"), 1)).drop("__n")


def top(df: DataFrame, by: Sequence[str], value: Column, n: int, name: str = "total") -> DataFrame:
    return df.groupBy(*by).agg(value.alias(name)).orderBy(F.desc(name), *by).limit(n)


def corridors(segments: DataFrame, values: Sequence[str]) -> DataFrame:
    """Sums over name and owner; a segment without a name is a corridor of its own."""
    key = F.coalesce("name", F.concat(F.lit("#"), F.col("lid").cast("string")))
    return segments.groupBy(key.alias("corridor"), "state_owned").agg(F.count("*").alias("blocks"), *(F.sum(v).alias(v) for v in values))


def street_profile(segments: DataFrame, ranges: Sequence[str], sums: Sequence[str]) -> DataFrame:
    spans = [f(c).alias(f"{n}_{c}") for c in ranges for n, f in (("min", F.min), ("max", F.max))]
    return segments.where("name is not null").groupBy("name").agg(F.count("*").alias("blocks"), *(F.sum(c).alias(c) for c in sums), *spans)


def street_ranks(streets: DataFrame, value: str, shown: float = 10.0) -> DataFrame:
    """Competition rank among streets with a positive value; ``top_percent`` only up to ``shown``.

    Ranks come from the sorted distinct values, so that no window spans the streets.
    """
    some = streets.where(F.col(value) > 0)
    levels = some.groupBy(value).agg(F.count("*").alias("__at"))
    above = Window.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = levels.select(value, (F.coalesce(F.sum("__at").over(above), F.lit(0)) + 1).alias("rank"))
    joined = some.join(ranks, value).crossJoin(F.broadcast(some.agg(F.count("*").alias("of"))))
    percent = F.bround(100.0 * F.col("rank") / F.col("of"), 1)
    return joined.withColumn("top_percent", F.when(percent <= shown, percent))


def shading_cap(df: DataFrame, value: str, q: float = 0.97) -> DataFrame:
    """``value`` clamped to a percentile of its positive values, as ``shade``."""
    cap = df.where(F.col(value) > 0).agg(F.percentile(value, q).alias("__cap"))
    return df.crossJoin(F.broadcast(cap)).withColumn("shade", F.least(F.col(value).cast("double"), F.col("__cap"))).drop("__cap")


def log_classes(df: DataFrame, value: str, classes: int = 5) -> DataFrame:
    """``class``: 0 to classes - 1 on a logarithmic scale from 0 to the largest value, for counts that are mostly zero."""
    most = df.agg(F.max(value).alias("__most"))
    share = F.log1p(F.col(value)) / F.log1p(F.col("__most"))
    return df.crossJoin(F.broadcast(most)).withColumn("class", F.when(F.col("__most") > 0, F.least(F.floor(share * classes + 1e-9), F.lit(classes - 1))).otherwise(0).cast("int")).drop("__most")


def screen(df: DataFrame, bounds: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Rows within all set bounds; a null value is kept unless a bound of its column is set."""
    out = F.lit(True)
    for name, (low, high) in bounds.items():
        if low is not None:
            out = out & F.coalesce(F.col(name) >= low, F.lit(False))
        if high is not None:
            out = out & F.coalesce(F.col(name) <= high, F.lit(False))
    return df.where(out)


def search_streets(segments: DataFrame, text: str, value: str = "n_severe") -> DataFrame:
    """``name, segments, best``: streets whose name holds the text, with the segment of highest value."""
    hit = segments.where(F.upper("name").contains(text.upper()))
    return hit.groupBy("name").agg(F.count("*").alias("segments"), F.max_by("lid", F.struct(F.col(value), -F.col("lid"))).alias("best"))
