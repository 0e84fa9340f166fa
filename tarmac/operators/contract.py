"""Declarative checks of published tables: rows ``check, level, value, ok``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Check:
    """An aggregate whose value must lie within bounds."""

    name: str
    value: Column
    low: float | None = None
    high: float | None = None
    level: str = "error"

    def row(self, column: Column) -> Column:
        v = column.cast("double")
        ok = F.coalesce(v.isNotNull() & (F.lit(True) if self.low is None else v >= self.low) & (F.lit(True) if self.high is None else v <= self.high), F.lit(False))
        return F.struct(F.lit(self.name).alias("check"), F.lit(self.level).alias("level"), v.alias("value"), ok.alias("ok"))


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """All checks of a table in one pass."""
    totals = df.agg(*(c.value.alias(f"v{i}") for i, c in enumerate(checks)))
    return totals.select(F.explode(F.array(*(c.row(F.col(f"v{i}")) for i, c in enumerate(checks)))).alias("x")).select("x.*")


def run_checks_by(df: DataFrame, keys: Sequence[str], checks: Sequence[Check]) -> DataFrame:
    """All checks in each group of a table, in one pass: the keys and ``check, level, value, ok``; nulls are a group."""
    totals = df.groupBy(*keys).agg(*(c.value.alias(f"__v{i}") for i, c in enumerate(checks)))
    return totals.select(*keys, F.explode(F.array(*(c.row(F.col(f"__v{i}")) for i, c in enumerate(checks)))).alias("__x")).select(*keys, "__x.*")


def statuses(results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys and ``errors, warnings`` (open checks of each level) and ``passed``, as ``passed`` says for a whole table."""
    open_at = lambda error: F.count_if(((F.col("level") == "error") == error) & ~F.col("ok"))
    return results.groupBy(*keys).agg(open_at(True).alias("errors"), open_at(False).alias("warnings")).withColumn("passed", F.col("errors") == 0)


def row_count(low: int, high: int, name: str = "rows") -> Check:
    return Check(name, F.count("*"), low, high)


def no_nulls(columns: Sequence[str]) -> list[Check]:
    return [Check(f"null {c}", F.count_if(F.col(c).isNull()), high=0) for c in columns]


def none_where(name: str, condition: Column, level: str = "error") -> Check:
    """No row may meet the condition; a null condition counts as met."""
    return Check(name, F.count_if(F.coalesce(condition, F.lit(True))), high=0, level=level)


def flags(columns: Sequence[str]) -> list[Check]:
    return [none_where(f"flag {c}", ~F.col(c).isin(0, 1)) for c in columns]


def unique(key: str) -> Check:
    return Check(f"repeated {key}", F.count(key) - F.count_distinct(key), high=0)


def in_box(lat: str, lon: str, box: tuple[float, float, float, float]) -> Check:
    return none_where("out of box", ~(F.col(lat).between(box[0], box[1]) & F.col(lon).between(box[2], box[3])))


def share(name: str, condition: Column, low: float, high: float = 1.0, level: str = "error") -> Check:
    return Check(name, F.avg(F.coalesce(condition, F.lit(False)).cast("double")), low, high, level)


def reconcile(left: DataFrame, right: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """Two one-row tables of totals must agree within relative tolerances."""
    both = left.select(*(F.col(c).alias(f"a_{c}") for c in tolerances)).crossJoin(right.select(*(F.col(c).alias(f"b_{c}") for c in tolerances)))
    rows = []
    for c, most in tolerances.items():
        off = F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) / F.greatest(F.abs(F.col(f"b_{c}")), F.lit(1))
        rows.append(Check(f"reconcile {c}", off, high=most).row(off))
    return both.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def references(child: DataFrame, parent: DataFrame, key: str, most: float = 0.01) -> DataFrame:
    """The share of distinct keys without a parent: a warning above 0, an error above ``most``."""
    ids = child.select(key).where(F.col(key).isNotNull()).distinct()
    marked = ids.join(parent.select(key, F.lit(True).alias("__known")).distinct(), key, "left")
    value = F.coalesce(F.avg(F.col("__known").isNull().cast("double")), F.lit(0.0))
    checks = [Check(f"orphan {key}", value, high=most), Check(f"any orphan {key}", value, high=0, level="warning")]
    return run_checks(marked, checks)


def not_empty(tables: dict[str, tuple[DataFrame, bool]]) -> DataFrame:
    """Tables (frame, required) must have a row; optional ones warn."""
    parts = [run_checks(df.limit(1), [Check(f"rows {name}", F.count("*"), low=1, level="error" if required else "warning")]) for name, (df, required) in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def version_diff(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """``column, changed``: rows whose value differs between two versions, and keys in one alone (as ``<key>``)."""
    a, b = old.select(F.col(key).alias("__a"), *(F.col(c).alias(f"a_{c}") for c in columns)), new.select(F.col(key).alias("__b"), *(F.col(c).alias(f"b_{c}") for c in columns))
    met = a.join(b, F.col("__a") == F.col("__b"), "full")
    alone = F.col("__a").isNull() | F.col("__b").isNull()
    counts = [F.count_if(alone).alias(key), *(F.count_if(~alone & ~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}"))).alias(c) for c in columns)]
    row = met.agg(*counts)
    return row.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("changed")) for c in [key, *columns]))).alias("x")).select("x.*")


def passed(results: DataFrame) -> bool:
    """Whether no error is open; warnings don't count."""
    return results.where("level = 'error' and not ok").limit(1).count() == 0


def row_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, change`` (added, removed, changed) between two versions with the same columns; rows that are alike are left out.

    Keys are unique; a null key is one. Rows are compared by their values, nulls being alike, after one join on the key.
    """
    rest = [c for c in new.columns if c != key]
    a, b = (df.select(F.col(key).alias(f"__{n}"), F.struct(*rest).alias(n)) for df, n in ((old, "old"), (new, "new")))
    both = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), F.col("__old").eqNullSafe(F.col("__new")), "full")
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.select(F.when(F.col("__b"), F.col("__new")).otherwise(F.col("__old")).alias(key), change.alias("change")).where("change is not null")
