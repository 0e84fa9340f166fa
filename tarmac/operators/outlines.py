"""Simplified outlines of zones that go on sharing their borders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarmac.operators.graph import stored
from tarmac.operators.simplify import reduced

_POINTS = "array<struct<x: double, y: double>>"


def _open(points: Column) -> Column:
    """A ring without points equal to the one before and without its closing point."""
    some = F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))
    n = F.size(some)
    return F.when((n > 1) & (some[0] == F.get(some, n - 1)), F.slice(some, F.lit(1), F.greatest(n - 1, F.lit(1)))).otherwise(some)


def _corners(rings: DataFrame) -> DataFrame:
    """``x, y`` where borders part or meet: the points whose neighbours are not the same two in every ring through them.

    Least and greatest neighbours are enough to see that, so no point gathers the rings that pass it.
    """
    n = F.size("pts")
    before = F.concat(F.slice("pts", n, F.lit(1)), F.slice("pts", F.lit(1), n - 1))
    after = F.concat(F.slice("pts", F.lit(2), n - 1), F.slice("pts", F.lit(1), F.lit(1)))
    each = rings.select(F.explode(F.arrays_zip(F.col("pts").alias("p"), before.alias("a"), after.alias("b"))).alias("v"))
    pairs = each.select("v.p.x", "v.p.y", F.least("v.a", "v.b").alias("low"), F.greatest("v.a", "v.b").alias("high"))
    got = pairs.groupBy("x", "y").agg(*(f(c).alias(f"{k}_{c}") for c in ("low", "high") for k, f in (("min", F.min), ("max", F.max))))
    return got.where("min_low <> max_low or min_high <> max_high").select("x", "y", F.lit(True).alias("corner"))


def _arcs(points: list[tuple], corners: list[int]) -> list[tuple[list[tuple], bool]]:
    """A ring cut at its corners, each arc in the direction that all rings give it, and whether this ring goes the other way.

    A ring without corners is one closed arc from its least point on.
    """
    if corners:
        turned = points[corners[0] :] + points[: corners[0]]
        at = [c - corners[0] for c in corners] + [len(points)]
        lines = [[*turned[a:b], turned[b % len(points)]] for a, b in zip(at, at[1:])]
    else:
        k = min(range(len(points)), key=points.__getitem__)
        lines = [[*points[k:], *points[:k], points[k]]]
    return [(line[::-1], True) if line[::-1] < line else (line, False) for line in lines]


def _thinned(line: list[tuple], most: float) -> list[tuple]:
    """Reduced, with both ends; a closed line is cut at the point farthest from its end, and keeps three corners at least."""
    if len(line) < 3:
        return line
    if line[0] != line[-1]:
        return reduced(line, most)
    away = max(range(len(line)), key=lambda i: ((line[i][0] - line[0][0]) ** 2 + (line[i][1] - line[0][1]) ** 2, -i))
    made = [*reduced(line[: away + 1], most)[:-1], *reduced(line[away:], most)]
    if len(made) > 3:
        return made
    (x0, y0), (x1, y1) = line[0], line[away]
    third = max(range(len(line)), key=lambda i: (abs((line[i][0] - x0) * (y1 - y0) - (line[i][1] - y0) * (x1 - x0)), -i))
    return [line[i] for i in sorted({0, away, third, len(line) - 1})]


def crosses_itself(points: np.ndarray) -> bool:
    """Whether two edges of a ring (n by 2, not closed) cross inside both, or fewer than three corners are left.

    Edges are sorted by their west ends, and each meets those that begin before it ends.
    """
    n = len(points)
    if len(np.unique(points, axis=0)) < 3:
        return True
    a, b = points, np.roll(points, -1, axis=0)
    west, east = np.minimum(a[:, 0], b[:, 0]), np.maximum(a[:, 0], b[:, 0])
    order = np.argsort(west, kind="stable")
    a, b, west, east = a[order], b[order], west[order], east[order]
    until = np.searchsorted(west, east, side="right")

    def side(p, q, r):
        return np.sign((q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0]))

    for i in range(n):
        c, d = a[i + 1 : until[i]], b[i + 1 : until[i]]
        if len(c) and ((side(a[i], b[i], c) * side(a[i], b[i], d) < 0) & (side(c, d, a[i]) * side(c, d, b[i]) < 0)).any():
            return True
    return False


def shared_outlines(rings: DataFrame, most: float, key: str = "zone_id", ring: str = "ring", points: str = "geometry") -> DataFrame:
    """``key, ring, points``: rings reduced within ``most`` so that zones with a common border have it in common still.

    Rings are cut at the points where borders meet; every stretch between two of them is reduced once, whatever the number
    of rings along it, and the rings are put together again, closed. Where a ring would cross itself or collapse, its
    stretches stay as they were, in all rings along them; that is repeated until no ring does. A ring that crosses itself
    from the start is left whole. Rings of fewer than three different points and null ones come out as they are; repeated
    rows are one. Borders are common where their points are: a point on the middle of a neighbour's edge is not found.
    Work follows the number of points; no task needs more than one ring.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rings.schema.fields}
    given = rings.select(F.col(key).alias("zone"), F.col(ring).alias("ring"), F.col(points).cast(_POINTS).alias("given")).distinct()
    held = given.withColumn("pts", _open(F.col("given"))).withColumn("id", F.xxhash64("given"))
    whole = F.coalesce(F.size(F.array_distinct("pts")) > 2, F.lit(False))
    some, own = held.where(whole), ["zone", "ring", "id"]
    flagged = some.select(*own, F.posexplode("pts").alias("at", "p")).select(*own, "at", "p.x", "p.y").join(_corners(some), ["x", "y"], "left")
    lined = flagged.groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("at", "x", "y", F.coalesce("corner", F.lit(False)).alias("corner")))).alias("v"))
    names = f"zone {kinds[key]}, ring {kinds[ring]}, id long"

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for zone, number, one, vertices in batch.itertuples(index=False):
                line = [(v["x"], v["y"]) for v in vertices]
                for no, (arc, back) in enumerate(_arcs(line, [i for i, v in enumerate(vertices) if v["corner"]])):
                    rows.append((zone, number, one, no, back, hashlib.blake2b(np.array(arc).tobytes(), digest_size=16).digest(), _records(arc), _records(_thinned(arc, most))))
            yield pd.DataFrame(rows, columns=["zone", "ring", "id", "no", "back", "arc", "full", "thin"])

    pieces = stored(lined.mapInPandas(cut, f"{names}, no int, back boolean, arc binary, full {_POINTS}, thin {_POINTS}"))
    uses = pieces.select(*own, "no", "back", "arc")
    arcs = pieces.select("arc", "full", "thin").dropDuplicates(["arc"])

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for zone, number, one, parts in batch.itertuples(index=False):
                line = [(p["x"], p["y"]) for part in parts for p in (part["thin"][::-1] if part["back"] else part["thin"])[:-1]]
                rows.append((zone, number, one, _records([*line, line[0]]), crosses_itself(np.array(line))))
            yield pd.DataFrame(rows, columns=["zone", "ring", "id", "made", "bad"])

    while True:
        parts = uses.join(arcs.select("arc", "thin"), "arc").groupBy(*own).agg(F.array_sort(F.collect_list(F.struct("no", "back", "thin"))).alias("parts"))
        made = stored(parts.mapInPandas(join, f"{names}, made {_POINTS}, bad boolean"))
        same = F.col("u.zone").eqNullSafe(F.col("b.zone")) & F.col("u.ring").eqNullSafe(F.col("b.ring")) & (F.col("u.id") == F.col("b.id"))
        bad = uses.alias("u").join(made.where("bad").alias("b"), same, "left_semi").select("arc").distinct()
        back = arcs.where("size(thin) < size(full)").join(bad, "arc", "left_semi").select("arc", F.lit(True).alias("back"))
        back = stored(back)
        if back.isEmpty():
            break
        arcs = stored(arcs.join(back, "arc", "left").select("arc", "full", F.when(F.col("back"), F.col("full")).otherwise(F.col("thin")).alias("thin")))
    rest = held.where(~whole).select("zone", "ring", F.col("given").alias("made"))
    return made.select("zone", "ring", "made").unionByName(rest).select(F.col("zone").alias(key), F.col("ring").alias(ring), F.col("made").alias(points))


def _records(line: list[tuple]) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in line]
