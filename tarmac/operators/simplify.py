"""Line simplification for display."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def reduced(points: list, most: float) -> list:
    """Douglas-Peucker without recursion: the points farther than ``most`` from the chords that are kept."""
    keep, open_ = {0, len(points) - 1}, [(0, len(points) - 1)]
    while open_:
        a, b = open_.pop()
        (x0, y0), (x1, y1) = points[a], points[b]
        dx, dy = x1 - x0, y1 - y0
        size = dx * dx + dy * dy
        far, at = most * most, None
        for i in range(a + 1, b):
            px, py = points[i]
            t = min(1.0, max(0.0, ((px - x0) * dx + (py - y0) * dy) / size)) if size else 0.0
            d2 = (px - x0 - t * dx) ** 2 + (py - y0 - t * dy) ** 2
            if d2 > far:
                far, at = d2, i
        if at is not None:
            keep.add(at)
            open_ += [(a, at), (at, b)]
    return [points[i] for i in sorted(keep)]


def simplify(df: DataFrame, most: float, points: str = "geometry") -> DataFrame:
    """``df`` with its line column reduced; ends stay. Lines of fewer than three points are left as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = []
            for line in batch[points]:
                flat = [] if line is None else [(p["x"], p["y"]) for p in line]
                made.append(None if line is None else [{"x": x, "y": y} for x, y in (reduced(flat, most) if len(flat) > 2 else flat)])
            yield batch.assign(**{points: pd.Series(made, index=batch.index, dtype=object)})

    return df.mapInPandas(run, df.schema)
