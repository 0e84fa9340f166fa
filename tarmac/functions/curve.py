"""Places in order along a space-filling curve, so that rows near each other on the map are near each other in files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each coordinate in a place.
BITS = 16


def _spread(v: Column) -> Column:
    """The bits of a number below 2^BITS with an empty bit before each."""
    width = BITS // 2
    while width:
        mask = sum(((1 << width) - 1) << (2 * width * k) for k in range(BITS // width))
        v = F.shiftleft(v, width).bitwiseOR(v).bitwiseAND(F.lit(mask).cast("long"))
        width //= 2
    return v


def place(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Number of a point along the Z-shaped curve through a box (x0, y0, x1, y1); points beyond it count for its rim."""

    def step(v: Column, low: float, high: float) -> Column:
        share = (v - low) / ((high - low) or 1.0)
        return F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * ((1 << BITS) - 1)).cast("long")

    return F.shiftleft(_spread(step(y, box[1], box[3])), 1).bitwiseOR(_spread(step(x, box[0], box[2])))
