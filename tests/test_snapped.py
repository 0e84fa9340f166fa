"""Samples snapped by rounded distances: widening radii give what all pairs give."""

import os
import random

import pytest

from tarmac.operators import spatial

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def distance(p, s):
    (px, py), (x0, y0, x1, y1) = p, s
    dx, dy = x1 - x0, y1 - y0
    t = 0.0 if dx == dy == 0 else min(max(((px - x0) * dx + (py - y0) * dy) / (dx * dx + dy * dy), 0.0), 1.0)
    return (px - x0 - t * dx) ** 2 + (py - y0 - t * dy) ** 2


def always_widen(monkeypatch):
    """Searches in several rounds however few pieces there are; the radii that they look at."""
    monkeypatch.setattr(spatial, "DENSE", 1)
    monkeypatch.setattr(spatial, "WORTH", 0)
    near, seen = spatial.near_pairs, []
    monkeypatch.setattr(spatial, "near_pairs", lambda points, pieces, reach, *how, **more: seen.append(reach) or near(points, pieces, reach, *how, **more))
    return seen


def test_equal_by_rounding(spark, monkeypatch):
    """Of distances that are equal once rounded the least id wins, on whichever side of a radius they lie."""
    seen = always_widen(monkeypatch)
    rng = random.Random(5)
    points, pieces = [], []
    for k in range(120):
        x, y = rng.uniform(-300, 300), rng.uniform(-300, 300)
        points.append((k, x, y))
        off = rng.choice([0.9375, 3.75, 15.0, 60.0, rng.uniform(0, 70)])  # 60 and its quarters: the radii of the rounds
        for j, by in enumerate(rng.sample([0.0, 2e-6, -2e-6, 4e-7, 0.01], 4)):
            ox = off + by / max(off, 1.0)
            pieces.append((k * 4 + 3 - j, x + ox, y, x + ox, y + rng.choice([0.0, 5.0]), f"s{k * 4 + 3 - j}"))
    frame = spark.createDataFrame(points, "pid long, px double, py double"), spark.createDataFrame(pieces, "lid long, x0 double, y0 double, x1 double, y1 double, name string")
    got = {r.pid: (r.lid, r.d2, r.name) for r in spatial.nearest(*frame, 60.0, ("name",), digits=1).collect()}
    want = {}
    for k, x, y in points:
        best = min((round(distance((x, y), s[1:5]), 1), s[0], s[5]) for s in pieces)
        if best[0] <= 3600:
            want[k] = (best[1], best[0], best[2])
    assert got == want and len(seen) > 1 and min(seen) < 20 and len(want) > 90


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_modal_speed_widens(spark, monkeypatch):
    """Where lines are dense, samples do not meet all that are within reach; the result is the same."""
    import __spark_entry__ as entry

    query = entry.queries()["sj8_modal_speed"]
    once = sorted(map(tuple, query(spark, SF).collect()))
    seen = always_widen(monkeypatch)
    assert sorted(map(tuple, query(spark, SF).collect())) == once and once
    assert len(seen) > 1 and min(seen) < 30
