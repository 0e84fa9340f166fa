"""Sums over the zones near lines: the same as over all pairs, which are not dealt out."""

import os
import random
import re

import pytest

from tarmac.operators import near_areas, spatial

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def layers(spark, seed):
    """Lines of one to four pieces; rectangles, triangles, wide zones, rings of many edges, open ones, holes in the values."""
    rng = random.Random(seed)
    at = lambda w: (float(rng.randint(-w, w)), float(rng.randint(-w, w)))
    pieces, edges, zones = [], [], []
    for lid in range(150):
        p = at(300)
        for k in range(rng.randint(1, 4)):
            q = tuple(c + rng.randint(-60, 60) for c in p)
            pieces.append((lid, k, *p, *q))
            p = q
    pieces += [(900, 0, None, 1.0, 2.0, 3.0), (901, 0, -900.0, 0.0, 900.0, 5.0), (902, 0, 7.0, 7.0, 7.0, 7.0)]
    for z in range(400):
        x, y = at(320)
        if z % 9 == 0:
            ring = [at(320) for _ in range(3)]
        elif z % 9 == 1:
            ring = [(x + 3 * (k % 20), y + (k * 7) % 11 + (30 if k >= 20 else 0)) for k in range(40)]
        else:
            w, h = rng.choice([(9, 9), (30, 12), (40, 40), (150, 60)])
            ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)][: 3 if z % 9 == 2 else 4]
        ends = list(zip(ring, ring[1:] + ring[:1]))
        edges += [(z, *a, *b) for a, b in (ends[:-1] if z % 50 == 7 else ends)]
        zones.append((z, rng.choice(["a", "b", "Unknown", None]), None if z % 13 == 0 else float(rng.randint(1, 999))))
    zones += [(5, "again", 3.0), (7777, "no edges", 1.0)]
    return (
        spark.createDataFrame(pieces, "lid long, piece int, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(zones, "zone_id long, lu string, area double"),
        spark.createDataFrame([*edges, (None, 0.0, 0.0, 1.0, 1.0)], "zone_id long, x0 double, y0 double, x1 double, y1 double"),
    )


def summed(rows):
    out = {}
    for lid, lu, area, n in rows:
        held = out.setdefault((lid, lu), [None, 0])
        held[0] = area if held[0] is None else held[0] if area is None else held[0] + area
        held[1] += n
    return out


@pytest.mark.parametrize("crowd", [near_areas.CROWD, (20, 15)])
def test_sums_are_those_of_all_pairs(spark, crowd):
    pieces, zones, edges = layers(spark, 3)
    pairs = spatial.area_weighted_neighbours(pieces, zones, edges, 40.0, "lu").collect()
    want = summed((r.lid, r.lu, r.area, 1) for r in pairs)
    got = summed((r.lid, r.lu, r.area, r.n) for r in near_areas.areas_within(pieces, zones, edges, 40.0, "lu", crowd=crowd).collect())
    assert len(pairs) > 2000 and got == want


def test_nothing_near_nothing(spark):
    pieces, zones, edges = layers(spark, 4)
    for p, z, e in ((pieces.where("false"), zones, edges), (pieces, zones.where("false"), edges), (pieces, zones, edges.where("false"))):
        assert near_areas.areas_within(p, z, e, 40.0, "lu").count() == 0


def test_zones_at_the_very_reach(spark):
    """Distances equal to the reach count, on every side and at corners; those a little beyond it do not."""
    pieces = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0)], "lid long, piece int, x0 double, y0 double, x1 double, y1 double")
    corners = [(110.0, 0.0), (-120.0, -5.0), (0.0, 100.0), (3.0, -120.0), (70.0, 80.0), (110.5, 0.0), (0.0, 100.001), (70.0, 80.5)] * 20
    rows = [(k, *c) for k, c in enumerate(corners)]
    zones = spark.createDataFrame([(k, "a", 1.0) for k, *_ in rows], "zone_id long, lu string, area double")
    ends = lambda x, y: [(x, y, x + 20, y), (x + 20, y, x + 20, y + 20), (x + 20, y + 20, x, y + 20), (x, y + 20, x, y)]
    edges = spark.createDataFrame([(k, *e) for k, x, y in rows for e in ends(x, y)], "zone_id long, x0 double, y0 double, x1 double, y1 double")
    got = near_areas.areas_within(pieces, zones, edges, 100.0, "lu").collect()
    assert summed((r.lid, r.lu, r.area, r.n) for r in got) == {(1, "a"): [100.0, 100]}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["sj13_land_use", "sj13_bent_land_use"])
def test_pairs_are_not_shuffled(spark, name):
    import __spark_entry__ as entry

    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\(lid#\w+, zone_id#|hashpartitioning\(zone_id#\w+, lid#", plan)
    assert len(re.findall(r"FlatMapCoGroups", plan)) == 1  # worked out once
