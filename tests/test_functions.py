"""Scalar and geometry expressions on hand-made cases."""

import math

import pytest
from pyspark.sql import functions as F
from tarmac.functions import geometry as g
from tarmac.functions import projection, tags


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def line(*points):
    return g.line(*((F.lit(float(x)), F.lit(float(y))) for x, y in points))


def test_lines(spark):
    bent = line((0, 0), (30, 0), (30, 40))
    got = one(
        spark, length=g.length(bent), mid=g.midpoint(bent), start=g.interpolate(bent, F.lit(0.0)), end=g.interpolate(bent, F.lit(1.0)), bearing=g.compass_bearing(line((0, 0), (-5, 0))),
        area=g.ring_area(line((0, 0), (4, 0), (4, 3), (0, 3))), rep=g.representative_point(bent), piece=g.piece_bearing(*(F.lit(float(v)) for v in (0, 0, -1, -1))),
        joined=g.merge_touching(line((0, 0), (1, 1)), line((2, 2), (1, 1))), apart=g.merge_touching(line((0, 0), (1, 1)), line((2, 2), (3, 3))), short=g.length(line((1, 1))),
    )
    assert got["length"] == 70 and (got["mid"].x, got["mid"].y) == (30, 5)
    assert (got["start"].x, got["end"].y) == (0, 40) and got["bearing"] == 270 and got["area"] == 12
    assert (got["rep"].x, got["rep"].y) == (30, 0) and got["piece"] == pytest.approx(45)
    assert [(p.x, p.y) for p in got["joined"]] == [(0, 0), (1, 1), (2, 2)] and got["apart"] is None and got["short"] == 0


def test_distances(spark):
    f = lambda *v: tuple(F.lit(float(x)) for x in v)
    got = one(
        spark, inside=g.point_piece_d2(*f(5, 3), *f(0, 0, 10, 0)), before=g.point_piece_d2(*f(-3, 4), *f(0, 0, 10, 0)), point=g.point_piece_d2(*f(3, 4), *f(0, 0, 0, 0)),
        crossing=g.piece_piece_d2(f(0, 0, 10, 10), f(0, 10, 10, 0)), beside=g.piece_piece_d2(f(0, 0, 10, 0), f(0, 6, 10, 6)), inline=g.piece_piece_d2(f(0, 0, 1, 0), f(3, 0, 5, 0)),
        parallel=g.parallel_within(f(0, 0, 10, 0), f(5, 5, -5, 6), math.tan(math.radians(30))), across=g.parallel_within(f(0, 0, 10, 0), f(0, 0, 0, 5), math.tan(math.radians(30))),
        opposed=g.opposed(f(0, 0, 10, 0), f(10, 1, 0, 1)), same=g.opposed(f(0, 0, 10, 0), f(0, 1, 10, 1)), corner=g.opposed(f(0, 0, 10, 0), f(0, 0, -10, 10)),
    )
    assert (got["inside"], got["before"], got["point"], got["crossing"], got["beside"], got["inline"]) == (9, 25, 25, 0, 36, 4)
    assert got["parallel"] and not got["across"] and got["opposed"] and not got["same"] and got["corner"]


def test_projection(spark):
    x, y = projection.to_feet(F.lit(-99.0), F.lit(27.0 + 50 / 60))
    lon, lat = projection.to_degrees(*projection.to_feet(F.lit(-95.3698), F.lit(29.7604)))
    got = one(spark, x=x, y=y, lon=lon, lat=lat)
    # The origin lies at the false easting and northing.
    assert got["x"] == pytest.approx(600000 * 3937 / 1200, abs=1e-3) and got["y"] == pytest.approx(4000000 * 3937 / 1200, abs=1e-3)
    assert got["lon"] == pytest.approx(-95.3698, abs=1e-10) and got["lat"] == pytest.approx(29.7604, abs=1e-10)
    # A degree of latitude is about 363,700 ft here, and the scale is within 2 in 10,000.
    a, b = (projection.to_feet(F.lit(-95.4), F.lit(v)) for v in (29.7, 29.8))
    far = one(spark, d=F.hypot(a[0] - b[0], a[1] - b[1]))["d"]
    assert far == pytest.approx(36371, rel=2e-3)


@pytest.mark.parametrize(("text", "lanes", "mph", "feet"), [("2;3", 2, 2, 2 * 3.28084), ("35 mph", None, 35, None), ("12'", None, None, 12), ("4 m", None, None, 4 * 3.28084), ("10 ft", None, None, 10), (None, None, None, None), ("wide", None, None, None)])
def test_tag_numbers(spark, text, lanes, mph, feet):
    t = F.lit(text).cast("string")
    got = one(spark, lanes=tags.lanes(t), mph=tags.speed_mph(t), feet=tags.width_feet(t))
    assert got["lanes"] == lanes and got["mph"] == mph
    if text != "2;3":
        assert got["feet"] == (pytest.approx(feet) if feet else None)


@pytest.mark.parametrize(("main", "both", "left", "right", "want"), [("both", None, None, None, "both"), (None, "yes", None, None, "both"), ("left", None, None, None, "one_side"), ("no", None, "yes", None, "none"), (None, None, "yes", "separate", "both"), (None, None, "yes", "no", "one_side"), (None, None, "no", "none", "none"), (None, None, "no", None, None), ("yes", None, None, None, "one_side"), (None, None, None, None, None)])
def test_sidewalk_table(spark, main, both, left, right, want):
    assert one(spark, s=tags.sidewalk_status(*(F.lit(x).cast("string") for x in (main, both, left, right))))["s"] == want


def test_rules(spark):
    s = lambda x: F.lit(x).cast("string")
    got = one(
        spark, hour=tags.clock_hour(s("07:45 PM")), midnight=tags.clock_hour(s("12:05 am")), bad=tags.clock_hour(s("25:00")), day=tags.day(s("2020-02-30")), kabco=tags.severity_letter(F.lit(9)), k=tags.severity_letter(F.lit(4)),
        edge=tags.income_tier(F.lit(50000.0)), top=tags.income_tier(F.lit(9e9)), none=tags.income_tier(F.lit(None).cast("double")), old=tags.years_lost(F.lit(80)), pct=tags.percent(F.lit(1), F.lit(0)), half=tags.percent(F.lit(1), F.lit(8)),
        sentinel=tags.no_sentinel(F.lit(-666666666)), tol=tags.sidewalk_tolerance(F.lit(None).cast("double")), wide=tags.sidewalk_tolerance(F.lit(200.0)), agree=tags.agree_within(F.lit(2.0), F.lit(3.0)), unknown=tags.agree_within(F.lit(2.0), F.lit(None).cast("double")),
        names=tags.names_agree(s("N Main Street"), s("MAIN ST")), nameless=tags.names_agree(s(None), s("MAIN")), link=tags.road_class(s("primary_link")), part=tags.side_class(F.lit(0.2), F.lit(0.1)), none_=tags.side_class(F.lit(0.0), F.lit(0.0)),
        cost=tags.crash_cost({k: F.lit(1) for k in "kabco"}, tags.ECONOMIC_COST), geoid=tags.geoid(s("48"), s("201"), s("000100"), s("1")), use=tags.land_use(s("Office")), other=tags.land_use(s("?")), freeway=tags.on_limited_access(F.lit(2), F.lit(None).cast("int"), s("katy fwy")), nofwy=tags.on_limited_access(F.lit(2), F.lit(None).cast("int"), s(None)),
    )
    assert (got["hour"], got["midnight"], got["bad"], got["day"], got["kabco"], got["k"]) == (19, 0, None, None, "UNK", "K")
    assert (got["edge"], got["top"], got["none"], got["old"], got["pct"], got["half"]) == (1, 3, None, 0, None, 12.5)
    assert (got["sentinel"], got["tol"], got["wide"], got["agree"], got["unknown"]) == (None, 37.0, 60.0, True, None)
    assert (got["names"], got["nameless"], got["link"], got["part"], got["none_"]) == (True, False, "Minor street", "partial", "none")
    assert (got["cost"], got["geoid"], got["use"], got["other"], got["freeway"], got["nofwy"]) == (1855515, "482010001001", "Commercial", "Unknown", True, False)


def test_published_costs():
    persons = dict(zip("kabco", (1780, 9596, 46851, 140894, 799522)))
    total = lambda table: sum(n * table[k] for k, n in persons.items())
    assert round(total(tags.ECONOMIC_COST) / 1e9, 2) == 15.26 and round(total(tags.COMPREHENSIVE_COST) / 1e9, 2) == 64.85
