"""Operators on micro tables with known answers, and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tarmac.functions import curve
from tarmac.functions import geometry as g
from tarmac.operators import concentration, conflate, contract, dissolve, facets, network, outlines, records, simplify, spatial
from tarmac.operators.graph import connected_components
from tarmac.sources import readers, writers


def pairs(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (100, 102), (7, 7), (None, 3)], "src long, dst long")
    got = dict(pairs(connected_components(edges), "node", "component"))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(edges.where("false")).count() == 0


def test_components_of_long_paths(spark):
    rng = random.Random(3)
    descending = [0, *range(400, 0, -1)]
    shuffled = rng.sample(range(1000, 1600), 600)
    star = [(2000 + i, 5000) for i in range(300)]
    edges = spark.createDataFrame([*zip(descending, descending[1:]), *zip(shuffled, shuffled[1:]), *star], "src long, dst long")
    got = dict(pairs(connected_components(edges), "node", "component"))
    assert got == {**{i: 0 for i in range(401)}, **{i: 1000 for i in range(1000, 1600)}, **{i: 2000 for i in [*range(2000, 2300), 5000]}}


def test_two_sides(spark):
    twins = spark.createDataFrame([(0, 1), (2, 1), (2, 3), (10, 11), (11, 12), (10, 12), (20, 21)], "src long, dst long")
    rows = {r.node: r for r in network.two_sides(twins).collect()}
    assert all(rows[a].side != rows[b].side for a, b in [(0, 1), (2, 1), (2, 3), (20, 21)])
    assert all(rows[n].conflict == (n in (10, 11, 12)) for n in rows) and len(rows) == 9
    assert {n: rows[n].component for n in rows} == {0: 0, 1: 0, 2: 0, 3: 0, 10: 10, 11: 10, 12: 10, 20: 20, 21: 20}
    assert (rows[10].side, rows[11].side, rows[12].side) == (0, 1, 1)


def test_absorption(spark):
    rows = [("a", "Main", 1, 2, 500.0, "primary"), ("b", "Main", 2, 3, 40.0, "primary"), ("c", "Main", 3, 4, 30.0, "primary"), ("d", "Main", 9, 8, 20.0, "primary"), ("e", None, 2, 5, 30.0, "service"), ("f", None, 2, 6, 300.0, "service"), ("g", "Ramp", 1, 2, 90.0, "primary_link")]
    df = spark.createDataFrame(rows, "seg_id string, name string, u long, v long, length_ft double, highway string")
    away = spark.createDataFrame([("x", "c"), ("y", "g"), ("z", "f")], "lid string, rep_seg_id string")
    tables = network.clean_slivers(df, away)
    kept = {r.seg_id: r for r in tables["segments"].collect()}
    assert set(kept) == {"a", "d", "f"}
    # c goes into b, b (now 70 ft) into a: nothing of the length is lost.
    assert kept["a"].length_ft == 570 and {kept["a"].u, kept["a"].v} == {1, 4}
    assert pairs(tables["removed"], "seg_id", "removal_reason") == [("e", network.FRAGMENT_REASON), ("g", network.LINK_REASON)]
    assert pairs(tables["away"], "lid", "rep_seg_id", "orphan") == [("x", "a", False), ("y", "g", True), ("z", "f", False)]


def test_undirected(spark):
    a, b = [{"x": 0.0, "y": 0.0}, {"x": 1.0, "y": 1.0}], [{"x": 0.0, "y": 0.0}, {"x": 5.0, "y": 0.0}, {"x": 1.0, "y": 1.0}]
    rows = [(1, 2, 0, a), (2, 1, 0, a[::-1]), (1, 2, 1, b), (3, 3, 0, a), (3, 3, 1, a[::-1])]
    df = spark.createDataFrame(rows, "u long, v long, key long, geometry array<struct<x: double, y: double>>")
    assert pairs(network.undirected(df), "u", "v", "key") == [(1, 2, 0), (1, 2, 1), (3, 3, 0)]
    assert dict(pairs(network.node_degrees(df), "node", "degree"))[3] == 4


def brute_nearest(points, pieces, reach):
    def d2(p, s):
        (px, py), (x0, y0, x1, y1) = p, s
        dx, dy = x1 - x0, y1 - y0
        size = dx * dx + dy * dy
        t = max(0.0, min(1.0, ((px - x0) * dx + (py - y0) * dy) / size)) if size else 0.0
        return (px - x0 - t * dx) ** 2 + (py - y0 - t * dy) ** 2

    out = {}
    for i, p in points.items():
        best = min((d2(p, s), k) for k, s in pieces.items())
        if best[0] <= reach * reach:
            out[i] = best[1]
    return out


def test_nearest_with_long_pieces(spark):
    import random

    rng = random.Random(2)
    points = {i: (rng.uniform(-500, 500), rng.uniform(-500, 500)) for i in range(300)}
    pieces = {k: (rng.uniform(-500, 500), rng.uniform(-500, 500), rng.uniform(-500, 500), rng.uniform(-500, 500)) for k in range(25)}
    p = spark.createDataFrame([(i, *v) for i, v in points.items()], "pid long, px double, py double")
    s = spark.createDataFrame([(k, 0, *v) for k, v in pieces.items()], "lid long, piece int, x0 double, y0 double, x1 double, y1 double")
    assert dict(pairs(spatial.nearest(p, s, 20.0), "pid", "lid")) == brute_nearest(points, pieces, 20.0)
    assert dict(pairs(spatial.nearest_unbounded(p, s, 5.0), "pid", "lid")) == brute_nearest(points, pieces, 1e9)
    assert spatial.nearest(p.where("false"), s, 20.0).count() == 0 and spatial.nearest_unbounded(p, s.where("false"), 5.0).count() == 0


def test_nearest_among_dense_lines_in_rounds(spark, monkeypatch):
    """Dense lines are searched by small radii first; ties, far points and both sides come out as by one round."""
    rng = random.Random(7)
    points = {i: (float(rng.randrange(400)), float(rng.randrange(400))) for i in range(300)} | {300: (560.0, 40.0), 301: (5000.0, 0.0)}
    pieces = {k: (x, y, x + rng.randrange(-30, 30), y + rng.randrange(-30, 30)) for k in range(200) for x, y in [(float(rng.randrange(400)), float(rng.randrange(400)))]}
    p = spark.createDataFrame([(i, *v) for i, v in points.items()], "pid long, px double, py double")
    s = spark.createDataFrame([(k, 0, *map(float, v)) for k, v in pieces.items()], "lid long, piece int, x0 double, y0 double, x1 double, y1 double")
    monkeypatch.setattr(spatial, "DENSE", 1)
    monkeypatch.setattr(spatial, "WORTH", 0)
    assert len(spatial._radii(p, s, 200.0, 200.0)) > 1
    monkeypatch.setattr(spatial, "_radii", lambda points, pieces, reach, size: [(size / 16, reach / 64), (size, reach)])
    assert dict(pairs(spatial.nearest(p, s, 200.0), "pid", "lid")) == brute_nearest(points, pieces, 200.0)
    samples = p.selectExpr("pid div 10 as lid", "pid % 10 as k", "px", "py", "1.0d as dx", "0.0d as dy", "30.0d as reach")
    jobs = [
        lambda: pairs(spatial.nearest_with_ties(p, s, 200.0), "pid", "lid"), lambda: pairs(spatial.side_shares(samples, s, 60.0), "lid", "left_share", "right_share"),
        lambda: pairs(spatial.parallel_share(s, s.withColumnRenamed("lid", "oid"), 60.0), "lid", "share"),
    ]
    rounds = [job() for job in jobs]
    monkeypatch.setattr(spatial, "_radii", lambda points, pieces, reach, size: [(size, reach)])
    assert rounds == [job() for job in jobs]


def test_covered_sides_are_not_broadcast(spark, tmp_path):
    """A table of small files has many rows once it is covered by cells: it must not pass through the driver."""
    spark.range(1000).selectExpr("id as lid", "0 as piece", "id % 2 as name", *(f"cast(id % {m} as double) as {c}" for c, m in (("x0", 37), ("y0", 41), ("x1", 43), ("y1", 47)))).write.parquet(str(tmp_path / "lines"))
    s = spark.read.parquet(str(tmp_path / "lines"))
    other, area = s.withColumnRenamed("lid", "oid"), s.selectExpr("lid as zone_id", "x0", "y0", "x1", "y1", "'a' as lu", "1.0d as area")
    jobs = [
        spatial.near_pairs(s.selectExpr("lid as pid", "x0 as px", "y0 as py"), s, 5.0, 5.0), spatial.piece_pairs(s, other, 5.0, 5.0, "lid", "oid"), spatial.parallel_share(s, other, 5.0), spatial.overlap_share(s, other, 5.0),
        spatial.area_weighted_neighbours(s, area, area, 5.0, "lu"),
    ]
    for df in jobs:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        for line in plan.splitlines():
            assert "BroadcastHashJoin" not in line or "__n" in line or "[cx" in line and "LeftOuter" in line or "band" in line, line


def test_polygon_with_a_hole_and_two_parts(spark, tmp_path):
    doc = '{"features":[{"properties":{"ID":"1"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[10,0],[10,10],[0,10],[0,0]],[[4,4],[6,4],[6,6],[4,6],[4,4]]]}},{"properties":{"ID":"2"},"geometry":{"type":"MultiPolygon","coordinates":[[[[20,0],[30,0],[30,10],[20,10],[20,0]]],[[[40,0],[50,0],[50,10],[40,10],[40,0]]]]}}]}'
    (tmp_path / "zones.json").write_text(doc)
    zones = readers.polygon_rings(readers.geojson_features(spark, str(tmp_path / "zones.json"), ["ID"]))
    edges = readers.ring_edges(zones, "ID")
    assert edges.count() == 16
    p = spark.createDataFrame([(1, 2.0, 2.0), (2, 5.0, 5.0), (3, 25.0, 5.0), (4, 45.0, 5.0), (5, 35.0, 5.0), (6, 5.0, 4.0)], "pid long, px double, py double")
    got = pairs(spatial.zone_of_point(p, edges.withColumnRenamed("ID", "zone_id"), 3.0), "pid", "zone_id")
    assert got == [(1, "1"), (2, None), (3, "2"), (4, "2"), (5, None), (6, None)]
    near = dict(pairs(spatial.nearest_zone(p, edges.withColumnRenamed("ID", "zone_id"), 3.0), "pid", "zone_id"))
    assert near == {1: "1", 2: "1", 3: "2", 4: "2", 5: "2", 6: "1"}


def test_overlap_share(spark):
    own = spark.createDataFrame([(1, 0, 0.0, 0.0, 100.0, 0.0), (2, 0, 0.0, 500.0, 100.0, 500.0), (3, 0, 0.0, 1000.0, 0.0, 1100.0)], "lid long, piece int, x0 double, y0 double, x1 double, y1 double")
    other = spark.createDataFrame([(9, 0, 0.0, 30.0, 50.0, 30.0), (9, 1, 20.0, 10.0, 60.0, 10.0), (8, 0, -200.0, 1050.0, 200.0, 1050.0)], "oid long, piece int, x0 double, y0 double, x1 double, y1 double")
    got = dict(pairs(spatial.overlap_share(own, other, 50.0), "lid", "share"))
    # Up to x = 60 + sqrt(50^2 - 10^2); the crossing line covers 50 ft on either side.
    assert got[1] == pytest.approx(1.0) and got[2] == 0 and got[3] == pytest.approx(1.0)
    assert dict(pairs(spatial.overlap_share(own, other, 10.0), "lid", "share"))[3] == pytest.approx(0.2)
    assert dict(pairs(spatial.overlap_share(own, other, 10.0), "lid", "share"))[1] == pytest.approx(0.4)
    assert dict(pairs(spatial.parallel_share(own, other, 60.0), "lid", "share")) == {1: 1.0, 2: 0.0, 3: 0.0}


def test_pieces_in_full_cells_are_not_compared(spark):
    """Where a dense layer lies in all cells of a piece, the piece is near it as a whole and meets none of its pieces."""
    schema = "lid long, piece int, x0 double, y0 double, x1 double, y1 double"
    own = spark.createDataFrame([(1, 0, 100.0, 100.0, 180.0, 130.0), (2, 0, 380.0, 200.0, 480.0, 200.0)], schema)
    other = spark.createDataFrame([(i, 0, x, 0.0, x, 400.0) for i in range(40) for x in [10.0 * i]], schema)
    rest, whole = spatial._within_full_cells(own.withColumn("__id", F.struct("lid", "piece")), other, 50.0 * 0.7071)
    assert pairs(whole, "lid") == [(1,)] and pairs(rest, "lid") == [(2,)]
    got = dict(pairs(spatial.overlap_share(own, other, 50.0), "lid", "share"))
    assert got[1] == pytest.approx(1.0) and got[2] == pytest.approx(0.6)


def test_overlap_share_by_dense_samples(spark):
    import random

    rng = random.Random(4)
    make = lambda n: [(k, 0, *(rng.uniform(0, 300) for _ in range(4))) for k in range(n)]
    schema = "lid long, piece int, x0 double, y0 double, x1 double, y1 double"
    a, b = make(8), make(10)
    got = dict(pairs(spatial.overlap_share(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 25.0), "lid", "share"))
    for k, _, x0, y0, x1, y1 in a:
        points = {i: (x0 + (x1 - x0) * (i + 0.5) / 2000, y0 + (y1 - y0) * (i + 0.5) / 2000) for i in range(2000)}
        assert got[k] == pytest.approx(len(brute_nearest(points, {s[0]: s[2:] for s in b}, 25.0)) / 2000, abs=0.005)


def test_sides(spark):
    samples = spark.createDataFrame([(1, k, 10.0 * k, 0.0, 1.0, 0.0, 30.0) for k in range(4)], "lid long, k int, px double, py double, dx double, dy double, reach double")
    walks = spark.createDataFrame([(1, 0.0, 20.0, 30.0, 20.0), (2, 0.0, -25.0, 0.0, -25.0)], "sid long, x0 double, y0 double, x1 double, y1 double")
    assert pairs(spatial.side_shares(samples, walks, 60.0), "lid", "left_share", "right_share") == [(1, 1.0, 0.5)]


def test_gini(spark):
    df = lambda rows: spark.createDataFrame(rows, "w double, v double")
    value = lambda rows: concentration.gini(df(rows), "w", "v").first()[0]
    assert value([(1.0, 1.0), (1.0, 1.0)]) == pytest.approx(0) and value([(1.0, 1.0), (1.0, 0.0)]) == pytest.approx(0.5)
    assert value([(1.0, 0.0)]) is None and value([]) is None
    rows = [(float(i % 7 + 1), float(i * i % 11)) for i in range(60)]
    assert 0 <= value(rows) < 1 and value([(w * 9, v) for w, v in rows]) == pytest.approx(value(rows))


def test_running_sums_need_no_single_window(spark):
    df = spark.createDataFrame([(i, i % 5) for i in range(500)], "k long, v long")
    got = pairs(concentration.running_sums(df, [F.col("k")], ["v"], blocks=7), "k", "cum_v")
    total = 0
    for k, cum in got:
        total += k % 5
        assert cum == total


def test_years_lost(spark):
    crashes = spark.createDataFrame([(1, True), (2, True), (3, True), (4, False)], "Crash_ID long, fatal boolean")
    killed = spark.createDataFrame([(1, "70"), (1, "80"), (2, None)], "Crash_ID long, age string")
    # The second has a person without an age: recorded, with 0 years; the third gets the mean of 5 and 0.
    assert pairs(records.with_years_lost(crashes, killed), "Crash_ID", "yll") == [(1, 5.0), (2, 0.0), (3, 2.5), (4, 0.0)]


def test_extracts(spark, tmp_path):
    for year, name, text in [("a", "x_crash_1.csv", "Crash_ID,Latitude,Other\n1,29.5,z\n2,,z\n"), ("b", "x_crash_2.csv", "crash_id,Longitude\n2,-95\n"), ("a", "x_person_1.csv", "Crash_ID,Prsn_Nbr\n1,1\n"), ("a", "x_primaryperson_1.csv", "Crash_ID,Prsn_Nbr\n1,1\n1,1\n")]:
        (tmp_path / year).mkdir(exist_ok=True)
        (tmp_path / year / name).write_text(text)
    df = readers.csv_extracts(spark, [str(tmp_path / y / "*crash_*.csv") for y in "ab"], ["Crash_ID", "Latitude", "Longitude"])
    assert [tuple(r)[:3] for r in df.orderBy("Crash_ID", "file").collect()] == [("1", "29.5", None), ("2", None, None), ("2", None, "-95")]
    assert records.keep_first(df, ["Crash_ID"], ["file"]).count() == 2
    people = readers.persons(spark, [str(tmp_path / "a" / "*person_*.csv")], ["Crash_ID", "Prsn_Nbr"])
    assert pairs(records.keep_first(people, ["Crash_ID", "kind", "Prsn_Nbr"], ["file"]), "kind") == [("person",), ("primaryperson",)]


def test_header_array_and_pages(spark, tmp_path):
    (tmp_path / "t.json").write_text('[["B01","state"],["5","48"],[null,"48"]]')
    assert pairs(readers.header_array(spark, str(tmp_path / "t.json"), ["state", "B01", "missing"]).na.fill("-"), "state", "B01", "missing") == [("48", "-", "-"), ("48", "5", "-")]
    page = '{"features":[{"properties":{"OBJECTID":"%d"},"geometry":null},{"properties":{"OBJECTID":"%d"},"geometry":null}]}'
    for i in range(2):
        (tmp_path / f"p{i}.json").write_text(page % (i, i + 1))
    features = readers.feature_pages(spark, str(tmp_path / "p*.json"), ["OBJECTID"], "OBJECTID")
    assert features.count() == 3 and not readers.page_completeness(features, "OBJECTID", 4).first().complete


def test_selection(spark):
    rows = [(2018 + i % 3, 1 + i % 12, i % 7, i % 24, i % 4 == 0, i % 9 == 0, i % 11 == 0, i % 2 == 0) for i in range(500)]
    df = spark.createDataFrame(rows, "year int, month int, weekday int, hour int, severe boolean, ped boolean, bike boolean, state_owned boolean").withColumn("fatal", F.lit(False))
    assert df.where(facets.cyclic(F.col("hour"), 18, 6)).count() == sum(r[3] >= 18 or r[3] <= 6 for r in rows)
    ranged = facets.Selection(years=frozenset([2018]), month_range=(2019 * 12, 2019 * 12 + 2))
    assert facets.filtered(df, ranged).count() == sum(r[0] == 2019 and r[1] <= 3 for r in rows)
    assert facets.filtered(df, facets.Selection()).count() == 500
    walking = facets.Selection(mode="walking", severe_only=True, owner="state")
    assert facets.filtered(df, walking).count() == sum(r[5] and r[4] and r[7] for r in rows)
    assert sum(r.n for r in facets.breakdown(df, "state_owned", walking).collect()) == sum(r[5] and r[4] for r in rows)
    with pytest.raises(ValueError):
        facets.Selection(district="A", neighbourhood=3)


def test_contract_catches_a_broken_file(spark):
    good = spark.createDataFrame([(i, 29.7, -95.4, 1, 2020) for i in range(50)], "id long, lat double, lon double, sev int, year int")
    listed = [contract.row_count(40, 60), contract.in_box("lat", "lon", (29.4, 30.2, -95.9, -94.9)), contract.unique("id"), *contract.flags(["sev"]), *contract.no_nulls(["lat"]), contract.none_where("year", ~F.col("year").between(2000, 2100))]
    assert contract.passed(contract.run_checks(good, listed))
    bad = good.where("id < 30").unionByName(spark.createDataFrame([(1, 12.0, -95.4, 7, 2020), (2, None, -95.4, None, None)], good.schema))
    failed = {r.check for r in contract.run_checks(bad, listed).collect() if not r.ok}
    assert failed == {"rows", "out of box", "repeated id", "flag sev", "null lat", "year"}


def test_enrichment_is_idempotent(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "seg_id long, name string")
    new = spark.createDataFrame([(1, 5)], "seg_id long, x int")
    once = records.enrich(base, new, ["x"])
    assert pairs(records.enrich(once, new, ["x"]), "seg_id", "name") == pairs(once, "seg_id", "name") and once.columns == records.enrich(once, new, ["x"]).columns


def test_speed_priority(spark):
    df = spark.createDataFrame([(1, 40.0, 35.0, "primary"), (2, None, 35.0, "primary"), (3, None, None, "residential"), (4, None, None, "primary")], "lid long, speed_city double, maxspeed_mph double, highway string")
    assert pairs(conflate.with_speed(df), "lid", "posted_speed_mph", "speed_source") == [(1, 40.0, "city"), (2, 35.0, "osm"), (3, 30.0, "default_30_local"), (4, 30.0, "default_30_unposted")]


def test_simplify(spark):
    wave = [{"x": float(i), "y": 0.4 * (i % 2)} for i in range(20)] + [{"x": 20.0, "y": 30.0}]
    df = spark.createDataFrame([(1, wave), (2, wave[:2]), (3, None)], "lid long, geometry array<struct<x: double, y: double>>")
    got = {r.lid: r.geometry for r in simplify.simplify(df, 1.0).collect()}
    assert len(got[1]) == 3 and got[1][0].x == 0 and got[1][-1].y == 30 and len(got[2]) == 2 and got[3] is None


def test_sinks(spark, tmp_path):
    x, y = 3120000.0, 13840000.0
    lines = spark.createDataFrame([("H-1", "Main", [{"x": x, "y": y}, {"x": x + 100, "y": y}], 3)], "seg_id string, name string, geometry array<struct<x: double, y: double>>, lanes int")
    row = writers.flat_rows(lines, ["name", "seg_id"]).first()
    assert list(row.asDict()) == ["name", "seg_id", "lanes", "lat", "lon", "map_url"] and 29 < row.lat < 31 and -96 < row.lon < -95
    writers.write_csv(writers.flat_rows(lines, ["name"]), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1
    writers.write_layers({"a": lines, "b": lines}, str(tmp_path / "layers"))
    assert spark.read.parquet(str(tmp_path / "layers/b")).count() == 1
    writers.write_text(writers.geojson_lines(lines, ["seg_id"]), str(tmp_path / "text"))
    assert '"type":"LineString"' in (spark.read.text(str(tmp_path / "text")).first().value)
    facts = spark.createDataFrame([(29.7, True, None, 'a "b"', None)], "lat double, sev boolean, year int, district string, sn int")
    assert writers.positional_rows(facts, ["lat", "sev", "year", "district", "sn"]).first().value == '[29.7,1,null,"a \\"b\\"",null]'


def test_pieces_and_samples(spark):
    df = spark.createDataFrame([(1, [{"x": 0.0, "y": 0.0}, {"x": 10.0, "y": 0.0}, {"x": 10.0, "y": 10.0}])], "lid long, geometry array<struct<x: double, y: double>>")
    assert pairs(g.explode_pieces(df), "piece", "x0", "y0", "x1", "y1") == [(0, 0.0, 0.0, 10.0, 0.0), (1, 10.0, 0.0, 10.0, 10.0)]
    assert pairs(spatial.sample_points(df, (0.25, 0.75)), "k", "px", "py") == [(0, 5.0, 0.0), (1, 10.0, 5.0)]


def test_hanging_groups_absorb_as_names_do(spark, monkeypatch):
    import random

    from tarmac.operators import network

    rng = random.Random(3)
    rows = [(i, f"Street {rng.randint(0, 4)}", rng.randint(0, 60), rng.randint(0, 60), float(rng.randint(10, 400))) for i in range(200)] + [(500, None, 1, 2, 20.0)]
    df = spark.createDataFrame(rows, "seg_id long, name string, u long, v long, length_ft double")
    held = lambda: [sorted(map(tuple, t.collect()), key=repr) for t in network.absorb_short(df)]
    by_name = held()
    monkeypatch.setattr(network, "STREET_PIECES", 5)
    assert held() == by_name and by_name[1]


@pytest.mark.parametrize("boundary", ["outside", "inside", "half_open"])
def test_points_on_edges(spark, boundary):
    """All sides, corners and the rim of a hole, of a rectangle and of a triangle with a slanted side."""
    rings = {1: [[(0, 0), (10, 0), (10, 10), (0, 10)], [(4, 4), (6, 4), (6, 6), (4, 6)]], 2: [[(20, 0), (28, 4), (20, 8)]]}
    edges = spark.createDataFrame([(z, *map(float, (*a, *b))) for z, all_ in rings.items() for r in all_ for a, b in zip(r, r[1:] + r[:1])], "zone_id long, x0 double, y0 double, x1 double, y1 double")
    rims = [(0, 5), (10, 5), (5, 0), (5, 10), (0, 0), (10, 0), (10, 10), (0, 10), (4, 5), (6, 5), (5, 4), (5, 6), (4, 4), (6, 6), (24, 2), (26, 5), (28, 4), (20, 3), (20, 8)]
    inner, outer = [(2, 5), (5, 2), (9.5, 5), (2, 4), (2, 6), (2, 9.999), (22, 4), (24, 4)], [(5, 5), (-1, 5), (11, 5), (5, 11), (-1, 0), (-1, 10), (11, 4), (19, 4), (29, 4), (28, 0)]
    points = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rims + inner + outer)], "pid long, px double, py double")
    got = {r.pid for r in spatial.zones_of_points(points, edges, 3.0, boundary=boundary).collect()}
    n, m = len(rims), len(rims) + len(inner)
    assert got - set(range(n)) == set(range(n, m))
    assert got & set(range(n)) == {"outside": set(), "inside": set(range(n)), "half_open": got & set(range(n))}[boundary]
    with pytest.raises(ValueError):
        spatial.zones_of_points(points, edges, 3.0, boundary="open")


def test_nearest_of_points_far_off(spark):
    """Millions of feet away, without coordinates, by group; the pyramid has no last round."""
    rng = random.Random(8)
    points = {i: (rng.uniform(-5e6, 5e6), rng.choice([0.0, 1e6, -3e6]) + rng.uniform(-50, 50)) for i in range(120)}
    pieces = {k: (x := rng.uniform(-2000, 2000), y := rng.uniform(-2000, 2000), x + rng.uniform(-90, 90), y + rng.uniform(-90, 90)) for k in range(150)}
    pieces[999] = (4e6, 4e6, 4.001e6, 4e6)
    nan = float("nan")
    p = spark.createDataFrame([*((i, i % 3, *v) for i, v in points.items()), (500, 1, None, 1.0), (501, 1, 1.0, None), (502, 1, nan, 2.0), (503, 7, 0.0, 0.0)], "pid long, g long, px double, py double")
    s = spark.createDataFrame([(k, k % 3, *v) for k, v in pieces.items()], "lid long, h long, x0 double, y0 double, x1 double, y1 double")
    got = dict(pairs(spatial.nearest_unbounded(p, s, 5.0), "pid", "lid"))
    nowhere = dict.fromkeys([500, 501, 502])
    assert {k: v for k, v in got.items() if k < 500} == brute_nearest(points, pieces, 1e18) and {k: got[k] for k in nowhere} == nowhere
    by = dict(pairs(spatial.nearest_unbounded(p, s, 5.0, group=("g", "h")), "pid", "lid"))
    want = {}
    for h in range(3):
        want |= brute_nearest({i: v for i, v in points.items() if i % 3 == h}, {k: v for k, v in pieces.items() if k % 3 == h}, 1e18)
    assert by == want | nowhere


def test_crowded_cells_are_cut_into_blocks(spark):
    """Half of all points in one cell: the pairs stay the same and no key holds more than about a block."""
    rng = random.Random(9)
    points = {i: (rng.uniform(0, 20), rng.uniform(0, 20)) if i % 2 else (rng.uniform(0, 900), rng.uniform(0, 900)) for i in range(4000)}
    pieces = {k: (x := rng.uniform(0, 60), y := rng.uniform(0, 60), x + 9, y - 5) for k in range(300)}
    p = spark.createDataFrame([(i, *v) for i, v in points.items()], "pid long, px double, py double")
    s = spark.createDataFrame([(k, *v) for k, v in pieces.items()], "lid long, x0 double, y0 double, x1 double, y1 double")
    plain, cut = (sorted((r.pid, r.lid) for r in spatial.near_pairs(p, s, 20.0, 20.0, crowd=c).collect()) for c in (10**9, 100))
    assert plain == cut and len(plain) > 10_000
    sides = spatial.with_cell(p, 20.0), spatial.cover(s, 20.0, 20.0)
    keys = {}
    for r in spatial.cell_join(*sides, crowd=100).groupBy("cx", "cy", "pid").count().collect():
        keys[r.cx, r.cy] = keys.get((r.cx, r.cy), 0) + 1
    assert max(keys.values()) > 1900  # the cell is crowded
    dealt = spatial.blocks(*sides, crowd=100)[0].groupBy("cx", "cy", "__l", "__r").count().collect()
    assert max(r["count"] for r in dealt) <= 200


def test_sides_of_a_long_odd_cycle(spark):
    """Rounds grow with the logarithm of an odd cycle's length; every component's least node is on side 0."""
    rng = random.Random(5)
    n = 10_001
    ring = rng.sample(range(n), n)
    even = rng.sample(range(20_000, 20_400), 400)
    edges = [*zip(ring, ring[1:] + ring[:1]), *zip(even, even[1:] + even[:1])]
    rows = {r.node: r for r in network.two_sides(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len(rows) == n + 400 and rows[0].side == 0 and rows[20_000].side == 0
    assert {r.component for r in rows.values()} == {0, 20_000}
    assert all(r.conflict == (r.component == 0) for r in rows.values())
    assert sum(rows[a].side == rows[b].side for a, b in edges) == 1


def test_absorption_in_rounds_is_that_in_sequence(spark):
    """Random streets with loops, parallel lines, equal lengths, falling chains and a crowded node."""
    rng = random.Random(1)
    rows = []
    for k in range(500):
        name = rng.choice(["A", "A", "A", "B", "C", None])
        u, v = rng.randint(0, 160), rng.randint(0, 160)
        rows.append((k, name, u, v if rng.random() < 0.9 else u, float(rng.choice([20, 30, 30, 45, 60, 99, 100, 150, 400]))))
    rows += [(1000 + k, "A", 500 + k, 501 + k, 90.0 - k) for k in range(8)] + [(2000 + k, "B", 900, 901 + k, float(rng.randint(10, 300))) for k in range(60)]
    df = spark.createDataFrame(rows, "seg_id long, name string, u long, v long, length_ft double")
    (one, into), (two, also) = (network.absorb_short(df, street_pieces=n) for n in (10_000, 0))
    assert pairs(one, "seg_id", "name", "u", "v", "length_ft") == pairs(two, "seg_id", "name", "u", "v", "length_ft")
    assert pairs(into, "seg_id", "absorbed_into") == pairs(also, "seg_id", "absorbed_into") and into.count() > 60
    assert sum(r.length_ft for r in one.collect()) == sum(r[4] for r in rows)


def _points(*xy):
    return [{"x": float(x), "y": float(y)} for x, y in xy]


def _ragged(rng, a, b, steps=40):
    """From a to b with noise across; ends stay."""
    mid = [(a[0] + (b[0] - a[0]) * k / steps + rng.uniform(-30, 30), a[1] + (b[1] - a[1]) * k / steps + rng.uniform(-30, 30)) for k in range(1, steps)]
    return [a, *mid, b]


def test_neighbours_share_their_border(spark):
    rng = random.Random(4)
    side = 1000
    sides = {}
    for c in range(4):
        for r in range(4):
            for a, b in (((c, r), (c + 1, r)), ((c, r), (c, r + 1))):
                if max(*a, *b) <= 3:
                    sides[a, b] = _ragged(rng, *((side * x, side * y) for x, y in (a, b)))
    rings = {}
    for c in range(3):
        for r in range(3):
            south, east = sides[(c, r), (c + 1, r)], sides[(c + 1, r), (c + 1, r + 1)]
            north, west = sides[(c, r + 1), (c + 1, r + 1)][::-1], sides[(c, r), (c, r + 1)][::-1]
            ring = [*south[:-1], *east[:-1], *north[:-1], *west[:-1]]
            turn = rng.randrange(len(ring))
            ring = ring[turn:] + ring[:turn]
            rings[c * 3 + r] = ring[::-1] if rng.random() < 0.5 else ring
    island = [(1500 + 200 * x, 1500 + 200 * y) for x, y in ((0, 0), (0.5, 0.01), (1, 0), (1, 1), (0, 1))]
    rows = [(z, 0, _points(*ring)) for z, ring in rings.items()] + [(4, 1, _points(*island, island[0])), (9, 0, _points(*island[2:], *island[:2])), (10, 0, None), (11, 0, _points((1, 1), (2, 2))), (None, 0, _points((0, 0), (5, 0), (5, 5), (0, 0)))]
    df = spark.createDataFrame([*rows, rows[0]], "zone_id long, ring int, geometry array<struct<x: double, y: double>>")
    got = {(r.zone_id, r.ring): r.geometry and [(p.x, p.y) for p in r.geometry] for r in outlines.shared_outlines(df, 60.0).collect()}
    assert set(got) == {(z, k) for z, k, _ in rows} and got[10, 0] is None and got[11, 0] == [(1, 1), (2, 2)]
    edges = {z: {frozenset(e) for e in zip(got[z, 0], got[z, 0][1:])} for z in range(9)}
    for c in range(3):
        for r in range(3):
            z = c * 3 + r
            assert got[z, 0][0] == got[z, 0][-1] and len(edges[z]) < 60
            assert not outlines.crosses_itself(np.array(got[z, 0][:-1]))
            inner = [set(s) for (a, b), s in sides.items() if sum(a in x and b in x for x in [{(i, j), (i + 1, j), (i, j + 1), (i + 1, j + 1)} for i in range(3) for j in range(3)]) == 2]
            for other in ((z + 3) if c < 2 else None, (z + 1) if r < 2 else None):
                if other is not None:
                    border = next(s for s in inner if s <= set(rings[z]) and s <= set(rings[other]))
                    assert {e for e in edges[z] if e <= border} == {e for e in edges[other] if e <= border} != set()
    assert set(got[4, 1]) == set(got[9, 0]) == {island[0], *island[2:]}
    assert len(set(got[None, 0])) == 3


def test_rings_that_would_cross_stay(spark):
    # A spike reaches through a shallow notch: without the notch's point the border would cut the spike.
    ring = [(0, 0), (1000, 0), (1000, 500), (520, 500), (500, 5), (480, 500), (0, 500)]
    notched = [(0, 0), (490, 0), (500, -40), (510, 0), *ring[1:4], (500, -30), *ring[5:]]
    df = spark.createDataFrame([(1, 0, _points(*notched))], "zone_id long, ring int, geometry array<struct<x: double, y: double>>")
    (row,) = outlines.shared_outlines(df, 50.0).collect()

    assert not outlines.crosses_itself(np.array([(p.x, p.y) for p in row.geometry[:-1]])) and len(row.geometry) == len(notched) + 1
    assert outlines.crosses_itself(np.array([(0, 0), (2, 2), (2, 0), (0, 2)], float)) and not outlines.crosses_itself(np.array([(0, 0), (2, 0), (2, 2), (0, 2)], float))


def test_grouped_medians(spark):
    import statistics

    rng = random.Random(8)
    rows = [("Main" if rng.random() < 0.6 else rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(60)), rng.random()])) for _ in range(900)] + [("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    want = {}
    for g_, v in rows:
        if v is not None:
            want.setdefault(g_, []).append(v)
    for blocks in (1, 7):
        got = {r.g: r.m for r in concentration.grouped_medians(df, "g", "v", "m", blocks).collect()}
        assert got == {k: pytest.approx(statistics.median(v)) for k, v in want.items()}
    assert concentration.grouped_medians(df.where("false"), "g", "v").count() == 0


def test_facets_in_one_scan(spark):
    rows = [(y, m, w, h, y % 2 == 0) for y in (2018, 2019) for m in (1, 6) for w in (0, 3) for h in (None, 7)]
    df = spark.createDataFrame(rows, "year int, month int, weekday int, hour int, severe boolean").selectExpr("*", "false as ped", "false as bike")
    chosen = facets.Selection(years=frozenset([2018]), hours=frozenset([7]))
    got = facets.facet_counts(df, chosen)
    assert pairs(got.where("facet = 'year'"), "bucket", "n", "n_severe") == [(2018, 4, 4), (2019, 4, 0)]
    assert {(r.bucket, r.n) for r in got.where("facet = 'hour'").collect()} == {(None, 4), (7, 4)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_a_version_is_seen_when_switched_to(spark, tmp_path):
    folder = str(tmp_path / "out")
    one, two = spark.range(5).toDF("k").withColumn("v", F.lit("x")), spark.createDataFrame([(3, "x"), (4, None), (9, "y")], "k long, v string")
    assert writers.versions(spark, folder).count() == 0
    with pytest.raises(ValueError):
        writers.published(spark, folder)
    writers.publish({"t": one}, folder)
    late = writers.write_version({"t": two}, folder)  # and the job ends here
    assert writers.published(spark, folder)["t"].count() == 5
    writers.switch_to(spark, folder, late, ["t"])
    new, old = writers.published(spark, folder)["t"], writers.published(spark, folder, 1)["t"]
    assert dict(pairs(contract.row_changes(old, new, "k"), "k", "change")) == {0: "removed", 1: "removed", 2: "removed", 4: "changed", 9: "added"}
    assert contract.row_changes(new, new, "k").count() == 0


RINGS = "grp string, zone_id int, geometry array<struct<x: double, y: double>>"


def ring(*corners):
    return [{"x": float(x), "y": float(y)} for x, y in corners]


def box(x0, y0, x1, y1, start=0, back=False):
    corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    corners = corners[start:] + corners[:start]
    return ring(*(corners[::-1] if back else corners))


def outlines_of(rows):
    return sorted((r.grp or "", r.area, tuple((p.x, p.y) for p in r.geometry)) for r in rows)


def test_dissolve_by_hand(spark):
    rows = [
        ("a", 1, box(0, 0, 2, 2, 1, True)), ("a", 2, box(2, 0, 4, 1)), ("a", 3, [*box(2, 1, 4, 2, 2), box(2, 1, 4, 2, 2)[0]]),  # a corner of two on the side of one
        ("b", 1, box(0, 0, 9, 9)), ("b", 1, box(3, 3, 6, 6)), ("b", 2, box(9, 9, 10, 10)),  # a hole, and a touch in one point
        ("c", 1, box(0, 0, 9, 9)), ("c", 1, box(3, 3, 6, 6)), ("c", 2, box(3, 3, 6, 6, 3, True)),  # a hole that another zone fills
        ("d", 1, box(0, 0, 9, 9)), ("d", 1, box(1, 1, 8, 8)), ("d", 1, box(2, 2, 7, 7)),  # an island in a hole
        (None, 1, box(0, 0, 1, 1)), (None, None, box(1, 0, 2, 1)), (None, 1, box(0, 0, 1, 1)),  # nulls, and a repeated row
        ("e", 1, ring((0, 0), (1, 1), (0, 0))), ("e", 2, ring((0, 0), (1, 1), (2, 2))), ("e", 3, None), ("e", 4, []),
    ]
    df = spark.createDataFrame(rows, RINGS)
    got = outlines_of(dissolve.dissolve(df, "grp", size=3.0).collect())
    closed = lambda x0, y0, x1, y1: tuple((p["x"], p["y"]) for p in [*box(x0, y0, x1, y1), box(x0, y0, x1, y1)[0]])
    want = [("", 2.0, closed(0, 0, 2, 1)), ("a", 8.0, closed(0, 0, 4, 2)), ("b", 81.0, closed(0, 0, 9, 9)), ("b", 1.0, closed(9, 9, 10, 10)), ("b", -9.0, closed(3, 3, 6, 6)[::-1]), ("c", 81.0, closed(0, 0, 9, 9)),
            ("d", 81.0, closed(0, 0, 9, 9)), ("d", -49.0, closed(1, 1, 8, 8)[::-1]), ("d", 25.0, closed(2, 2, 7, 7))]
    assert got == sorted(want)
    assert dissolve.dissolve(df.where("false"), "grp").collect() == []


@pytest.mark.parametrize("seed", [1, 2])
def test_dissolve_random_cells(spark, seed):
    """Random cells, some in halves: as many outlines as a flood fill finds areas and openings, and the same area."""
    rng = random.Random(seed)
    cells = {(i, j) for i in range(14) for j in range(14) if rng.random() < 0.6}
    rows = []
    for n, (i, j) in enumerate(sorted(cells)):
        halves = [(i, j, i + 0.5, j + 1), (i + 0.5, j, i + 1, j + 1)] if rng.random() < 0.3 else [(i, j, i + 1, j + 1)]
        rows += [("g", 2 * n + k, box(*h, rng.randrange(4), rng.random() < 0.5)) for k, h in enumerate(halves)]
    got = dissolve.dissolve(spark.createDataFrame(rows, RINGS), "grp", size=2.0).collect()

    def areas(held, steps):
        left, n = set(held), 0
        while left:
            n, todo = n + 1, [left.pop()]
            while todo:
                x, y = todo.pop()
                near = {(x + a, y + b) for a, b in steps} & left
                left -= near
                todo += near
        return n

    straight = [(0, 1), (1, 0), (0, -1), (-1, 0)]
    outside = {(i, j) for i in range(-1, 15) for j in range(-1, 15)} - cells
    assert sum(r.area for r in got) == len(cells)
    assert sum(r.area > 0 for r in got) == areas(cells, straight)
    # Openings that touch in a corner are one: the area parts there.
    assert sum(r.area < 0 for r in got) == areas(outside, [*straight, (1, 1), (1, -1), (-1, 1), (-1, -1)]) - 1


def test_dissolve_refuses_overlaps(spark):
    for rows in ([("g", 1, box(0, 0, 2, 2)), ("g", 2, box(0, 0, 2, 2))], [("g", 1, box(0, 0, 2, 2)), ("g", 2, box(0, 0, 1, 3))]):
        with pytest.raises(ValueError, match="overlap"):
            dissolve.dissolve(spark.createDataFrame(rows, RINGS), "grp").collect()


def test_places_follow_the_curve(spark):
    rng = random.Random(3)
    rows = [(rng.random() * 100, rng.random() * 50) for _ in range(200)] + [(-5.0, 20.0), (200.0, 60.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "x double, y double").select(curve.place(F.col("x"), F.col("y"), (0.0, 0.0, 100.0, 50.0))).collect()]

    def slow(x, y):
        at = [int(min(max(v / high, 0), 1) * 65535) for v, high in ((x, 100), (y, 50))]
        return sum(((at[k % 2] >> (k // 2)) & 1) << k for k in range(32))

    assert got == [slow(x, y) for x, y in rows]


def rows_scanned(df):
    """What the scan of a plan gives to the steps above it, in one run of its own: metrics of a plan add up over its runs."""
    plan = df.select("*")._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().get("numOutputRows").get().value() for i in range(leaves.size()))


def test_box_reads_a_part_of_the_rows(spark, tmp_path):
    n = 40_000
    at = spark.range(n).selectExpr("id as pid", "cast((id * 7919) % 10007 as double) as px", "cast((id * 6151) % 10009 as double) as py").unionByName(spark.createDataFrame([(-1, None, 3.0), (-2, None, None)], "pid long, px double, py double"))
    area = (2000.0, 3000.0, 2500.0, 3500.0)
    writers.write_by_place(at, str(tmp_path / "placed"), files=32)
    at.write.parquet(str(tmp_path / "plain"))
    inside = {r.pid for r in at.where("px between 2000 and 2500 and py between 3000 and 3500").collect()}
    for name, most in (("placed", n // 8), ("plain", 2 * n)):
        read = readers.stored_in_box(spark, str(tmp_path / name), area)
        assert {r.pid for r in read.collect()} == inside and inside
        assert rows_scanned(read) <= most
    assert rows_scanned(readers.stored_in_box(spark, str(tmp_path / "plain"), area)) > n // 2
    assert spark.read.parquet(str(tmp_path / "placed")).count() == n + 2
    writers.write_by_place(at.where("false"), str(tmp_path / "none"))
    assert readers.stored_in_box(spark, str(tmp_path / "none"), area).collect() == []


def test_statuses_of_groups(spark):
    rows = [("a", 1), ("a", 2), ("b", None), ("b", 1), ("c", -1), (None, 1)]
    df = spark.createDataFrame(rows, "k string, v int")
    got = contract.statuses(contract.run_checks_by(df, ["k"], [contract.none_where("low", F.col("v") < 0), contract.Check("unknown", F.count_if(F.col("v").isNull()), high=0, level="warning")]), ["k"]).collect()
    assert {r.k: (r.errors, r.warnings, r.passed) for r in got} == {"a": (0, 0, True), "b": (1, 1, False), "c": (1, 0, False), None: (0, 0, True)}


def test_pieces_without_length_share_nothing(spark):
    own = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 0.0), (1, 1, 10.0, 0.0, 10.0, 0.0), (2, 0, 5.0, 5.0, 5.0, 5.0)], "lid int, piece int, x0 double, y0 double, x1 double, y1 double")
    other = spark.createDataFrame([(0.0, 1.0, 5.0, 1.0)], "x0 double, y0 double, x1 double, y1 double")
    got = {r.lid: r.share for r in spatial.overlap_share(own, other, 1.0).collect()}
    assert got == {1: pytest.approx(0.5), 2: None}
