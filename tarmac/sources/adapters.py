"""Street and crash shapes over the star-schema tables, in integer feet so that distances are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crashes as points, from events."""
    return _table(spark, sf_dir, "events").selectExpr(
        "event_id as pid", "cast((event_id * 7919) % 10007 as double) as px", "cast((event_id * 6151 + user_id * 97) % 10009 as double) as py", "ts",
        "case event_type when 'error' then 'K' when 'signup' then 'A' when 'purchase' then 'B' when 'click' then 'C' else 'O' end as kabco",
        "event_type = 'error' as fatal", "event_type in ('error', 'signup') as severe", "event_type in ('error', 'signup', 'purchase', 'click') as any_injury",
        "user_id % 20 = 0 as ped", "user_id % 20 = 1 as bike", "user_id",
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streets as straight pieces, from part: odd keys are the even ones' opposite twins."""
    base = _table(spark, sf_dir, "part").selectExpr("p_partkey as lid", "p_partkey - p_partkey % 2 as b", "p_partkey % 2 = 1 as twin", "p_type", "p_size").selectExpr(
        "*", "(b * 4093) % 10007 as bx", "(b * 2557) % 10009 as by", "(b * 31) % 201 - 100 as rx", "(b * 57) % 201 - 100 as dy"
    ).withColumn("dx", F.expr("case when rx = 0 and dy = 0 then 1 else rx end"))
    ends = {"x0": "bx + dx + 60", "y0": "by + dy + 40", "x1": "bx + 60", "y1": "by + 40"}, {"x0": "bx", "y0": "by", "x1": "bx + dx", "y1": "by + dy"}
    return base.selectExpr(
        "lid", "0 as piece", *(f"cast(case when twin then {ends[0][c]} else {ends[1][c]} end as double) as {c}" for c in ("x0", "y0", "x1", "y1")),
        "case when b % 11 <> 0 then concat('Street ', (b div 2) % 97) end as name",
        "case p_size % 6 when 0 then 'primary' when 1 then 'secondary' when 2 then 'tertiary' when 3 then 'residential' when 4 then 'unclassified' else 'secondary_link' end as highway",
        "true as oneway", "case when p_size % 7 <> 0 then cast(p_size % 5 + 1 as double) end as lanes", "p_size % 3 = 0 as state_owned",
    ).withColumn("length_ft", F.expr("sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0))"))


def bent_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The streets in two to four pieces, bent where they meet: lid, piece, x0, y0, x1, y1."""
    n = "2 + lid % 3"
    at = lambda k: f"array({', '.join(f'case when {k} = 0 then {c}0 when {k} = {n} then {c}1 else {c}0 + floor(({c}1 - {c}0) * {k} / ({n})) + (lid * {m} * {k}) % 41 - 20 end' for c, m in (('x', 17), ('y', 29)))})"
    each = lines(spark, sf_dir).withColumn("piece", F.expr("explode(sequence(0, cast(1 + lid % 3 as int)))"))
    return each.selectExpr("lid", "piece", f"{at('piece')} as a", f"{at('(piece + 1)')} as b").selectExpr("lid", "piece", "a[0] as x0", "a[1] as y0", "b[0] as x1", "b[1] as y1")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares of a grid in five groups, from customer: grp, zone_id, geometry, a row for each ring.

    A third of them are two halves, so that their neighbours' sides have a corner of theirs in the middle, and a third are
    frames, their openings being zones of their own.
    """
    cells = _table(spark, sf_dir, "customer").selectExpr("c_mktsegment as grp", "(c_custkey * 3301) % 10007 div 200 as i", "(c_custkey * 5417) % 10009 div 200 as j").distinct()
    rect = lambda x0, y0, x1, y1: "array(" + ", ".join(f"struct(cast(i * 200 + {x} as double) as x, cast(j * 200 + {y} as double) as y)" for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))) + ")"
    whole, hole = rect(0, 0, 200, 200), rect(50, 50, 150, 150)
    parts = f"""case (i + j) % 3 when 0 then array(struct(0 as part, {rect(0, 0, 200, 100)} as p), struct(1 as part, {rect(0, 100, 200, 200)} as p))
     when 1 then array(struct(0 as part, {whole} as p), struct(0 as part, {hole} as p), struct(1 as part, {hole} as p)) else array(struct(0 as part, {whole} as p)) end"""
    return cells.select("grp", "i", "j", F.explode(F.expr(parts)).alias("z")).selectExpr("grp", "concat_ws('-', i, j, z.part) as zone_id", "z.p as geometry")


def value_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City lines with attributes, from customer."""
    base = _table(spark, sf_dir, "customer").selectExpr("c_custkey as sid", "cast((c_custkey * 3301) % 10007 as double) as x0", "cast((c_custkey * 5417) % 10009 as double) as y0", "*")
    return base.selectExpr(
        "sid", "0 as piece", "x0", "y0", "x0 + (c_custkey * 43) % 301 - 150 as x1", "y0 + (c_custkey * 71) % 301 - 150 as y1",
        "case when c_acctbal >= 0 then cast(25 + 5 * (c_nationkey % 9) as double) end as speed", "c_mktsegment as median_type", "concat('Street ', c_custkey % 97) as city_name", "cast(c_nationkey % 6 + 1 as double) as lanes_city",
    )


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles with gaps between them, from nation: zone_id, xa, ya, xb, yb, income."""
    return _table(spark, sf_dir, "nation").selectExpr(
        "n_nationkey as zone_id", "cast((n_nationkey % 5) * 2002 as double) as xa", "cast((n_nationkey div 5) * 2002 as double) as ya",
        "cast((n_nationkey % 5) * 2002 + 1900 as double) as xb", "cast((n_nationkey div 5) * 2002 + 1900 as double) as yb",
        "case when n_nationkey % 7 <> 0 then cast(20000 + n_nationkey * 6000 as double) end as income", "n_regionkey as district",
    )


def rectangle_edges(boxes: DataFrame, key: str = "zone_id") -> DataFrame:
    sides = [("xa", "ya", "xb", "ya"), ("xb", "ya", "xb", "yb"), ("xb", "yb", "xa", "yb"), ("xa", "yb", "xa", "ya")]
    each = F.explode(F.array(*(F.struct(*(F.col(c).alias(n) for c, n in zip(s, ("x0", "y0", "x1", "y1")))) for s in sides)))
    return boxes.select(key, each.alias("e")).select(key, "e.*")


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "supplier").selectExpr("s_suppkey as station_id", "cast((s_suppkey * 911) % 10007 as double) as px", "cast((s_suppkey * 677) % 10009 as double) as py")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "l_suppkey as station_id", "cast(l_shipdate as date) as date", "cast(l_extendedprice as double) as adt", "l_linestatus = 'F' and l_returnflag <> 'R' as ok",
        "case when l_discount <> 0 then cast(l_quantity as double) end as op_speed", "l_orderkey as order_key", "l_linenumber as line_no", "l_partkey as part_key",
    )


def crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crash records, from orders."""
    return _table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as Crash_ID", "cast(o_orderdate as string) as Crash_Date", "format_string('%02d:%02d %s', o_custkey % 12 + 1, o_orderkey % 60, case when o_custkey % 2 = 0 then 'AM' else 'PM' end) as Crash_Time",
        "case substr(o_orderpriority, 1, 1) when '1' then 4 when '2' then 1 when '3' then 2 when '4' then 3 else 5 end as Crash_Sev_ID",
        "o_custkey", "cast(o_totalprice as double) as o_totalprice", "o_orderstatus",
    )


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons of crashes with repeats, from lineitem."""
    return _table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey as Crash_ID", "l_linenumber as Prsn_Nbr", "l_linestatus as kind", "l_returnflag = 'A' as killed", "case when l_partkey % 2 <> 0 then cast(l_quantity as double) end as age", "l_partkey", "l_suppkey", "cast(l_extendedprice as double) as price",
    )


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares with a land-use group, from customer: zone_id, xa, ya, xb, yb, lu, area."""
    return _table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as zone_id", "cast((c_custkey * 2917) % 10007 as double) as xa", "cast((c_custkey * 4421) % 10009 as double) as ya", "cast(20 + c_custkey % 60 as double) as side",
        "case c_mktsegment when 'BUILDING' then 'Residential' when 'AUTOMOBILE' then 'Commercial' when 'MACHINERY' then 'Industrial' when 'HOUSEHOLD' then 'Unknown' else 'Other' end as lu",
    ).selectExpr("zone_id", "xa", "ya", "xa + side as xb", "ya + side as yb", "lu", "side * side as area")
