"""The adapters of ``tarmac.sources.adapters`` as SQL tables, for the SQL twins of queries."""

FX = {
    "pts": """SELECT event_id AS pid, CAST((event_id * 7919) % 10007 AS DOUBLE) AS px, CAST((event_id * 6151 + user_id * 97) % 10009 AS DOUBLE) AS py, ts,
 event_type = 'error' AS fatal, event_type IN ('error', 'signup') AS severe, event_type IN ('error', 'signup', 'purchase', 'click') AS any_injury,
 user_id % 20 = 0 AS ped, user_id % 20 = 1 AS bike, user_id FROM events""",
    "lns": """SELECT lid, name, highway, lanes, state_owned,
 CAST(CASE WHEN twin THEN bx + dx + 60 ELSE bx END AS DOUBLE) AS x0, CAST(CASE WHEN twin THEN by_ + dy + 40 ELSE by_ END AS DOUBLE) AS y0,
 CAST(CASE WHEN twin THEN bx + 60 ELSE bx + dx END AS DOUBLE) AS x1, CAST(CASE WHEN twin THEN by_ + 40 ELSE by_ + dy END AS DOUBLE) AS y1, sqrt(CAST(dx * dx + dy * dy AS DOUBLE)) AS length_ft
 FROM (SELECT *, CASE WHEN rx = 0 AND dy = 0 THEN 1 ELSE rx END AS dx FROM (
  SELECT lid, twin, (b * 4093) % 10007 AS bx, (b * 2557) % 10009 AS by_, (b * 31) % 201 - 100 AS rx, (b * 57) % 201 - 100 AS dy,
   CASE WHEN b % 11 <> 0 THEN 'Street ' || CAST((b // 2) % 97 AS VARCHAR) END AS name,
   CASE p_size % 6 WHEN 0 THEN 'primary' WHEN 1 THEN 'secondary' WHEN 2 THEN 'tertiary' WHEN 3 THEN 'residential' WHEN 4 THEN 'unclassified' ELSE 'secondary_link' END AS highway,
   CASE WHEN p_size % 7 <> 0 THEN CAST(p_size % 5 + 1 AS DOUBLE) END AS lanes, p_size % 3 = 0 AS state_owned
  FROM (SELECT p_partkey AS lid, p_partkey - p_partkey % 2 AS b, p_partkey % 2 = 1 AS twin, p_size FROM part)))""",
    "vls": """SELECT sid, x0, y0, x0 + (c_custkey * 43) % 301 - 150 AS x1, y0 + (c_custkey * 71) % 301 - 150 AS y1,
 CASE WHEN c_acctbal >= 0 THEN CAST(25 + 5 * (c_nationkey % 9) AS DOUBLE) END AS speed, c_mktsegment AS median_type, 'Street ' || CAST(c_custkey % 97 AS VARCHAR) AS city_name, CAST(c_nationkey % 6 + 1 AS DOUBLE) AS lanes_city
 FROM (SELECT c_custkey AS sid, CAST((c_custkey * 3301) % 10007 AS DOUBLE) AS x0, CAST((c_custkey * 5417) % 10009 AS DOUBLE) AS y0, * FROM customer)""",
    "zns": """SELECT n_nationkey AS zone_id, CAST((n_nationkey % 5) * 2002 AS DOUBLE) AS xa, CAST((n_nationkey // 5) * 2002 AS DOUBLE) AS ya,
 CAST((n_nationkey % 5) * 2002 + 1900 AS DOUBLE) AS xb, CAST((n_nationkey // 5) * 2002 + 1900 AS DOUBLE) AS yb,
 CASE WHEN n_nationkey % 7 <> 0 THEN CAST(20000 + n_nationkey * 6000 AS DOUBLE) END AS income, n_regionkey AS district FROM nation""",
    "stn": "SELECT s_suppkey AS station_id, CAST((s_suppkey * 911) % 10007 AS DOUBLE) AS px, CAST((s_suppkey * 677) % 10009 AS DOUBLE) AS py FROM supplier",
    "rdg": """SELECT l_suppkey AS station_id, CAST(l_shipdate AS DATE) AS date, CAST(l_extendedprice AS DOUBLE) AS adt, l_linestatus = 'F' AND l_returnflag <> 'R' AS ok,
 CASE WHEN l_discount <> 0 THEN CAST(l_quantity AS DOUBLE) END AS op_speed, l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key FROM lineitem""",
    "crs": """SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, (o_custkey % 12 + 1) % 12 + CASE WHEN o_custkey % 2 = 0 THEN 0 ELSE 12 END AS hour,
 CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'K' WHEN '2' THEN 'A' WHEN '3' THEN 'B' WHEN '4' THEN 'C' ELSE 'O' END AS kabco, o_custkey, o_orderstatus FROM orders""",
    "prs": """SELECT l_orderkey AS id, l_linenumber AS nbr, l_linestatus AS kind, l_returnflag = 'A' AS killed, CASE WHEN l_partkey % 2 <> 0 THEN CAST(l_quantity AS DOUBLE) END AS age, l_partkey, l_suppkey, CAST(l_extendedprice AS DOUBLE) AS price FROM lineitem""",
    "pcl": """SELECT zone_id, xa, ya, xa + side AS xb, ya + side AS yb, lu, side * side AS area FROM (SELECT c_custkey AS zone_id, CAST((c_custkey * 2917) % 10007 AS DOUBLE) AS xa, CAST((c_custkey * 4421) % 10009 AS DOUBLE) AS ya,
 CAST(20 + c_custkey % 60 AS DOUBLE) AS side, CASE c_mktsegment WHEN 'BUILDING' THEN 'Residential' WHEN 'AUTOMOBILE' THEN 'Commercial' WHEN 'MACHINERY' THEN 'Industrial' WHEN 'HOUSEHOLD' THEN 'Unknown' ELSE 'Other' END AS lu FROM customer)""",
}

#: The bent streets, over ``lns``.
_BEND = {k: {c: f"CASE WHEN {k} = 0 THEN {c}0 WHEN {k} = 2 + lid % 3 THEN {c}1 ELSE {c}0 + floor(({c}1 - {c}0) * {k} / (2 + lid % 3)) + (lid * {m} * {k}) % 41 - 20 END" for c, m in (("x", 17), ("y", 29))} for k in ("piece", "(piece + 1)")}
FX["bls"] = "SELECT lid, piece, " + ", ".join(f"{e} AS {c}{i}" for i, ends in enumerate(_BEND.values()) for c, e in ends.items()) + " FROM (SELECT *, unnest(range(2 + lid % 3)) AS piece FROM lns)"


def point_d2(px: str, py: str, s: str) -> str:
    """Squared distance of a point from the piece of table ``s``."""
    dx, dy, ax, ay = f"({s}.x1 - {s}.x0)", f"({s}.y1 - {s}.y0)", f"({px} - {s}.x0)", f"({py} - {s}.y0)"
    size, dot, cross = f"({dx} * {dx} + {dy} * {dy})", f"({ax} * {dx} + {ay} * {dy})", f"({ax} * {dy} - {ay} * {dx})"
    return f"(CASE WHEN {dot} <= 0 THEN {ax} * {ax} + {ay} * {ay} WHEN {dot} >= {size} THEN ({px} - {s}.x1) * ({px} - {s}.x1) + ({py} - {s}.y1) * ({py} - {s}.y1) ELSE {cross} * {cross} / {size} END)"


def piece_d2(a: str, b: str) -> str:
    """Squared distance of the pieces of two tables."""

    def side(s: str, x: str, y: str) -> str:
        return f"sign(({s}.x1 - {s}.x0) * ({y} - {s}.y0) - ({s}.y1 - {s}.y0) * ({x} - {s}.x0))"

    boxes = " AND ".join(f"least({p}.{c}0, {p}.{c}1) <= greatest({q}.{c}0, {q}.{c}1)" for c in "xy" for p, q in ((a, b), (b, a)))
    cross = f"{boxes} AND {side(a, f'{b}.x0', f'{b}.y0')} * {side(a, f'{b}.x1', f'{b}.y1')} <= 0 AND {side(b, f'{a}.x0', f'{a}.y0')} * {side(b, f'{a}.x1', f'{a}.y1')} <= 0"
    ends = ", ".join(point_d2(f"{p}.x{k}", f"{p}.y{k}", q) for p, q in ((a, b), (b, a)) for k in (0, 1))
    return f"(CASE WHEN {cross} THEN 0.0 ELSE least({ends}) END)"


def near_box(a: str, b: str, reach: float) -> str:
    """A cheap necessary condition for pieces within reach."""
    return " AND ".join(f"least({p}.{c}0, {p}.{c}1) - {reach} <= greatest({q}.{c}0, {q}.{c}1)" for c in "xy" for p, q in ((a, b), (b, a)))


def degrees(table: str, x: str = "x", y: str = "y") -> str:
    """The columns of ``table`` with ``lon, lat`` of an easting and northing, by the series of ``functions.projection``."""
    from tarmac.functions import projection as p

    out = f"SELECT *, {x} * {p.FOOT_M!r} - {p.FALSE_EAST_M!r} AS ee, {p._R0!r} - ({y} * {p.FOOT_M!r} - {p.FALSE_NORTH_M!r}) AS nn FROM {table}"
    out = f"SELECT *, pow(sqrt(ee * ee + nn * nn) / {p.SEMI_MAJOR_M * p._K!r}, {1 / p._N!r}) AS tt FROM ({out})"
    out = f"SELECT *, pi() / 2 - 2 * atan(tt) AS phi0 FROM ({out})"
    for k in range(5):
        s = f"{p._E!r} * sin(phi{k})"
        out = f"SELECT *, pi() / 2 - 2 * atan(tt * pow((1 - {s}) / (1 + {s}), {p._E / 2!r})) AS phi{k + 1} FROM ({out})"
    return f"SELECT *, degrees(atan2(ee, nn) / {p._N!r}) + {p.ORIGIN_LON!r} AS lon, degrees(phi5) AS lat FROM ({out})"


def sql(body: str, *tables: str, recursive: bool = False) -> str:
    """A query over the named adapters; ``body`` may begin with further tables after WITH."""
    head = ", ".join(f"{t} AS (SELECT * FROM ({FX[t]}))" for t in tables)
    body = body.strip()
    more = body[5:] if body.upper().startswith("WITH ") else None
    if not head:
        return body
    start = "WITH RECURSIVE" if recursive else "WITH"
    return f"{start} {head}, {more}" if more else f"{start} {head} {body}"
