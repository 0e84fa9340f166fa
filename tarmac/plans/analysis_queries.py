"""Concentration, facets, rankings, costs and contract checks over the adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.operators import concentration as c
from tarmac.operators import contract as dq
from tarmac.operators import facets as q
from tarmac.operators.graph import checkpoint
from tarmac.plans.registry import query
from tarmac.plans.spatial_queries import _COUNTS, counted
from tarmac.plans.sql import sql
from tarmac.sources import adapters as fx
from tarmac.functions import tags

_MILES = _COUNTS + ", v AS (SELECT lid, length_ft / 5280 AS miles, n_severe, CASE WHEN lanes IS NOT NULL THEN lanes * 1000 * length_ft / 5280 END AS vmt FROM g)"


def _miles(spark, d):
    """Segments with counts, kept: shares, totals and curves read them several times."""
    return checkpoint(_measured(spark, d))


def _measured(spark, d):
    return counted(spark, d).select("lid", "name", "state_owned", (F.col("length_ft") / 5280).alias("miles"), "n_severe", (F.col("lanes") * 1000 * F.col("length_ft") / 5280).alias("vmt"))


def _gini(weight: str, value: str, where: str) -> str:
    return f"""(SELECT round(sum(w * (2 * cv - v)) / (sum(w) * sum(v)) - 1, 6) FROM (SELECT {weight} AS w, {value} AS v, sum({value}) OVER (ORDER BY {value} / {weight} DESC, lid) AS cv FROM v WHERE {where}))"""


@query("win2_gini", sql(_MILES + f" SELECT {_gini('miles', 'n_severe', 'true')} AS gini", "pts", "lns"))
def gini(spark, d):
    return c.gini(_miles(spark, d), "miles", "n_severe").select(F.round("gini", 6).alias("gini"))


@query("win3_exposure_ginis", sql(_MILES + f" SELECT {_gini('miles', 'n_severe', 'vmt IS NOT NULL')} AS ksi_miles, {_gini('miles', 'vmt', 'vmt IS NOT NULL')} AS vmt_miles, {_gini('vmt', 'n_severe', 'vmt IS NOT NULL')} AS ksi_vmt", "pts", "lns"))
def exposure_ginis(spark, d):
    rows = _miles(spark, d).where("vmt is not null")
    one = lambda w, v, n: c.gini(rows, w, v).select(F.round("gini", 6).alias(n))
    return one("miles", "n_severe", "ksi_miles").crossJoin(one("miles", "vmt", "vmt_miles")).crossJoin(one("vmt", "n_severe", "ksi_vmt"))


@query("win1_share_at_six_percent", sql(_MILES + ", r AS (SELECT sum(miles) OVER w AS cm, sum(n_severe) OVER w AS cs FROM v WINDOW w AS (ORDER BY n_severe DESC, lid ROWS UNBOUNDED PRECEDING)), t AS (SELECT sum(miles) AS m, sum(n_severe) AS s FROM v) SELECT round(arg_min(cs / s, cm), 6) AS share FROM r, t WHERE cm >= 0.06 * m", "pts", "lns"))
def share_at_six(spark, d):
    return c.share_at(_miles(spark, d), "miles", "n_severe", 0.06, [F.col("n_severe").desc(), F.col("lid")]).select(F.round("share", 6).alias("share"))


@query("win4_share_on_busiest_half", sql(_MILES + ", u AS (SELECT * FROM v WHERE vmt IS NOT NULL), r AS (SELECT sum(vmt) OVER w AS cm, sum(n_severe) OVER w AS cs FROM u WINDOW w AS (ORDER BY vmt DESC, lid ROWS UNBOUNDED PRECEDING)), t AS (SELECT sum(vmt) AS m, sum(n_severe) AS s FROM u) SELECT round(arg_min(cs / s, cm), 6) AS share FROM r, t WHERE cm >= 0.5 * m", "pts", "lns"))
def busiest_half(spark, d):
    return c.share_at(_miles(spark, d).where("vmt is not null"), "vmt", "n_severe", 0.5, [F.col("vmt").desc(), F.col("lid")]).select(F.round("share", 6).alias("share"))


@query("win5_rate_ranking", sql(_MILES + " SELECT lid, round(n_severe / vmt, 9) AS rate FROM v WHERE vmt > 0 ORDER BY n_severe / vmt DESC, lid LIMIT 6", "pts", "lns"))
def rate_ranking(spark, d):
    rate = F.col("n_severe") / F.col("vmt")
    return _miles(spark, d).where("vmt > 0").orderBy(rate.desc(), "lid").limit(6).select("lid", F.round(rate, 9).alias("rate"))


@query("q7_half_the_harm", sql(_MILES + ", r AS (SELECT miles / (SELECT sum(miles) FROM v) AS m, sum(miles) OVER w AS cm, sum(n_severe) OVER w AS cs FROM v WINDOW w AS (ORDER BY n_severe / miles DESC)) SELECT round(min(cm) / (SELECT sum(miles) FROM v), 6) AS share FROM r WHERE cs >= 0.5 * (SELECT sum(n_severe) FROM v)", "pts", "lns"))
def half_the_harm(spark, d):
    return c.weight_holding(_miles(spark, d), "miles", "n_severe", 0.5).select(F.round("share", 6).alias("share"))


_FACTS = """WITH f AS (SELECT pid, px, py, CAST(2016 + user_id % 10 AS INT) AS year, CAST(1 + pid % 12 AS INT) AS month, CAST(isodow(ts) - 1 AS INT) AS weekday, CAST(hour(ts) AS INT) AS hour, fatal, severe, ped, bike, user_id % 3 = 0 AS state_owned,
 CAST(pid % 5 AS VARCHAR) AS district, CAST(user_id % 4 AS INT) AS tier, CAST(CASE WHEN fatal THEN 1 ELSE 0 END AS INT) AS n_k, CAST(CASE WHEN severe AND NOT fatal THEN 1 + pid % 2 ELSE 0 END AS INT) AS n_a, CAST(pid % 3 AS INT) AS n_b, CAST(pid % 2 AS INT) AS n_c, CAST(pid % 4 AS INT) AS n_noinj, CASE WHEN fatal THEN 20.5 ELSE 0.0 END AS yll FROM pts)"""


def facts(spark, d):
    """One row a crash with the facets that filters use."""
    return fx.points(spark, d).selectExpr(
        "pid", "px", "py", "cast(2016 + user_id % 10 as int) as year", "cast(1 + pid % 12 as int) as month", "weekday(ts) as weekday", "hour(ts) as hour", "fatal", "severe", "ped", "bike", "user_id % 3 = 0 as state_owned",
        "cast(pid % 5 as string) as district", "cast(user_id % 4 as int) as tier", "cast(case when fatal then 1 else 0 end as int) as n_k", "cast(case when severe and not fatal then 1 + pid % 2 else 0 end as int) as n_a",
        "cast(pid % 3 as int) as n_b", "cast(pid % 2 as int) as n_c", "cast(pid % 4 as int) as n_noinj", "case when fatal then 20.5d else 0.0d end as yll",
    )


#: Evening to morning, in winter, of three years, on foot.
CHOSEN = q.Selection(hours=frozenset([18, 19, 20, 21, 22, 23, 0, 1, 2, 3, 4, 5, 6]), months=frozenset([11, 12, 1, 2]), years=frozenset([2018, 2019, 2020]), mode="driving", district="2")
_HOURS, _MONTHS, _YEARS, _REST = "(hour >= 18 OR hour <= 6)", "(month >= 11 OR month <= 2)", "year BETWEEN 2018 AND 2020", "NOT ped AND NOT bike AND district = '2'"


@query("q1_faceted_filter", sql(_FACTS + f" SELECT pid, year, month, hour FROM f WHERE {_HOURS} AND {_MONTHS} AND {_YEARS} AND {_REST}", "pts"))
def faceted(spark, d):
    return q.filtered(facts(spark, d), CHOSEN).select("pid", "year", "month", "hour")


def _facet(name: str, *conditions: str) -> str:
    return f"SELECT '{name}' AS facet, {name} AS bucket, count(*) AS n, count(*) FILTER (severe) AS n_severe FROM f WHERE {' AND '.join([*conditions, _REST])} GROUP BY {name}"


@query("q2_facet_counts", sql(_FACTS + " " + " UNION ALL ".join([_facet("year", _HOURS, _MONTHS), _facet("month", _HOURS, _YEARS), _facet("weekday", _HOURS, _MONTHS, _YEARS), _facet("hour", _MONTHS, _YEARS)]), "pts"))
def facet_counts(spark, d):
    return q.facet_counts(facts(spark, d), CHOSEN)


@query("q3_stacked_years", sql(_FACTS + " SELECT year AS bucket, count(*) FILTER (fatal) AS lower, count(*) FILTER (severe AND NOT fatal) AS upper FROM f GROUP BY year", "pts"))
def stacked(spark, d):
    return q.stacked(facts(spark, d), "year", True)


@query("q4_trend", sql(_FACTS + ", y AS (SELECT year, count(*) AS n FROM f WHERE severe AND year <> 2025 GROUP BY year) SELECT round(regr_slope(n, year), 6) AS slope, round(100 * (avg(n) FILTER (year > 2021) / avg(n) FILTER (year < 2019) - 1), 6) AS change FROM y", "pts"))
def trend(spark, d):
    by = facts(spark, d).where("severe").groupBy("year").agg(F.count("*").alias("n"))
    return q.trend(by, "year", "n", partial_year=2025).select(F.round("slope", 6).alias("slope"), F.round("change", 6).alias("change"))


def _cost(table: dict) -> str:
    return " + ".join(f"{n} * {table[k]}" for n, k in zip(("n_k", "n_a", "n_b", "n_c", "n_noinj"), "kabco"))


@query("q5_tally", sql(_FACTS + f" SELECT count(*) FILTER (fatal) AS killed, count(*) FILTER (severe AND NOT fatal) AS serious, count(*) FILTER (severe) AS ksi, round(sum(yll), 1) AS yll, CAST(sum({_cost(tags.ECONOMIC_COST)}) AS BIGINT) AS economic, CAST(sum(CAST({_cost(tags.COMPREHENSIVE_COST)} AS BIGINT)) AS BIGINT) AS comprehensive FROM f", "pts"))
def tally(spark, d):
    return q.tally(facts(spark, d))


@query("q6_breakdown", sql(_FACTS + " SELECT tier AS bucket, count(*) AS n, count(*) FILTER (severe) AS n_severe, round_even(100.0 * count(*) / (SELECT count(*) FROM f), 1) AS share FROM f GROUP BY tier", "pts"))
def breakdown(spark, d):
    return q.breakdown(facts(spark, d), "tier")


@query("q8_top_streets", sql(_COUNTS + " SELECT name, CAST(sum(n_crash) AS BIGINT) AS n_crash FROM g WHERE name IS NOT NULL GROUP BY name ORDER BY 2 DESC, 1 LIMIT 10", "pts", "lns"))
def top_streets(spark, d):
    return q.top(counted(spark, d).where("name is not null"), ["name"], F.sum("n_crash"), 10, "n_crash")


@query("q9_corridors", sql(_COUNTS + " SELECT coalesce(name, '#' || CAST(lid AS VARCHAR)) AS corridor, state_owned, count(*) AS blocks, CAST(sum(n_severe) AS BIGINT) AS n_severe FROM g GROUP BY 1, 2", "pts", "lns"))
def corridors(spark, d):
    return q.corridors(counted(spark, d), ["n_severe"])


@query("q10_street_profile", sql(_COUNTS + " SELECT name, count(*) AS blocks, CAST(sum(n_crash) AS BIGINT) AS n_crash, min(lanes) AS min_lanes, max(lanes) AS max_lanes FROM g WHERE name IS NOT NULL GROUP BY name", "pts", "lns"))
def profile(spark, d):
    return q.street_profile(counted(spark, d), ["lanes"], ["n_crash"])


@query("q11_street_ranks", sql(_COUNTS + ", s AS (SELECT name, CAST(sum(n_severe) AS BIGINT) AS n FROM g WHERE name IS NOT NULL GROUP BY name HAVING sum(n_severe) > 0), r AS (SELECT name, n, rank() OVER (ORDER BY n DESC) AS rank, count(*) OVER () AS of_ FROM s) SELECT name, n, rank, CASE WHEN round_even(100.0 * rank / of_, 1) <= 10 THEN round_even(100.0 * rank / of_, 1) END AS top_percent FROM r", "pts", "lns"))
def ranks(spark, d):
    streets = counted(spark, d).where("name is not null").groupBy("name").agg(F.sum("n_severe").alias("n"))
    return q.street_ranks(streets, "n").select("name", "n", "rank", "top_percent")


@query("q12_shading_cap", sql(_COUNTS + ", k AS (SELECT quantile_cont(n_crash, 0.97) AS cap FROM g WHERE n_crash > 0) SELECT lid, round(least(CAST(n_crash AS DOUBLE), cap), 6) AS shade FROM g, k", "pts", "lns"))
def shading(spark, d):
    return q.shading_cap(counted(spark, d), "n_crash").select("lid", F.round("shade", 6).alias("shade"))


@query("q13_overlay_comparison", sql(_COUNTS + " SELECT state_owned, round(sum(length_ft) / (SELECT sum(length_ft) FROM g), 6) AS miles_share, round(sum(n_severe) / (SELECT sum(n_severe) FROM g), 6) AS ksi_share FROM g GROUP BY state_owned", "pts", "lns"))
def overlay(spark, d):
    g = checkpoint(counted(spark, d).select("state_owned", "length_ft", "n_severe"))
    total = g.agg(F.sum("length_ft").alias("m"), F.sum("n_severe").alias("s"))
    by = g.groupBy("state_owned").agg(F.sum("length_ft").alias("a"), F.sum("n_severe").alias("b"))
    return by.crossJoin(F.broadcast(total)).select("state_owned", F.round(F.col("a") / F.col("m"), 6).alias("miles_share"), F.round(F.col("b") / F.col("s"), 6).alias("ksi_share"))


@query("q14_yearly_cube", sql(_FACTS + " SELECT district, year, count(*) AS n, count(*) FILTER (severe) AS n_severe, count(*) FILTER (fatal) AS n_fatal, count(*) FILTER (ped) AS n_ped, count(*) FILTER (bike) AS n_bike FROM f GROUP BY district, year", "pts"))
def cube(spark, d):
    return facts(spark, d).groupBy("district", "year").agg(F.count("*").alias("n"), *(F.count_if(x).alias(f"n_{x}") for x in ("severe", "fatal", "ped", "bike")))


@query("q15_street_search", sql(_COUNTS + " SELECT name, count(*) AS segments, arg_max(lid, struct_pack(a := n_severe, b := -lid)) AS best FROM g WHERE upper(name) LIKE '%T 1%' GROUP BY name", "pts", "lns"))
def search(spark, d):
    return q.search_streets(counted(spark, d), "t 1")


@query("q17_screen", sql(_COUNTS + " SELECT lid FROM g WHERE lanes >= 4 AND n_crash <= 5", "pts", "lns"))
def screen(spark, d):
    return q.screen(counted(spark, d), {"lanes": (4, None), "n_crash": (None, 5), "length_ft": (None, None)}).select("lid")


@query("q18_class_breaks", sql(_COUNTS + ", k AS (SELECT quantile_cont(length_ft, [0.2, 0.4, 0.6, 0.8]) AS b FROM g) SELECT CAST(list_sum(list_transform(b, lambda x: CAST(length_ft >= x AS INT))) AS INT) AS class, count(*) AS n FROM g, k GROUP BY 1", "pts", "lns"))
def breaks(spark, d):
    g = checkpoint(counted(spark, d).select("length_ft"))
    wanted = {f"q{k}": k / 5 for k in range(1, 5)}
    cuts = c.exact_quantiles(g, "length_ft", wanted).select(F.array(*wanted).alias("b"))
    return g.crossJoin(F.broadcast(cuts)).groupBy(F.size(F.filter("b", lambda x: F.col("length_ft") >= x)).alias("class")).agg(F.count("*").alias("n"))


@query("agg13_headline", sql(_FACTS + " SELECT count(*) FILTER (severe) AS ksi, count(*) FILTER (severe AND ped) AS ksi_ped, count(*) FILTER (severe AND bike) AS ksi_bike, CAST(round_even(100.0 * count(*) FILTER (fatal AND (ped OR bike)) / count(*) FILTER (fatal), 0) AS BIGINT) AS vulnerable FROM f", "pts"))
def headline(spark, d):
    severe, fatal, soft = F.col("severe"), F.col("fatal"), F.col("ped") | F.col("bike")
    return facts(spark, d).agg(F.count_if(severe).alias("ksi"), F.count_if(severe & F.col("ped")).alias("ksi_ped"), F.count_if(severe & F.col("bike")).alias("ksi_bike"), F.bround(100.0 * F.count_if(fatal & soft) / F.count_if(fatal), 0).cast("long").alias("vulnerable"))


@query("dq1_contract_checks", sql(_FACTS + """, t AS (SELECT count(*) AS n, count(*) FILTER (px IS NULL OR py NOT BETWEEN 0 AND 9000) AS box, count(*) - count(DISTINCT pid) AS rep, count(*) FILTER (NOT coalesce(year BETWEEN 2000 AND 2024, false)) AS yr, avg(CAST(tier < 2 AS INT)) AS low FROM f)
SELECT 'rows' AS "check", 'error' AS level, CAST(n AS DOUBLE) AS value, n BETWEEN 100 AND 10000000 AS ok FROM t UNION ALL SELECT 'out of box', 'error', box, box = 0 FROM t UNION ALL SELECT 'repeated pid', 'error', rep, rep = 0 FROM t UNION ALL SELECT 'year', 'warning', yr, yr = 0 FROM t UNION ALL SELECT 'low tiers', 'error', low, low BETWEEN 0.2 AND 0.9 FROM t""", "pts"))
def checks(spark, d):
    listed = [dq.row_count(100, 10_000_000), dq.in_box("py", "px", (0, 9000, 0, 20000)), dq.unique("pid"), dq.none_where("year", ~F.col("year").between(2000, 2024), "warning"), dq.share("low tiers", F.col("tier") < 2, 0.2, 0.9)]
    return dq.run_checks(facts(spark, d), listed)


@query("dq6_reconciliation", sql(_COUNTS + """, a AS (SELECT sum(n_crash) AS n, sum(n_severe) AS s FROM g), q AS (SELECT count(*) AS n, count(*) FILTER (severe) AS s FROM pts)
SELECT 'reconcile n' AS "check", 'error' AS level, round(abs(a.n - q.n) / q.n, 9) AS value, abs(a.n - q.n) / q.n <= 0.02 AS ok FROM a, q UNION ALL SELECT 'reconcile s', 'error', round(abs(a.s - q.s) / q.s, 9), abs(a.s - q.s) / q.s <= 0.01 FROM a, q""", "pts", "lns"))
def reconciliation(spark, d):
    left = counted(spark, d).agg(F.sum("n_crash").alias("n"), F.sum("n_severe").alias("s"))
    right = fx.points(spark, d).agg(F.count("*").alias("n"), F.count_if("severe").alias("s"))
    return dq.reconcile(left, right, {"n": 0.02, "s": 0.01}).withColumn("value", F.round("value", 9))


@query("dq7_references", sql("""WITH i AS (SELECT DISTINCT station_id FROM rdg), o AS (SELECT avg(CAST(station_id NOT IN (SELECT station_id FROM stn WHERE station_id <> 7) AS INT)) AS v FROM i)
SELECT 'orphan station_id' AS "check", 'error' AS level, v AS value, v <= 0.01 AS ok FROM o UNION ALL SELECT 'any orphan station_id', 'warning', v, v = 0 FROM o""", "rdg", "stn"))
def references(spark, d):
    return dq.references(fx.readings(spark, d), fx.stations(spark, d).where("station_id <> 7"), "station_id")


@query("dq9_not_empty", sql("""SELECT 'rows zones' AS "check", 'error' AS level, 1.0 AS value, true AS ok UNION ALL SELECT 'rows none', 'warning', 0.0, false FROM (SELECT 1)""", "zns"))
def not_empty(spark, d):
    return dq.not_empty({"zones": (fx.zones(spark, d), True), "none": (fx.zones(spark, d).where("zone_id < 0"), False)})


@query("dq11_version_diff", sql('SELECT "column", changed FROM (SELECT \'lid\' AS "column", CAST(0 AS BIGINT) AS changed UNION ALL SELECT \'name\', 0 UNION ALL SELECT \'lanes\', (SELECT count(*) FROM lns WHERE lid % 10 = 3 AND lanes IS NOT NULL))', "lns"))
def version_diff(spark, d):
    old = fx.lines(spark, d)
    new = old.withColumn("lanes", F.when(F.col("lid") % 10 == 3, F.col("lanes") + 1).otherwise(F.col("lanes")))
    return dq.version_diff(old, new, "lid", ["name", "lanes"])
