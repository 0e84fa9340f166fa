"""Registered queries: names, schemas, and SQL twins on the smallest tables."""

import decimal
import math
import os
import re

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def catalogue():
    import __spark_entry__ as entry

    return entry.queries(), entry.oracle_sql()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 5)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


def test_names():
    queries, sql = catalogue()
    assert set(sql) <= set(queries) and len(queries) > 90


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def twins():
    """Queries with SQL, but for those of the training-text operators, which have tests of their own."""
    return sorted(name for name in catalogue()[1] if not name.startswith("op"))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_every_zone_and_line_counts(spark):
    from tarmac.sources import adapters as fx

    queries, _ = catalogue()
    zones, lines = fx.zones(spark, SF).collect(), fx.lines(spark, SF).select("x0", "y0").collect()
    held = {z.zone_id: any(z.xa <= p.x0 < z.xb and z.ya <= p.y0 < z.yb for p in lines) for z in zones}
    got = {r.zone_id: r.income for r in queries["jn7_zone_income"](spark, SF).collect()}
    assert got == {z.zone_id: z.income if held[z.zone_id] else None for z in zones}
    people = sum(r.people for r in queries["jn6_all_attributes"](spark, SF).collect())
    assert people == spark.read.parquet(f"{SF}/customer.parquet").count()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", twins())
def test_sql_twin(spark, name):
    import duckdb

    queries, sql = catalogue()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    cursor = con.execute(sql[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in cursor.fetchall()), key=repr)
    assert sorted(names) == columns and got == want


def test_ids_of_six_digits(spark, tmp_path):
    """str1_tags follows its SQL, which keeps five digits; str8_padded_ids keeps them all."""
    import duckdb

    spark.sql("select 7L as p_partkey, 3 as p_size union all select 123456L, 4").write.parquet(str(tmp_path / "part.parquet"))
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    queries, sql = catalogue()
    for name in ("str1_tags", "str8_padded_ids"):
        got = {r.id: r.seg_id for r in queries[name](spark, str(tmp_path)).collect()}
        assert got == dict(con.execute(f"select id, seg_id from ({sql[name]})").fetchall())
    assert got == {7: "H-00007", 123456: "H-123456"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["agg1_segment_counts", "agg1_counts_with_halves", "top1_worst_streets", "rpt3_assignment_integrity", "q7_half_the_harm", "q9_corridors", "q10_street_profile", "q13_overlay_comparison", "agg6_station_volumes", "agg8_merged_attributes"])
def test_tables_are_not_broadcast(spark, name, monkeypatch):
    """Points, lines and stations, small as the optimiser takes them for, do not go to the executors through the driver."""
    from pyspark.sql.classic.dataframe import DataFrame

    plan, kept, plans = (lambda df: df._jdf.queryExecution().executedPlan().toString()), DataFrame.checkpoint, []
    monkeypatch.setattr(DataFrame, "checkpoint", lambda df, *how: plans.append(plan(df)) or kept(df, *how))
    plans.append(plan(catalogue()[0][name](spark, SF)))
    keys = {key for held in plans for key in re.findall(r"BroadcastHashJoin \[(\w+)#", held)}
    assert keys <= {"cx", "__block", "__own"}  # crowded cells and levels of a pyramid, both counted, and a row a partition
