"""Hand-computed cases, invariants, and parity of some queries with the other engine."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from touchline.functions import scalar as S
from touchline.operators import market, motion, roles, threat
from touchline.plans.registry import oracle_sql, queries

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("v")).first().v


def test_directions_without_shots(spark):
    e = spark.createDataFrame([("A", 1, "PASS", 0.1), ("A", 2, "PASS", 0.1), ("B", 1, "SHOT", 0.2)], "team string, period int, type string, sx double")
    got = {(r.team, r.period): r.direction for r in threat.directions(e).collect()}
    assert got == {("A", 1): 1, ("A", 2): -1, ("B", 1): -1, ("B", 2): 1}


def test_clip_keeps_null(spark):
    assert one(spark, S.clip(F.lit(None).cast("double"), -12, 12)) is None
    assert one(spark, S.clip(F.lit(50.0), -12, 12)) == 12


def test_control_of_two_players(spark):
    row = spark.sql("select array(named_struct('x', 5D, 'y', 0D)) a, array(named_struct('x', 10D, 'y', 0D)) d, cast(array() as array<struct<x:double,y:double>>) none")
    r = row.select(S.control(F.col("a"), F.col("d"), F.lit(0.0), F.lit(0.0)).alias("c"), S.control(F.col("a"), F.col("none"), F.lit(0.0), F.lit(0.0)).alias("n")).first()
    assert r.c == pytest.approx(1 / (1 + math.exp(-1 / 0.45))) and r.n is None


def test_nearest_takes_the_first_of_equals(spark):
    row = spark.sql("select array(named_struct('x', 1D, 'y', 0D), named_struct('x', -1D, 'y', 0D)) p")
    assert row.select(S.nearest(F.col("p"), F.lit(0.0), F.lit(0.0))["p"]["x"].alias("v")).first().v == 1


@pytest.mark.parametrize("v,cell", [(1.0, 11), (0.0, 0), (-3.0, 0), (5.0, 11), (0.5, 6)])
def test_zone_edges(spark, v, cell):
    assert one(spark, S.zone(F.lit(v), 12)) == cell


def test_single_player_team_has_z_zero(spark):
    d = spark.createDataFrame([(1, 5.0), (2, 1.0), (2, 3.0)], "team int, v double")
    assert sorted(r.v for r in roles.z_scores(d, ["team"], ["v"]).collect())[1] == 0


def test_as_of_includes_the_day_itself(spark):
    h = spark.sql("select 1 k, date '2020-01-05' day, 1 tiebreak, 7D value union all select 1, date '2020-01-06', 2, 9D")
    left = spark.sql("select 1 k, date '2020-01-05' on union all select 2, date '2020-01-05'")
    assert {r.k: r.value for r in market.as_of(left, h, "k", "on").collect()} == {1: 7, 2: None}


def test_checked_join_refuses_repeated_keys(spark):
    a, b = spark.sql("select 1 k"), spark.sql("select 1 k, 2 v union all select 1, 3")
    with pytest.raises(Exception, match="repeat"):
        market.checked_left_join(a, b, ["k"]).collect()


def test_velocity_without_neighbours_is_null(spark):
    t = spark.createDataFrame([(1, 1, 1.0)], "p int, frame int, x double")
    assert motion.velocities(t, ["p"], ["x"]).first().vx is None


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([(0, 1, 2, 1), (0, 2, 3, 1)], "team int, src int, dst int, weight long")
    assert {r.node: r.betweenness for r in roles.betweenness(e).collect()} == {1: 0, 2: 0.5, 3: 0}


def test_names(spark):
    d = spark.createDataFrame([("Piero Martín  Hincapié-Reyna",), (None,)], "n string")
    assert [r.v for r in d.select(S.normalize_name("n").alias("v")).collect()] == ["piero martin hincapie reyna", ""]


@pytest.mark.parametrize("name", ["a13_territory", "x01_xt_value_iteration", "a09_shrunk_turnover", "g04_intended_receiver", "j11_asof_value", "x05_pagerank", "w01_smoothed_velocity"])
def test_parity(spark, name):
    got = queries()[name](spark, SF).toPandas()
    con = duckdb.connect()
    for t in "supplier customer orders lineitem events documents nation region".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(oracle_sql()[name]).df()[list(got.columns)]
    key = list(got.columns)
    a, b = (d.sort_values(key).reset_index(drop=True) for d in (got, want))
    assert len(a) == len(b)
    for c in key:
        if a[c].dtype.kind == "f":
            assert abs(a[c] - b[c].astype(float)).max() < 2e-6
        else:
            assert (a[c] == b[c]).all()
