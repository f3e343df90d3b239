"""Statistics of all pairs of a population, block by block, against the pairs themselves."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.functions import scalar as S
from touchline.operators import pairs
from touchline.operators import roles as R


@pytest.fixture
def blocks(monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 20)
    monkeypatch.setattr(pairs, "RANGES", 8)
    monkeypatch.setattr(pairs, "MOST_TOLD", 50)


def population(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice([rng.uniform(-4, 4), 1.5]), rng.choice([rng.uniform(0, 9), 2.0]), rng.choice([None, rng.uniform(0, 9), 3.0])) for k in range(90)]
    rows += [(90, None, 1.0, 9.0), (91, 1.5, 2.0, 9.0), (None, 0.0, 0.0, 9.0)]
    return rows, spark.createDataFrame(rows, "player_id int, a double, b double, quality double")


def test_blocks_give_what_all_pairs_give(spark, blocks):
    rows, df = population(spark)
    people = [r for r in rows if r[0] is not None]
    known = [r for r in people if r[1] is not None]
    apart = lambda p, q: math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)
    d = [apart(p, q) for p in known for q in known if p[0] < q[0]]
    assert "MapInArrow" not in R.pair_distances(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    for share in (0.0, 0.25, 0.5, 0.73, 1.0):
        assert pairs.distance_quantile(df, "player_id", ["a", "b"], share) == pytest.approx(float(np.quantile(d, share)), abs=1e-12)
    h, tau = np.quantile(d, 0.5), np.quantile(d, 0.25)
    got = {r.player_id: r for r in R.scarcity_densities(df, ["a", "b"], {"one": 1.0, "wide": 1.6}).collect()}
    assert set(got) == set(range(92)) and got[90].one is None
    for p in known:
        for name, scale in (("one", 1.0), ("wide", 1.6)):
            k = [math.exp(-0.5 * (apart(p, q) / (h * scale)) ** 2) for q in known if q[0] != p[0]]
            assert got[p[0]][name] == pytest.approx(-math.log(sum(k) / len(k) + 1e-12), abs=1e-9)
    want = {p[0]: sum(q[0] != p[0] and q[3] is not None and q[3] >= p[3] and apart(p, q) <= tau for q in known) for p in known if p[3] is not None}
    assert {r.p: r.k for r in R.pool_sizes(df, ["a", "b"]).collect()} == {p: k for p, k in want.items() if k}


def test_small_populations(spark):
    _, df = population(spark)
    none, one = df.where("player_id < 0"), df.where("player_id = 3")
    for d in (none, one):
        assert pairs.distance_quantile(d, "player_id", ["a", "b"], 0.5) is None
        assert R.scarcity_density(d, ["a", "b"]).collect() == [] and R.pool_sizes(d, ["a", "b"]).collect() == []


def test_no_pair_leaves_its_task(spark):
    """A population's pairs are counted where they meet: sums a player and block are all that is shuffled."""
    df = spark.range(9000).select(F.col("id").cast("int").alias("player_id"), (F.col("id") % 997).cast("double").alias("a"), (F.col("id") % 89).cast("double").alias("b"), F.lit(1.0).alias("quality"))
    plan = R.scarcity_density(df, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "FlatMapGroupsInArrow" in plan


def test_pairs_meet_range_by_range(spark, monkeypatch):
    """No side is sent to all tasks, and every pair comes once, whatever ranges the ids fall to."""
    monkeypatch.setattr(pairs, "RANGE", 10)
    monkeypatch.setattr(pairs, "LOOKED_AT", 3)
    rows, df = population(spark)
    rows, df = rows + [(91, 0.0, 0.0, 1.0)], df.union(spark.createDataFrame([(91, 0.0, 0.0, 1.0)], df.schema))
    d = R.pair_distances(df, ["a", "b"])
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan
    people = [r for r in rows if r[0] is not None]
    want = sorted((p[0], q[0], None if p[1] is None or q[1] is None else math.sqrt((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2)) for p in people for q in people if p[0] < q[0])
    got = sorted((r.p, r.q, r.d) for r in d.collect())
    key = lambda x: (x[0], x[1], x[2] is None, x[2] or 0.0)
    assert [x[:2] for x in sorted(got, key=key)] == [x[:2] for x in sorted(want, key=key)]
    assert [x[2] for x in sorted(got, key=key)] == pytest.approx([x[2] for x in sorted(want, key=key)], abs=1e-12)
    most = d.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert most < len(want) / 8  # writers keep much of a partition's pairs in memory
    words = df.select(F.format_string("n%03d", "player_id").alias("name"), "a", "b").where("player_id < 40")
    assert R.pair_distances(words, ["a", "b"], "name").where("p < q").count() == 40 * 39 // 2
    assert R.pair_distances(df.where("player_id < 0"), ["a", "b"]).collect() == []


def test_lengths_are_rounded_as_in_sql(spark):
    import duckdb

    rng = random.Random(7)
    v = [0.0, 1.0000005, 0.0000005, 2.5e-7, 0.49999999999999994e-6, 1e9 + 0.1234565, 2.0**33 + 0.25, 1e300, float("inf"), float("nan"), None]
    v += [rng.randrange(10**9) / 1e7 for _ in range(2000)] + [math.sqrt(rng.randrange(10**6)) for _ in range(2000)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "k int, d double")
    d = df.select("k", S.r6_length(F.col("d")).alias("d"))
    got = {r.k: r.d for r in d.collect()}
    want = dict(duckdb.sql("SELECT k, round(d, 6) + 0.0 FROM (SELECT unnest($1) k, unnest($2::DOUBLE[]) d)", params=[list(range(len(v))), v]).fetchall())
    assert {k: str(x) for k, x in got.items()} == {k: str(x) for k, x in want.items()}
