"""Control and arrival times on grids: whole grids of ragged rows against the column expression, and means over rows."""

import math

from pyspark.sql import functions as F

from touchline.functions import scalar as S
from touchline.operators import motion as M

ROWS = [
    (1, [(0.0, 0.0), (10.5, -3.25)], [(5.0, 5.0)]),
    (2, [(None, 3.0), (-7.0, 1.0)], [(30.0, -20.0), (1.0, None), (2.0, 2.0)]),
    (3, [], [(0.0, 0.0)]),
    (4, [(1.0, 1.0)], None),
    (5, [(k * 0.7 - 30, k % 13 * 1.5) for k in range(90)], [(40.0 - k, k * 0.25) for k in range(45)]),
    (6, [(None, None)], [(0.0, 0.0)]),
]
POINTS = "array<struct<x: double, y: double>>"


def rows(spark):
    return spark.createDataFrame(ROWS, f"pass_id long, teammates {POINTS}, opponents {POINTS}")


def test_control_grid_makes_a_row_at_once(spark):
    got = M.control_grid(rows(spark), 7, 5)
    assert got.columns == ["pass_id", "teammates", "opponents", "ix", "gx", "iy", "gy", "control"]
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 6 * 7 * 5
    both = got.withColumn("want", S.control(F.col("teammates"), F.col("opponents"), F.col("gx"), F.col("gy"))).collect()
    for r in both:
        assert r.gx == r.ix * (105.0 / 6) - 52.5 and r.gy == r.iy * (68.0 / 4) - 34.0
        assert (r.control is None) == (r.want is None) == (r.pass_id in (3, 4, 6))
        assert r.control is None or math.isclose(r.control, r.want, rel_tol=1e-12)


def test_player_grid_leaves_out_rows_without_a_side(spark):
    got = {(r.ix, r.iy): r for r in M.player_grid(rows(spark)).collect()}
    assert len(got) == 96
    time = lambda ps, x, y: min((0.7 + math.hypot(p - x, q - y) / 5 for p, q in ps if p is not None and q is not None), default=None)
    for ix, iy in [(0, 0), (5, 3), (11, 7)]:
        x, y = (ix + 0.5) * 105 / 12 - 52.5, (iy + 0.5) * 68 / 8 - 34
        pairs = [(time(a, x, y), time(d, x, y)) for _, a, d in ROWS if a and d]
        near = [a for a, _ in pairs if a is not None]
        r = got[ix, iy]
        assert math.isclose(r.attackers, sum(near) / len(near)) and math.isclose(r.defenders, sum(d for _, d in pairs) / len(pairs))
        assert r.led == sum(a is not None and a < d for a, d in pairs)
    assert M.player_grid(rows(spark).where("pass_id in (3, 4)")).collect() == []
