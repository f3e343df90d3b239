"""Lengths at a bound, and places at one distance, as the SQL has them."""

import math

from touchline.functions import scalar as S
from touchline.operators import roles as R


def test_length_at_a_bound(spark):
    rows = [(1, 7, -10.700000000000003, 20.200000000000003, -28.7, -3.8000000000000007), (1, 8, -23.3, -5.199999999999999, 0.7000000000000028, 12.799999999999997), (1, 9, 0.0, 0.0, 40.0, 0.0)]
    got = R.territory_style(spark.createDataFrame(rows, "team int, passer int, start_x double, start_y double, end_x double, end_y double"))
    assert {r.player_id: r.long_share for r in got.collect()} == {p: float(math.sqrt((ex - x) ** 2 + (ey - y) ** 2) > 30) for _, p, x, y, ex, ey in rows}


def test_nearest_of_places_at_one_distance(spark):
    far = lambda v: ((v / 105.0 + 0.5) * 120.0 / 120.0 - 0.5) * 105.0
    wide = lambda v: (0.5 - (0.5 - v / 68.0) * 80.0 / 80.0) * 68.0
    rows = []
    for order, customer in [(80553, 1467), *((k, k * 7 % 1500) for k in range(300))]:
        end = far(order * 29 % 1050 / 10 - 52.5), wide(customer * 43 % 680 / 10 - 34.0)
        rows.append((order, [(far((order * 31 + k * 97) % 1050 / 10 - 52.5), wide((customer * 17 + k * 61) % 680 / 10 - 34.0)) for k in range(3, 21, 2)], *end))
    rows += [(-1, [], 0.0, 0.0), (-2, None, 0.0, 0.0), (-3, [(1.0, 0.0), (-1.0, 0.0)], 0.0, 0.0), (-4, [(1.0, 0.0)], None, 0.0)]
    got = spark.createDataFrame(rows, "i int, p array<struct<x: double, y: double>>, x double, y double").select("i", S.nearest_place("p", "x", "y").alias("n"))
    got = {r.i: r.n and tuple(r.n) for r in got.collect()}
    assert got[-1] is None and got[-2] is None and got[-3] == (1.0, 1.0, 0.0) and got[-4] == (None, 1.0, 0.0)
    for i, points, x, y in rows[:-4]:
        assert got[i] == min((math.sqrt((a - x) ** 2 + (b - y) ** 2), k, a, b) for k, (a, b) in enumerate(points))[:1] + min((math.sqrt((a - x) ** 2 + (b - y) ** 2), k, a, b) for k, (a, b) in enumerate(points))[2:]
