"""Tracked games by hand: attempts turned to attack, features, the value table, the pooled surface."""

import math

import pytest
from pyspark.sql import functions as F

from touchline.operators import passing as P
from touchline.operators import tracked

TRACK = "game_id int, period int, frame long, t double, team string, player_id string, x double, y double"
EVENT = "game_id int, event_seq long, team string, type string, subtype string, period int, start_frame long, end_frame long, passer string, recipient string, start_x double, start_y double, end_x double, end_y double"


@pytest.fixture(scope="module")
def game(spark):
    spots = {("home", "1"): (-10.0, 5.0), ("home", "2"): (-20.0, 5.0), ("home", "3"): (-10.0, 25.0), ("away", "1"): (-15.0, 0.0), ("away", "2"): (-30.0, 5.0), ("away", "9"): (None, None)}
    rows = [(1, 1, f, f * 0.04, team, k, x, y) for f in range(10, 16) for (team, k), (x, y) in spots.items()]
    rows = [(*r[:6], r[6] + 0.2 * (r[2] - 10), r[7]) if r[4:6] == ("away", "2") else r for r in rows]  # runs at 5 m/s
    rows += [(1, 1, f, f * 0.04, "ball", None, 0.0, 0.0) for f in range(10, 16)]
    ev = lambda n, kind, frame, start, end, to="2", sub=None, who="1", team="home": (1, n, team, kind, sub, 1, frame, frame + 1, who, to, *start, *end)
    events = [
        ev(1, "PASS", 10, (-10.0, 5.0), (-20.0, 5.0)), ev(2, "BALL LOST", 10, (-10.0, 5.0), (-40.0, 6.0), None, "INTERCEPTION"), ev(3, "BALL LOST", 10, (-10.0, 5.0), (50.0, 5.0), None, "INTERCEPTION"),
        ev(4, "PASS", 99, (-10.0, 5.0), (-20.0, 5.0)), ev(5, "PASS", 10, (-10.0, 5.0), (-20.0, 5.0), "77"), ev(6, "BALL LOST", 10, (-10.0, 5.0), (-20.0, 5.0), None, None), ev(7, "SHOT", 12, (-45.0, 0.0), (-52.5, 0.0), None, "ON TARGET-GOAL"),
    ]
    return tracked.moving(spark.createDataFrame(rows, TRACK)).persist(), spark.createDataFrame(events, EVENT)


def test_velocities_use_the_median_step(game):
    fast, _ = game
    v = {(r.team, r.player_id): (r.vx, r.vy) for r in fast.where("frame = 13").collect()}
    assert v["away", "2"] == (pytest.approx(5.0), pytest.approx(0.0)) and v["home", "1"] == (0.0, 0.0) and v["away", "9"] == (None, None)
    assert ("ball", None) not in v


def test_attempts_are_turned_and_have_their_receiver(game):
    """The home team shoots towards -x, so that everything is turned round."""
    fast, events = game
    tried = tracked.attempts(fast, events)
    assert {r.pass_id for r in tried.collect()} == {1, 2, 3, 5}
    got = {r.pass_id: r for r in tracked.attempt_features(tried).collect()}
    assert set(got) == {1, 2}  # 3 has no teammate ahead, 5's receiver isn't in the frame
    a, b = got[1], got[2]
    assert (a.target, a.completed, b.target, b.completed) == ("2", 1, "2", 0)
    assert (a.distance_m, a.forward_m) == (pytest.approx(10.0), pytest.approx(10.0))
    assert a.pressure_m == pytest.approx(math.hypot(5, 5))
    # to the target (-20, 5): player 2 stands there; away 1 is 7.07 m off, away 2 runs for 0.7 s at 5 m/s from 10 m off
    lead = min(math.hypot(5, 5), 10.0 - 3.5) / 5
    assert a.control_target == pytest.approx(1 / (1 + math.exp(-lead / 0.45)))


def test_the_value_table_leaves_failed_passes_out(game, spark):
    fast, events = game
    tried = tracked.attempts(fast, events)
    xt = spark.range(96).selectExpr("cast(id as int) zone", "cast(id % 12 as double) / 100 xt")
    even = P.fixed_model(0.0, {"control_target": 0.0})
    done = P.tracked_value(tried, xt, even).collect()
    assert [r.pass_id for r in done] == [1]
    both = {r.pass_id: r for r in P.tracked_value(tried, xt, even, include_failed=True).collect()}
    assert set(both) == {1, 2}
    # candidates 2 at (20, -5) and 3 at (10, -25) once turned: columns 8 and 7, mirrored 3 and 4
    r = both[1]
    assert (r.from_player, r.to_player, r.n_candidates) == ("1", "2", 2)
    assert (r.ev_chosen, r.ev_baseline_max, r.ev_baseline_avg) == (pytest.approx(0.025), pytest.approx(0.025), pytest.approx((0.025 + 0.015) / 2))
    assert (r.cpv_max, r.cpv_avg, r.execution_quality) == (pytest.approx(0.0), pytest.approx(0.005), pytest.approx(0.08 - 0.025))
    # lost at (40, -6): column 10, which the others see as 1
    assert both[2].execution_quality == pytest.approx(-0.01 - 0.025)
    near = P.tracked_value(tried, xt, even, widest=5.0).first()
    assert near.n_candidates == 1 and near.to_player == "2"


def test_the_pooled_surface(game):
    _, events = game
    values = {r.zone: r.xt for r in tracked.pooled_threat(events).collect()}
    assert len(values) == 96 and max(values.values()) == 1.0  # the shot's zone scored
    assert values[4 * 12 + 11] == 1.0


def test_all_of_it(game):
    fast, events = game
    tracking, rows, surface = tracked.prototype(fast.drop("vx", "vy"), events)
    assert tracking.count() == fast.count() and rows.count() == 2 and surface.agg(F.count("*")).first()[0] == 96
