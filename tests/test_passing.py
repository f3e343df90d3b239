"""Passing value with fitted models, provider files end to end, and the choice of a model."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.operators import models as M
from touchline.operators import passing as P
from touchline.operators import threat as T
from touchline.plans.passes import MODEL, prepared
from touchline.sources import files
from touchline.sources.synthetic import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def season(spark):
    passes, log = (table(spark, SF, t) for t in ("syn_passes", "syn_log"))
    rows = prepared(table(spark, SF, "syn_snapshots")).persist()
    return rows, T.surface(passes).persist(), P.turnover_surface(log).persist()


@pytest.fixture(scope="module")
def learnable(spark):
    """Features whose label depends on them in a way that no line follows."""
    r = np.random.default_rng(2)
    x = r.random((6000, 4)) * [1, 60, 40, 20]
    p = np.where(x[:, 1] < 30, 0.9, 0.2) + 0.08 * (x[:, 0] > 0.5)
    y = (r.random(6000) < p).astype(int)
    rows = [(k, k % 12, *map(float, a), int(b)) for k, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "pass_id long, match_id int, control_target double, distance_m double, forward_m double, pressure_m double, completed int").repartition(3).persist()


@pytest.mark.parametrize("empirical", [False, True])
def test_value_in_the_row_equals_the_value_of_exploded_choices(season, empirical):
    rows, xt, cost = season
    turnover = cost if empirical else None
    one = P.passing_value_in_place(rows, xt, MODEL, turnover)
    two = P.passing_value(P.expected_values(P.choices(rows), xt, MODEL, turnover))
    columns = ["n_candidates", "ev_chosen", "ev_mean", "ev_max", "ev_spread", "p_complete_chosen", "v_receive_chosen", "v_turnover_chosen", "cpv_avg", "cpv_max"]
    a, b = ({r.pass_id: [r[c] for c in columns] for r in d.collect()} for d in (one, two))
    assert set(a) == set(b) and len(a) > 1000
    for k in a:
        assert a[k] == pytest.approx(b[k], abs=1e-12)


def test_trees_as_a_column_equal_the_model(season, learnable):
    model = M.boosted(learnable, P.FEATURES, "completed", rounds=12, key=["pass_id"])
    predict = M.boosted_expression(model, P.FEATURES)
    both = M.boosted_probability(model, learnable, P.FEATURES).withColumn("q", predict({f: F.col(f) for f in P.FEATURES}))
    assert both.agg(F.max(F.abs(F.col("p") - F.col("q")))).first()[0] < 1e-12 and both.select("q").distinct().count() > 20
    # and within the rows' own options
    rows, xt, cost = season
    one = P.passing_value_in_place(rows, xt, predict, cost)
    scored = M.boosted_probability(model, P.choices(rows).where("chosen"), P.FEATURES).select("pass_id", "p")
    worst = one.join(scored, "pass_id").agg(F.max(F.abs(F.col("p") - F.col("p_complete_chosen"))), F.count("*")).first()
    assert worst[0] < 1e-12 and worst[1] == rows.where(F.size("teammates") >= 2).count()


def test_the_model_with_the_least_gap_is_chosen(learnable):
    model, compared = M.completion_model(learnable, "match_id", P.FEATURES, "completed", ["pass_id"], n=3, rounds=40)
    rows = {r.kind: r for r in compared.collect()}
    assert rows["boosted"].chosen and not rows["logistic"].chosen
    assert rows["boosted"].worst_gap < rows["logistic"].worst_gap and rows["boosted"].brier < rows["logistic"].brier < rows["logistic"].baseline + 0.01
    assert rows["boosted"].n == rows["logistic"].n == 6000
    at = lambda control, far: model({"control_target": F.lit(control), "distance_m": F.lit(far), "forward_m": F.lit(5.0), "pressure_m": F.lit(5.0)})
    near, other = learnable.limit(1).select(at(0.9, 10.0), at(0.9, 50.0)).first()
    assert near > 0.75 and other < 0.5


def test_rounds_end_where_they_no_longer_help(learnable):
    noise = learnable.withColumn("completed", (F.pmod(F.xxhash64("pass_id"), F.lit(3)) > 0).cast("int"))
    assert M.boosted(noise, P.FEATURES, "completed", rounds=60, key=["pass_id"]).getNumTrees < 20


def test_folds_are_near_equal_and_whole(learnable):
    got = M.folds(learnable, "match_id", 5, 0).groupBy("fold").agg(F.count_distinct("match_id").alias("n"), F.count("*").alias("rows")).collect()
    assert sorted(r.n for r in got) == [2, 2, 2, 3, 3] and sum(r.rows for r in got) == 6000


def event(i, kind, x=60, y=40, possession=9, team="A", **more):
    place = [] if x is None else [x, y]
    return {"id": i, "type": {"name": kind}, "team": {"name": team}, "period": 1, "minute": 2, "possession": possession, "possession_team": {"name": "A"}, "player": {"id": 7, "name": "P"}, "location": place, **more}


def seen(x, y, mate, actor=False):
    return {"teammate": mate, "actor": actor, "keeper": False, "location": [x, y]}


def test_values_of_a_season_of_files(spark, tmp_path):
    """One pass by hand: its target, features and value; a pass without a place is left out."""
    for folder in ("events", "three-sixty"):
        (tmp_path / folder).mkdir()
    events = [event("a", "Pass", **{"pass": {"end_location": [72, 40]}}), event("b", "Pass", None, **{"pass": {"end_location": [72, 40]}}), event("s", "Shot", shot={"outcome": {"name": "Goal"}})]
    frame = [seen(60, 40, True, True), seen(84, 40, True), seen(72, 40, True), seen(90, 40, False), seen(60, 50, False)]
    (tmp_path / "events" / "31.json").write_text(json.dumps(events))
    (tmp_path / "three-sixty" / "31.json").write_text(json.dumps([{"event_uuid": i, "freeze_frame": frame} for i in "ab"]))
    passes = files.read_season(spark, str(tmp_path))
    f = P.completion_features(passes).collect()
    assert [r.pass_id for r in f] == ["a"] and f[0].match_id == 31 and f[0].passer == "P"
    # target (10.5, 0): nearest mate 0 m, opponents 15.75 m ahead and 13.5 m away
    away = (10.5**2 + 8.5**2) ** 0.5
    assert f[0].control_target == pytest.approx(1 / (1 + np.exp(-(min(15.75, away) / 5 - 0) / 0.45)))
    assert (f[0].distance_m, f[0].forward_m, f[0].pressure_m, f[0].target_match_dist) == pytest.approx((10.5, 10.5, 8.5, 0.0))
    xt = spark.range(96).selectExpr("cast(id as int) zone", "cast(id % 12 as double) / 100 xt")
    v = P.passing_value_in_place(passes, xt, P.fixed_model(0.0, {"control_target": 0.0})).first()
    # columns 8 (both mates' x of 21 and 10.5 m: cells 8 and 7) and mirrored 3 and 4, at even odds
    far, near = (0.08 - 0.03) / 2, (0.07 - 0.04) / 2
    assert v.ev_chosen == pytest.approx(near) and v.ev_mean == pytest.approx((far + 2 * near) / 3) and v.cpv_max == pytest.approx(near - far) and v.n_candidates == 3
    r = P.reception(passes, xt).first()
    assert (r.scored, r.zone_xt) == (1, 0.07)


def test_a_chosen_season_reports_every_match(spark, tmp_path):
    for folder in ("events", "three-sixty"):
        (tmp_path / folder).mkdir()
    one = json.dumps([event("a", "Pass", **{"pass": {"end_location": [72, 40]}})])
    frames = json.dumps([{"event_uuid": "a", "freeze_frame": [seen(60, 40, True, True), seen(84, 40, True), seen(90, 40, False)]}])
    other = json.dumps([{"event_uuid": "zzz", "freeze_frame": []}])
    for match, e, f in ((1, one, frames), (2, one, None), (3, None, frames), (4, one[:-9], frames), (5, one, frames[:-9]), (6, one, other), (7, one, frames), (8, one, frames)):
        for folder, text in (("events", e), ("three-sixty", f)):
            if text is not None:
                (tmp_path / folder / f"{match}.json").write_text(text)
    m = [(k, f"2024-01-{20 - k:02}", "X" if k % 2 else "Y", "Y" if k % 2 else "X") for k in range(1, 8)] + [(8, "2024-01-01", "U", "V")]
    (tmp_path / "m.json").write_text(json.dumps([{"match_id": k, "match_date": d, "home_team": {"home_team_name": h}, "away_team": {"away_team_name": a}} for k, d, h, a in m]))
    matches = files.read_matches(spark, str(tmp_path / "m.json"))
    assert [r.match_id for r in files.season_matches(matches, "X", 3).collect()] == [7, 6, 5]
    passes, report = files.read_chosen(spark, str(tmp_path), files.season_matches(matches, "X"))
    got = {r.match_id: (r.events, r.frames, r.passes, r.status) for r in report.collect()}
    assert got == {1: (1, 1, 1, "read"), 2: (1, 0, 0, "no frames"), 3: (0, 1, 0, "no events"), 4: (0, 1, 0, "broken events"), 5: (1, 0, 0, "broken frames"), 6: (1, 1, 0, "no passes"), 7: (1, 1, 1, "read")}
    assert {r.match_id for r in passes.collect()} == {1, 7}
