"""Completion features, expected value of choices, counterfactual passing value, reception and turnover values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions.scalar import ControlParams, control, distance, events_to_metric, logistic, metric_to_season, mirror, num, zone
from touchline.operators.motion import match_target, pressure, receiver_in_frame
from touchline.operators.threat import NX, NY, lookup

FEATURES = ["control_target", "distance_m", "forward_m", "pressure_m"]


def completion_features(passes: DataFrame, params: ControlParams = ControlParams()) -> DataFrame:
    """The chosen action's features at the matched target, one row a pass with players on both sides."""
    tx, ty, sx, sy = (F.col(c) for c in ("target_x", "target_y", "start_x", "start_y"))
    usable = passes.where((F.size("teammates") >= 1) & (F.size("opponents") >= 1))
    return usable.select("pass_id", "match_id", "team", "passer", "completed", "target_match_dist", control(F.col("teammates"), F.col("opponents"), tx, ty, params).alias("control_target"), distance(tx, ty, sx, sy).alias("distance_m"), (tx - sx).alias("forward_m"), pressure(F.col("opponents"), sx, sy).alias("pressure_m"))


def fixed_model(intercept: float, weights: dict[str, float]) -> Callable[[dict[str, Column]], Column]:
    """A logistic model as a column expression over the features."""

    def predict(features: dict[str, Column]) -> Column:
        z = num(intercept)
        for k, w in weights.items():
            z = z + features[k] * w
        return logistic(z)

    return predict


def choices(passes: DataFrame, params: ControlParams = ControlParams()) -> DataFrame:
    """One row a candidate of every pass with two teammates or more: all teammates and, once more, the chosen target."""
    point = F.struct(F.col("target_x").alias("x"), F.col("target_y").alias("y"))
    all_ = F.concat("teammates", F.array(point))
    df = passes.where((F.size("teammates") >= 2) & (F.size("opponents") >= 1)).withColumn("n_candidates", F.size("teammates") + 1)
    df = df.withColumn("pressure_m", pressure(F.col("opponents"), F.col("start_x"), F.col("start_y")))
    df = df.select("*", F.posexplode(all_).alias("ord", "c")).withColumn("cx", F.col("c.x")).withColumn("cy", F.col("c.y")).withColumn("chosen", F.col("ord") == F.col("n_candidates") - 1)
    df = df.withColumn("control_target", control(F.col("teammates"), F.col("opponents"), F.col("cx"), F.col("cy"), params))
    df = df.withColumn("distance_m", distance(F.col("cx"), F.col("cy"), F.col("start_x"), F.col("start_y"))).withColumn("forward_m", F.col("cx") - F.col("start_x"))
    return df.drop("teammates", "opponents", "frame", "c")


def expected_values(options: DataFrame, xt: DataFrame, model, turnover: DataFrame | None = None) -> DataFrame:
    """Adds p, v_receive, v_turnover, ev. `turnover`: a surface of conceded goals; without, the opponents' own threat."""
    nx, ny = metric_to_season(F.col("cx"), F.col("cy"))
    df = lookup(options, xt, nx, ny, "v_receive")
    if turnover is None:
        df = lookup(df, xt, nx, ny, "v_turnover", opponents=True)
    else:
        df = lookup(df, turnover.select("zone", F.col("value").alias("xt")), nx, ny, "v_turnover").withColumn("v_turnover", -F.col("v_turnover"))
    df = df.withColumn("p", model({k: F.col(k) for k in FEATURES}))
    return df.withColumn("ev", F.col("p") * F.col("v_receive") + (num(1) - F.col("p")) * F.col("v_turnover"))


def passing_value(valued: DataFrame) -> DataFrame:
    """One row a pass: the chosen option's expected value against the mean, the best, the spread and the rank of all."""
    pick = lambda c: F.max(F.when(F.col("chosen"), F.col(c)))
    keys = ["pass_id", "match_id", "team", "passer", "completed", "target_match_dist", "n_candidates", "start_x", "start_y", "target_x", "target_y"]
    best = Window.partitionBy("pass_id")
    df = valued.withColumn("ev_chosen", F.max(F.when(F.col("chosen"), F.col("ev"))).over(best))
    df = df.groupBy(*keys).agg(F.max("ev_chosen").alias("ev_chosen"), F.avg("ev").alias("ev_mean"), F.max("ev").alias("ev_max"), F.stddev_pop("ev").alias("ev_spread"), pick("p").alias("p_complete_chosen"), pick("v_receive").alias("v_receive_chosen"), pick("v_turnover").alias("v_turnover_chosen"), F.count_if(F.col("ev") < F.col("ev_chosen")).alias("below"))
    c, m = F.col("ev_chosen"), F.col("ev_mean")
    df = df.withColumn("cpv_avg", c - m).withColumn("cpv_max", c - F.col("ev_max")).withColumn("cpv_z", (c - m) / F.greatest("ev_spread", num(1e-4)))
    return df.withColumn("cpv_rank", F.col("below") / F.greatest(F.col("n_candidates") - 1, F.lit(1))).drop("below")


def zone_values(values: DataFrame) -> DataFrame:
    """One row with the values of all zones of the grid as an array; 0 for a zone that has none."""
    known = values.agg(F.map_from_entries(F.collect_list(F.struct(F.col("zone").cast("int"), F.col("xt").cast("double")))).alias("v"))
    return known.select(F.transform(F.sequence(F.lit(0), F.lit(NX * NY - 1)), lambda z: F.coalesce(F.try_element_at("v", z), num(0))).alias("zone_values"))


def passing_value_in_place(passes: DataFrame, xt: DataFrame, model, turnover: DataFrame | None = None, params: ControlParams = ControlParams()) -> DataFrame:
    """What `passing_value` gives for all choices of each pass, computed within its row: nothing is exploded or shuffled.

    `turnover`: a surface of conceded goals; without, the opponents' own threat.
    """
    sx, sy = F.col("start_x"), F.col("start_y")
    point = F.struct(F.col("target_x").alias("x"), F.col("target_y").alias("y"))
    df = passes.where((F.size("teammates") >= 2) & (F.size("opponents") >= 1)).crossJoin(F.broadcast(zone_values(xt).withColumnRenamed("zone_values", "gains")))
    if turnover is not None:
        df = df.crossJoin(F.broadcast(zone_values(turnover.select("zone", F.col("value").alias("xt"))).withColumnRenamed("zone_values", "losses")))
    df = df.withColumn("pressure_m", pressure(F.col("opponents"), sx, sy))

    def option(c: Column) -> Column:
        x, y = metric_to_season(c["x"], c["y"])
        at = zone(y, NY) * NX + zone(x, NX)
        mx, my = mirror(x, y)
        lost = -F.get("gains", zone(my, NY) * NX + zone(mx, NX)) if turnover is None else -F.get("losses", at)
        features = {"control_target": control(F.col("teammates"), F.col("opponents"), c["x"], c["y"], params), "distance_m": distance(c["x"], c["y"], sx, sy), "forward_m": c["x"] - sx, "pressure_m": F.col("pressure_m")}
        return F.struct(*(f.alias(k) for k, f in features.items()), F.get("gains", at).alias("v"), lost.alias("t"))

    df = df.withColumn("options", F.transform(F.concat("teammates", F.array(point)), option))
    # the features are bound now: a model may read them many times
    df = df.withColumn("options", F.transform("options", lambda o: F.struct(model({k: o[k] for k in FEATURES}).alias("p"), o["v"].alias("v"), o["t"].alias("t"))))
    df = df.withColumn("evs", F.transform("options", lambda o: o["p"] * o["v"] + (num(1) - o["p"]) * o["t"])).withColumn("n", F.size("evs"))
    total = lambda f: F.aggregate("evs", num(0), lambda s, e: s + f(e))
    df = df.withColumn("ev_chosen", F.get("evs", F.col("n") - 1)).withColumn("ev_mean", total(lambda e: e) / F.col("n")).withColumn("ev_max", F.array_max("evs")).withColumn("best", F.get("options", F.col("n") - 1))
    df = df.withColumn("ev_spread", F.sqrt(total(lambda e: (e - F.col("ev_mean")) * (e - F.col("ev_mean"))) / F.col("n")))
    c, m = F.col("ev_chosen"), F.col("ev_mean")
    below = F.size(F.filter("evs", lambda e: e < c))
    return df.select("pass_id", "match_id", "team", "passer", "completed", "target_match_dist", F.col("n").alias("n_candidates"), "start_x", "start_y", "target_x", "target_y", "ev_chosen", "ev_mean", "ev_max", "ev_spread", F.col("best.p").alias("p_complete_chosen"), F.col("best.v").alias("v_receive_chosen"), F.col("best.t").alias("v_turnover_chosen"),
                     (c - m).alias("cpv_avg"), (c - F.col("ev_max")).alias("cpv_max"), ((c - m) / F.greatest("ev_spread", num(1e-4))).alias("cpv_z"), (below / F.greatest(F.col("n") - 1, F.lit(1))).alias("cpv_rank"))


def tracked_value(passes: DataFrame, xt: DataFrame, model, include_failed: bool = False, widest: float | None = None, most: float = 40.0, params: ControlParams = ControlParams()) -> DataFrame:
    """The value of tracked attempts: pass_id, team, from_player, to_player, completed, ev_chosen, ev_baseline_max,
    ev_baseline_avg, cpv_max, cpv_avg, execution_quality, n_candidates.

    passes(pass_id, team, passer, completed, receiver, start, end, frame, teammates, opponents): `receiver` is the k of the
    recorded receiver of a completed pass; a failed one's is the teammate whose bearing deviates least, within `most`
    degrees. Candidates are the teammates in the frame, those within `widest` metres and the receiver. Failed passes are left
    out unless asked for, as their inferred target leans to valuable places. What a pass returned is the threat at its end,
    or what losing the ball there costs; less the expected value, this is its execution. Computed in the row.
    """
    sx, sy = F.col("start_x"), F.col("start_y")
    inferred = receiver_in_frame(passes.withColumnRenamed("receiver", "recorded"), most)
    df = inferred.withColumn("to_player", F.when(F.col("completed") == 1, F.col("recorded")).otherwise(F.col("receiver"))).drop("receiver", "angle")
    df = df.where(F.col("to_player").isNotNull() & (F.size("opponents") >= 1) & (F.lit(include_failed) | (F.col("completed") == 1)))
    df = df.crossJoin(F.broadcast(zone_values(xt).withColumnRenamed("zone_values", "gains"))).withColumn("pressure_m", pressure(F.col("opponents"), sx, sy))

    def worth(x: Column, y: Column) -> tuple[Column, Column]:
        x, y = metric_to_season(x, y)
        mx, my = mirror(x, y)
        return F.get("gains", zone(y, NY) * NX + zone(x, NX)), -F.get("gains", zone(my, NY) * NX + zone(mx, NX))

    def option(c: Column) -> Column:
        v, t = worth(c["x"], c["y"])
        features = {"control_target": control(F.col("teammates"), F.col("opponents"), c["x"], c["y"], params), "distance_m": distance(c["x"], c["y"], sx, sy), "forward_m": c["x"] - sx, "pressure_m": F.col("pressure_m")}
        return F.struct(c["k"].alias("k"), *(f.alias(n) for n, f in features.items()), v.alias("v"), t.alias("t"))

    near = (lambda c: (distance(c["x"], c["y"], sx, sy) <= widest) | (c["k"] == F.col("to_player"))) if widest is not None else (lambda c: F.lit(True))
    df = df.withColumn("options", F.transform(F.filter("frame", lambda c: c["teammate"] & ~c["actor"] & near(c)), option))

    def valued(o: Column) -> Column:
        p = model({k: o[k] for k in FEATURES})
        return F.struct(o["k"].alias("k"), p.alias("p"), o["v"].alias("v"), o["t"].alias("t"))

    df = df.withColumn("options", F.transform("options", valued)).withColumn("options", F.transform("options", lambda o: F.struct(o["k"].alias("k"), (o["p"] * o["v"] + (num(1) - o["p"]) * o["t"]).alias("ev"))))
    df = df.withColumn("ev_chosen", F.get(F.filter("options", lambda o: o["k"] == F.col("to_player")), F.lit(0))["ev"]).where("ev_chosen is not null").withColumn("n_candidates", F.size("options"))
    df = df.withColumn("ev_baseline_max", F.array_max(F.transform("options", lambda o: o["ev"]))).withColumn("ev_baseline_avg", F.aggregate("options", num(0), lambda a, o: a + o["ev"]) / F.col("n_candidates"))
    good, bad = worth(F.col("end_x"), F.col("end_y"))
    c = F.col("ev_chosen")
    return df.select("pass_id", "team", F.col("passer").alias("from_player"), "to_player", "completed", "ev_chosen", "ev_baseline_max", "ev_baseline_avg", (c - F.col("ev_baseline_max")).alias("cpv_max"), (c - F.col("ev_baseline_avg")).alias("cpv_avg"),
                     (F.when(F.col("completed") == 1, good).otherwise(bad) - c).alias("execution_quality"), F.col("n_candidates").cast("long").alias("n_candidates"))


def pass_table(events: DataFrame, frames: DataFrame) -> DataFrame:
    """One row a pass that has a freeze frame with players of both sides: its ends, its nearest teammate as the target, all
    positions in metres, and whether its possession's first team scored in it.

    events(match_id, event_seq, and the provider's fields) and frames(match_id, event_uuid, freeze_frame). Passes that were
    neither completed nor cut out (out of play, offside, stopped) and those without a place are left out. The columns are
    those that features, values and receptions are made of.
    """
    point = lambda p: F.struct(*(c.alias(n) for c, n in zip(events_to_metric(F.get(p, F.lit(0)), F.get(p, F.lit(1))), "xy")))
    goal = (F.col("type.name") == "Shot") & (F.col("shot.outcome.name") == "Goal")
    log = events.select("match_id", "possession", F.col("event_seq").alias("seq"), F.col("possession_team.name").alias("owner"), F.when(goal, F.col("team.name")).alias("scorer"))
    owners = log.where("possession is not null").groupBy("match_id", "possession").agg(F.min_by("owner", "seq").alias("owner"), F.collect_set("scorer").alias("scorers"))
    scored = owners.select("match_id", "possession", F.array_contains("scorers", F.col("owner")).cast("int").alias("scored"))
    outcome = F.col("pass.outcome.name")
    passes = events.where((F.col("type.name") == "Pass") & (F.size("location") > 0) & (outcome.isNull() | (outcome == "Incomplete")))
    passes = passes.select("match_id", F.col("id").alias("pass_id"), "period", "minute", F.col("team.name").alias("team"), F.col("player.id").alias("passer_id"), F.col("player.name").alias("passer"), F.col("pass.recipient.id").alias("recipient_id"), F.col("pass.recipient.name").alias("recipient"),
                           F.when(outcome.isNull(), 1).otherwise(0).alias("completed"), point(F.col("location")).alias("s"), point(F.col("pass.end_location")).alias("e"), "possession")
    seen = frames.select("match_id", F.col("event_uuid").alias("pass_id"), F.transform("freeze_frame", lambda p: F.struct(point(p["location"]).alias("at"), p["teammate"].alias("teammate"), F.coalesce(p["actor"], F.lit(False)).alias("actor"))).alias("ps"))
    side = lambda mate: F.transform(F.filter("ps", lambda p: ~p["actor"] & (p["teammate"] == mate)), lambda p: p["at"])
    # what is shuffled: passes with their possession's goal, and of a frame the places of either side
    seen = seen.select("match_id", "pass_id", side(True).alias("teammates"), side(False).alias("opponents"), F.size("ps").alias("n_visible")).where((F.size("teammates") > 0) & (F.size("opponents") > 0))
    passes = passes.join(scored, ["match_id", "possession"], "left").withColumn("scored", F.coalesce("scored", F.lit(0)))
    df = passes.join(seen, ["match_id", "pass_id"]).select("*", F.col("s.x").alias("start_x"), F.col("s.y").alias("start_y"), F.col("e.x").alias("end_x"), F.col("e.y").alias("end_y")).drop("s", "e")
    return match_target(df)


def possessions(log: DataFrame) -> DataFrame:
    """match_id, possession, team (first seen), start_x, start_y (first located), scored (by that team)."""
    first = log.groupBy("match_id", "possession").agg(F.min_by("team", "seq").alias("owner"), F.min_by(F.struct("x", "y"), F.when(F.col("x").isNotNull(), F.col("seq"))).alias("start"))
    goals = log.where("type = 'Shot' and goal").groupBy("match_id", "possession", F.col("team").alias("owner")).agg(F.lit(1).alias("scored"))
    return first.join(goals, ["match_id", "possession", "owner"], "left").select("match_id", "possession", F.col("owner").alias("team"), F.col("start.x").alias("start_x"), F.col("start.y").alias("start_y"), F.coalesce("scored", F.lit(0)).alias("scored"))


def last_turnovers(log: DataFrame) -> DataFrame:
    """match_id, possession, losing_team, x, y of the last located turnover of each possession."""
    lost = log.where("lost and x is not null")
    return lost.groupBy("match_id", "possession").agg(F.max_by(F.struct("team", "x", "y"), "seq").alias("l")).select("match_id", "possession", F.col("l.team").alias("losing_team"), "l.x", "l.y")


def conceded(log: DataFrame) -> DataFrame:
    """Turnovers after which the other team has the next possession, and whether it scored in it."""
    after = possessions(log).select("match_id", (F.col("possession") - 1).alias("possession"), F.col("team").alias("next_team"), F.col("scored").alias("conceded"))
    return last_turnovers(log).join(after, ["match_id", "possession"]).where("next_team <> losing_team")


def turnover_surface(log: DataFrame, nx: int = NX, ny: int = NY, prior: float = 40.0) -> DataFrame:
    """zone, n, goals, value: chance to concede after a loss in a zone, shrunk to the overall rate; every zone has a value."""
    z = (zone(F.col("y") / 80.0, ny) * nx + zone(F.col("x") / 120.0, nx)).alias("zone")
    counts = conceded(log).groupBy(z).agg(F.count("*").alias("n"), F.sum("conceded").alias("goals"))
    grid = log.sparkSession.range(nx * ny).select(F.col("id").cast("int").alias("zone"))
    full = grid.join(counts, "zone", "left").na.fill(0, ["n", "goals"])
    total = full.agg((F.sum("goals") / F.greatest(F.sum("n"), F.lit(1))).alias("rate"))
    return full.crossJoin(F.broadcast(total)).select("zone", "n", "goals", ((F.col("goals") + prior * F.col("rate")) / (F.col("n") + prior)).alias("value"))


def reception(passes: DataFrame, xt: DataFrame, most: float = 6.0) -> DataFrame:
    """Completed passes with a matched target: zone_xt, control_target, scored."""
    tx, ty = F.col("target_x"), F.col("target_y")
    d = passes.where((F.col("completed") == 1) & (F.col("target_match_dist") <= most))
    d = lookup(d, xt, *metric_to_season(tx, ty), "zone_xt")
    return d.select("pass_id", "scored", "zone_xt", control(F.col("teammates"), F.col("opponents"), tx, ty).alias("control_target")).where("control_target is not null")
