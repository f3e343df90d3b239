"""From tracked games to what models are made of: velocities, attempts with the players of their frame, features, threat."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.functions.scalar import ControlParams, control, distance, num, zone
from touchline.operators.motion import frame_step, pressure, receiver_in_frame, velocities
from touchline.operators.threat import NX, NY, directions, transitions, value_iteration, zone_counts, zone_rates


def moving(tracking: DataFrame) -> DataFrame:
    """Adds vx, vy to the players' positions; the time between frames is the median of all games' steps."""
    dt = frame_step(tracking).first().dt
    players = tracking.where("team <> 'ball'")
    return velocities(players, ["game_id", "period", "team", "player_id"], ["x", "y"], dt=dt or 0.04)


def sides_of_play(events: DataFrame) -> DataFrame:
    """`events` with direction: 1 where the team attacks towards +x in that game and period, else -1."""
    e = events.withColumn("sx", F.col("start_x") / 105.0 + 0.5)
    d = directions(e.withColumn("team", F.struct("game_id", "team")).withColumn("type", F.upper("type")))
    d = d.select(F.col("team.game_id").alias("game_id"), F.col("team.team").alias("team"), "period", "direction")
    return events.join(F.broadcast(d), ["game_id", "team", "period"], "left").withColumn("direction", F.coalesce("direction", F.lit(1)))


def attempts(tracking: DataFrame, events: DataFrame) -> DataFrame:
    """Passes, and losses to an interception, whose start frame is tracked: pass_id, match_id, period, start_frame, team,
    passer, receiver (recorded; null for a loss), completed, direction, start, end, frame, teammates, opponents.

    Places are turned so that the team attacks towards +x, y upwards as in the season's files. `frame` has the players that
    are in it, with velocities: the passing team's and the others; teammates are the passing team with the passer.
    """
    lost = (F.col("type") == "BALL LOST") & F.coalesce(F.col("subtype").contains("INTERCEPTION"), F.lit(False))
    e = sides_of_play(events).where(((F.col("type") == "PASS") | lost) & F.col("passer").isNotNull() & (F.col("passer") != "") & F.col("start_x").isNotNull() & F.col("end_x").isNotNull())
    seen = tracking.where("x is not null and y is not null").select("game_id", "period", F.col("frame").alias("start_frame"), F.struct(F.col("team"), F.col("player_id").alias("k"), "x", "y", "vx", "vy").alias("p"))
    at = seen.groupBy("game_id", "period", "start_frame").agg(F.array_sort(F.collect_list("p")).alias("ps"))  # a frame's players
    d = e.join(at, ["game_id", "period", "start_frame"])
    turn = lambda x, y: ((x * F.col("direction")), (y * -F.col("direction")))

    def player(p):
        (x, y), (vx, vy) = turn(p["x"], p["y"]), turn(p["vx"], p["vy"])
        return F.struct(p["k"].alias("k"), (p["team"] == F.col("team")).alias("teammate"), ((p["team"] == F.col("team")) & (p["k"] == F.col("passer"))).alias("actor"), x.alias("x"), y.alias("y"), vx.alias("vx"), vy.alias("vy"))

    (sx, sy), (ex, ey) = (turn(F.col(f"{c}_x"), F.col(f"{c}_y")) for c in ("start", "end"))
    d = d.select("event_seq", "game_id", "period", "start_frame", "team", "passer", F.when(F.col("type") == "PASS", F.col("recipient")).alias("receiver"), (F.col("type") == "PASS").cast("int").alias("completed"), "direction",
                 sx.alias("start_x"), sy.alias("start_y"), ex.alias("end_x"), ey.alias("end_y"), F.transform("ps", player).alias("frame"))
    d = d.withColumn("teammates", F.filter("frame", lambda p: p["teammate"])).withColumn("opponents", F.filter("frame", lambda p: ~p["teammate"]))
    return d.withColumnsRenamed({"event_seq": "pass_id", "game_id": "match_id"})


def attempt_features(tried: DataFrame, most: float = 40.0, params: ControlParams = ControlParams()) -> DataFrame:
    """The completion model's rows: pass_id, match_id, team, period, frame, passer, target, completed, control_target,
    distance_m, forward_m, pressure_m, at the receiver's place in the start frame. A loss's receiver is the teammate whose
    bearing deviates least; attempts without a receiver in the frame, or with one side alone in it, are left out."""
    d = receiver_in_frame(tried.withColumnRenamed("receiver", "recorded"), most)
    d = d.withColumn("target", F.when(F.col("completed") == 1, F.col("recorded")).otherwise(F.col("receiver")))
    spot = F.get(F.filter("frame", lambda p: p["teammate"] & (p["k"] == F.col("target"))), F.lit(0))
    d = d.withColumn("_s", spot).where("_s is not null").withColumn("tx", F.col("_s.x")).withColumn("ty", F.col("_s.y"))
    d = d.withColumn("control_target", control(F.col("teammates"), F.col("opponents"), F.col("tx"), F.col("ty"), params, moving=True)).where("control_target is not null")
    return d.select("pass_id", "match_id", "team", "period", F.col("start_frame").alias("frame"), "passer", "target", "completed", "control_target", distance(F.col("tx"), F.col("ty"), F.col("start_x"), F.col("start_y")).alias("distance_m"),
                    (F.col("tx") - F.col("start_x")).alias("forward_m"), pressure(F.col("opponents"), F.col("start_x"), F.col("start_y")).alias("pressure_m"))


def pooled_threat(events: DataFrame) -> DataFrame:
    """zone, xt of all games' shots, passes and interceptions, each team turned to attack towards +x."""
    d = sides_of_play(events).where("start_x is not null and start_y is not null")
    at = lambda c: zone(num(0.5) + F.col(f"{c}_y") * F.col("direction") / 68.0, NY) * NX + zone(F.col(f"{c}_x") * F.col("direction") / 105.0 + 0.5, NX)
    kind = F.when(F.col("type") == "SHOT", "SHOT").when((F.col("type") == "PASS") & F.col("end_x").isNotNull() & F.col("end_y").isNotNull(), "PASS").when(F.col("type") == "BALL LOST", "BALL LOST")
    goal = F.coalesce(F.col("subtype").contains("GOAL"), F.lit(False))
    acts = d.select(kind.alias("type"), goal.alias("goal"), at("start").alias("z0"), at("end").alias("z1")).where("type is not null")
    return value_iteration(zone_rates(zone_counts(acts)), transitions(acts))


def prototype(tracking: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of loaded games: tracking with velocities, the completion model's rows, and the pooled threat surface."""
    fast = moving(tracking)
    return fast, attempt_features(attempts(fast, events)), pooled_threat(events)
