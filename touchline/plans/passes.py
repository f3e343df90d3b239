"""Queries: snapshots, control, completion features, passing value, tracking windows."""

import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import scalar as S
from touchline.operators import motion as M
from touchline.operators.models import reliability
from touchline.operators.order import rank_correlation
from touchline.operators import passing as P
from touchline.operators import threat as T
from touchline.sources import files
from touchline.sources.scratch import kept, shared_dir

from .base import query
from .zones import SURFACE, XT, Z

EX = """ex AS (SELECT pass_id, match_id, team, passer, completed, scored, start_x, start_y, end_x, end_y, unnest(frame) f FROM syn_snapshots),
  att AS (SELECT pass_id, f.k k, f.x x, f.y y FROM ex WHERE f.teammate AND NOT f.actor), opp AS (SELECT pass_id, f.k k, f.x x, f.y y FROM ex WHERE NOT f.teammate)"""
TARGET = """tgt AS (SELECT s.pass_id, arg_min({'x': a.x, 'y': a.y}, {'d': sqrt((a.x - s.end_x) ** 2 + (a.y - s.end_y) ** 2), 'k': a.k}) p, min(sqrt((a.x - s.end_x) ** 2 + (a.y - s.end_y) ** 2)) dist
    FROM syn_snapshots s JOIN att a USING (pass_id) GROUP BY s.pass_id),
  pas AS (SELECT s.*, t.p.x target_x, t.p.y target_y, t.dist target_match_dist FROM syn_snapshots s JOIN tgt t USING (pass_id)),
  press AS (SELECT s.pass_id, min(sqrt((o.x - s.start_x) ** 2 + (o.y - s.start_y) ** 2)) pressure_m FROM syn_snapshots s JOIN opp o USING (pass_id) GROUP BY 1)"""


def control_sql(points: str, keys: str) -> str:
    """Control at points(pass_id, ..., tx, ty)."""
    side = lambda s: f"(SELECT {keys}, min(0.7 + sqrt((p.tx - s.x) ** 2 + (p.ty - s.y) ** 2) / 5.0) t FROM {points} p JOIN {s} s USING (pass_id) GROUP BY ALL)"
    return f"(SELECT {keys}, 1.0 / (1 + exp(-(o.t - a.t) / 0.45)) control FROM {side('att')} a JOIN {side('opp')} o USING ({keys}))"


FEATS = f"""{EX}, {TARGET}, pts AS (SELECT pass_id, target_x tx, target_y ty FROM pas), ctl AS {control_sql("pts", "pass_id")},
  feats AS (SELECT p.pass_id, p.match_id, p.team, p.passer, p.completed, p.scored, p.target_match_dist, c.control control_target, sqrt((target_x - start_x) ** 2 + (target_y - start_y) ** 2) distance_m,
    target_x - start_x forward_m, pr.pressure_m FROM pas p JOIN ctl c USING (pass_id) JOIN press pr USING (pass_id))"""
WEIGHTS = {"control_target": 2.0, "distance_m": -0.04, "forward_m": -0.01, "pressure_m": 0.05}
MODEL = P.fixed_model(0.5, WEIGHTS)
PSQL = "1.0 / (1 + exp(-(0.5 + 2.0 * control_target - 0.04 * distance_m - 0.01 * forward_m + 0.05 * pressure_m)))"


def prepared(snapshots):
    return M.match_target(M.sides(snapshots))


@query("p07_pass_filter", "syn_snapshots", f"WITH {EX} SELECT s.pass_id, (SELECT count(*) FROM att a WHERE a.pass_id = s.pass_id) n_teammates, (SELECT count(*) FROM opp o WHERE o.pass_id = s.pass_id) n_opponents FROM syn_snapshots s WHERE completed = 1")
def _(s):
    d = M.sides(s).where((F.col("completed") == 1) & (F.size("teammates") >= 1) & (F.size("opponents") >= 1))
    return d.select("pass_id", F.size("teammates").alias("n_teammates"), F.size("opponents").alias("n_opponents"))


@query("j14_nearest_target", "syn_snapshots", f"WITH {EX}, {TARGET} SELECT pass_id, R[target_x]R target_x, R[target_y]R target_y, R[target_match_dist]R target_match_dist FROM pas")
def _(s):
    return prepared(s).select("pass_id", "target_x", "target_y", "target_match_dist")


@query("g10_target_match", "syn_snapshots", f"WITH {EX}, {TARGET} SELECT team, R[avg(target_match_dist)]R mean_dist, count(*) FILTER (target_match_dist <= 6) matched FROM pas GROUP BY team")
def _(s):
    return prepared(s).groupBy("team").agg(F.avg("target_match_dist").alias("mean_dist"), F.count_if(F.col("target_match_dist") <= 6).alias("matched"))


@query("p11_match_distance_filter", "syn_snapshots", f"WITH {EX}, {TARGET} SELECT pass_id, completed FROM pas WHERE target_match_dist <= 6")
def _(s):
    return prepared(s).where("target_match_dist <= 6D").select("pass_id", "completed")


@query("a35_class_retention", "syn_snapshots", f"WITH {EX}, {TARGET} SELECT completed, R[avg(CASE WHEN target_match_dist <= 6 THEN 1.0::DOUBLE ELSE 0 END)]R retained FROM pas GROUP BY completed")
def _(s):
    return prepared(s).groupBy("completed").agg(F.avg((F.col("target_match_dist") <= 6).cast("double")).alias("retained"))


@query("j15_pressure", "syn_snapshots", f"WITH {EX}, {TARGET} SELECT pass_id, R[pressure_m]R pressure_m FROM press")
def _(s):
    return M.sides(s).select("pass_id", M.pressure(F.col("opponents"), F.col("start_x"), F.col("start_y")).alias("pressure_m"))


@query("g02_control_at_target", "syn_snapshots", f"WITH {FEATS} SELECT pass_id, R[control_target]R control FROM feats")
def _(s):
    d = prepared(s)
    return d.select("pass_id", S.control(F.col("teammates"), F.col("opponents"), F.col("target_x"), F.col("target_y")).alias("control"))


@query("g01_time_to_intercept", "syn_snapshots", f"WITH {EX} SELECT s.pass_id, R[min(0.7 + sqrt((s.end_x - a.x) ** 2 + (s.end_y - a.y) ** 2) / 5.0)]R t FROM syn_snapshots s JOIN att a USING (pass_id) GROUP BY 1")
def _(s):
    return M.sides(s).select("pass_id", S.nearest_time(F.col("teammates"), F.col("end_x"), F.col("end_y"), S.ControlParams()).alias("t"))


@query("g05_control_grid", "syn_snapshots")
def _(s):
    """The operator's own grid (50 x 34) for every snapshot, 1700 rows of each. Snapshots are not shuffled: their frames are
    much wider than the rows that they are made of, which `table` deals over the cores."""
    return M.control_grid(M.sides(s).select("pass_id", "teammates", "opponents")).select("pass_id", "ix", "iy", "control")


@query("j18_player_grid", "syn_snapshots", f"""WITH {EX}, g AS (SELECT x.ix, y.iy, (x.ix + 0.5) * 105.0 / 12 - 52.5 gx, (y.iy + 0.5) * 68.0 / 8 - 34 gy FROM range(12) x(ix), range(8) y(iy)),
  ta AS (SELECT pass_id, ix, iy, min(0.7 + sqrt((gx - x) ** 2 + (gy - y) ** 2) / 5.0) t FROM att, g GROUP BY ALL), td AS (SELECT pass_id, ix, iy, min(0.7 + sqrt((gx - x) ** 2 + (gy - y) ** 2) / 5.0) t FROM opp, g GROUP BY ALL)
  SELECT ix, iy, R[avg(ta.t)]R attackers, R[avg(td.t)]R defenders, count(*) FILTER (ta.t < td.t) led FROM ta JOIN td USING (pass_id, ix, iy) GROUP BY ALL""")
def _(s):
    """Every player against every cell of the pitch, in all snapshots: how soon either side is there, and how often first."""
    return M.player_grid(M.sides(s))


CANDIDATES = """ang AS (SELECT s.pass_id, a.k, a.x, a.y, degrees(acos(least(1.0, greatest(-1.0, ((a.x - start_x) / sqrt((a.x - start_x) ** 2 + (a.y - start_y) ** 2)) * ((end_x - start_x) / sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2))
    + ((a.y - start_y) / sqrt((a.x - start_x) ** 2 + (a.y - start_y) ** 2)) * ((end_y - start_y) / sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2)))))) angle FROM syn_snapshots s JOIN att a USING (pass_id)
    WHERE sqrt((a.x - start_x) ** 2 + (a.y - start_y) ** 2) >= 1e-6 AND sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2) >= 1e-6),
  rec AS (SELECT pass_id, arg_min({'k': k, 'angle': angle}, {'a': angle, 'k': k}) b FROM ang GROUP BY 1)"""


def candidates(s):
    d = s.select("pass_id", F.col("start_x").alias("sx"), F.col("start_y").alias("sy"), F.col("end_x").alias("ex"), F.col("end_y").alias("ey"), F.explode("frame").alias("p")).where("p.teammate and not p.actor")
    return d.select("pass_id", F.col("p.k").alias("id"), F.col("p.k").alias("ord"), "p.x", "p.y", "sx", "sy", "ex", "ey")


@query("g04_intended_receiver", "syn_snapshots", f"WITH {EX}, {CANDIDATES} SELECT pass_id, b.k receiver, R[b.angle]R angle FROM rec WHERE b.angle <= 40")
def _(s):
    return M.receiver_in_frame(s).where("receiver is not null").select("pass_id", "receiver", "angle")


@query("j16_bearing_argmin", "syn_snapshots", f"WITH {EX}, {CANDIDATES} SELECT pass_id, b.k receiver, R[b.angle]R angle FROM rec WHERE b.angle <= 40")
def _(s):
    """The same as a join of passes and candidates, for candidates that are rows of a table."""
    return M.intended_receiver(candidates(s), "pass_id")


@query("a32_receiver_accuracy", "syn_snapshots", f"""WITH {EX}, {TARGET}, {CANDIDATES}, truth AS (SELECT s.pass_id, arg_min(a.k, {{'d': sqrt((a.x - s.end_x) ** 2 + (a.y - s.end_y) ** 2), 'k': a.k}}) k FROM syn_snapshots s JOIN att a USING (pass_id) WHERE completed = 1 GROUP BY 1)
    SELECT count(*) n_total, count(*) FILTER (b.angle <= 40) n_resolved, R[count(*) FILTER (b.angle <= 40) * 1.0::DOUBLE / count(*)]R resolve_rate, R[count(*) FILTER (b.angle <= 40 AND b.k = t.k) * 1.0::DOUBLE / count(*) FILTER (b.angle <= 40)]R accuracy
    FROM truth t LEFT JOIN rec r USING (pass_id)""")
def _(s):
    """How often the bearing finds the receiver of completed passes, where the nearest teammate is the truth."""
    d = M.receiver_in_frame(M.sides(s).where("completed = 1")).withColumn("i", S.nearest(F.col("teammates"), F.col("end_x"), F.col("end_y"))["i"]).withColumn("ok", F.col("receiver") == F.col("i") * 2 + 3)
    n, r = F.count("*"), F.count("receiver")
    return d.agg(n.alias("n_total"), r.alias("n_resolved"), (r / n).alias("resolve_rate"), F.try_divide(F.count_if("ok"), r).alias("accuracy"))


@query("g08_candidates", "syn_snapshots", f"WITH {EX} SELECT pass_id, count(*) n FROM att GROUP BY 1")
def _(s):
    return candidates(s).groupBy("pass_id").agg(F.count("*").alias("n"))


@query("g09_choice_range", "syn_snapshots", f"""WITH {EX}, {CANDIDATES} SELECT pass_id, count(*) n FROM (SELECT a.pass_id FROM att a JOIN syn_snapshots s USING (pass_id) JOIN rec r USING (pass_id)
    WHERE r.b.angle <= 40 AND (sqrt((a.x - start_x) ** 2 + (a.y - start_y) ** 2) <= 40 OR a.k = r.b.k)) GROUP BY 1""")
def _(s):
    c = candidates(s)
    return M.choice_set(c.join(M.receiver_in_frame(s).where("receiver is not null").select("pass_id", "receiver"), "pass_id"), 40.0).groupBy("pass_id").agg(F.count("*").alias("n"))


@query("c06_completion_features", "syn_snapshots", f"WITH {FEATS} SELECT pass_id, match_id, team, passer, completed, R[target_match_dist]R target_match_dist, R[control_target]R control_target, R[distance_m]R distance_m, R[forward_m]R forward_m, R[pressure_m]R pressure_m FROM feats")
def _(s):
    return P.completion_features(prepared(s))


@query("c01_attempt_features", "syn_snapshots", f"""WITH {EX}, {TARGET}, {CANDIDATES}, pts AS (SELECT pass_id, k target_id, x tx, y ty FROM att JOIN rec USING (pass_id) WHERE rec.b.k = att.k AND rec.b.angle <= 40), ctl AS {control_sql("pts", "pass_id")}
    SELECT pts.pass_id, target_id, R[control]R control_target, R[sqrt((tx - start_x) ** 2 + (ty - start_y) ** 2)]R distance_m, R[tx - start_x]R forward_m, R[pressure_m]R pressure_m
    FROM pts JOIN ctl USING (pass_id) JOIN press USING (pass_id) JOIN syn_snapshots s USING (pass_id)""")
def _(s):
    """Features at the start-frame place of the receiver that the bearing points to."""
    d = M.receiver_in_frame(M.sides(s)).where("receiver is not null")
    p = F.element_at(F.filter("frame", lambda p: p["k"] == F.col("receiver")), 1)
    d = d.withColumn("tx", p["x"]).withColumn("ty", p["y"])
    return d.select("pass_id", F.col("receiver").alias("target_id"), S.control(F.col("teammates"), F.col("opponents"), F.col("tx"), F.col("ty")).alias("control_target"), S.distance(F.col("tx"), F.col("ty"), F.col("start_x"), F.col("start_y")).alias("distance_m"), (F.col("tx") - F.col("start_x")).alias("forward_m"), M.pressure(F.col("opponents"), F.col("start_x"), F.col("start_y")).alias("pressure_m"))


@query("a17_reliability", "syn_snapshots", f"""WITH {FEATS}, pr AS (SELECT completed y, {PSQL} p FROM feats), b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) bin, count(*) n, avg(p) mp, avg(y) my FROM pr GROUP BY 1)
    SELECT bin, n, R[mp]R mean_predicted, R[my]R mean_observed, n >= 30 counts, R[abs(mp - my)]R gap FROM b""")
def _(s):
    return reliability(P.completion_features(prepared(s)).withColumn("p", MODEL({k: F.col(k) for k in P.FEATURES})), "completed", "p")


@query("a18_brier", "syn_snapshots", f"WITH {FEATS}, pr AS (SELECT completed y, {PSQL} p, avg(completed) OVER () base FROM feats) SELECT R[avg((p - y) ** 2)]R brier, R[avg((base - y) ** 2)]R baseline FROM pr")
def _(s):
    d = P.completion_features(prepared(s)).withColumn("p", MODEL({k: F.col(k) for k in P.FEATURES}))
    y = F.col("completed")
    return d.agg(F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"), F.var_pop(y).alias("baseline"))


@query("m13_calibration_gate", "syn_snapshots", f"""WITH {FEATS}, pr AS (SELECT completed y, {PSQL} p FROM feats), b AS (SELECT least(floor(p * 10), 9) bin, count(*) n, abs(avg(p) - avg(y)) gap FROM pr GROUP BY 1)
    SELECT R[max(gap) FILTER (n >= 30)]R worst_gap, max(gap) FILTER (n >= 30) <= 0.10 passed FROM b""")
def _(s):
    r = reliability(P.completion_features(prepared(s)).withColumn("p", MODEL({k: F.col(k) for k in P.FEATURES})), "completed", "p")
    return r.where("counts").agg(F.max("gap").alias("worst_gap")).withColumn("passed", F.col("worst_gap") <= 0.10)


XTS = XT.replace("WITH RECURSIVE", "WITH RECURSIVE " + EX + ", " + TARGET + ",")
VALUED = f"""{XTS}, opt AS (SELECT pass_id, k ord, x tx, y ty, false chosen FROM att UNION ALL SELECT pass_id, 99, target_x, target_y, true FROM pas), pts AS (SELECT pass_id, ord, tx, ty FROM opt), ctl AS {control_sql("pts", "pass_id, ord")},
  ft AS (SELECT o.*, c.control control_target, sqrt((tx - start_x) ** 2 + (ty - start_y) ** 2) distance_m, tx - start_x forward_m, pr.pressure_m FROM opt o JOIN ctl c USING (pass_id, ord) JOIN press pr USING (pass_id) JOIN pas USING (pass_id)),
  vl AS (SELECT ft.*, {PSQL} p, a.xt v_receive, -b.xt v_turnover FROM ft JOIN xt a ON a.zone = {Z("0.5 - ty / 68.0", 8)} * 12 + {Z("tx / 105.0 + 0.5", 12)} JOIN xt b ON b.zone = {Z("1 - (0.5 - ty / 68.0)", 8)} * 12 + {Z("1 - (tx / 105.0 + 0.5)", 12)}),
  ev AS (SELECT *, p * v_receive + (1 - p) * v_turnover ev FROM vl), ag AS (SELECT pass_id, count(*) n, avg(ev) m, max(ev) mx, stddev_pop(ev) sd, max(ev) FILTER (chosen) c, max(p) FILTER (chosen) pc FROM ev GROUP BY 1),
  cpv AS (SELECT ag.*, (SELECT count(*) FROM ev e WHERE e.pass_id = ag.pass_id AND e.ev < ag.c) below FROM ag)"""


#: The same with the empirical cost of a loss at the option's own place.
EMPIRICAL = VALUED.replace("-b.xt v_turnover", "-sv.value v_turnover").replace(f"""JOIN xt b ON b.zone = {Z("1 - (0.5 - ty / 68.0)", 8)} * 12 + {Z("1 - (tx / 105.0 + 0.5)", 12)}""", f"""JOIN surf sv ON sv.zone = {Z("0.5 - ty / 68.0", 8)} * 12 + {Z("tx / 105.0 + 0.5", 12)}""").replace("WITH RECURSIVE", f"WITH RECURSIVE {SURFACE},", 1)


def valued(p, s):
    return P.expected_values(P.choices(prepared(s)), T.surface(p), MODEL)


def rated(p, s):
    return P.passing_value_in_place(prepared(s), T.surface(p), MODEL)


@query("c07_cpv_fixed_model", "syn_passes syn_snapshots", f"""{VALUED} SELECT pas.pass_id, pas.team, pas.passer, n n_candidates, R[c]R ev_chosen, R[m]R ev_mean, R[mx]R ev_max, R[sd]R ev_spread, R[pc]R p_complete_chosen, R[c - m]R cpv_avg, R[c - mx]R cpv_max,
    R[(c - m) / greatest(sd, 1e-4)]R cpv_z FROM cpv JOIN pas USING (pass_id)""")
def _(p, s):
    return rated(p, s).select("pass_id", "team", "passer", F.col("n_candidates").cast("long").alias("n_candidates"), "ev_chosen", "ev_mean", "ev_max", "ev_spread", "p_complete_chosen", "cpv_avg", "cpv_max", "cpv_z")


@query("c07_cpv_empirical_turnover", "syn_passes syn_snapshots syn_log", f"""{EMPIRICAL} SELECT pas.pass_id, R[c]R ev_chosen, R[m]R ev_mean, R[mx]R ev_max, R[c - m]R cpv_avg, R[c - mx]R cpv_max FROM cpv JOIN pas USING (pass_id)""")
def _(p, s, log):
    """Losses are charged what was conceded after losses in the zone."""
    return P.passing_value_in_place(prepared(s), T.surface(p), MODEL, P.turnover_surface(log)).select("pass_id", "ev_chosen", "ev_mean", "ev_max", "cpv_avg", "cpv_max")


@query("c07_cpv_fitted", "syn_passes syn_snapshots syn_log")
def _(p, s, log):
    """The season's value: the completion model that calibrates best out of fold, fitted to the passes whose target is
    matched, scores every option of all passes; losses by the empirical surface."""
    from touchline.operators import models

    rows = prepared(s)
    model, _ = models.completion_model(P.completion_features(rows.where("target_match_dist <= 6D")), "match_id", P.FEATURES, "completed", ["pass_id"])
    return P.passing_value_in_place(rows, T.surface(p), model, P.turnover_surface(log))


@query("a19_choice_aggregates", "syn_passes syn_snapshots", f"{VALUED} SELECT team, R[avg(c - m)]R cpv_avg, R[avg(c - mx)]R cpv_max, R[avg(sd)]R spread, count(*) n FROM cpv JOIN pas USING (pass_id) GROUP BY team")
def _(p, s):
    return rated(p, s).groupBy("team").agg(F.avg("cpv_avg").alias("cpv_avg"), F.avg("cpv_max").alias("cpv_max"), F.avg("ev_spread").alias("spread"), F.count("*").alias("n"))


@query("a20_choice_baselines", "syn_passes syn_snapshots", f"{VALUED}, b AS (SELECT pass_id, avg(ev) a, max(ev) x, count(*) n FROM ev WHERE NOT chosen GROUP BY 1) SELECT pass_id, n n_candidates, R[a]R ev_baseline_avg, R[x]R ev_baseline_max FROM b")
def _(p, s):
    """Baselines over distinct candidates, without the second copy of the chosen one."""
    return valued(p, s).where("not chosen").groupBy("pass_id").agg(F.count("*").alias("n_candidates"), F.avg("ev").alias("ev_baseline_avg"), F.max("ev").alias("ev_baseline_max"))


@query("w05_choice_rank", "syn_passes syn_snapshots", f"{VALUED} SELECT pass_id, R[(SELECT count(*) FROM ev e WHERE e.pass_id = ag.pass_id AND round(e.ev, 9) < round(ag.c, 9)) * 1.0::DOUBLE / greatest(n - 1, 1)]R cpv_rank FROM ag")
def _(p, s):
    """Rank of the chosen option; options whose values agree to nine places are equal."""
    c = F.max(F.when(F.col("chosen"), F.round("ev", 9))).over(Window.partitionBy("pass_id"))
    d = valued(p, s).withColumn("c", c).groupBy("pass_id").agg(F.count_if(F.round("ev", 9) < F.col("c")).alias("below"), F.count("*").alias("n"))
    return d.select("pass_id", (F.col("below") / F.greatest(F.col("n") - 1, F.lit(1))).alias("cpv_rank"))


@query("c02_candidates", "syn_passes syn_snapshots", f"{VALUED} SELECT pass_id, row_number() OVER (PARTITION BY pass_id ORDER BY ord) - 1 ord, chosen, R[control_target]R control_target, R[p]R p, R[v_receive]R v_receive, R[v_turnover]R v_turnover, R[ev]R ev FROM ev")
def _(p, s):
    """Every option of every pass, with what its value is made of."""
    return valued(p, s).select("pass_id", F.col("ord").cast("long").alias("ord"), "chosen", "control_target", "p", "v_receive", "v_turnover", "ev")


@query("w09_chosen_candidate", "syn_passes syn_snapshots", f"{VALUED} SELECT pass_id, min(row_number) ord FROM (SELECT o.pass_id, row_number() OVER (PARTITION BY o.pass_id ORDER BY o.ord) - 1 row_number, o.tx, o.ty FROM opt o) q JOIN pas USING (pass_id) WHERE tx = target_x AND ty = target_y GROUP BY pass_id")
def _(p, s):
    """The first option that stands where the target is: the receiver's own, before the copy that is added."""
    d = P.choices(prepared(s)).where("cx = target_x and cy = target_y")
    return d.groupBy("pass_id").agg(F.min("ord").cast("long").alias("ord"))


ZONED = f"""{VALUED}, zv AS (SELECT {Z("0.5 - start_y / 68.0", 8)} * 12 + {Z("start_x / 105.0 + 0.5", 12)} zone, c - m cpv_avg, c - mx cpv_max, (c - m) / greatest(sd, 1e-4) cpv_z FROM cpv JOIN pas USING (pass_id)),
  zl AS (SELECT zone, 'cpv_avg' metric, cpv_avg v FROM zv UNION ALL SELECT zone, 'cpv_max', cpv_max FROM zv UNION ALL SELECT zone, 'cpv_z', cpv_z FROM zv), zm AS (SELECT metric, zone, count(*) n, CASE WHEN count(*) >= 25 THEN avg(v) END mean FROM zl GROUP BY ALL)"""


def zoned(p, s):
    """metric, zone, v of each pass and each way to value it."""
    x, y = S.metric_to_season(F.col("start_x"), F.col("start_y"))
    d = rated(p, s).select((S.zone(y, 8) * 12 + S.zone(x, 12)).alias("zone"), F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in ("cpv_avg", "cpv_max", "cpv_z")))).alias("m"))
    return d.select("zone", "m.*")


@query("v01_zone_means", "syn_passes syn_snapshots", f"{ZONED} SELECT metric, zone, n, R[mean]R mean FROM zm")
def _(p, s):
    """Mean value by where a pass starts, of zones with 25 passes, for each way to value it."""
    return zoned(p, s).groupBy("metric", "zone").agg(F.count("*").alias("n"), F.when(F.count("*") >= 25, F.avg("v")).alias("mean"))


@query("v01_zone_dependence", "syn_passes syn_snapshots", f"{ZONED} SELECT metric, R[(SELECT stddev_pop(mean) FROM zm WHERE zm.metric = zl.metric) / (stddev_samp(v) + 1e-12)]R spread FROM zl GROUP BY metric")
def _(p, s):
    """How much of a metric's deviation the zones' means have: the less, the less a value tells where its passes were."""
    d = zoned(p, s)
    means = d.groupBy("metric", "zone").agg(F.when(F.count("*") >= 25, F.avg("v")).alias("mean")).groupBy("metric").agg(F.stddev_pop("mean").alias("between"))
    return d.groupBy("metric").agg(F.stddev_samp("v").alias("all")).join(means, "metric").select("metric", (F.col("between") / (F.col("all") + 1e-12)).alias("spread"))


@query("w04_choice_z", "syn_passes syn_snapshots", f"{VALUED} SELECT pass_id, R[(c - m) / greatest(sd, 1e-4)]R cpv_z FROM cpv")
def _(p, s):
    return rated(p, s).select("pass_id", "cpv_z")


@query("c02_pass_evaluation", "syn_passes syn_snapshots", f"{VALUED} SELECT pass_id, R[sum(p)]R sum_p, R[sum(ev)]R sum_ev, R[min(v_turnover)]R worst_loss FROM ev GROUP BY 1")
def _(p, s):
    return valued(p, s).groupBy("pass_id").agg(F.sum("p").alias("sum_p"), F.sum("ev").alias("sum_ev"), F.min("v_turnover").alias("worst_loss"))


@query("c03_execution_quality", "syn_passes syn_snapshots", f"""{VALUED} SELECT pas.pass_id, R[CASE WHEN completed = 1 THEN a.xt ELSE -b.xt END - c]R execution_quality FROM cpv JOIN pas USING (pass_id)
    JOIN xt a ON a.zone = {Z("0.5 - end_y / 68.0", 8)} * 12 + {Z("end_x / 105.0 + 0.5", 12)} JOIN xt b ON b.zone = {Z("1 - (0.5 - end_y / 68.0)", 8)} * 12 + {Z("1 - (end_x / 105.0 + 0.5)", 12)}""")
def _(p, s):
    """What the pass returned at its actual end, less the chosen option's expected value."""
    xt, end = T.surface(p), S.metric_to_season(F.col("end_x"), F.col("end_y"))
    d = T.lookup(T.lookup(s, xt, *end, "good"), xt, *end, "bad", opponents=True).join(rated(p, s).select("pass_id", "ev_chosen"), "pass_id")
    return d.select("pass_id", (F.when(F.col("completed") == 1, F.col("good")).otherwise(F.col("bad")) - F.col("ev_chosen")).alias("execution_quality"))


@query("a10_quality_by_passer", "syn_passes syn_snapshots", f"{VALUED} SELECT team, passer, count(*) n, R[avg((c - m) / greatest(sd, 1e-4))]R quality FROM cpv JOIN pas USING (pass_id) GROUP BY ALL HAVING count(*) >= 10")
def _(p, s):
    return rated(p, s).groupBy("team", "passer").agg(F.count("*").alias("n"), F.avg("cpv_z").alias("quality")).where("n >= 10")


@query("a12_rounded_class_means", "syn_passes syn_snapshots", f"{VALUED} SELECT completed, round(avg(c), 5) ev_chosen, round(avg(c - m), 5) cpv_avg FROM cpv JOIN pas USING (pass_id) GROUP BY completed")
def _(p, s):
    return rated(p, s).groupBy("completed").agg(F.round(F.avg("ev_chosen"), 5).alias("ev_chosen"), F.round(F.avg("cpv_avg"), 5).alias("cpv_avg"))


@query("c10_reception", "syn_passes syn_snapshots", f"""{XTS}, pts AS (SELECT pass_id, target_x tx, target_y ty FROM pas WHERE completed = 1 AND target_match_dist <= 6), ctl AS {control_sql("pts", "pass_id")}
    SELECT pass_id, scored, R[xt.xt]R zone_xt, R[control]R control_target FROM ctl JOIN pas USING (pass_id) JOIN xt ON xt.zone = {Z("0.5 - target_y / 68.0", 8)} * 12 + {Z("target_x / 105.0 + 0.5", 12)}""")
def _(p, s):
    return P.reception(prepared(s), T.surface(p))


@query("v03_widest_choice", "syn_passes syn_snapshots", f"{VALUED} SELECT pass_id, R[sd]R ev_spread FROM cpv JOIN pas USING (pass_id) WHERE n >= 8 AND start_x BETWEEN -10 AND 20 ORDER BY round(sd, 9) DESC, pass_id LIMIT 1")
def _(p, s):
    d = rated(p, s).where((F.col("n_candidates") >= 8) & F.col("start_x").between(-10, 20))
    return d.orderBy(F.round("ev_spread", 9).desc(), "pass_id").limit(1).select("pass_id", "ev_spread")


@query("v07_eye_test", "syn_passes syn_snapshots", f"""{VALUED}, k AS (SELECT pass_id, round(c - m, 9) v FROM cpv WHERE n >= 4), u AS ((SELECT pass_id, v, 'top' side FROM k ORDER BY v DESC, pass_id LIMIT 5) UNION ALL (SELECT pass_id, v, 'bottom' FROM k ORDER BY v, pass_id LIMIT 5))
    SELECT pass_id, R[v]R cpv_avg, side FROM u""")
def _(p, s):
    d = rated(p, s).where("n_candidates >= 4").select("pass_id", F.round("cpv_avg", 9).alias("cpv_avg"))
    return d.orderBy(F.desc("cpv_avg"), "pass_id").limit(5).withColumn("side", F.lit("top")).union(d.orderBy("cpv_avg", "pass_id").limit(5).withColumn("side", F.lit("bottom")))


# --- tracking ---
STEP = "st AS (SELECT *, x - lag(x) OVER (PARTITION BY player_id, period ORDER BY frame) dx FROM syn_tracking)"
VEL = f"""{STEP}, sm AS (SELECT *, avg(dx) OVER (PARTITION BY player_id, period ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 0.04 v FROM st)"""


@query("w01_smoothed_velocity", "syn_tracking", f"WITH {VEL} SELECT player_id, period, frame, R[CASE WHEN v IS NULL THEN NULL ELSE least(12.0, greatest(-12.0, v)) END]R vx FROM sm")
def _(t):
    return M.velocities(t, ["player_id", "period"], ["x"]).select("player_id", "period", "frame", "vx")


@query("w02_frame_step", "syn_tracking", "WITH d AS (SELECT frame * 0.04 - lag(frame * 0.04) OVER (PARTITION BY player_id ORDER BY frame) d FROM syn_tracking) SELECT R[median(d)]R dt FROM d")
def _(t):
    return M.frame_step(t.select(F.col("player_id").alias("game_id"), "frame", (F.col("frame") * 0.04).alias("t")))


@query("g03_control_moving", "syn_snapshots", f"""WITH {EX}, mv AS (SELECT pass_id, f.k k, f.teammate tm, f.actor ac, f.x + ((f.k * 7) % 11 - 5) * 0.7 x, f.y + CASE WHEN f.k % 3 = 0 THEN 0 ELSE ((f.k * 5) % 7 - 3) * 0.7 END y, end_x, end_y FROM ex)
    SELECT pass_id, R[1.0 / (1 + exp(-(min(sqrt((end_x - x) ** 2 + (end_y - y) ** 2)) FILTER (NOT tm) - min(sqrt((end_x - x) ** 2 + (end_y - y) ** 2)) FILTER (tm)) / 5.0 / 0.45))]R control FROM mv GROUP BY 1""")
def _(s):
    """With velocities; every third player has none in y and counts as standing."""
    p = lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), ((q["k"] * 7) % 11 - 5).cast("double").alias("vx"), F.when(q["k"] % 3 != 0, ((q["k"] * 5) % 7 - 3).cast("double")).alias("vy"))
    att, opp = F.transform(F.filter("frame", lambda q: q["teammate"]), p), F.transform(F.filter("frame", lambda q: ~q["teammate"]), p)
    return s.select("pass_id", S.control(att, opp, F.col("end_x"), F.col("end_y"), moving=True).alias("control"))


@query("j01_frames_of_both_sides", "syn_tracking", "SELECT frame, player_id, R[x]R x FROM syn_tracking WHERE frame IN (SELECT frame FROM syn_tracking WHERE player_id % 2 = 0 AND frame % 3 <> 0) AND period = 1")
def _(t):
    """Frames that both files have, as a semi-join in long form."""
    there = t.where("player_id % 2 = 0 and frame % 3 <> 0").select("frame")
    return t.where("period = 1").join(there, "frame", "left_semi").select("frame", "player_id", "x")


@query("j02_events_at_frames", "syn_attempts syn_tracking", "SELECT a.seq, a.type, R[t.x]R x FROM syn_attempts a JOIN syn_tracking t ON t.frame = a.seq AND t.period = a.period WHERE a.type = 'PASS'")
def _(e, t):
    return e.where("type = 'PASS'").join(t.withColumnRenamed("frame", "seq"), ["seq", "period"]).select("seq", "type", "x")


# --- tracked attempts ---
def tracked_sql(failed: bool, widest: float | None = None, name: str = "") -> str:
    """CTEs ending in tv{name}: the value of tracked attempts."""
    near = "" if widest is None else f" WHERE sqrt((a.x - s.start_x) ** 2 + (a.y - s.start_y) ** 2) <= {widest} OR a.k = ch{name}.k"
    more = " UNION ALL SELECT pass_id, b.k FROM rec JOIN syn_snapshots USING (pass_id) WHERE completed = 0 AND b.angle <= 40" if failed else ""
    return f"""ch{name} AS (SELECT pass_id, k FROM truth{more}), opt{name} AS (SELECT a.pass_id, a.k ord, a.x tx, a.y ty, a.k = ch{name}.k chosen FROM att a JOIN ch{name} USING (pass_id) JOIN syn_snapshots s USING (pass_id){near}),
  pts{name} AS (SELECT pass_id, ord, tx, ty FROM opt{name}), ctl{name} AS {control_sql(f"pts{name}", "pass_id, ord")},
  ft{name} AS (SELECT o.*, c.control control_target, sqrt((tx - start_x) ** 2 + (ty - start_y) ** 2) distance_m, tx - start_x forward_m, pr.pressure_m FROM opt{name} o JOIN ctl{name} c USING (pass_id, ord) JOIN press pr USING (pass_id) JOIN pas USING (pass_id)),
  ev{name} AS (SELECT ft{name}.*, {PSQL} p, p * a.xt + (1 - p) * -b.xt ev FROM ft{name} JOIN xt a ON a.zone = {Z("0.5 - ty / 68.0", 8)} * 12 + {Z("tx / 105.0 + 0.5", 12)} JOIN xt b ON b.zone = {Z("1 - (0.5 - ty / 68.0)", 8)} * 12 + {Z("1 - (tx / 105.0 + 0.5)", 12)}),
  tv{name} AS (SELECT pass_id, count(*) n, avg(ev) m, max(ev) mx, max(ev) FILTER (chosen) c, max(ord) FILTER (chosen) k FROM ev{name} GROUP BY 1)"""


TRACKED = f"""{XTS}, {CANDIDATES}, truth AS (SELECT s.pass_id, arg_min(a.k, {{'d': sqrt((a.x - s.end_x) ** 2 + (a.y - s.end_y) ** 2), 'k': a.k}}) k FROM syn_snapshots s JOIN att a USING (pass_id) WHERE completed = 1 GROUP BY 1)"""
TABLE = f"""SELECT pas.pass_id, pas.team, pas.passer from_player, tv.k to_player, completed, R[c]R ev_chosen, R[mx]R ev_baseline_max, R[m]R ev_baseline_avg, R[c - mx]R cpv_max, R[c - m]R cpv_avg, R[CASE WHEN completed = 1 THEN a.xt ELSE -b.xt END - c]R execution_quality, n n_candidates
    FROM tv JOIN pas USING (pass_id) JOIN xt a ON a.zone = {Z("0.5 - end_y / 68.0", 8)} * 12 + {Z("end_x / 105.0 + 0.5", 12)} JOIN xt b ON b.zone = {Z("1 - (0.5 - end_y / 68.0)", 8)} * 12 + {Z("1 - (end_x / 105.0 + 0.5)", 12)}"""


def attempts(s):
    """Snapshots as tracked attempts: the teammate nearest to a completed pass's end is its recorded receiver."""
    d = M.sides(s)
    return d.withColumn("receiver", F.when(F.col("completed") == 1, S.nearest(F.col("teammates"), F.col("end_x"), F.col("end_y"))["i"] * 2 + 3))


@query("c03_cpv_table", "syn_passes syn_snapshots", f"{TRACKED}, {tracked_sql(False)} {TABLE}")
def _(p, s):
    """The tracked passes' value table: completed passes alone, unless failed ones are asked for."""
    return P.tracked_value(attempts(s), T.surface(p), MODEL)


@query("c03_cpv_table_with_failed", "syn_passes syn_snapshots", f"{TRACKED}, {tracked_sql(True)} {TABLE}")
def _(p, s):
    return P.tracked_value(attempts(s), T.surface(p), MODEL, include_failed=True)


# --- does a choice of the method change who ranks well ---
def by_player(sql: str, value: str, where: str = "true", least: int = 5) -> str:
    return f"(SELECT team, passer, round(avg({value}), 9) v, count(*) n FROM {sql} JOIN pas USING (pass_id) WHERE {where} GROUP BY ALL HAVING count(*) >= {least})"


RHO = "(SELECT corr(a, b) FROM (SELECT rank() OVER (ORDER BY x.v) + (count(*) OVER (PARTITION BY x.v) - 1) / 2.0::DOUBLE a, rank() OVER (ORDER BY y.v) + (count(*) OVER (PARTITION BY y.v) - 1) / 2.0::DOUBLE b FROM {x} x JOIN {y} y USING (team, passer)))"
THRESHOLDS = [4.0, 6.0, 8.0, 12.0, 1e9]


def player_means(d, value, by, least=5):
    """Mean of each player with so many passes, rounded so that equal means are equal."""
    return d.groupBy(*by).agg(F.round(F.avg(value), 9).alias("v"), F.count("*").alias("n")).where(F.col("n") >= least).drop("n")


def stability(x, y, by):
    """Rank correlation of two rankings over the players of both."""
    both = x.withColumnRenamed("v", "x").join(y.withColumnRenamed("v", "y"), by)
    return rank_correlation(both, "x", "y")


@query("m14_match_distance_sensitivity", "syn_passes syn_snapshots", f"{VALUED}, cv AS (SELECT pass_id, c - m v FROM cpv) " + " UNION ALL ".join(f"SELECT {t}::DOUBLE threshold, (SELECT count(*) FROM cpv JOIN pas USING (pass_id) WHERE target_match_dist <= {t}) n_passes, (SELECT count(*) FROM {by_player('cv', 'v', f'target_match_dist <= {t}')}) n_players, R[{RHO.format(x=by_player('cv', 'v', 'target_match_dist <= 6.0'), y=by_player('cv', 'v', f'target_match_dist <= {t}'))}]R rho" for t in THRESHOLDS))
def _(p, s):
    """How many passes and players stay under each limit of the target's distance, and whether they rank as under 6 m."""
    by = ["team", "passer"]
    d = kept(rated(p, s).select(*by, "target_match_dist", "cpv_avg"), "rated")
    at = lambda t: player_means(d.where(F.col("target_match_dist") <= t), "cpv_avg", by)
    rows = [(t, d.where(F.col("target_match_dist") <= t).count(), at(t).count(), stability(at(6.0), at(t), by).first().rho) for t in THRESHOLDS]
    return s.sparkSession.createDataFrame(rows, "threshold double, n_passes long, n_players long, rho double")


@query("m14_baseline_and_width_stability", "syn_passes syn_snapshots", f"""{TRACKED}, {tracked_sql(False)}, {tracked_sql(False, 40.0, "w")}, r AS (SELECT {RHO.format(x=by_player("(SELECT pass_id, c - mx v FROM tv)", "v"), y=by_player("(SELECT pass_id, c - m v FROM tv)", "v"))} rb,
    {RHO.format(x=by_player("(SELECT pass_id, c - mx v FROM tv)", "v"), y=by_player("(SELECT pass_id, c - mx v FROM tvw)", "v"))} rw) SELECT R[rb]R rho_baseline, R[rw]R rho_width, rb >= 0.7 AND rw >= 0.7 passed FROM r""")
def _(p, s):
    """Players ranked against the best and against the mean option, and with all options and those within 40 m."""
    xt, by = T.surface(p), ["team", "from_player"]
    wide, narrow = (kept(P.tracked_value(attempts(s), xt, MODEL, widest=w).select(*by, "cpv_max", "cpv_avg"), "tracked") for w in (None, 40.0))
    best = player_means(wide, "cpv_max", by)
    rho = [stability(best, other, by).first().rho for other in (player_means(wide, "cpv_avg", by), player_means(narrow, "cpv_max", by))]
    return s.sparkSession.createDataFrame([(*rho, None not in rho and min(rho) >= 0.7)], "rho_baseline double, rho_width double, passed boolean")


# --- provider files: a season is written from the snapshots, read back and valued ---
CONVERTED = """cs AS (SELECT pass_id, match_id, team, passer, completed, scored, X(start_x) start_x, Y(start_y) start_y, X(end_x) end_x, Y(end_y) end_y,
    list_transform(frame, lambda p: {'k': p.k, 'teammate': p.teammate, 'actor': p.actor, 'x': X(p.x), 'y': Y(p.y)}) frame FROM syn_snapshots)"""
CONVERTED = re.sub(r"X\(([\w.]+)\)", r"(((\1 / 105.0::DOUBLE + 0.5::DOUBLE) * 120.0::DOUBLE) / 120.0::DOUBLE - 0.5::DOUBLE) * 105.0::DOUBLE", CONVERTED)
CONVERTED = re.sub(r"Y\(([\w.]+)\)", r"(0.5::DOUBLE - ((0.5::DOUBLE - \1 / 68.0::DOUBLE) * 80.0::DOUBLE) / 80.0::DOUBLE) * 68.0::DOUBLE", CONVERTED)


def from_files(sql: str) -> str:
    """The same SQL over snapshots whose places went through the files' units."""
    sql = sql.replace("syn_snapshots", "cs")
    return sql.replace("WITH RECURSIVE", f"WITH RECURSIVE {CONVERTED},", 1) if "WITH RECURSIVE" in sql else sql.replace("WITH", f"WITH {CONVERTED},", 1)


def season_files(s, kinds: str = "events frames") -> str:
    """Folder of event and freeze-frame files (or of one kind) of all snapshots: a pass each, and a goal in its possession if it
    led to one."""
    spot = lambda x, y: F.array((x / S.LENGTH + 0.5) * S.EVENT_LENGTH, (S.num(0.5) - y / S.WIDTH) * S.EVENT_WIDTH)
    name = lambda c: F.struct(c.alias("name"))
    team = name(F.col("team").cast("string"))
    at = spot(F.col("start_x"), F.col("start_y"))
    common = [F.lit(1).alias("period"), F.lit(0).alias("minute"), team.alias("team"), F.col("pass_id").alias("possession"), team.alias("possession_team")]
    who = F.struct(F.col("passer").cast("long").alias("id"), F.concat(F.lit("P"), F.col("passer").cast("string")).alias("name")).alias("player")
    detail = F.struct(spot(F.col("end_x"), F.col("end_y")).alias("end_location"), F.when(F.col("completed") == 0, name(F.lit("Incomplete"))).alias("outcome"))
    part = F.floor(F.col("pass_id") / 10_000).alias("part")
    given = F.struct(F.col("pass_id").cast("string").alias("id"), name(F.lit("Pass")).alias("type"), *common, who, at.alias("location"), detail.alias("pass"))
    goal = F.struct(F.concat(F.lit("s"), F.col("pass_id").cast("string")).alias("id"), name(F.lit("Shot")).alias("type"), *common, F.struct(name(F.lit("Goal")).alias("outcome")).alias("shot"))
    order = (F.col("pass_id") * 2).alias("event_seq")
    events = s.select("match_id", part, order, F.to_json(given).alias("event")).union(s.where("scored = 1").select("match_id", part, order + 1, F.to_json(goal)))
    seen = F.transform("frame", lambda p: F.struct(p["teammate"].alias("teammate"), p["actor"].alias("actor"), F.lit(False).alias("keeper"), spot(p["x"], p["y"]).alias("location")))
    frames = s.select("match_id", part, F.to_json(F.struct(F.col("pass_id").cast("string").alias("event_uuid"), seen.alias("freeze_frame"))).alias("frame"))
    folder = f"{shared_dir(s.sparkSession)}/season-{uuid.uuid4().hex}"
    files.write_season(events if "events" in kinds else None, frames if "frames" in kinds else None, folder)
    return folder


def read_back(s):
    table = files.read_season(s.sparkSession, season_files(s))
    return table.withColumn("pass_id", F.col("pass_id").cast("long"))


@query("c05_pass_table", "syn_snapshots", from_files(f"WITH {EX}, {TARGET} SELECT pass_id, match_id, team::VARCHAR team, passer::BIGINT passer_id, completed, scored, 20 n_visible, R[target_x]R target_x, R[target_y]R target_y, R[target_match_dist]R target_match_dist FROM pas"))
def _(s):
    """The pass table of event and frame files."""
    return read_back(s).select("pass_id", "match_id", "team", "passer_id", "completed", "scored", "n_visible", "target_x", "target_y", "target_match_dist")


@query("c05_values_of_files", "syn_passes syn_snapshots", from_files(f"{VALUED} SELECT pas.pass_id, n n_candidates, R[c]R ev_chosen, R[c - m]R cpv_avg, R[c - mx]R cpv_max FROM cpv JOIN pas USING (pass_id)"))
def _(p, s):
    """Features, completion and value of passes that come from files."""
    d = P.passing_value_in_place(read_back(s), T.surface(p), MODEL)
    return d.select("pass_id", F.col("n_candidates").cast("long").alias("n_candidates"), "ev_chosen", "cpv_avg", "cpv_max")


@query("c05_receptions_of_files", "syn_passes syn_snapshots", from_files(f"""{XTS}, pts AS (SELECT pass_id, target_x tx, target_y ty FROM pas WHERE completed = 1 AND target_match_dist <= 6), ctl AS {control_sql("pts", "pass_id")}
    SELECT pass_id, scored, R[xt.xt]R zone_xt, R[control]R control_target FROM ctl JOIN pas USING (pass_id) JOIN xt ON xt.zone = {Z("0.5 - target_y / 68.0", 8)} * 12 + {Z("target_x / 105.0 + 0.5", 12)}"""))
def _(p, s):
    return P.reception(read_back(s), T.surface(p))


MATCHES = "ml AS (SELECT match_id, '2023-' || lpad((8 + match_id // 9)::VARCHAR, 2, '0') || '-' || lpad((1 + match_id * 11 % 28)::VARCHAR, 2, '0') date, (match_id % 18)::VARCHAR home_team, ((match_id * 7 + 3) % 18)::VARCHAR away_team FROM (SELECT DISTINCT match_id FROM syn_snapshots))"


def matches_of(s):
    """A match list of the snapshots' matches."""
    m = F.col("match_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return s.select("match_id").distinct().select(m.cast("long").alias("match_id"), F.concat(F.lit("2023-"), two(8 + F.floor(m / 9)), F.lit("-"), two(1 + m * 11 % 28)).alias("date"), (m % 18).cast("string").alias("home_team"), ((m * 7 + 3) % 18).cast("string").alias("away_team"))


@query("s16_season_report", "syn_snapshots", f"""WITH {MATCHES}, ch AS (SELECT * FROM ml WHERE '3' IN (home_team, away_team) ORDER BY date, match_id LIMIT 3)
    SELECT ch.match_id::BIGINT match_id, date, count(*) + count(*) FILTER (scored = 1) events, count(*) frames, count(*) passes, 'read' status FROM ch JOIN syn_snapshots s ON s.match_id = ch.match_id GROUP BY ALL""")
def _(s):
    """A team's first matches at home and away, read from files, with a report of each."""
    return files.read_chosen(s.sparkSession, season_files(s), files.season_matches(matches_of(s), "3", 3))[1]


@query("s05_match_list", "syn_snapshots", f"WITH {MATCHES} SELECT match_id::BIGINT match_id, date, home_team, away_team FROM ml")
def _(s):
    """The match list as a JSON file, flattened."""
    team = lambda c, n: F.struct(F.col(c).alias(n))
    raw = matches_of(s).select("match_id", F.col("date").alias("match_date"), team("home_team", "home_team_name").alias("home_team"), team("away_team", "away_team_name").alias("away_team"))
    folder = f"{shared_dir(s.sparkSession)}/matches-{uuid.uuid4().hex}"
    part = F.floor(F.col("match_id") / 1000)  # an array a file, of a thousand matches
    raw.groupBy(part.alias("part")).agg(F.to_json(F.collect_list(F.struct(*raw.columns))).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(folder)
    return files.read_matches(s.sparkSession, folder)


@query("s06_events_of_files", "syn_snapshots", """SELECT pass_id::VARCHAR id, match_id::BIGINT match_id, 'Pass' type, team::VARCHAR team, pass_id possession FROM syn_snapshots
    UNION ALL SELECT 's' || pass_id, match_id, 'Shot', team::VARCHAR, pass_id FROM syn_snapshots WHERE scored = 1""")
def _(s):
    """All events of all matches' files in one scan."""
    e = files.read_events(s.sparkSession, f"{season_files(s, 'events')}/events")
    return e.select("id", "match_id", F.col("type.name").alias("type"), F.col("team.name").alias("team"), "possession")


@query("s07_frames_of_files", "syn_snapshots", "SELECT pass_id::VARCHAR event_uuid, match_id::BIGINT match_id, len(frame)::INT n, len(list_filter(frame, lambda p: p.teammate))::INT mates FROM syn_snapshots")
def _(s):
    """Freeze frames of all matches' files, by event; a missing folder has none."""
    folder = season_files(s, "frames")
    f = files.read_frames(s.sparkSession, f"{folder}/three-sixty").unionByName(files.read_frames(s.sparkSession, f"{folder}/not-there"))
    return f.select("event_uuid", "match_id", F.size("freeze_frame").alias("n"), F.size(F.filter("freeze_frame", lambda p: p["teammate"])).alias("mates"))


@query("s10_season_of_a_team", "syn_snapshots", f"WITH {MATCHES} SELECT match_id::BIGINT match_id, date FROM ml WHERE '3' IN (home_team, away_team) ORDER BY date, match_id")
def _(s):
    """The matches that a team plays at home or away, by date."""
    return files.season_matches(matches_of(s), "3").select("match_id", "date")


@query("j03_passes_of_frames", "syn_snapshots", "SELECT pass_id::VARCHAR id, completed, len(list_filter(frame, lambda p: NOT p.teammate))::INT opponents FROM syn_snapshots")
def _(s):
    """Passes of the event files with the freeze frame of their id."""
    folder = season_files(s)
    e, f = files.read_events(s.sparkSession, f"{folder}/events").where("type.name = 'Pass'"), files.read_frames(s.sparkSession, f"{folder}/three-sixty")
    e = e.select("match_id", "id", F.when(F.col("pass.outcome").isNull(), 1).otherwise(0).alias("completed"))
    f = f.select("match_id", F.col("event_uuid").alias("id"), F.size(F.filter("freeze_frame", lambda p: ~p["teammate"])).alias("opponents"))
    return e.join(f, ["match_id", "id"]).select("id", "completed", "opponents")


@query("s01_tracking_files", "syn_tracking", "SELECT period, frame, player_id::VARCHAR player_id, R[x]R x, R[x / 2]R y FROM syn_tracking WHERE player_id % 3 = 1 UNION ALL SELECT period, frame, player_id::VARCHAR, R[x]R, NULL FROM syn_tracking WHERE player_id % 3 <> 1")
def _(t):
    """Tracking CSVs with their own header rows, each of other players, read in one scan."""
    spark, folder = t.sparkSession, f"{shared_dir(t.sparkSession)}/tracking-{uuid.uuid4().hex}"

    def lines(rows):
        """A file for each task: three header rows, and a line a frame with the players that are in it."""
        import pandas as pd

        rows = pd.concat(list(rows)) if rows is not None else None
        if rows is None or not len(rows):
            return
        who = sorted(rows["player_id"].unique())
        head = [",,," + ",".join(["Home,"] * len(who)), ",,," + ",".join(f"{w}," for w in who), "Period,Frame,Time [s]," + ",".join(f"Player{w}," for w in who)]
        at = {w: k for k, w in enumerate(who)}
        body = []
        for p, f, w, x in zip(rows["period"], rows["frame"], rows["player_id"], rows["x"]):
            cells = ["NaN,NaN"] * len(who)
            cells[at[w]] = f"{float(x)!r},{float(x) / 2!r}" if w % 3 == 1 else f"{float(x)!r},NaN"
            body.append(f"{p},{f},{f * 0.04:.2f}," + ",".join(cells))
        yield pd.DataFrame({"value": head + body})

    # few rows a file, so that its players are few
    n = max(1, -(-t.count() // 500))
    t.repartitionByRange(n, "player_id", "frame").mapInPandas(lines, "value string").write.text(folder)
    got = files.read_tracking(spark, folder, "home", 1)
    return got.where("x is not null").select("period", "frame", "player_id", "x", "y")
