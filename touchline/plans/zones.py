"""Queries: zones, expected threat, turnovers, orientation."""

from pyspark.sql import functions as F

from touchline.functions import scalar as S
from touchline.operators import passing as P
from touchline.operators import threat as T

from .base import opened, query, streamed

ZONE = "CAST(least(floor(least(0.999999, greatest(0.0, {v})) * {n}), {m}) AS INT)"
Z = lambda v, n: ZONE.format(v=v, n=n, m=n - 1)
ACTIONS = f"""acts AS (SELECT CASE WHEN start_x > 30 AND passer % 5 = 0 THEN 'SHOT' WHEN completed THEN 'PASS' ELSE 'BALL LOST' END type,
    start_x > 30 AND passer % 5 = 0 AND recipient % 3 = 0 goal, {Z("0.5 - start_y / 68.0", 8)} * 12 + {Z("start_x / 105.0 + 0.5", 12)} z0,
    {Z("0.5 - end_y / 68.0", 8)} * 12 + {Z("end_x / 105.0 + 0.5", 12)} z1 FROM syn_passes)"""
COUNTS = """counts AS (SELECT z0, count(*) FILTER (type = 'SHOT') shots, count(*) FILTER (type = 'SHOT' AND goal) goals, count(*) FILTER (type = 'PASS') moves,
    count(*) FILTER (type = 'BALL LOST') losses FROM acts GROUP BY z0)"""
RATES = """rates AS (SELECT z0, shots * 1.0::DOUBLE / (shots + moves + losses) s, moves * 1.0::DOUBLE / (shots + moves + losses) m, losses * 1.0::DOUBLE / (shots + moves + losses) l,
    coalesce(goals * 1.0::DOUBLE / nullif(shots, 0), 0) g FROM counts)"""
MOVES = """moves AS (SELECT z0, z1, count(*) * 1.0::DOUBLE / sum(count(*)) OVER (PARTITION BY z0) p FROM acts WHERE type = 'PASS' GROUP BY z0, z1)"""
ITERATE = """dense AS (SELECT a.z z0, list(coalesce(p, 0.0::DOUBLE) ORDER BY b.z) row_ FROM range(96) a(z) CROSS JOIN range(96) b(z) LEFT JOIN moves ON z0 = a.z AND z1 = b.z GROUP BY a.z),
  node AS (SELECT d.z0, coalesce(s * g, 0.0::DOUBLE) sg, coalesce(m, 0.0::DOUBLE) m, row_ FROM dense d LEFT JOIN rates r ON r.z0 = d.z0),
  packed AS (SELECT list({'sg': sg, 'm': m, 'r': row_} ORDER BY z0) a FROM node),
  it AS (SELECT 0 i, list_transform(range(96), lambda q: 0.0::DOUBLE) x, 1.0::DOUBLE d
    UNION ALL SELECT i + 1, nx, list_max(list_transform(list_zip(nx, x), lambda q: abs(q[1] - q[2]))) FROM (
      SELECT i, x, list_transform(a, lambda c: c.sg + c.m * list_dot_product(c.r, x)) nx FROM it, packed WHERE i < 200 AND d >= 1e-7)),
  xt AS (SELECT unnest(range(96))::INT zone, unnest(x) xt FROM (SELECT x FROM it ORDER BY i DESC LIMIT 1))"""
VELOCITY = """st AS (SELECT *, x - lag(x) OVER (PARTITION BY player_id, period ORDER BY frame) dx FROM syn_tracking), sm AS (SELECT *, avg(dx) OVER (PARTITION BY player_id, period ORDER BY frame ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 0.04 v FROM st)"""
XT = f"WITH RECURSIVE {ACTIONS}, {COUNTS}, {RATES}, {MOVES}, {ITERATE}"


@query("a02_zone_counts", "syn_passes", f"WITH {ACTIONS}, {COUNTS} SELECT * FROM counts")
def _(p):
    return T.zone_counts(T.actions(p))


@query("a03_zone_rates", "syn_passes", f"WITH {ACTIONS}, {COUNTS}, {RATES} SELECT z0, R[s]R s, R[m]R m, R[l]R l, R[g]R g FROM rates")
def _(p):
    return T.zone_rates(T.zone_counts(T.actions(p)))


@query("a04_transitions", "syn_passes", f"WITH {ACTIONS}, {MOVES} SELECT z0, z1, R[p]R p FROM moves")
def _(p):
    return T.transitions(T.actions(p))


@query("x01_xt_value_iteration", "syn_passes", f"{XT} SELECT zone, R[xt]R xt FROM xt")
def _(p):
    return T.surface(p)


POOLED = f"""WITH RECURSIVE gs AS (SELECT game_id, team, period, CASE WHEN avg(sx) > 0.5 THEN 1 ELSE -1 END d FROM syn_attempts WHERE type = 'SHOT' GROUP BY ALL),
  gk AS (SELECT t.game_id, t.team, max(d) FILTER (period = 1) a, max(d) FILTER (period = 2) b FROM (SELECT DISTINCT game_id, team FROM syn_attempts) t LEFT JOIN gs USING (game_id, team) GROUP BY ALL),
  gd AS (SELECT game_id, team, 1 period, coalesce(a, -b, 1) d FROM gk UNION ALL SELECT game_id, team, 2, coalesce(b, -coalesce(a, -b, 1)) FROM gk),
  tn AS (SELECT type, subtype, CASE WHEN d = -1 THEN 1 - sx ELSE sx END sx, CASE WHEN d = -1 THEN 1 - sy ELSE sy END sy, CASE WHEN d = -1 THEN 1 - ex ELSE ex END ex, CASE WHEN d = -1 THEN 1 - ey ELSE ey END ey FROM syn_attempts JOIN gd USING (game_id, team, period)),
  acts AS (SELECT type, coalesce(contains(subtype, 'GOAL'), false) goal, {Z("sy", 8)} * 12 + {Z("sx", 12)} z0, {Z("ey", 8)} * 12 + {Z("ex", 12)} z1 FROM tn), {COUNTS}, {RATES}, {MOVES}, {ITERATE}"""


@query("x02_xt_pooled_games", "syn_attempts", f"{POOLED} SELECT zone, R[xt]R xt FROM xt")
def _(e):
    """Orientation of each team and period of each game, then one surface over all games."""
    o = T.orient(e.withColumn("team", F.struct("game_id", "team")))
    x, y = S.zone(F.col("sx"), 12), S.zone(F.col("sy"), 8)
    acts = o.select(F.col("type"), F.coalesce(F.contains("subtype", F.lit("GOAL")), F.lit(False)).alias("goal"), (y * 12 + x).alias("z0"), (S.zone(F.col("ey"), 8) * 12 + S.zone(F.col("ex"), 12)).alias("z1"))
    return T.value_iteration(T.zone_rates(T.zone_counts(acts)), T.transitions(acts))


@query("c04_xt_lookup", "syn_passes", f"""{XT}, v AS (SELECT team, xt.xt own, -m.xt theirs FROM syn_passes
    JOIN xt ON xt.zone = {Z("0.5 - end_y / 68.0", 8)} * 12 + {Z("end_x / 105.0 + 0.5", 12)}
    JOIN xt m ON m.zone = {Z("1 - (0.5 - end_y / 68.0)", 8)} * 12 + {Z("1 - (end_x / 105.0 + 0.5)", 12)})
    SELECT team, R[avg(own)]R own, R[avg(theirs)]R theirs, R[max(own)]R best FROM v GROUP BY team""")  # fmt: skip
def _(p):
    x, y = S.metric_to_season(F.col("end_x"), F.col("end_y"))
    xt = T.surface(p)
    d = T.lookup(T.lookup(p, xt, x, y, "own"), xt, x, y, "theirs", opponents=True)
    return d.groupBy("team").agg(F.avg("own").alias("own"), F.avg("theirs").alias("theirs"), F.max("own").alias("best"))


@query("t01_top_zones", "syn_passes", f"{XT} SELECT zone, R[xt]R xt FROM xt ORDER BY xt DESC, zone LIMIT 10")
def _(p):
    return T.surface(p).orderBy(F.desc("xt"), "zone").limit(10)


@query("c14_target_bias", "syn_passes", f"""{XT}, v AS (SELECT completed, xt.xt v, sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2) d FROM syn_passes
    JOIN xt ON xt.zone = {Z("0.5 - end_y / 68.0", 8)} * 12 + {Z("end_x / 105.0 + 0.5", 12)})
    SELECT completed, count(*) n, R[avg(v)]R mean_value, R[median(v)]R median_value, R[avg(d)]R mean_distance FROM v GROUP BY completed""")  # fmt: skip
def _(p):
    d = T.lookup(p, T.surface(p), *S.metric_to_season(F.col("end_x"), F.col("end_y")), "v")
    return d.groupBy("completed").agg(F.count("*").alias("n"), F.avg("v").alias("mean_value"), F.median("v").alias("median_value"), F.avg(S.distance(F.col("end_x"), F.col("end_y"), F.col("start_x"), F.col("start_y"))).alias("mean_distance"))


MEANS = "shots AS (SELECT team, period, avg(sx) m FROM syn_attempts WHERE type = 'SHOT' GROUP BY team, period)"
DIRECTIONS = f"""{MEANS}, known AS (SELECT t.team, p.period, CASE WHEN m > 0.5 THEN 1 WHEN m IS NOT NULL THEN -1 END d
    FROM (SELECT DISTINCT team FROM syn_attempts) t CROSS JOIN (VALUES (1), (2)) p(period) LEFT JOIN shots s ON s.team = t.team AND s.period = p.period),
  one AS (SELECT team, coalesce(max(d) FILTER (period = 1), -max(d) FILTER (period = 2), 1) d1, max(d) FILTER (period = 2) d2 FROM known GROUP BY team),
  dirs AS (SELECT team, 1 period, d1::INT direction FROM one UNION ALL SELECT team, 2, coalesce(d2, -d1)::INT FROM one)"""


@query("a01_shot_side", "syn_attempts", f"WITH {MEANS} SELECT team, period, R[m]R mean, CASE WHEN m > 0.5 THEN 1 ELSE -1 END sign FROM shots")
def _(e):
    return e.where("type = 'SHOT'").groupBy("team", "period").agg(F.avg("sx").alias("mean")).withColumn("sign", F.when(F.col("mean") > 0.5, 1).otherwise(-1))


@query("g06_attack_directions", "syn_attempts", f"WITH {DIRECTIONS} SELECT * FROM dirs")
def _(e):
    return T.directions(e)


@query("g07_orient_events", "syn_attempts", f"""WITH {DIRECTIONS} SELECT seq, direction, R[CASE WHEN direction = -1 THEN 1 - sx ELSE sx END]R sx, R[CASE WHEN direction = -1 THEN 1 - ey ELSE ey END]R ey
    FROM syn_attempts JOIN dirs USING (team, period)""")
def _(e):
    return T.orient(e).select("seq", "direction", "sx", "ey")


# --- possessions and turnovers ---
POSSESSIONS = """firsts AS (SELECT match_id, possession, arg_min(team, seq) team, arg_min({'x': x, 'y': y}, seq) FILTER (x IS NOT NULL) st FROM syn_log GROUP BY ALL),
  poss AS (SELECT f.match_id, f.possession, f.team, st.x start_x, st.y start_y, CASE WHEN EXISTS (SELECT 1 FROM syn_log l WHERE l.match_id = f.match_id AND l.possession = f.possession
    AND l.team = f.team AND l.type = 'Shot' AND l.goal) THEN 1 ELSE 0 END scored FROM firsts f)"""
LOST = """lost AS (SELECT match_id, possession, arg_max({'team': team, 'x': x, 'y': y}, seq) l FROM syn_log WHERE lost AND x IS NOT NULL GROUP BY ALL)"""
CONCEDED = f"""{POSSESSIONS}, {LOST}, conc AS (SELECT l.match_id, l.possession, l.l.x x, l.l.y y, p.scored conceded FROM lost l JOIN poss p ON p.match_id = l.match_id AND p.possession = l.possession + 1 WHERE p.team <> l.l.team)"""
SURFACE = f"""{CONCEDED}, zc AS (SELECT {Z("y / 80.0", 8)} * 12 + {Z("x / 120.0", 12)} zone, count(*) n, sum(conceded) goals FROM conc GROUP BY 1),
  fullz AS (SELECT g.z::INT zone, coalesce(n, 0) n, coalesce(goals, 0) goals FROM range(96) g(z) LEFT JOIN zc ON zc.zone = g.z),
  surf AS (SELECT zone, n, goals::BIGINT goals, (goals + 40.0 * (SELECT sum(goals) * 1.0::DOUBLE / greatest(sum(n), 1) FROM fullz)) / (n + 40.0) value FROM fullz)"""


@query("a05_possession_rollup", "syn_log", f"WITH {POSSESSIONS} SELECT match_id, possession, team, R[start_x]R start_x, R[start_y]R start_y, scored FROM poss")
def _(log):
    return P.possessions(log)


@query("a06_possession_scored", "syn_log", f"WITH {POSSESSIONS} SELECT match_id, possession, scored FROM poss")
def _(log):
    return P.possessions(log).select("match_id", "possession", "scored")


@query("a07_last_turnover", "syn_log", f"WITH {LOST} SELECT match_id, possession, l.team losing_team, R[l.x]R x, R[l.y]R y FROM lost")
def _(log):
    return P.last_turnovers(log)


@query("j05_next_possession", "syn_log", f"WITH {CONCEDED} SELECT match_id, possession, R[x]R x, R[y]R y, conceded FROM conc")
def _(log):
    return P.conceded(log).select("match_id", "possession", "x", "y", "conceded")


@query("a08_zone_turnovers", "syn_log", f"WITH {SURFACE} SELECT zone, n, goals FROM surf")
def _(log):
    return P.turnover_surface(log).select("zone", "n", "goals")


@query("a09_shrunk_turnover", "syn_log", f"WITH {SURFACE} SELECT zone, R[value]R value FROM surf")
def _(log):
    return P.turnover_surface(log).select("zone", "value")


@query("c08_turnover_surface", "syn_log", f"WITH {SURFACE} SELECT zone, n, goals, R[value]R value FROM surf")
def _(log):
    return P.turnover_surface(log)


@query("c09_turnover_lookup", "syn_log syn_passes", f"""WITH {SURFACE} SELECT team, R[avg(-value)]R cost, R[min(-value)]R worst FROM syn_passes
    JOIN surf ON surf.zone = {Z("0.5 - end_y / 68.0", 8)} * 12 + {Z("end_x / 105.0 + 0.5", 12)} GROUP BY team""")
def _(log, p):
    s = P.turnover_surface(log).select("zone", (-F.col("value")).alias("xt"))
    d = T.lookup(p, s, *S.metric_to_season(F.col("end_x"), F.col("end_y")), "cost")
    return d.groupBy("team").agg(F.avg("cost").alias("cost"), F.min("cost").alias("worst"))


@query("a34_surface_by_column", "syn_log", f"WITH {SURFACE} SELECT zone % 12 ix, R[avg(value)]R mean_value FROM surf GROUP BY 1")
def _(log):
    return P.turnover_surface(log).groupBy((F.col("zone") % 12).alias("ix")).agg(F.avg("value").alias("mean_value"))


@query("c16_old_new_turnover", "syn_log syn_passes", f"""{XT.replace("WITH RECURSIVE", "WITH RECURSIVE " + SURFACE + ",")} SELECT s.zone % 12 ix, R[avg(-m.xt)]R mirrored, R[avg(-s.value)]R empirical
    FROM surf s JOIN xt m ON m.zone = (7 - s.zone // 12) * 12 + (11 - s.zone % 12) GROUP BY 1""")
def _(log, p):
    s = P.turnover_surface(log)
    ix, iy = F.col("zone") % 12, F.floor(F.col("zone") / 12)
    d = T.lookup(s, T.surface(p), (ix + 0.5) / 12.0, (iy + 0.5) / 8.0, "mirrored", opponents=True)
    return d.groupBy(ix.alias("ix")).agg(F.avg("mirrored").alias("mirrored"), F.avg(-F.col("value")).alias("empirical"))


@query("s14_surface_table", "syn_passes", f"{XT} SELECT zone % 12 ix, zone // 12 iy, R[xt]R value FROM xt")
def _(p):
    """The surface as the cell table that is stored instead of a dense array."""
    return T.surface(p).select((F.col("zone") % 12).alias("ix"), F.floor(F.col("zone") / 12).cast("int").alias("iy"), F.col("xt").alias("value"))


@query("a21_zone_means", "syn_passes", f"""SELECT {Z("0.5 - start_y / 68.0", 8)} iy, {Z("start_x / 105.0 + 0.5", 12)} ix, count(*) n, CASE WHEN count(*) >= 25 THEN R[avg(end_x)]R END mean FROM syn_passes GROUP BY 1, 2""")
def _(p):
    x, y = S.metric_to_season(F.col("start_x"), F.col("start_y"))
    return p.groupBy(S.zone(y, 8).alias("iy"), S.zone(x, 12).alias("ix")).agg(F.count("*").alias("n"), F.when(F.count("*") >= 25, F.avg("end_x")).alias("mean"))


@query("a22_zone_spread", "syn_passes", f"""WITH m AS (SELECT CASE WHEN count(*) >= 25 THEN avg(end_x) END m FROM syn_passes GROUP BY {Z("0.5 - start_y / 68.0", 8)}, {Z("start_x / 105.0 + 0.5", 12)})
    SELECT R[(SELECT stddev_pop(m) FROM m) / (SELECT stddev_samp(end_x) FROM syn_passes)]R spread""")
def _(p):
    x, y = S.metric_to_season(F.col("start_x"), F.col("start_y"))
    m = p.groupBy(S.zone(y, 8), S.zone(x, 12)).agg(F.when(F.count("*") >= 25, F.avg("end_x")).alias("m")).agg(F.stddev_pop("m").alias("a"))
    return m.crossJoin(F.broadcast(p.agg(F.stddev_samp("end_x").alias("b")))).select((F.col("a") / F.col("b")).alias("spread"))


@streamed("st01_windowed_zone_counts", "events", "", f"""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, {Z("(event_id * 11 % 1000) / 1000.0", 8)} * 12 + {Z("(user_id * 7 % 1000) / 1000.0", 12)} zone, count(*) n FROM events GROUP BY 1, 2""")
def _(spark, path):
    """The rollup of a stream over the table's files."""
    from touchline.streaming.sink import latest
    from touchline.streaming.zone_counts import zone_counts

    e = opened(spark, path)
    d = e.select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") * 7 % 1000 / 1000.0).alias("x"), (F.col("event_id") * 11 % 1000 / 1000.0).alias("y"))
    return latest(zone_counts(d, window="1 hour"), ["start", "zone"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "zone", "n")


@streamed("st02_smoothed_velocity", "events", "syn_tracking", f"WITH {VELOCITY} SELECT player_id, period, frame, R[CASE WHEN v IS NULL THEN NULL ELSE least(12.0, greatest(-12.0, v)) END]R vx FROM sm")
def _(spark, path):
    """Velocities of a stream of positions, as files come in; the last version of each frame."""
    from touchline.streaming.sink import latest
    from touchline.streaming.velocities import velocities

    e = opened(spark, path, 1)
    t = e.select(F.col("user_id").cast("int").alias("player_id"), (F.col("event_id") % 2 + 1).cast("int").alias("period"), F.col("event_id").alias("frame"), ((F.col("user_id") * 53 + F.col("event_id") * 7) % 1050 / 10.0 - 52.5).alias("x"))
    return latest(velocities(t), ["player_id", "period", "frame"])
