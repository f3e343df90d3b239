"""Queries: fitted models, gates, the data behind figures."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import scalar as S
from touchline.operators import bootstrap as B
from touchline.operators import market as K
from touchline.operators import models as M
from touchline.operators import passing as P
from touchline.operators import roles as R
from touchline.operators import threat as T
from touchline.operators.order import rank_correlation
from touchline.sources.scratch import kept

from .base import query
from .passes import prepared, rated, reliability
from .people import AX, PAIRS, POOL, ROLES, priced
from .zones import SURFACE, Z

FULL = ["quality", "age", "age_sq", "log_passes", "log_caps", "pos_MID", "pos_FWD"]


def featured(s):
    """The passes' features as a written table: fits and folds read them many times."""
    return kept(P.completion_features(prepared(s)), "features")


@query("m01_completion_logistic", "syn_snapshots")
def _(s):
    b, w = M.logistic(featured(s), P.FEATURES, "completed")
    return s.sparkSession.createDataFrame([("intercept", b), *w.items()], "name string, weight double")


@query("m02_completion_boosted", "syn_snapshots")
def _(s):
    """Reliability of the boosted model: up to 300 rounds, ended by a tenth of the passes."""
    d = featured(s)
    return reliability(M.boosted_probability(M.boosted(d, P.FEATURES, "completed", key=["pass_id"]), d, P.FEATURES), "completed", "p")


@query("m03_grouped_folds", "syn_snapshots")
def _(s):
    return reliability(M.out_of_fold(featured(s), "match_id", P.FEATURES, "completed"), "completed", "p")


@query("m03_model_choice", "syn_snapshots")
def _(s):
    """Logistic and boosted, judged out of fold over the matches; the least worst gap is chosen."""
    return M.compared(P.completion_features(prepared(s).where("target_match_dist <= 6D")), "match_id", P.FEATURES, "completed", ["pass_id"])


@query("m04_leave_one_out", "syn_snapshots")
def _(s):
    """Two games, each predicted from the other."""
    d = featured(s).withColumn("game", (F.col("match_id") % 2).cast("int"))
    o = M.out_of_fold(d, "game", P.FEATURES, "completed", n=2)
    y = F.col("completed")
    return o.groupBy("game").agg(F.avg((F.col("p") - y) * (F.col("p") - y)).alias("brier"), F.count("*").alias("n"))


def received(p, s):
    return P.reception(prepared(s), T.surface(p))


@query("m05_reception_discount", "syn_passes syn_snapshots")
def _(p, s):
    d = kept(received(p, s), "received")
    _, curve = M.discount(d)
    return d.select("pass_id", curve(F.col("control_target")).alias("discount"), (F.col("zone_xt") * curve(F.col("control_target"))).alias("v_receive"))


@query("m06_bootstrap_ci", "syn_passes syn_snapshots")
def _(p, s):
    """Does control at the target tell more than the zone: 300 resamples of the reception model's coefficients."""
    return B.coefficient_intervals(received(p, s), ["zone_xt", "control_target"], "scored", ["pass_id"])


@query("v04_player_ci", "syn_passes syn_snapshots")
def _(p, s):
    """Players of all teams with 20 passes: the mean of cpv_avg and its interval over 400 resamples."""
    return B.mean_intervals(rated(p, s), ["team", "passer"], "cpv_avg", ["pass_id"]).where("n >= 20")


@query("m07_pca", "syn_passes")
def _(p):
    d, k = M.principal_axes(R.z_scores(R.territory_style(p), ["team"], R.TERRITORY + R.STYLE), R.TERRITORY + R.STYLE)
    return d.select("team", "player_id", F.lit(k).alias("k"), F.abs("pc1").alias("pc1"))


@query("v05_role_map", "syn_passes")
def _(p):
    """Scarcity of one league's players in the space of their roles' main components."""
    d, k = M.principal_axes(R.z_scores(R.territory_style(p, 20), ["team"], R.TERRITORY + R.STYLE), R.TERRITORY + R.STYLE)
    d = d.withColumn("player_id", F.col("team") * 1000 + F.col("player_id"))
    return R.scarcity_density(d, [f"pc{i + 1}" for i in range(k)]).orderBy(F.desc("scarcity_density"), "player_id")


STANDARD = lambda c: f"CASE WHEN coalesce(stddev_samp({c}) OVER w, 0) = 0 THEN 0 ELSE ({c} - avg({c}) OVER w) / stddev_samp({c}) OVER w END"


@query("c11_population", "syn_passes", f"WITH {ROLES}, po AS (SELECT *, CASE WHEN mean_x < -12 THEN 'DEF' WHEN mean_x < 12 THEN 'MID' ELSE 'FWD' END position FROM ts WHERE n_passes >= 15 AND mean_x >= -30) SELECT team, player_id, position, R[{STANDARD('mean_x')}]R mean_x, R[{STANDARD('dispersion')}]R dispersion, R[{STANDARD('fwd_share')}]R fwd_share, R[{STANDARD('long_share')}]R long_share FROM po WINDOW w AS (PARTITION BY team)")
def _(p):
    """Position by depth, goalkeepers left out, and only then each team's features normalised."""
    d = R.territory_style(p, 15).withColumn("position", S.position_by_depth(F.col("mean_x"))).where("position <> 'GK'")
    return R.z_scores(d, ["team"], ["mean_x", "dispersion", "fwd_share", "long_share"]).select("team", "player_id", "position", "mean_x", "dispersion", "fwd_share", "long_share")


BOTH = f"""{POOL}, h AS (SELECT quantile_cont(d, 0.5) h FROM pr), den AS (SELECT p player_id, -ln(avg(exp(-0.5 * (d / h) ** 2)) + 1e-12) density FROM bw, h GROUP BY p),
  bo AS (SELECT r.player_id, r.team, density, CASE WHEN quality IS NOT NULL THEN -ln((coalesce(k, 0) + 1) * 1.0::DOUBLE / (SELECT count(*) FROM syn_roles)) END pool FROM syn_roles r JOIN den USING (player_id) LEFT JOIN k ON k.id = r.player_id)"""


def boarded(r):
    return R.scarcity_density(r, AX).join(R.scarcity_pool(r, AX), "player_id").join(r.select("player_id", "team"), "player_id").select("player_id", "team", F.col("scarcity_density").alias("density"), F.col("scarcity_pool").alias("pool"))


@query("v05_squad_board", "syn_roles", f"WITH {BOTH} SELECT team, player_id, R[density]R density, R[pool]R pool, row_number() OVER (PARTITION BY team ORDER BY round(density, 9) DESC, player_id)::INT place FROM bo")
def _(r):
    """Each squad's players, the scarcest first, with both kinds of scarcity."""
    place = F.row_number().over(Window.partitionBy("team").orderBy(F.round("density", 9).desc(), "player_id"))
    return boarded(r).withColumn("place", place).select("team", "player_id", "density", "pool", "place")


@query("v05_density_against_pool", "syn_roles", f"WITH {BOTH}, rk AS (SELECT rank() OVER (ORDER BY round(density, 9)) + (count(*) OVER (PARTITION BY round(density, 9)) - 1) / 2.0::DOUBLE a, rank() OVER (ORDER BY round(pool, 9)) + (count(*) OVER (PARTITION BY round(pool, 9)) - 1) / 2.0::DOUBLE b FROM bo WHERE pool IS NOT NULL) SELECT R[corr(a, b)]R rho, count(*) n FROM rk")
def _(r):
    return rank_correlation(boarded(r).select(F.round("density", 9).alias("density"), F.round("pool", 9).alias("pool")), "density", "pool")


@query("v06_residual_by_club", "syn_players", "WITH f AS (SELECT team, regr_slope(quality, b) OVER () * b + regr_intercept(quality, b) OVER () - quality surplus FROM syn_players WHERE quality IS NOT NULL) SELECT team, count(*) n, R[avg(surplus)]R surplus FROM f GROUP BY team HAVING count(*) >= 5")
def _(p):
    """Mean surplus of clubs with five players."""
    d = M.surplus(p.where("quality is not null"), ["b"], "quality")
    return d.groupBy("team").agg(F.count("*").alias("n"), F.avg("surplus").alias("surplus")).where("n >= 5")


@query("m08_cross_validated_r2", "customer syn_valuations")
def _(c, v):
    return M.cross_validated_r2(K.price_features(priced(c, v), "2024-03-01"), "player_id", FULL, "log_value")


@query("a31_fold_scores", "customer syn_valuations")
def _(c, v):
    return M.cross_validated_r2(K.price_features(priced(c, v), "2024-03-01"), "player_id", FULL, "log_value").agg(F.avg("r2").alias("mean"), F.stddev_pop("r2").alias("std"))


@query("m09_ols_coefficients", "customer syn_valuations")
def _(c, v):
    return M.coefficients(K.price_features(priced(c, v), "2024-03-01"), FULL, "log_value")


@query("m09_ols_closed_form", "syn_players", "SELECT R[regr_slope(quality, b)]R coef, R[regr_intercept(quality, b)]R intercept, R[regr_r2(quality, b)]R r2 FROM syn_players WHERE quality IS NOT NULL")
def _(p):
    model, _ = M.ols(p.where("quality is not null"), ["b"], "quality")
    return p.sparkSession.createDataFrame([(float(model.coefficients[0]), float(model.intercept), float(model.summary.r2))], "coef double, intercept double, r2 double")


SURPLUS = "f AS (SELECT player_id, quality, regr_slope(quality, b) OVER () * b + regr_intercept(quality, b) OVER () pred FROM syn_players WHERE quality IS NOT NULL)"


@query("m10_surplus", "syn_players", f"WITH {SURPLUS} SELECT player_id, R[pred]R predicted, R[quality - pred]R residual, R[pred - quality]R surplus FROM f")
def _(p):
    return M.surplus(p.where("quality is not null"), ["b"], "quality").select("player_id", F.col("predicted_log_value").alias("predicted"), "residual", "surplus")


@query("v06_surplus_extremes", "syn_players", f"WITH {SURPLUS}, r AS (SELECT player_id, round(pred - quality, 6) surplus FROM f) (SELECT player_id, surplus, 'over' side FROM r ORDER BY surplus DESC, player_id LIMIT 12) UNION ALL (SELECT player_id, surplus, 'under' FROM r ORDER BY surplus, player_id LIMIT 12)")
def _(p):
    d = M.surplus(p.where("quality is not null"), ["b"], "quality").select("player_id", F.round("surplus", 6).alias("surplus"))
    return d.orderBy(F.desc("surplus"), "player_id").limit(12).withColumn("side", F.lit("over")).union(d.orderBy("surplus", "player_id").limit(12).withColumn("side", F.lit("under")))


KNN = f"{PAIRS}, nn AS (SELECT p, q, row_number() OVER (PARTITION BY p ORDER BY d, q) r FROM bw), vt AS (SELECT p, r2.team % 3 l, count(*) n FROM nn JOIN syn_roles r2 ON r2.player_id = q WHERE r <= 3 GROUP BY ALL), g AS (SELECT p, arg_min(l, {{'n': -n, 'l': l}}) g FROM vt GROUP BY p)"


@query("m11_knn_accuracy", "syn_roles", f"WITH {KNN} SELECT R[avg(CASE WHEN g = team % 3 THEN 1.0::DOUBLE ELSE 0 END)]R accuracy, count(*) n, R[(SELECT max(c) * 1.0::DOUBLE / sum(c) FROM (SELECT count(*) c FROM syn_roles GROUP BY team % 3))]R majority FROM g JOIN syn_roles ON player_id = p")
def _(r):
    labels = r.select("player_id", (F.col("team") % 3).alias("label"))
    return M.nearest_neighbours_accuracy(R.neighbours(r, AX, 3), labels, "player_id", "label")


@query("x13_split_half_random", "syn_passes")
def _(p):
    """Mean rank correlation of mean_x between random halves of the matches, drawn on the driver (34 ids)."""
    import numpy as np

    ids = np.array(sorted(r[0] for r in p.select("match_id").distinct().collect()))
    rng, k = np.random.default_rng(0), len(ids) // 2
    rows = [(rep, int(side), int(m)) for rep in range(5) for side, part in enumerate(np.split(rng.choice(ids, 2 * k, replace=False), 2)) for m in part]
    draw = p.sparkSession.createDataFrame(rows, "rep int, side int, match_id int")
    f = p.join(F.broadcast(draw), "match_id").groupBy("rep", "side", "team", "passer").agg(F.avg("start_x").alias("v"))
    both = f.where("side = 0").select("rep", "team", "passer", F.col("v").alias("x")).join(f.where("side = 1").select("rep", "team", "passer", F.col("v").alias("y")), ["rep", "team", "passer"])
    return R.spearman(both, "x", "y", ["rep"]).agg(F.avg("rho").alias("rho"), F.count("*").alias("reps"))


@query("v02_turnover_map", "syn_log", f"""WITH {SURFACE} SELECT i % 60 gx, i // 60 gy, R[value]R value FROM range(2400) r(i) JOIN surf
    ON surf.zone = {Z("(i // 60 + 0.5) / 40.0", 8)} * 12 + {Z("(i % 60 + 0.5) / 60.0", 12)}""")
def _(log):
    s = P.turnover_surface(log).select("zone", F.col("value").alias("xt"))
    g = log.sparkSession.range(2400).select((F.col("id") % 60).alias("gx"), F.floor(F.col("id") / 60).alias("gy"))
    return T.lookup(g, s, (F.col("gx") + 0.5) / 60.0, (F.col("gy") + 0.5) / 40.0, "value")


@query("c17_prototype", "syn_tracking", "WITH d AS (SELECT frame * 0.04 - lag(frame * 0.04) OVER (PARTITION BY player_id ORDER BY frame) d FROM syn_tracking) SELECT R[median(d)]R dt, (SELECT count(*) FROM syn_tracking) n FROM d")
def _(t):
    from touchline.operators.motion import frame_step

    return frame_step(t.select(F.col("player_id").alias("game_id"), "frame", (F.col("frame") * 0.04).alias("t"))).crossJoin(F.broadcast(t.agg(F.count("*").alias("n"))))
