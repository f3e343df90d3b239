"""Queries: roles, networks, scarcity, names, prices, and the relational pieces that they use."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import scalar as S
from touchline.operators import market as K
from touchline.operators import pairs as X
from touchline.operators import roles as R
from touchline.operators.order import quantiles, rank_correlation
from touchline.sources.scratch import kept
from touchline.sources.synthetic import spread

from .base import query

D = "sqrt((end_x - start_x) ** 2 + (end_y - start_y) ** 2)"
SH = lambda c: f"avg(CASE WHEN {c} THEN 1.0::DOUBLE ELSE 0 END)"
ROLES = f"""ts AS (SELECT team, passer player_id, count(*) n_passes, avg(start_x) mean_x, avg(start_y) mean_y, sqrt(var_pop(start_x) + var_pop(start_y)) dispersion, {SH("start_x < -17.5")} def_share,
    {SH("start_x BETWEEN -17.5 AND 17.5")} mid_share, {SH("start_x > 17.5")} att_share, {SH("end_x - start_x > 5")} fwd_share, {SH("abs(end_x - start_x) <= 5")} lat_share, {SH("end_x - start_x < -5")} back_share,
    avg({D}) mean_pass_dist, stddev_pop({D}) std_pass_dist, {SH(D + " > 30")} long_share FROM syn_passes GROUP BY team, passer)"""
EDGES = "e AS (SELECT team, passer src, recipient dst, count(*) weight FROM syn_passes WHERE completed AND passer <> recipient GROUP BY ALL)"
IO = """nd AS (SELECT team, src node FROM e UNION SELECT team, dst FROM e), io AS (SELECT nd.team, nd.node, coalesce((SELECT sum(weight) FROM e WHERE e.team = nd.team AND e.dst = nd.node), 0)::BIGINT in_w,
    coalesce((SELECT sum(weight) FROM e WHERE e.team = nd.team AND e.src = nd.node), 0)::BIGINT out_w FROM nd)"""


@query("a13_territory", "syn_passes", f"WITH {ROLES} SELECT team, player_id, n_passes, R[mean_x]R mean_x, R[mean_y]R mean_y, R[dispersion]R dispersion, R[def_share]R def_share, R[mid_share]R mid_share, R[att_share]R att_share FROM ts")
def _(p):
    return R.territory_style(p).select("team", "player_id", "n_passes", *R.TERRITORY)


@query("a14_style", "syn_passes", f"WITH {ROLES} SELECT team, player_id, R[fwd_share]R fwd_share, R[lat_share]R lat_share, R[back_share]R back_share, R[mean_pass_dist]R mean_pass_dist, R[std_pass_dist]R std_pass_dist, R[long_share]R long_share FROM ts")
def _(p):
    return R.territory_style(p).select("team", "player_id", *R.STYLE)


TURNED = """gs AS (SELECT game_id, team, period, CASE WHEN avg(sx) > 0.5 THEN 1 ELSE -1 END d FROM syn_attempts WHERE type = 'SHOT' GROUP BY ALL),
  gk AS (SELECT t.game_id, t.team, max(d) FILTER (period = 1) a, max(d) FILTER (period = 2) b FROM (SELECT DISTINCT game_id, team FROM syn_attempts) t LEFT JOIN gs USING (game_id, team) GROUP BY ALL),
  gd AS (SELECT game_id, team, 1 period, coalesce(a, -b, 1) d FROM gk UNION ALL SELECT game_id, team, 2, coalesce(b, -coalesce(a, -b, 1)) FROM gk),
  op AS (SELECT game_id, team tm, game_id * 2 + CASE WHEN team = 'Home' THEN 0 ELSE 1 END team, passer, recipient, true completed, (sx - 0.5) * 105.0 * d start_x, (sy - 0.5) * 68.0 * d start_y, (ex - 0.5) * 105.0 * d end_x, (ey - 0.5) * 68.0 * d end_y
    FROM syn_attempts JOIN gd USING (game_id, team, period) WHERE type = 'PASS' AND passer IS NOT NULL AND sx IS NOT NULL AND sy IS NOT NULL AND ex IS NOT NULL AND ey IS NOT NULL)"""
OF_GAMES = lambda sql: sql.replace("syn_passes", "op")
SIDE = "team // 2 game_id, CASE WHEN team % 2 = 0 THEN 'Home' ELSE 'Away' END team"


@query("x12_territory_style_oriented", "syn_attempts", f"WITH {TURNED}, {OF_GAMES(ROLES)} SELECT {SIDE}, player_id, n_passes, R[mean_x]R mean_x, R[mean_y]R mean_y, R[dispersion]R dispersion, R[def_share]R def_share, R[att_share]R att_share, R[fwd_share]R fwd_share, R[back_share]R back_share, R[std_pass_dist]R std_pass_dist, R[long_share]R long_share FROM ts WHERE n_passes >= 10")
def _(e):
    """Where tracked players pass from and how, every team turned to attack towards +x."""
    d = R.oriented_passes(e).withColumn("team", F.col("game_id") * 2 + F.when(F.col("team") == "Home", 0).otherwise(1))
    d = R.territory_style(d, 10).withColumn("game_id", F.floor(F.col("team") / 2).cast("int")).withColumn("team", F.when(F.col("team") % 2 == 0, "Home").otherwise("Away"))
    return d.select("game_id", "team", "player_id", "n_passes", "mean_x", "mean_y", "dispersion", "def_share", "att_share", "fwd_share", "back_share", "std_pass_dist", "long_share")


@query("p12_min_support", "syn_passes", "SELECT team, passer player_id, count(*) n_passes FROM syn_passes GROUP BY ALL HAVING count(*) >= 130")
def _(p):
    return R.territory_style(p, 130).select("team", "player_id", "n_passes")


@query("a16_pass_network", "syn_passes", f"WITH {EDGES} SELECT * FROM e")
def _(p):
    return R.network(p)


@query("x09_pass_network_build", "syn_passes", f"WITH {EDGES} SELECT team, count(*) edges, sum(weight)::BIGINT passes FROM e GROUP BY team")
def _(p):
    return R.network(p).groupBy("team").agg(F.count("*").alias("edges"), F.sum("weight").alias("passes"))


@query("a15_degrees", "syn_passes", f"WITH {EDGES}, {IO} SELECT team, node, in_w, out_w, R[(in_w + 1) * 1.0::DOUBLE / (out_w + 1)]R in_out_ratio FROM io")
def _(p):
    return R.in_out_ratio(R.network(p))


PR = f"""WITH RECURSIVE {EDGES}, {IO.split(', io AS')[0]}, ix AS (SELECT team, node, row_number() OVER (PARTITION BY team ORDER BY node) - 1 i, count(*) OVER (PARTITION BY team) n FROM nd),
  ow AS (SELECT team, src, sum(weight) w FROM e GROUP BY ALL), pe AS (SELECT e.team, a.i si, b.i di, e.weight * 1.0::DOUBLE / ow.w p FROM e JOIN ow USING (team, src) JOIN ix a ON a.team = e.team AND a.node = e.src JOIN ix b ON b.team = e.team AND b.node = e.dst),
  dense AS (SELECT d.team, d.i, d.n, list(coalesce(pe.p, 0.0::DOUBLE) ORDER BY s.i) r FROM ix d JOIN ix s ON s.team = d.team LEFT JOIN pe ON pe.team = d.team AND pe.si = s.i AND pe.di = d.i GROUP BY ALL),
  dg AS (SELECT ix.team, list(CASE WHEN ow.w IS NULL THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END ORDER BY i) dv FROM ix LEFT JOIN ow ON ow.team = ix.team AND ow.src = ix.node GROUP BY ix.team),
  pk AS (SELECT team, any_value(n) n, list(r ORDER BY i) a FROM dense GROUP BY team),
  it AS (SELECT pk.team, 0 k, list_transform(a, lambda q: 1.0::DOUBLE / n) x, 1e9::DOUBLE err FROM pk
    UNION ALL SELECT team, k + 1, nx, list_sum(list_transform(list_zip(nx, x), lambda q: abs(q[1] - q[2]))) FROM (
      SELECT it.team, it.k, it.x, list_transform(pk.a, lambda r: 0.85::DOUBLE * (list_dot_product(r, it.x) + list_dot_product(dg.dv, it.x) / pk.n) + 0.15::DOUBLE / pk.n) nx
      FROM it JOIN pk USING (team) JOIN dg USING (team) WHERE it.k < 100 AND it.err >= pk.n * 1e-6)),
  fin AS (SELECT team, arg_max(x, k) x FROM it GROUP BY team), pr AS (SELECT ix.team, ix.node, fin.x[ix.i + 1] pagerank FROM ix JOIN fin USING (team))"""


@query("x05_pagerank", "syn_passes", f"{PR} SELECT team, node, R[pagerank]R pagerank FROM pr")
def _(p):
    return R.pagerank(R.network(p))


CL = """u0 AS (SELECT team, least(src, dst) a, greatest(src, dst) b, arg_max(weight, CASE WHEN src > dst THEN 1 ELSE 0 END) w FROM e GROUP BY ALL), u AS (SELECT team, a, b, w * 1.0::DOUBLE / max(w) OVER (PARTITION BY team) w FROM u0),
  bw AS (SELECT * FROM u UNION ALL SELECT team, b, a, w FROM u), tri AS (SELECT x.team, x.a node, sum(cbrt(x.w * y.w * z.w)) t FROM bw x JOIN bw y ON y.team = x.team AND y.a = x.b AND y.b <> x.a JOIN bw z ON z.team = x.team AND z.a = y.b AND z.b = x.a GROUP BY ALL),
  dgr AS (SELECT team, a node, count(*) k FROM bw GROUP BY ALL), cl AS (SELECT d.team, d.node, CASE WHEN k < 2 THEN 0 ELSE coalesce(t, 0) / (k * (k - 1)) END clustering FROM dgr d LEFT JOIN tri USING (team, node))"""


@query("x07_clustering", "syn_passes", f"WITH {EDGES}, {CL} SELECT team, node, R[clustering]R clustering FROM cl")
def _(p):
    return R.clustering(R.network(p))


@query("x06_betweenness", "syn_passes", None)
def _(p):
    return R.betweenness(R.network(p))


@query("x08_network_features", "syn_passes", f"{PR}, io AS{IO.split(', io AS')[1]}, {CL} SELECT team, node, R[pagerank]R pagerank, R[(in_w + 1) * 1.0::DOUBLE / (out_w + 1)]R in_out_ratio, R[clustering]R clustering FROM pr JOIN io USING (team, node) JOIN cl USING (team, node)")
def _(p):
    e = R.network(p)
    return R.pagerank(e).join(R.in_out_ratio(e).select("team", "node", "in_out_ratio"), ["team", "node"]).join(R.clustering(e), ["team", "node"])


@query("x11_role_features", "syn_passes", f"{PR}, io AS{IO.split(', io AS')[1]}, {CL}, {ROLES} SELECT ts.team, ts.player_id, n_passes, round(dispersion, 5) dispersion, R[long_share]R long_share, R[pagerank]R pagerank, R[clustering]R clustering FROM ts LEFT JOIN pr ON pr.team = ts.team AND pr.node = ts.player_id LEFT JOIN cl ON cl.team = ts.team AND cl.node = ts.player_id")
def _(p):
    return R.role_features(p).select("team", "player_id", "n_passes", F.round("dispersion", 5).alias("dispersion"), "long_share", "pagerank", "clustering")


@query("x10_role_features_match", "syn_attempts", f"{OF_GAMES(PR).replace('WITH RECURSIVE', 'WITH RECURSIVE ' + TURNED + ',', 1)}, io AS{OF_GAMES(IO.split(', io AS')[1])}, {CL}, {OF_GAMES(ROLES)} SELECT ts.team // 2 game_id, CASE WHEN ts.team % 2 = 0 THEN 'Home' ELSE 'Away' END team, ts.player_id, n_passes, R[mean_x]R mean_x, R[fwd_share]R fwd_share, R[pagerank]R pagerank, R[(in_w + 1) * 1.0::DOUBLE / (out_w + 1)]R in_out_ratio, R[clustering]R clustering FROM ts LEFT JOIN pr ON pr.team = ts.team AND pr.node = ts.player_id LEFT JOIN io ON io.team = ts.team AND io.node = ts.player_id LEFT JOIN cl ON cl.team = ts.team AND cl.node = ts.player_id WHERE n_passes >= 10")
def _(e):
    """Both teams' role vectors in each match; betweenness, which the operator gives too, is x06's."""
    return R.match_role_features(e).select("game_id", "team", "player_id", "n_passes", "mean_x", "fwd_share", "pagerank", "in_out_ratio", "clustering")


@query("w03_team_z_scores", "syn_players", "SELECT player_id, R[CASE WHEN coalesce(stddev_samp(a) OVER w, 0) = 0 THEN 0 ELSE (a - avg(a) OVER w) / stddev_samp(a) OVER w END]R a FROM syn_players WINDOW w AS (PARTITION BY team)")
def _(p):
    return R.z_scores(p, ["team"], ["a"]).select("player_id", "a")


@query("p22_position_by_depth", "syn_passes", f"WITH {ROLES} SELECT team, player_id, CASE WHEN mean_x < -30 THEN 'GK' WHEN mean_x < -12 THEN 'DEF' WHEN mean_x < 12 THEN 'MID' ELSE 'FWD' END inferred_position FROM ts")
def _(p):
    return R.territory_style(p).select("team", "player_id", S.position_by_depth(F.col("mean_x")).alias("inferred_position"))


NAMES23 = [n for v in S.POSITION_GROUPS.values() for n in v]
ARR = "[" + ", ".join(f"'{n}'" for n in [*NAMES23, "Sweeper"]) + "]"
POS = f"ps AS (SELECT player_id, seq, {ARR}[((seq * 7 + player_id) % 24)::INT + 1] position FROM (SELECT user_id player_id, event_id seq FROM events))"
GROUPCASE = "CASE " + " ".join(f"WHEN position IN ({', '.join(repr(n) for n in v)}) THEN '{g}'" for g, v in S.POSITION_GROUPS.items()) + " ELSE 'UNK' END"


def positions(e):
    a = F.array(*map(F.lit, [*NAMES23, "Sweeper"]))
    return e.select(F.col("user_id").alias("player_id"), F.col("event_id").alias("seq"), F.get(a, F.pmod(F.col("event_id") * 7 + F.col("user_id"), F.lit(24)).cast("int")).alias("position"))


@query("p23_position_groups", "events", f"WITH {POS} SELECT {GROUPCASE} grp, count(*) n FROM ps GROUP BY 1")
def _(e):
    return positions(e).groupBy(S.position_group(F.col("position")).alias("grp")).agg(F.count("*").alias("n"))


@query("a24_modal_position", "events", f"WITH {POS}, c AS (SELECT player_id, position, count(*) n, min(seq) f FROM ps GROUP BY ALL) SELECT player_id, arg_min(position, {{'n': -n, 'f': f}}) position FROM c GROUP BY 1")
def _(e):
    return modal(positions(e))


def modal(d):
    """Most frequent position of each player; the one seen first of equals."""
    c = d.groupBy("player_id", "position").agg(F.count("*").alias("n"), F.min("seq").alias("f"))
    return c.groupBy("player_id").agg(F.min_by("position", F.struct((-F.col("n")).alias("n"), "f")).alias("position"))


@query("c15_position_labels", "events", f"WITH {POS}, c AS (SELECT player_id, position, count(*) n, min(seq) f FROM ps GROUP BY ALL), m AS (SELECT player_id, arg_min(position, {{'n': -n, 'f': f}}) position FROM c GROUP BY 1) SELECT player_id, {GROUPCASE} label FROM m")
def _(e):
    return modal(positions(e)).select("player_id", S.position_group(F.col("position")).alias("label"))


@query("p26_position_order", "events", f"WITH {POS} SELECT list_position(['GK', 'DEF', 'MID', 'FWD'], {GROUPCASE}) - 1 o, count(*) n FROM ps GROUP BY 1")
def _(e):
    return positions(e).groupBy(S.position_order(S.position_group(F.col("position"))).alias("o")).agg(F.count("*").alias("n"))


PAIRS = "pr AS (SELECT p.player_id p, q.player_id q, sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2) d FROM syn_roles p JOIN syn_roles q ON p.player_id < q.player_id), bw AS (SELECT * FROM pr UNION ALL SELECT q, p, d FROM pr)"
AX = ["a", "b"]


@query("j17_pair_distances", "syn_roles", f"WITH {PAIRS} SELECT p, q, R[d]R d FROM pr", done=True)
def _(r):
    return R.pair_distances(r, AX).withColumn("d", S.r6_length(F.col("d")))


@query("x03_scarcity_density", "syn_roles", f"WITH {PAIRS}, h AS (SELECT quantile_cont(d, 0.5) h FROM pr) SELECT p player_id, R[-ln(avg(exp(-0.5 * (d / h) ** 2)) + 1e-12)]R scarcity_density FROM bw, h GROUP BY p")
def _(r):
    return R.scarcity_density(r, AX)


@query("a36_kernel_mean", "syn_roles", f"WITH {PAIRS}, h AS (SELECT quantile_cont(d, 0.5) h FROM pr) SELECT p player_id, R[avg(exp(-0.5 * (d / h) ** 2))]R density FROM bw, h GROUP BY p")
def _(r):
    return R.scarcity_density(r, AX).select("player_id", (F.exp(-F.col("scarcity_density")) - 1e-12).alias("density"))


POOL = f"{PAIRS}, tau AS (SELECT quantile_cont(d, 0.25) t FROM pr), k AS (SELECT bw.p id, count(*) k FROM bw JOIN syn_roles a ON a.player_id = bw.p JOIN syn_roles b ON b.player_id = bw.q, tau WHERE d <= t AND b.quality >= a.quality GROUP BY 1)"


@query("x04_scarcity_pool", "syn_roles", f"WITH {POOL} SELECT r.player_id, R[CASE WHEN quality IS NOT NULL THEN -ln((coalesce(k, 0) + 1) * 1.0::DOUBLE / (SELECT count(*) FROM syn_roles)) END]R scarcity_pool FROM syn_roles r LEFT JOIN k ON k.id = r.player_id")
def _(r):
    return R.scarcity_pool(r, AX)


@query("a37_pool_size", "syn_roles", f"WITH {POOL} SELECT id player_id, k FROM k")
def _(r):
    return R.pool_sizes(r, AX).select(F.col("p").alias("player_id"), "k")


@query("a23_exact_quantiles", "syn_passes", "SELECT team, R[median(start_x)]R med, R[quantile_cont(end_x, 0.02)]R q02, R[quantile_cont(end_x, 0.98)]R q98, R[quantile_cont(end_y, 0.25)]R q25 FROM syn_passes GROUP BY team")
def _(p):
    x = quantiles(p, "start_x", {"med": 0.5}, ["team"]).join(quantiles(p, "end_x", {"q02": 0.02, "q98": 0.98}, ["team"]), "team")
    return x.join(quantiles(p, "end_y", {"q25": 0.25}, ["team"]), "team")


@query("a25_pearson", "syn_players", "SELECT team, R[corr(a, quality)]R r FROM syn_players GROUP BY team")
def _(p):
    return p.groupBy("team").agg(F.corr("a", "quality").alias("r"))


RANKS = "rk AS (SELECT team, rank() OVER (PARTITION BY team ORDER BY b) + (count(*) OVER (PARTITION BY team, b) - 1) / 2.0::DOUBLE ra, rank() OVER (PARTITION BY team ORDER BY quality) + (count(*) OVER (PARTITION BY team, quality) - 1) / 2.0::DOUBLE rb FROM syn_players WHERE quality IS NOT NULL)"


@query("a26_spearman", "syn_players", f"WITH {RANKS} SELECT team, R[corr(ra, rb)]R rho, count(*) n FROM rk GROUP BY team")
def _(p):
    return R.spearman(p, "b", "quality", ["team"])


@query("a27_ols_line", "syn_players", "SELECT team, R[regr_slope(quality, b)]R slope, R[regr_intercept(quality, b)]R intercept FROM syn_players GROUP BY team")
def _(p):
    return p.groupBy("team").agg(F.regr_slope("quality", "b").alias("slope"), F.regr_intercept("quality", "b").alias("intercept"))


@query("m15_orthogonality_gate", "syn_roles", f"WITH {PAIRS}, h AS (SELECT quantile_cont(d, 0.5) h FROM pr), s AS (SELECT p player_id, -ln(avg(exp(-0.5 * (d / h) ** 2)) + 1e-12) v FROM bw, h GROUP BY p) SELECT R[corr(v, quality)]R r, abs(corr(v, quality)) < 0.3 passed FROM s JOIN syn_roles USING (player_id)")
def _(r):
    d = R.scarcity_density(r, AX).join(r, "player_id").agg(F.corr("scarcity_density", "quality").alias("r"))
    return d.withColumn("passed", F.abs("r") < 0.3)


BW2 = "h AS (SELECT quantile_cont(d, 0.5) h FROM pr), s AS (SELECT p, -ln(avg(exp(-0.5 * (d / (h * 0.6)) ** 2)) + 1e-12) n, -ln(avg(exp(-0.5 * (d / (h * 1.6)) ** 2)) + 1e-12) w FROM bw, h GROUP BY p), r AS (SELECT rank() OVER (ORDER BY n) a, rank() OVER (ORDER BY w) b FROM s)"


@query("m14_bandwidth_sensitivity", "syn_roles", f"WITH {PAIRS}, {BW2} SELECT R[corr(a, b)]R rho, corr(a, b) >= 0.7 passed FROM r")
def _(r):
    d = R.scarcity_densities(r, AX, {"narrow": 0.6, "wide": 1.6})
    return rank_correlation(d, "narrow", "wide").select("rho", (F.col("rho") >= 0.7).alias("passed"))


HALF = "h AS (SELECT match_id % 2 AS half, team, passer, avg(start_x) v FROM syn_passes GROUP BY ALL), j AS (SELECT a.team, a.passer, a.v x, b.v y FROM h a JOIN h b ON a.team = b.team AND a.passer = b.passer AND a.half = 0 AND b.half = 1)"


@query("j07_split_half_join", "syn_passes", f"WITH {HALF} SELECT team, passer, R[x]R x, R[y]R y FROM j")
def _(p):
    return halves(p)


def halves(p):
    """A player's mean position in either half of the matches."""
    h = p.groupBy((F.col("match_id") % 2).alias("half"), "team", "passer").agg(F.avg("start_x").alias("v"))
    return h.where("half = 0").select("team", "passer", F.col("v").alias("x")).join(h.where("half = 1").select("team", "passer", F.col("v").alias("y")), ["team", "passer"])


@query("x14_split_half_rho", "syn_passes", f"WITH {HALF}, r AS (SELECT rank() OVER (ORDER BY round(x, 9)) + (count(*) OVER (PARTITION BY round(x, 9)) - 1) / 2.0::DOUBLE a, rank() OVER (ORDER BY round(y, 9)) + (count(*) OVER (PARTITION BY round(y, 9)) - 1) / 2.0::DOUBLE b FROM j) SELECT R[corr(a, b)]R rho, count(*) n FROM r")
def _(p):
    return rank_correlation(halves(p).select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y")), "x", "y")


# --- names and links: every name (MET: whose id is divisible by 50) against all others of its club ---
ASKED = 50
NORM = r"nm AS (SELECT doc_id id, club, trim(regexp_replace(lower(strip_accents(coalesce(name, ''))), '[^\p{L}\p{N}]+', ' ', 'g')) norm FROM syn_names), tk AS (SELECT *, list_distinct(list_filter(string_split(norm, ' '), lambda w: w <> '')) t FROM nm)"
MET = f"""{NORM}, pr AS (SELECT a.id, b.id other, a.norm = b.norm ex, len(list_intersect(a.t, b.t)) s, len(a.t) na, len(b.t) nb, len(list_filter(list_intersect(a.t, b.t), lambda w: length(w) >= 4)) > 0 anchor
    FROM tk a JOIN tk b ON a.id <> b.id AND (a.club = b.club OR a.club IS NULL) WHERE a.id % {ASKED} = 0),
  sc AS (SELECT *, CASE WHEN ex THEN 1.0::DOUBLE WHEN na > 0 AND nb > 0 THEN s * 1.0::DOUBLE / (na + nb - s) ELSE 0.0::DOUBLE END score FROM pr),
  be AS (SELECT id, arg_min(other, {{'a': NOT ex, 's': -score, 'o': other}}) best, bool_or(ex) ex, max(score) score, count(*) FILTER (anchor) anchors, min(other) FILTER (anchor) anchored FROM sc GROUP BY id),
  li AS (SELECT nm.id, CASE WHEN ex THEN 'exact' WHEN score >= 0.34 THEN 'token' WHEN anchors = 1 THEN 'surname' WHEN anchors > 1 THEN 'ambiguous' ELSE 'none' END AS method, coalesce(score, 0) score, best, anchored FROM nm LEFT JOIN be USING (id) WHERE nm.id % {ASKED} = 0),
  lk AS (SELECT id, CASE WHEN method IN ('exact', 'token') THEN best WHEN method = 'surname' THEN anchored END tm_id, score, method FROM li)"""
#: The same for every name.
EVERY = MET.replace(f" WHERE a.id % {ASKED} = 0", "").replace(f" WHERE nm.id % {ASKED} = 0", "")


def named(n):
    """Every name, normalised; letters and digits of other scripts stay as they are."""
    return n.select(F.col("doc_id").alias("id"), "club", S.normalize_name("name").alias("norm"))


@query("f01_normalize_name", "syn_names", f"WITH {NORM} SELECT id, norm FROM nm")
def _(n):
    return named(n).select("id", "norm")


def normalised(n):
    """`named` as a written table, dealt over the cores: it is read several times, and normalising costs most of a small job."""
    return kept(named(spread(n)), "names")


def blocked(n, every=ASKED, work=X.pairs_of_sets, schema="id bigint, other bigint, ta array<string>, tb array<string>", rows=X.ASKED):
    """`work` on blocks of the names asked for and of all names of their club (or of all, without a club). A name without an id
    has no pair."""
    d = normalised(n).where("id is not null")
    asked, others = K.in_pools(d.where(F.col("id") % every == 0), d.select(F.col("id").alias("other"), "club", F.col("norm").alias("other_norm")))
    return X.met(asked.select("_pool", "id", "norm"), others.select("_pool", "other", "other_norm"), "_pool", "id", "other", work, schema, rows)


@query("f02_token_jaccard", "syn_names", f"WITH {EVERY} SELECT id, other, R[CASE WHEN na > 0 AND nb > 0 THEN s * 1.0::DOUBLE / (na + nb - s) ELSE 0 END]R score FROM pr")
def _(n):
    return blocked(n, 1, X.every_pair, "id bigint, other bigint, score double", 1024)


@query("f03_surname_anchor", "syn_names", f"WITH {MET} SELECT id, count(*) FILTER (anchor) anchors FROM pr GROUP BY id")
def _(n):
    d = blocked(n, ASKED, X.long_shared, "id bigint, met bigint, anchors bigint")
    return d.groupBy("id").agg(F.sum("met").alias("met"), F.sum("anchors").alias("anchors")).where("met > 0").drop("met")


@query("f04_club_core", "syn_names", f"WITH {NORM} SELECT id, len(list_filter(t, lambda w: w NOT IN ({', '.join(map(repr, S.CLUB_WORDS))})))::INT n FROM tk")
def _(n):
    return named(n).select("id", F.size(S.club_core(F.col("norm"))).alias("n"))


@query("u03_token_sets", "syn_names", f"WITH {EVERY} SELECT id, sum(s)::BIGINT shared, sum(na + nb - s)::BIGINT total FROM pr GROUP BY id")
def _(n):
    d = normalised(n).where("id is not null").select("id", "club", F.array_distinct(F.filter(F.split("norm", " "), lambda w: w != "")).alias("t"))
    return K.sums_of_sets(*K.in_pools(d, d))


def linked(n, every=ASKED):
    """Every name asked for against the other names of its club."""
    d = normalised(n)
    return K.link_players(d.where(F.col("id") % every == 0) if every > 1 else d, d.where("id is not null").select(F.col("id").alias("tm_id"), F.col("norm").alias("tm_norm"), "club", F.col("id").alias("ord")), same=True)


@query("j12_fuzzy_links", "syn_names", f"WITH {MET} SELECT id, tm_id, R[score]R score, method FROM lk")
def _(n):
    return linked(n)


@query("c12_link_audit", "syn_names", f"WITH {EVERY} SELECT id, R[score]R score, method FROM lk WHERE method <> 'exact' ORDER BY round(lk.score, 9), id LIMIT 25")
def _(n):
    return linked(n, 1).where("method <> 'exact'").orderBy(F.round("score", 9), F.asc_nulls_last("id")).limit(25).select("id", "score", "method")


@query("t04_lowest_confidence", "syn_names", f"WITH {EVERY} SELECT id, R[score]R score FROM lk WHERE tm_id IS NOT NULL ORDER BY round(lk.score, 9), id LIMIT 25")
def _(n):
    return linked(n, 1).where("tm_id is not null").orderBy(F.round("score", 9), "id").limit(25).select("id", "score")


@query("p24_exclusions", "syn_names", f"WITH {MET} SELECT id, CASE WHEN tm_id % 7 = 0 THEN NULL ELSE tm_id END tm_id, CASE WHEN tm_id % 7 = 0 THEN 'excluded' ELSE method END AS method FROM lk")
def _(n):
    d = linked(n).withColumn("club", F.lit("x"))
    bad = d.where("tm_id % 7 = 0").select("tm_id", "club").distinct()
    return K.exclude(d, bad).select("id", "tm_id", "method")


@query("a33_link_rate", "syn_names", f"WITH {MET} SELECT R[avg(CASE WHEN tm_id IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END)]R linked, count(*) n FROM lk")
def _(n):
    return linked(n).agg(F.avg(F.col("tm_id").isNotNull().cast("double")).alias("linked"), F.count("*").alias("n"))


@query("j13_club_match", "nation region", """WITH t AS (SELECT lower(n_name) team, list_distinct(string_split(lower(n_name), ' ')) tc FROM nation), c AS (SELECT r_regionkey::INT club_id, lower(r_name) || ' ' || lower(n_name) club FROM region JOIN nation ON n_regionkey = r_regionkey),
    m AS (SELECT team, c.club, club_id, len(list_intersect(tc, list_distinct(string_split(c.club, ' ')))) * 1.0::DOUBLE / len(list_distinct(list_concat(tc, string_split(c.club, ' ')))) s FROM t, c)
    SELECT team, arg_min(club_id, {'s': -s, 'o': club}) club_id FROM m WHERE s > 0 GROUP BY team""")
def _(n, r):
    clubs = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("r_regionkey").cast("int").alias("club_id"), F.concat_ws(" ", F.lower("r_name"), F.lower("n_name")).alias("club"))
    return K.match_clubs(n.select(F.lower("n_name").alias("team")), clubs.withColumn("ord", F.col("club"))).where("club_id is not null")


# --- values over time ---
ASOF = "ao AS (SELECT c.c_custkey player_id, arg_max(v.value, {'d': v.day, 't': v.tiebreak}) v FROM customer c LEFT JOIN syn_valuations v ON v.player_id = c.c_custkey AND v.day <= DATE '1998-01-01' GROUP BY 1)"


def valued_at(c, v, day="1998-01-01"):
    left = c.select(F.col("c_custkey").alias("player_id")).withColumn("on", F.lit(day).cast("date"))
    return K.as_of(left, v, "player_id", "on")


@query("j11_asof_value", "customer syn_valuations", f"WITH {ASOF} SELECT player_id, R[v]R value FROM ao")
def _(c, v):
    return valued_at(c, v).select("player_id", "value")


@query("w06_point_in_time", "customer syn_valuations", f"WITH {ASOF} SELECT count(v) priced, R[median(v)]R median_value FROM ao")
def _(c, v):
    return valued_at(c, v).agg(F.count("value").alias("priced"), F.median("value").alias("median_value"))


@query("j08_checked_join", "customer syn_valuations nation", f"WITH {ASOF} SELECT n_name, count(*) n, count(v) priced FROM ao JOIN customer ON c_custkey = player_id JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
def _(c, v, n):
    d = K.checked_left_join(c.select(F.col("c_custkey").alias("player_id"), "c_nationkey"), valued_at(c, v).select("player_id", "value"), ["player_id"])
    return d.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("n"), F.count("value").alias("priced"))


FEAT = f"""{ASOF}, pf AS (SELECT ao.player_id, v, DATE '1970-01-01' + (player_id * 37 % 9000)::INT dob, CASE WHEN player_id % 13 = 0 THEN NULL ELSE player_id % 80 END caps, player_id % 900 n_passes,
    ['DEF', 'MID', 'FWD'][(player_id % 3)::INT + 1] position, CASE WHEN player_id % 20 = 0 THEN NULL ELSE (player_id * 61 % 997)::DOUBLE / 100 END quality FROM ao),
  ft AS (SELECT player_id, quality, datediff('day', dob, DATE '2024-03-01') / 365.25::DOUBLE age, ln(1 + n_passes) log_passes, ln(1 + coalesce(caps, 0)) log_caps, ln(v) log_value, CASE WHEN position = 'MID' THEN 1.0::DOUBLE ELSE 0 END pos_MID,
    CASE WHEN position = 'FWD' THEN 1.0::DOUBLE ELSE 0 END pos_FWD FROM pf WHERE v IS NOT NULL AND quality IS NOT NULL)"""


def priced(c, v):
    d = valued_at(c, v).withColumnRenamed("value", "market_value")
    i = F.col("player_id")
    return d.select("player_id", "market_value", F.date_add(F.lit("1970-01-01").cast("date"), (i * 37 % 9000).cast("int")).alias("date_of_birth"), F.when(i % 13 != 0, i % 80).alias("caps"), (i % 900).alias("n_passes"), F.element_at(F.array(F.lit("DEF"), F.lit("MID"), F.lit("FWD")), (i % 3 + 1).cast("int")).alias("position"), F.when(i % 20 != 0, (i * 61 % 997).cast("double") / 100.0).alias("quality"))


@query("m12_price_features", "customer syn_valuations", f"WITH {FEAT} SELECT player_id, R[quality]R quality, R[age]R age, R[age * age]R age_sq, R[log_passes]R log_passes, R[log_caps]R log_caps, R[log_value]R log_value, pos_MID, pos_FWD FROM ft")
def _(c, v):
    return K.price_features(priced(c, v), "2024-03-01")


CHAIN = r"""sq AS (SELECT DISTINCT c_nationkey club_id, o_custkey tm FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority = '1-URGENT' AND o_orderdate::DATE BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'),
  ro AS (SELECT c_custkey player_id, n_name team, n_nationkey nk, CASE c_custkey % 7 WHEN 1 THEN 'Jr. ' || c_name WHEN 2 THEN 'Unknown ' || right(c_name, 9) || ' Of The Long Name' WHEN 3 THEN 'nobody' ELSE c_name END name FROM customer JOIN nation ON n_nationkey = c_nationkey),
  nr AS (SELECT player_id, team, nk, trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) norm FROM ro), nm AS (SELECT c_custkey tm, trim(regexp_replace(lower(c_name), '[^\p{L}\p{N}]+', ' ', 'g')) norm FROM customer),
  tk AS (SELECT n_nationkey nk, list_filter(string_split(trim(regexp_replace(lower(n_name), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w NOT IN (WORDS)) t FROM nation),
  cm AS (SELECT a.nk, arg_min(b.nk, {'s': -len(list_intersect(a.t, b.t)) * 1.0::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 'o': b.nk}) club FROM tk a JOIN tk b ON len(list_intersect(a.t, b.t)) > 0 WHERE b.nk IN (SELECT club_id FROM sq) GROUP BY a.nk),
  pl AS (SELECT nr.player_id, sq.tm FROM nr JOIN cm USING (nk) JOIN sq ON sq.club_id = cm.club UNION ALL SELECT nr.player_id, nm.tm FROM nr, nm WHERE nr.nk NOT IN (SELECT nk FROM cm)),
  pr AS (SELECT nr.player_id, pl.tm, nr.norm = nm.norm ex, string_split(nr.norm, ' ') a, string_split(nm.norm, ' ') b FROM nr JOIN pl USING (player_id) JOIN nm USING (tm)),
  sc AS (SELECT player_id, tm, ex, CASE WHEN ex THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) * 1.0::DOUBLE / len(list_distinct(list_concat(a, b))) END s, len(list_filter(list_intersect(a, b), lambda w: length(w) >= 4)) > 0 anchor FROM pr),
  be AS (SELECT player_id, arg_min(tm, {'x': NOT ex, 's': -s, 'o': tm}) best, bool_or(ex) ex, max(s) s, count(*) FILTER (anchor) k, min(tm) FILTER (anchor) one FROM sc GROUP BY 1),
  li AS (SELECT *, CASE WHEN ex THEN 'exact' WHEN s >= 0.34 THEN 'token' WHEN k = 1 THEN 'surname' WHEN k > 1 THEN 'ambiguous' ELSE 'none' END me FROM be),
  lk AS (SELECT player_id, CASE WHEN me IN ('exact', 'token') THEN best WHEN me = 'surname' THEN one END tm, s, me FROM li),
  va AS (SELECT lk.*, (SELECT arg_max(o_totalprice, {'d': o_orderdate, 't': o_orderkey}) FROM orders WHERE o_custkey = lk.tm AND o_orderdate::DATE <= DATE '1998-01-01') v FROM lk)
  SELECT ro.player_id, ro.team, CASE WHEN tm % 97 = 5 THEN NULL ELSE tm END tm_id, R[coalesce(s, 0)]R score, CASE WHEN tm % 97 = 5 THEN 'excluded' ELSE coalesce(me, 'none') END AS method, R[CASE WHEN tm % 97 = 5 THEN NULL ELSE v END]R market_value FROM ro LEFT JOIN va USING (player_id)""".replace("WORDS", ", ".join(map(repr, S.CLUB_WORDS)))


def market_of(c, n, o):
    """Roles, appearances, clubs, players, valuations and known wrong links, drawn from customers and their orders."""
    i = F.col("c_custkey")
    odd = F.when(i % 7 == 1, F.concat(F.lit("Jr. "), "c_name")).when(i % 7 == 2, F.concat(F.lit("Unknown "), F.right(F.col("c_name"), F.lit(9)), F.lit(" Of The Long Name"))).when(i % 7 == 3, F.lit("nobody")).otherwise(F.col("c_name"))
    roles = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(i.alias("player_id"), F.col("n_name").alias("team"), odd.alias("name"))
    appearances = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_custkey").alias("player_id"), F.col("c_nationkey").alias("player_club_id"), F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("competition_id"))
    clubs, players = n.select(F.col("n_nationkey").alias("club_id"), F.col("n_name").alias("name")), c.select(i.alias("player_id"), F.col("c_name").alias("name"))
    valuations = o.select(F.col("o_custkey").alias("player_id"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_orderkey").alias("tiebreak"), F.col("o_totalprice").cast("double").alias("value"))
    wrong = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).where(i % 97 == 5).select(i.alias("tm_id"), F.col("n_name").alias("team"))
    return roles, appearances, clubs, players, valuations, wrong


@query("c13_price_data", "customer nation orders", f"WITH {CHAIN}")
def _(c, n, o):
    """The chain: season squads, clubs by name, players by name within their club's squad, values at a date, wrong links out."""
    roles, appearances, clubs, players, valuations, wrong = market_of(c, n, o)
    out = K.price_data(roles, appearances, clubs, players, valuations, "1-URGENT", ("1996-01-01", "1996-12-31"), "1998-01-01", wrong)
    return out.select("player_id", "team", "tm_id", "score", "method", "market_value")


@query("c13_priced_by_position", "customer syn_valuations", f"WITH {FEAT} SELECT position, count(*) n, count(v) priced, R[avg(v)]R mean_value FROM pf GROUP BY position")
def _(c, v):
    return priced(c, v).groupBy("position").agg(F.count("*").alias("n"), F.count("market_value").alias("priced"), F.avg("market_value").alias("mean_value"))


@query("f11_age_years", "customer syn_valuations", f"WITH {FEAT} SELECT player_id, R[age]R age FROM ft")
def _(c, v):
    return K.price_features(priced(c, v), "2024-03-01").select("player_id", "age")


@query("p21_position_dummies", "customer syn_valuations", f"WITH {FEAT} SELECT pos_MID, pos_FWD, count(*) n FROM ft GROUP BY ALL")
def _(c, v):
    return K.price_features(priced(c, v), "2024-03-01").groupBy("pos_MID", "pos_FWD").agg(F.count("*").alias("n"))


@query("a30_describe", "syn_valuations", "SELECT count(value) n, R[avg(value)]R mean, R[stddev_samp(value)]R std, R[min(value)]R lo, R[quantile_cont(value, 0.25)]R q1, R[median(value)]R q2, R[quantile_cont(value, 0.75)]R q3, R[max(value)]R hi FROM syn_valuations")
def _(v):
    q = lambda p: F.percentile("value", F.lit(p))
    return v.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("lo"), q(0.25).alias("q1"), q(0.5).alias("q2"), q(0.75).alias("q3"), F.max("value").alias("hi"))


@query("w07_first_per_key", "syn_valuations", "SELECT player_id, arg_min(value, {'d': day, 't': tiebreak}) value FROM syn_valuations GROUP BY 1")
def _(v):
    return v.groupBy("player_id").agg(F.min_by("value", F.struct("day", "tiebreak")).alias("value"))


@query("w08_rank_in_pool", "syn_valuations", "SELECT player_id, tiebreak FROM (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY value DESC, tiebreak) k FROM syn_valuations) WHERE k = 1")
def _(v):
    w = Window.partitionBy("player_id").orderBy(F.desc("value"), "tiebreak")
    return v.withColumn("k", F.row_number().over(w)).where("k = 1").select("player_id", "tiebreak")


@query("a28_distinct", "syn_passes", "SELECT team, count(DISTINCT match_id) n, list_sort(list_distinct(list(passer)))[1:3]::VARCHAR first3 FROM syn_passes GROUP BY team")
def _(p):
    return p.groupBy("team").agg(F.count_distinct("match_id").alias("n"), F.concat(F.lit("["), F.array_join(F.slice(F.sort_array(F.collect_set("passer")), 1, 3), ", "), F.lit("]")).alias("first3"))


@query("a29_frequencies", "syn_passes", "SELECT team, count(*) n, R[count(*) * 1.0::DOUBLE / sum(count(*)) OVER ()]R share FROM syn_passes GROUP BY team")
def _(p):
    return p.groupBy("team").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


@query("a11_named_aggregates", "syn_passes", "SELECT completed, count(*) n, R[avg(end_x)]R mean_x, R[median(end_x)]R median_x FROM syn_passes GROUP BY completed")
def _(p):
    return p.groupBy("completed").agg(F.count("*").alias("n"), F.avg("end_x").alias("mean_x"), F.median("end_x").alias("median_x"))
