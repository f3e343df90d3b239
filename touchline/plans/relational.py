"""Queries: projections, filters, joins, sets, sorts and scalar functions that the other operators use."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions import scalar as S

from .base import query


@query("p01_affine_tracking", "syn_attempts", "SELECT seq, R[(sx - 0.5) * 105]R x, R[(sy - 0.5) * 68]R y FROM syn_attempts")
def _(e):
    x, y = S.tracking_to_metric(F.col("sx"), F.col("sy"))
    return e.select("seq", x.alias("x"), y.alias("y"))


@query("p02_event_units", "syn_log", "SELECT match_id, seq, R[(x / 120 - 0.5) * 105]R x, R[(0.5 - y / 80) * 68]R y FROM syn_log")
def _(log):
    x, y = S.events_to_metric(F.col("x"), F.col("y"))
    return log.select("match_id", "seq", x.alias("x"), y.alias("y"))


@query("p03_frames_round_trip", "syn_attempts", "SELECT seq, R[sx]R x, R[sy]R y FROM syn_attempts")
def _(e):
    x, y = S.metric_to_tracking(*S.tracking_to_metric(F.col("sx"), F.col("sy")))
    return e.select("seq", x.alias("x"), y.alias("y"))


@query("p04_players_of_team", "syn_passes", "SELECT DISTINCT team, passer FROM syn_passes")
def _(p):
    return p.select("team", "passer").distinct()


@query("p05_label_to_id", "syn_tracking", "SELECT DISTINCT trim(replace('Player ' || player_id, 'Player', '')) id FROM syn_tracking")
def _(t):
    return t.select(S.label_to_id(F.concat(F.lit("Player "), F.col("player_id").cast("string"))).alias("id")).distinct()


@query("p06_attempt_masks", "syn_attempts", "SELECT count(*) FILTER (type = 'PASS') passes, count(*) FILTER (type = 'BALL LOST' AND contains(coalesce(subtype, ''), 'INTERCEPTION')) failed FROM syn_attempts")
def _(e):
    failed = (F.col("type") == "BALL LOST") & F.contains(F.coalesce("subtype", F.lit("")), F.lit("INTERCEPTION"))
    return e.agg(F.count_if(F.col("type") == "PASS").alias("passes"), F.count_if(failed).alias("failed"))


@query("p09_event_recode", "syn_log", "SELECT CASE type WHEN 'Shot' THEN 'SHOT' WHEN 'Miscontrol' THEN 'BALL LOST' ELSE 'PASS' END kind, count(*) n FROM syn_log WHERE x IS NOT NULL GROUP BY 1")
def _(log):
    kind = F.when(F.col("type") == "Shot", "SHOT").when(F.col("type") == "Miscontrol", "BALL LOST").otherwise("PASS")
    return log.where("x is not null").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query("p10_located_events", "syn_log", "SELECT type, count(*) n FROM syn_log WHERE x IS NOT NULL GROUP BY type")
def _(log):
    located = F.when(F.col("x").isNotNull(), F.array("x", "y"))
    return log.where(F.size(F.coalesce(located, F.array().cast("array<double>"))) > 0).groupBy("type").agg(F.count("*").alias("n"))


@query("p13_drop_nulls", "syn_players", "SELECT player_id FROM syn_players WHERE quality IS NOT NULL AND a IS NOT NULL")
def _(p):
    return p.dropna(subset=["quality", "a"]).select("player_id")


@query("p16_date_range", "syn_valuations orders", "SELECT player_id, tiebreak FROM syn_valuations WHERE day BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' AND tiebreak IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def _(v, o):
    """Valuations of a half-year whose order has one priority, as the reference takes one competition."""
    urgent = o.where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("tiebreak"))
    return v.where("day between date '1996-01-01' and date '1996-06-30'").join(urgent, "tiebreak", "left_semi").select("player_id", "tiebreak")


@query("p17_numeric_range", "syn_passes", "SELECT count(*) n FROM syn_passes WHERE start_x BETWEEN -10 AND 20")
def _(p):
    return p.where(F.col("start_x").between(-10, 20)).agg(F.count("*").alias("n"))


@query("p18_membership", "syn_passes", "SELECT team, count(*) n FROM syn_passes WHERE match_id IN (1, 5, 9) AND team NOT IN (2, 3) GROUP BY team")
def _(p):
    return p.where(F.col("match_id").isin(1, 5, 9) & ~F.col("team").isin(2, 3)).groupBy("team").agg(F.count("*").alias("n"))


@query("p20_override", "syn_players", "SELECT player_id, R[coalesce(quality, b)]R v FROM syn_players")
def _(p):
    return p.select("player_id", F.coalesce("quality", "b").alias("v"))


@query("p25_period_filter", "syn_tracking", "SELECT player_id, R[avg(x)]R x FROM syn_tracking WHERE period = 1 GROUP BY 1")
def _(t):
    return t.where("period = 1").groupBy("player_id").agg(F.avg("x").alias("x"))


@query("j03_pass_frame_join", "syn_snapshots syn_log", "SELECT s.pass_id, l.type FROM syn_snapshots s JOIN syn_log l ON l.seq = s.pass_id")
def _(s, log):
    return s.select("pass_id").join(log.select(F.col("seq").alias("pass_id"), "type"), "pass_id")


@query("j04_possession_default", "syn_snapshots syn_log", "SELECT s.pass_id, coalesce(l.possession, 0) possession FROM syn_snapshots s LEFT JOIN syn_log l ON l.seq = s.pass_id")
def _(s, log):
    return s.select("pass_id").join(log.select(F.col("seq").alias("pass_id"), "possession"), "pass_id", "left").select("pass_id", F.coalesce("possession", F.lit(0)).alias("possession"))


@query("j09_left_to_profile", "syn_valuations customer", "SELECT v.tiebreak, c.c_name FROM syn_valuations v LEFT JOIN customer c ON c.c_custkey = v.player_id AND c.c_custkey % 2 = 0")
def _(v, c):
    return v.join(c.where("c_custkey % 2 = 0"), F.col("player_id") == F.col("c_custkey"), "left").select("tiebreak", "c_name")


@query("j10_name_lookup", "supplier nation", "SELECT s_suppkey, n_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def _(s, n):
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"), "left").select("s_suppkey", "n_name")


@query("j19_common_keys", "syn_passes", "SELECT DISTINCT passer FROM syn_passes WHERE team = 1 AND passer IN (SELECT passer FROM syn_passes WHERE team = 2)")
def _(p):
    return p.where("team = 1").select("passer").distinct().join(p.where("team = 2").select("passer").distinct(), "passer")


@query("j20_overlap_report", "syn_snapshots syn_log", "SELECT match_id, count(*) n, count(*) FILTER (pass_id IN (SELECT seq FROM syn_log)) hit FROM syn_snapshots GROUP BY match_id")
def _(s, log):
    seen = log.select(F.col("seq").alias("pass_id"), F.lit(1).alias("hit")).distinct()
    return s.select("match_id", "pass_id").join(seen, "pass_id", "left").groupBy("match_id").agg(F.count("*").alias("n"), F.count("hit").alias("hit"))


@query("j21_fallback_pool", "syn_players", "SELECT team, CASE WHEN count(*) FILTER (b > 9.9) = 0 THEN count(*) ELSE count(*) FILTER (b > 9.9) END pool FROM syn_players GROUP BY team")
def _(p):
    inside = p.where("b > 9.9").groupBy("team").agg(F.count("*").alias("pool"))
    rest = p.join(inside, "team", "left_anti").groupBy("team").agg(F.count("*").alias("pool"))
    return inside.unionByName(rest)


@query("t02_head", "syn_valuations", "SELECT tiebreak FROM syn_valuations ORDER BY day, tiebreak LIMIT 20")
def _(v):
    return v.orderBy("day", "tiebreak").limit(20).select("tiebreak")


@query("t03_sorted_ranks", "syn_players", "SELECT player_id, row_number() OVER (PARTITION BY team ORDER BY a DESC, player_id) k FROM syn_players")
def _(p):
    return p.select("player_id", F.row_number().over(Window.partitionBy("team").orderBy(F.desc("a"), "player_id")).alias("k"))


@query("t05_by_value", "syn_passes", "SELECT team, count(*) n FROM syn_passes GROUP BY team ORDER BY n DESC, team LIMIT 5")
def _(p):
    return p.groupBy("team").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "team").limit(5)


@query("t06_by_size", "syn_players", "SELECT player_id FROM syn_players ORDER BY abs(a) DESC, player_id LIMIT 15")
def _(p):
    return p.orderBy(F.abs("a").desc(), "player_id").limit(15).select("player_id")


@query("u01_bag_union", "syn_passes", "SELECT count(*) n FROM (SELECT team FROM syn_passes WHERE team < 3 UNION ALL SELECT team FROM syn_passes WHERE team < 5)")
def _(p):
    return p.where("team < 3").select("team").unionByName(p.where("team < 5").select("team")).agg(F.count("*").alias("n"))


@query("u02_intersection", "syn_passes", "SELECT count(*) n FROM (SELECT passer, recipient FROM syn_passes WHERE team = 1 INTERSECT SELECT passer, recipient FROM syn_passes WHERE team = 2)")
def _(p):
    pair = lambda t: p.where(F.col("team") == t).select("passer", "recipient")
    return pair(1).intersect(pair(2)).agg(F.count("*").alias("n"))


@query("u05_token_difference", "nation", "SELECT n_nationkey, len(list_filter(list_distinct(string_split(lower(n_name), ' ')), lambda w: w NOT IN ('united', 'of', 'de'))) n FROM nation")
def _(n):
    return n.select("n_nationkey", F.size(F.array_except(F.split(F.lower("n_name"), " "), F.array(F.lit("united"), F.lit("of"), F.lit("de")))).alias("n"))


@query("f05_strings", "syn_attempts", "SELECT seq, contains(upper(coalesce(subtype, '')), 'GOAL') goal, string_split(lower(team), 'o')[-1] tail, 'g' || period || '_' || seq k FROM syn_attempts")
def _(e):
    return e.select("seq", F.contains(F.upper(F.coalesce("subtype", F.lit(""))), F.lit("GOAL")).alias("goal"), F.element_at(F.split(F.lower("team"), "o"), -1).alias("tail"), F.concat(F.lit("g"), "period", F.lit("_"), "seq").alias("k"))


@query("f07_math", "syn_players", "SELECT player_id, R[sqrt(a * a + b * b)]R h, R[ln(1 + b)]R l, R[degrees(acos(b / 10))]R d, R[1 / (1 + exp(-b))]R s FROM syn_players")
def _(p):
    a, b = F.col("a"), F.col("b")
    return p.select("player_id", F.sqrt(a * a + b * b).alias("h"), F.log1p(b).alias("l"), F.degrees(F.acos(b / 10)).alias("d"), S.logistic(b).alias("s"))


@query("f08_zone_index", "syn_attempts", "SELECT seq, CAST(least(floor(least(0.999999, greatest(0.0, sx)) * 12), 11) AS INT) ix, CAST(least(floor(least(0.999999, greatest(0.0, sy)) * 8), 7) AS INT) iy FROM syn_attempts")
def _(e):
    return e.select("seq", S.zone(F.col("sx"), 12).alias("ix"), S.zone(F.col("sy"), 8).alias("iy"))


@query("f12_nulls", "syn_players", "SELECT count(*) FILTER (quality IS NULL) missing, R[avg(coalesce(quality, 0))]R filled FROM syn_players")
def _(p):
    return p.agg(F.count_if(F.col("quality").isNull()).alias("missing"), F.avg(F.coalesce("quality", F.lit(0.0))).alias("filled"))


@query("f14_json_paths", "syn_log", "SELECT seq, match_id, type, team, CASE WHEN x IS NOT NULL THEN R[x]R END x FROM syn_log")
def _(log):
    """Events as nested JSON, read back with the reader's schema."""
    from touchline.sources.files import EVENT

    j = F.to_json(F.struct(F.col("seq").cast("string").alias("id"), F.struct(F.col("type").alias("name")).alias("type"), F.struct(F.col("team").cast("string").alias("name")).alias("team"), F.when(F.col("x").isNotNull(), F.array("x", "y")).alias("location")))
    d = log.select("match_id", F.from_json(j, EVENT).alias("e"))
    return d.select(F.col("e.id").cast("long").alias("seq"), "match_id", F.col("e.type.name").alias("type"), F.col("e.team.name").cast("int").alias("team"), F.get("e.location", F.lit(0)).alias("x"))


@query("p08_all_pass_filter", "syn_passes", "SELECT match_id, team, count(*) n, count(*) FILTER (NOT completed) failed FROM syn_passes GROUP BY ALL")
def _(p):
    """Every recorded outcome counts as failed."""
    return p.groupBy("match_id", "team").agg(F.count("*").alias("n"), F.count_if(~F.col("completed")).alias("failed"))


@query("p14_row_guards", "syn_log", "SELECT match_id, count(*) n FROM syn_log WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1")
def _(log):
    return log.where(F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("match_id").agg(F.count("*").alias("n"))


@query("p15_keep_known", "syn_players", "SELECT player_id FROM syn_players WHERE quality IS NOT NULL AND a > 0 AND name IS NOT NULL")
def _(p):
    return p.where("quality is not null and a > 0 and name is not null").select("player_id")


@query("p19_columns", "syn_players", "SELECT player_id AS id, R[a + b]R total FROM syn_players")
def _(p):
    return p.withColumn("total", F.col("a") + F.col("b")).withColumnRenamed("player_id", "id").select("id", "total")


@query("s05_matches", "syn_snapshots", "SELECT match_id, count(*) passes, min(pass_id) first_pass FROM syn_snapshots GROUP BY match_id")
def _(s):
    return s.groupBy("match_id").agg(F.count("*").alias("passes"), F.min("pass_id").alias("first_pass"))


@query("s07_last_frame_wins", "syn_log", "SELECT match_id, possession, arg_max(type, seq) type FROM syn_log GROUP BY ALL")
def _(log):
    return log.groupBy("match_id", "possession").agg(F.max_by("type", "seq").alias("type"))


@query("s10_season_of_team", "syn_passes", "SELECT DISTINCT match_id FROM syn_passes WHERE team = 3 ORDER BY match_id")
def _(p):
    return p.where("team = 3").select("match_id").distinct().orderBy("match_id")


@query("s16_season_union", "syn_snapshots", "SELECT match_id, count(*) n FROM syn_snapshots WHERE match_id IN (SELECT DISTINCT match_id FROM syn_snapshots ORDER BY match_id LIMIT 5) GROUP BY match_id")
def _(s):
    """The first matches only, as the loader's limit gives them."""
    first = s.select("match_id").distinct().orderBy("match_id").limit(5)
    return s.join(F.broadcast(first), "match_id", "left_semi").groupBy("match_id").agg(F.count("*").alias("n"))


@query("s17_all_passes", "syn_passes", "SELECT match_id, team, passer, recipient, completed::INT completed, R[start_x]R start_x, R[end_y]R end_y FROM syn_passes")
def _(p):
    return p.select("match_id", "team", "passer", "recipient", F.col("completed").cast("int").alias("completed"), "start_x", "end_y")


@query("j06_left_network", "syn_passes", "WITH t AS (SELECT team, passer, count(*) n FROM syn_passes GROUP BY ALL), d AS (SELECT team, recipient passer, count(*) k FROM syn_passes WHERE completed AND passer <> recipient AND recipient < 20 GROUP BY ALL) SELECT t.team, t.passer, n, k FROM t LEFT JOIN d USING (team, passer)")
def _(p):
    t = p.groupBy("team", "passer").agg(F.count("*").alias("n"))
    d = p.where("completed and passer <> recipient and recipient < 20").groupBy("team", F.col("recipient").alias("passer")).agg(F.count("*").alias("k"))
    return t.join(d, ["team", "passer"], "left")


@query("j16_bearing_pairs", "syn_attempts", "SELECT seq, R[degrees(atan2(ey - sy, ex - sx))]R bearing FROM syn_attempts WHERE ex <> sx OR ey <> sy")
def _(e):
    return e.where("ex <> sx or ey <> sy").select("seq", F.degrees(F.atan2(F.col("ey") - F.col("sy"), F.col("ex") - F.col("sx"))).alias("bearing"))


@query("u04_index_intersection", "syn_players", "SELECT player_id FROM syn_players WHERE a > 0 AND player_id IN (SELECT player_id FROM syn_players WHERE b > 5)")
def _(p):
    return p.where("a > 0").select("player_id").join(p.where("b > 5").select("player_id"), "player_id")


@query("f06_formats", "syn_valuations", "SELECT tiebreak, CAST(round(value / 1000, 1) AS DECIMAL(12, 1))::VARCHAR || 'k' label FROM syn_valuations")
def _(v):
    return v.select("tiebreak", F.concat(F.round(F.col("value") / 1000, 1).cast("decimal(12,1)").cast("string"), F.lit("k")).alias("label"))


@query("f13_arrays", "syn_snapshots", "SELECT pass_id, len(frame) n, R[list_min(list_transform(frame, lambda p: p.x))]R lo, frame[-1].k::INT last FROM syn_snapshots")
def _(s):
    return s.select("pass_id", F.size("frame").cast("long").alias("n"), F.array_min(F.transform("frame", lambda p: p["x"])).alias("lo"), F.element_at("frame", -1)["k"].cast("int").alias("last"))


@query("f15_map_counts", "syn_log", "SELECT match_id, type, count(*) n FROM syn_log GROUP BY ALL")
def _(log):
    return log.groupBy("match_id", "type").agg(F.count("*").alias("n"))


@query("f16_conditionals", "syn_players", "SELECT player_id, CASE WHEN a < 0 THEN 'low' WHEN a < 5000 THEN 'mid' ELSE 'high' END band FROM syn_players")
def _(p):
    return p.select("player_id", F.when(F.col("a") < 0, "low").when(F.col("a") < 5000, "mid").otherwise("high").alias("band"))
