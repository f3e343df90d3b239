"""Role space: territory, style, pass networks and their centralities, normalisation, scarcity."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions.scalar import length, num, safe_div, tracking_to_metric
from touchline.operators import pairs
from touchline.operators.threat import directions

TERRITORY = ["mean_x", "mean_y", "dispersion", "def_share", "mid_share", "att_share"]
STYLE = ["fwd_share", "lat_share", "back_share", "mean_pass_dist", "std_pass_dist", "long_share"]
NETWORK = ["pagerank", "in_out_ratio", "clustering"]


def share(cond):
    return F.avg(F.when(cond, num(1)).otherwise(num(0)))


def territory_style(passes: DataFrame, least: int = 1) -> DataFrame:
    """team, player_id, n_passes, where a player passes from and how."""
    x, dx = F.col("start_x"), F.col("end_x") - F.col("start_x")
    dy = F.col("end_y") - F.col("start_y")
    d = F.col("_d")
    out = passes.withColumn("_d", length(dx, dy)).groupBy("team", F.col("passer").alias("player_id")).agg(
        F.count("*").alias("n_passes"), F.avg("start_x").alias("mean_x"), F.avg("start_y").alias("mean_y"), F.sqrt(F.var_pop("start_x") + F.var_pop("start_y")).alias("dispersion"),
        share(x < -17.5).alias("def_share"), share((x >= -17.5) & (x <= 17.5)).alias("mid_share"), share(x > 17.5).alias("att_share"),
        share(dx > 5).alias("fwd_share"), share(F.abs(dx) <= 5).alias("lat_share"), share(dx < -5).alias("back_share"), F.avg(d).alias("mean_pass_dist"), F.stddev_pop(d).alias("std_pass_dist"), share(d > 30).alias("long_share"),
    )
    return out.where(F.col("n_passes") >= least)


def network(passes: DataFrame) -> DataFrame:
    """team, src, dst, weight: completed passes between two known players."""
    return passes.where("completed and recipient is not null and passer <> recipient").groupBy("team", F.col("passer").alias("src"), F.col("recipient").alias("dst")).agg(F.count("*").alias("weight"))


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select("team", F.col("src").alias("node")).union(edges.select("team", F.col("dst").alias("node"))).distinct()


def in_out_ratio(edges: DataFrame) -> DataFrame:
    """team, node, in_w, out_w and (in + 1) / (out + 1)."""
    ins = edges.groupBy("team", F.col("dst").alias("node")).agg(F.sum("weight").alias("in_w"))
    outs = edges.groupBy("team", F.col("src").alias("node")).agg(F.sum("weight").alias("out_w"))
    both = ins.join(outs, ["team", "node"], "full").na.fill(0, ["in_w", "out_w"])
    return both.withColumn("in_out_ratio", (F.col("in_w") + 1) / (F.col("out_w") + 1))


def pagerank(edges: DataFrame, alpha: float = 0.85, most: int = 100, tolerance: float = 1e-6) -> DataFrame:
    """team, node, pagerank, weighted; one fold a team's (squad-sized) network; null where it does not converge."""
    by = Window.partitionBy("team").orderBy("node")
    idx = nodes(edges).withColumn("i", F.row_number().over(by) - 1)
    out = edges.groupBy("team", "src").agg(F.sum("weight").alias("w"))
    e = edges.join(out, ["team", "src"]).join(idx.select("team", F.col("node").alias("src"), F.col("i").alias("si")), ["team", "src"])
    into = e.groupBy("team", F.col("dst").alias("node")).agg(F.collect_list(F.struct(F.col("si").alias("z"), (F.col("weight") / F.col("w")).alias("p"))).alias("tl"))
    sends = edges.select("team", F.col("src").alias("node")).distinct().withColumn("sends", F.lit(True))
    n = idx.join(into, ["team", "node"], "left").join(sends, ["team", "node"], "left")
    item = F.struct("i", "node", F.coalesce("tl", F.array().cast("array<struct<z:int,p:double>>")).alias("tl"), F.col("sends").isNull().alias("dangling"))
    row = n.groupBy("team").agg(F.array_sort(F.collect_list(item)).alias("a")).withColumn("n", F.size("a").cast("double"))
    fold = f"""aggregate(sequence(1, {most}), named_struct('x', array_repeat(1D / n, size(a)), 'done', false), (s, k) ->
        CASE WHEN s.done THEN s ELSE aggregate(array(aggregate(filter(a, c -> c.dangling), 0D, (t, c) -> t + s.x[c.i])), s, (u, lost) ->
          aggregate(array(transform(a, c -> {alpha!r}D * (aggregate(c.tl, 0D, (t, e) -> t + e.p * s.x[e.z]) + lost / n) + {1 - alpha!r}D / n)), s,
            (v, nx) -> named_struct('x', nx, 'done', aggregate(zip_with(nx, s.x, (p, q) -> abs(p - q)), 0D, (t, d) -> t + d) < n * {tolerance!r}D))) END)"""
    solved = row.withColumn("r", F.expr(fold)).select("team", "a", F.when(F.col("r.done"), F.col("r.x")).alias("x"))
    return solved.select("team", F.explode(F.transform("a", lambda c: F.struct(c["node"].alias("node"), F.get(F.col("x"), c["i"]).alias("pagerank")))).alias("o")).select("team", "o.*")


def clustering(edges: DataFrame) -> DataFrame:
    """team, node, clustering of the undirected network. Between two nodes the weight of the edge that leaves the larger id holds
    (the reverse one only if it is alone); weights are divided by the largest; 0 for nodes with fewer than two neighbours."""
    u = edges.select("team", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "weight", (F.col("src") > F.col("dst")).alias("later"))
    u = u.groupBy("team", "a", "b").agg(F.max_by("weight", "later").alias("w"))
    u = u.withColumn("w", F.col("w") / F.max("w").over(Window.partitionBy("team")))
    both = u.union(u.select("team", F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    x, y, z = both.alias("x"), both.alias("y"), both.alias("z")
    tri = x.join(y, (F.col("x.team") == F.col("y.team")) & (F.col("x.b") == F.col("y.a")) & (F.col("x.a") != F.col("y.b"))).join(z, (F.col("y.team") == F.col("z.team")) & (F.col("y.b") == F.col("z.a")) & (F.col("z.b") == F.col("x.a")))
    closed = tri.groupBy(F.col("x.team").alias("team"), F.col("x.a").alias("node")).agg(F.sum(F.cbrt(F.col("x.w") * F.col("y.w") * F.col("z.w"))).alias("t"))
    degree = both.groupBy("team", F.col("a").alias("node")).agg(F.count("*").alias("k"))
    return degree.join(closed, ["team", "node"], "left").select("team", "node", safe_div(F.coalesce("t", num(0)), F.col("k") * (F.col("k") - 1)).alias("clustering"))


def betweenness(edges: DataFrame, team: str = "int") -> DataFrame:
    """team, node, betweenness: shares of shortest paths (length 1 / weight), normalised for directed networks.

    Brandes' algorithm on one team's network at a time: a squad has a few dozen nodes.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        out: dict[int, list[tuple[int, float]]] = {}
        for s, d, w in zip(pdf["src"], pdf["dst"], pdf["weight"]):
            out.setdefault(int(s), []).append((int(d), 1.0 / w))
        names = sorted({*map(int, pdf["src"]), *map(int, pdf["dst"])})
        score = dict.fromkeys(names, 0.0)
        for s in names:
            best, paths, before, order, queue = {s: 0.0}, {s: 1.0}, {s: []}, [], [(0.0, s)]
            done = set()
            while queue:
                d, v = heapq.heappop(queue)
                if v in done:
                    continue
                done.add(v)
                order.append(v)
                for w, length in out.get(v, ()):
                    new = d + length
                    if w not in best or new < best[w] - 1e-12:
                        best[w], paths[w], before[w] = new, paths[v], [v]
                        heapq.heappush(queue, (new, w))
                    elif abs(new - best[w]) <= 1e-12 and w not in done:
                        paths[w] += paths[v]
                        before[w].append(v)
            owed = dict.fromkeys(order, 0.0)
            for w in reversed(order):
                for v in before[w]:
                    owed[v] += paths[v] / paths[w] * (1 + owed[w])
                if w != s:
                    score[w] += owed[w]
        n = len(names)
        scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
        return pd.DataFrame({"team": pdf["team"].iloc[0], "node": names, "betweenness": [score[k] * scale for k in names]})

    return edges.groupBy("team").applyInPandas(one, f"team {team}, node int, betweenness double")


def role_features(passes: DataFrame, least: int = 1) -> DataFrame:
    """Territory, style and network of each player of each team; no network features for players without completed edges."""
    e = network(passes)
    net = pagerank(e).join(in_out_ratio(e).select("team", "node", "in_out_ratio"), ["team", "node"]).join(clustering(e), ["team", "node"])
    return territory_style(passes, least).join(net.withColumnRenamed("node", "player_id"), ["team", "player_id"], "left")


def oriented_passes(events: DataFrame) -> DataFrame:
    """Completed passes of tracked events (game_id, team, period, type, passer, recipient, sx .. ey in 0 .. 1) as a metric
    pass table in which every team attacks towards +x in every period of every game. Rows without a passer or a place go."""
    d = events.where("type = 'PASS' and passer is not null and sx is not null and sy is not null and ex is not null and ey is not null")
    games = directions(events.withColumn("team", F.struct("game_id", "team"))).select(F.col("team.game_id").alias("game_id"), F.col("team.team").alias("team"), "period", "direction")
    d = d.join(F.broadcast(games), ["game_id", "team", "period"], "left").withColumn("direction", F.coalesce("direction", F.lit(1)))
    ends = [c for x, y in (("sx", "sy"), ("ex", "ey")) for c in tracking_to_metric(F.col(x), F.col(y))]
    return d.select("game_id", "team", "passer", "recipient", F.lit(True).alias("completed"), *((c * F.col("direction")).alias(n) for c, n in zip(ends, ("start_x", "start_y", "end_x", "end_y"))))


def match_role_features(events: DataFrame, least: int = 10) -> DataFrame:
    """Role vectors of both teams' players in each match: oriented territory and style, and the network with betweenness;
    players with fewer passes are left out, those without edges have no network features."""
    passes = oriented_passes(events)
    side = F.concat_ws("/", F.col("game_id").cast("string"), F.col("team").cast("string"))
    passes = passes.withColumn("team", side)
    e = network(passes)
    far = betweenness(e, "string").withColumnRenamed("node", "player_id")
    out = role_features(passes, least).join(far, ["team", "player_id"], "left")
    return out.withColumn("game_id", F.substring_index("team", "/", 1).cast(events.schema["game_id"].dataType)).withColumn("team", F.substring_index("team", "/", -1))


def z_scores(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Each column as z-score within its group (sample deviation); 0 in groups without spread."""
    w = Window.partitionBy(*by)
    for c in columns:
        s = F.stddev_samp(c).over(w)
        df = df.withColumn(c, F.when(s.isNull() | (s == 0), num(0)).otherwise((F.col(c) - F.avg(c).over(w)) / s))
    return df


def pair_distances(df: DataFrame, axes: list[str], key: str = "player_id") -> DataFrame:
    """p, q, d of each pair p < q.

    Every player of the population needs every other's distance, so the pairs are the result: they are streamed where two
    ranges of players meet, so that a task keeps one range at a time and no player is sent to all tasks at once.
    """
    sides = (d.select("_g", "_h", F.col(key).alias(n), *[F.col(a).alias(f"{n}_{a}") for a in axes]) for n, d in zip("pq", pairs.in_ranges(df, key, axes)))
    left, right = sides
    total = num(0)
    for a in axes:
        total = total + (F.col(f"p_{a}") - F.col(f"q_{a}")) * (F.col(f"p_{a}") - F.col(f"q_{a}"))
    return left.join(right.hint("merge"), ["_g", "_h"]).where("p < q").select("p", "q", F.sqrt(total).alias("d"))


def neighbours(df: DataFrame, axes: list[str], k: int, key: str = "player_id") -> DataFrame:
    """p, q, d: the pairs p < q among which each player's k nearest are, found block by block."""
    d = df.select(F.lit(0).alias("_all"), F.col(key).alias("p"), F.array(*axes).alias("at"))
    kind = d.schema["p"].dataType.simpleString()
    near = pairs.met(d, d.select("_all", F.col("p").alias("q"), F.col("at").alias("there")), "_all", "p", "q", pairs.nearest_points(k), f"p {kind}, q {kind}, d double")
    return near.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "d").distinct()


def scarcity_densities(df: DataFrame, axes: list[str], scales: dict[str, float], key: str = "player_id") -> DataFrame:
    """player_id, and for each of `scales` -log of the mean Gaussian kernel to all others; bandwidth: the median distance x scale.
    Blocks of players meet in tasks, which give back sums a player."""
    h = pairs.distance_quantile(df, key, axes, 0.5)
    means = pairs.kernel_means(df, key, axes, [float("nan") if h is None else h * s for s in scales.values()])
    return means.select(F.col("p").alias("player_id"), *((-F.ln(F.col(f"k{k}") + 1e-12)).alias(name) for k, name in enumerate(scales)))


def scarcity_density(df: DataFrame, axes: list[str], key: str = "player_id") -> DataFrame:
    return scarcity_densities(df, axes, {"scarcity_density": 1.0}, key)


def pool_sizes(df: DataFrame, axes: list[str], key: str = "player_id") -> DataFrame:
    """p, k: how many others are as near as the lower quartile of distances and at least as good; without those that have none."""
    tau = pairs.distance_quantile(df, key, axes, 0.25)
    return pairs.better_within(df, key, axes, "quality", float("nan") if tau is None else tau)


def scarcity_pool(df: DataFrame, axes: list[str], key: str = "player_id") -> DataFrame:
    """player_id, scarcity_pool: -log((others as near as the lower quartile of distances and at least as good + 1) / N)."""
    q = df.select(F.col(key).alias("p"), "quality")
    n = df.agg(F.count("*").alias("n"))
    return q.join(pool_sizes(df, axes, key), "p", "left").crossJoin(F.broadcast(n)).select(F.col("p").alias(key), F.when(F.col("quality").isNotNull(), -F.ln((F.coalesce("k", F.lit(0)) + 1) / F.col("n"))).alias("scarcity_pool"))


def average_rank(c: str, by: list[str]):
    """Rank within a group; equals share their mean rank."""
    w = Window.partitionBy(*by)
    return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / num(2)


def spearman(df: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """by, rho, n over rows that have both values."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = d.withColumn("_a", average_rank(a, by)).withColumn("_b", average_rank(b, by))
    return d.groupBy(*by).agg(F.corr("_a", "_b").alias("rho"), F.count("*").alias("n"))
