"""Expected threat: zone counts, transition probabilities, value iteration, lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from touchline.functions.scalar import mirror, num, safe_div, zone

NX, NY = 12, 8


def directions(events: DataFrame) -> DataFrame:
    """team, period, direction: +1 where a team shoots towards x = 1 on average, else -1.

    Without shots in a period the direction is the reverse of the other period's; with shots in neither, period 1 is +1
    and period 2 -1 (period 1 is settled first). Periods after the second are not filled.
    """
    shots = events.where("type = 'SHOT'").groupBy("team", "period").agg(F.avg("sx").alias("mean"))
    shots = shots.select("team", "period", F.when(F.col("mean") > 0.5, 1).otherwise(-1).alias("d"))
    grid = events.select("team").distinct().crossJoin(F.broadcast(events.sparkSession.range(1, 3).select(F.col("id").cast("int").alias("period"))))
    by = Window.partitionBy("team")
    known = grid.join(shots, ["team", "period"], "left")
    other = F.max(F.when(F.col("period") == 2, F.col("d"))).over(by), F.max(F.when(F.col("period") == 1, F.col("d"))).over(by)
    first = F.coalesce(other[1], -other[0], F.lit(1))
    filled = F.when(F.col("period") == 1, first).otherwise(F.coalesce("d", -first))
    return known.select("team", "period", filled.alias("direction")).unionByName(shots.where("period > 2").withColumnRenamed("d", "direction"))


def orient(events: DataFrame) -> DataFrame:
    """Turns by 180 degrees what a team does in a period in which it attacks towards x = 0."""
    turned = events.join(F.broadcast(directions(events)), ["team", "period"], "left").withColumn("direction", F.coalesce("direction", F.lit(1)))
    flip = lambda c: F.when(F.col("direction") == -1, num(1) - F.col(c)).otherwise(F.col(c)).alias(c)
    return turned.select(*[flip(c) if c in ("sx", "sy", "ex", "ey") else F.col(c) for c in events.columns], "direction")


def actions(passes: DataFrame) -> DataFrame:
    """type, goal, z0, z1 from a metric pass table; shots are those of every fifth passer near the goal."""
    x, y = F.col("start_x") / 105.0 + 0.5, num(0.5) - F.col("start_y") / 68.0
    ex, ey = F.col("end_x") / 105.0 + 0.5, num(0.5) - F.col("end_y") / 68.0
    shot = (F.col("start_x") > 30) & (F.col("passer") % 5 == 0)
    kind = F.when(shot, "SHOT").when(F.col("completed"), "PASS").otherwise("BALL LOST")
    return passes.select(kind.alias("type"), (shot & (F.col("recipient") % 3 == 0)).alias("goal"), (zone(y, NY) * NX + zone(x, NX)).alias("z0"), (zone(ey, NY) * NX + zone(ex, NX)).alias("z1"))


def zone_counts(acts: DataFrame) -> DataFrame:
    """z0, shots, goals, moves, losses of the zones that have actions."""
    n = lambda c: F.count_if(c)
    return acts.groupBy("z0").agg(n(F.col("type") == "SHOT").alias("shots"), n((F.col("type") == "SHOT") & F.col("goal")).alias("goals"), n(F.col("type") == "PASS").alias("moves"), n(F.col("type") == "BALL LOST").alias("losses"))


def zone_rates(counts: DataFrame) -> DataFrame:
    """z0, s, m, l, g: shares of shots, moves and losses, and goals a shot; 0 where there are none."""
    total = F.col("shots") + F.col("moves") + F.col("losses")
    return counts.select("z0", safe_div(F.col("shots"), total).alias("s"), safe_div(F.col("moves"), total).alias("m"), safe_div(F.col("losses"), total).alias("l"), safe_div(F.col("goals"), F.col("shots")).alias("g"))


def transitions(acts: DataFrame) -> DataFrame:
    """z0, z1, p: where a move from z0 ends."""
    c = acts.where("type = 'PASS'").groupBy("z0", "z1").agg(F.count("*").alias("n"))
    return c.select("z0", "z1", (F.col("n") / F.sum("n").over(Window.partitionBy("z0"))).alias("p"))


def value_iteration(rates: DataFrame, moves: DataFrame, zones: int = NX * NY, most: int = 200, tolerance: float = 1e-7) -> DataFrame:
    """zone, xt: xt <- s g + m (T xt) from 0, at most `most` sweeps, until no value changes by `tolerance`.

    One row holds the (fixed number of) zones, and the sweeps are one fold over it: no job a sweep.
    """
    spark = rates.sparkSession
    lists = moves.groupBy("z0").agg(F.collect_list(F.struct(F.col("z1").alias("z"), "p")).alias("tl"))
    grid = F.broadcast(spark.range(zones).select(F.col("id").cast("int").alias("z0")))
    full = grid.join(rates, "z0", "left").join(lists, "z0", "left")
    node = F.struct("z0", F.coalesce(F.col("s") * F.col("g"), num(0)).alias("sg"), F.coalesce("m", num(0)).alias("m"), F.coalesce("tl", F.array().cast("array<struct<z:int,p:double>>")).alias("tl"))
    row = full.agg(F.array_sort(F.collect_list(node)).alias("a"))
    sweep = f"""aggregate(sequence(1, {most}), named_struct('x', array_repeat(0D, {zones}), 'done', false), (s, k) ->
        CASE WHEN s.done THEN s ELSE aggregate(array(transform(a, c -> c.sg + c.m * aggregate(c.tl, 0D, (t, e) -> t + e.p * s.x[e.z]))), s,
          (u, nx) -> named_struct('x', nx, 'done', array_max(zip_with(nx, s.x, (p, q) -> abs(p - q))) < {tolerance!r}D)) END).x"""
    return row.select(F.posexplode(F.expr(sweep)).alias("zone", "xt"))


def surface(passes: DataFrame) -> DataFrame:
    acts = actions(passes)
    return value_iteration(zone_rates(zone_counts(acts)), transitions(acts))


def lookup(df: DataFrame, values: DataFrame, x: Column, y: Column, name: str, nx: int = NX, ny: int = NY, opponents: bool = False) -> DataFrame:
    """Adds the value of the zone of a normalised place; with `opponents` minus its value as they see it.

    The surface has nx x ny rows, so it is broadcast.
    """
    if opponents:
        x, y = mirror(x, y)
    z = values.select(F.col("zone").alias("_z"), F.col("xt").alias(name))
    out = df.withColumn("_z", zone(y, ny) * nx + zone(x, nx)).join(F.broadcast(z), "_z", "left").drop("_z")
    return out.withColumn(name, -F.col(name)) if opponents else out
