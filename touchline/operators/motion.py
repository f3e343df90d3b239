"""Tracking: long form, smoothed velocities, control at targets, pressure, intended receivers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType
from pyspark.sql.window import Window

from touchline.functions.scalar import LENGTH, WIDTH, ControlParams, clip, distance, nearest_place, num
from touchline.operators.order import quantiles


def velocities(tracking: DataFrame, keys: list[str], axes: list[str], dt: float = 0.04, half: int = 3, limit: float = 12.0) -> DataFrame:
    """Adds v<axis>: first difference in a period, centred mean over 2 half + 1 frames, divided by dt, then clipped.

    A frame without a difference of its own takes its neighbours' mean; without any, null.
    """
    by = Window.partitionBy(*keys).orderBy("frame")
    for a in axes:
        tracking = tracking.withColumn(f"_d{a}", F.col(a) - F.lag(a).over(by))
    for a in axes:
        tracking = tracking.withColumn(f"v{a}", clip(F.avg(f"_d{a}").over(by.rowsBetween(-half, half)) / dt, -limit, limit))
    return tracking.drop(*(f"_d{a}" for a in axes))


def frame_step(tracking: DataFrame, time: str = "t") -> DataFrame:
    """dt: the median time between frames that follow each other (over the frames of all games; one row a frame)."""
    frames = tracking.select("game_id", "frame", time).distinct()
    step = F.col(time) - F.lag(time).over(Window.partitionBy("game_id").orderBy("frame"))
    return quantiles(frames.select(step.alias("d")), "d", {"dt": 0.5})


def sides(df: DataFrame) -> DataFrame:
    """Adds teammates (without the actor) and opponents, arrays of points in the order of the frame."""
    point = lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))
    return df.withColumn("teammates", F.transform(F.filter("frame", lambda p: p["teammate"] & ~p["actor"]), point)).withColumn("opponents", F.transform(F.filter("frame", lambda p: ~p["teammate"]), point))


def match_target(df: DataFrame) -> DataFrame:
    """Adds target_x, target_y, target_match_dist: the teammate nearest to where the pass ended."""
    df = df.withColumn("_t", nearest_place(F.col("teammates"), F.col("end_x"), F.col("end_y")))
    return df.select("*", F.col("_t.x").alias("target_x"), F.col("_t.y").alias("target_y"), F.col("_t.d").alias("target_match_dist")).drop("_t")


def pressure(opponents: Column, x: Column, y: Column) -> Column:
    """Distance of the nearest opponent."""
    return F.array_min(F.transform(opponents, lambda p: distance(p["x"], p["y"], x, y)))


def intended_receiver(candidates: DataFrame, key: str, most: float = 40.0) -> DataFrame:
    """key, receiver, angle: of candidates(key, id, ord, x, y, sx, sy, ex, ey) the one whose bearing deviates least from the
    ball's way, within `most` degrees; the first in `ord` of equals. No row without a direction or a candidate."""
    dx, dy = F.col("ex") - F.col("sx"), F.col("ey") - F.col("sy")
    vx, vy = F.col("x") - F.col("sx"), F.col("y") - F.col("sy")
    n, v = F.sqrt(dx * dx + dy * dy), F.sqrt(vx * vx + vy * vy)
    cosine = clip((vx / v) * (dx / n) + (vy / v) * (dy / n), -1.0, 1.0)
    seen = candidates.where((n >= 1e-6) & (v >= 1e-6)).withColumn("angle", F.degrees(F.acos(cosine)))
    best = seen.groupBy(key).agg(F.min_by(F.struct("id", "angle"), F.struct("angle", "ord")).alias("b"))
    return best.where(F.col("b.angle") <= most).select(key, F.col("b.id").alias("receiver"), F.col("b.angle").alias("angle"))


def receiver_in_frame(snapshots: DataFrame, most: float = 40.0) -> DataFrame:
    """Adds receiver, angle to rows with start, end and frame: the teammate (k, without the actor) whose bearing deviates
    least from the ball's way, within `most` degrees; the first in the frame of equals; null without one. Computed in the
    row: nothing is exploded or shuffled."""
    dx, dy = F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")
    n = F.sqrt(dx * dx + dy * dy)

    def turned(p: Column, i: Column) -> Column:
        vx, vy = p["x"] - F.col("start_x"), p["y"] - F.col("start_y")
        v = F.sqrt(vx * vx + vy * vy)
        angle = F.degrees(F.acos(clip((vx / v) * (dx / n) + (vy / v) * (dy / n), -1.0, 1.0)))
        return F.struct(F.when((n >= 1e-6) & (v >= 1e-6), angle).alias("angle"), i.alias("i"), p["k"].alias("k"))

    mates = F.transform(F.filter("frame", lambda p: p["teammate"] & ~p["actor"]), turned)
    best = snapshots.withColumn("_b", F.array_min(F.filter(mates, lambda m: m["angle"] <= most)))
    return best.select(*snapshots.columns, F.col("_b.k").alias("receiver"), F.col("_b.angle").alias("angle"))


#: Numbers that a slice of a grid holds at once (of rows x points), and players of a row that are looked at together.
SLICE, PLAYERS = 1 << 16, 32


def _squares(v: np.ndarray) -> np.ndarray:
    """By the C library's pow, as SQL engines compare lengths (see `scalar.length`)."""
    return np.float_power(v, 2.0)


def soonest(players: pa.Array, gx: np.ndarray, gy: np.ndarray, params: ControlParams = ControlParams()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of slices of rows of players (lists of struct<x, y>): the rows' places, and rows x gx x gy: when the first player is at
    a point. Rows without a player whose place is known are in no slice.

    A squared distance is one of len(gx) numbers of a player plus one of len(gy); the time rises with it.
    """
    n = pc.fill_null(pc.list_value_length(players), 0).to_numpy(zero_copy_only=False)
    flat = players.flatten()
    x, y = (pc.struct_field(flat, c) for c in "xy")
    known = pc.and_(pc.is_valid(x), pc.is_valid(y)).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(n)), n)[known]
    x, y = (c.to_numpy(zero_copy_only=False)[known] for c in (x, y))
    n = np.bincount(row, minlength=len(n))
    start, order = np.cumsum(n) - n, np.argsort(n, kind="stable")  # rows of a slice have players alike many
    order, size = order[n[order] > 0], max(1, SLICE // (len(gx) * len(gy)))
    for at in range(0, len(order), size):
        rows = order[at : at + size]
        least = np.full((len(rows), len(gx), len(gy)), np.nan)
        for k in range(0, n[rows[-1]], PLAYERS):
            who = np.arange(k, min(k + PLAYERS, n[rows[-1]]))
            who = start[rows][:, None] + np.minimum(who, n[rows][:, None] - 1)  # the last one again, where a row has fewer
            dx, dy = _squares(x[who][:, :, None] - gx), _squares(y[who][:, :, None] - gy)
            for j in range(who.shape[1]):
                np.fmin(least, dx[:, j, :, None] + dy[:, j, None, :], out=least)
        yield rows, params.reaction_time + np.sqrt(least) / params.max_speed


def control_grid(snapshot: DataFrame, nx: int = 50, ny: int = 34, params: ControlParams = ControlParams()) -> DataFrame:
    """ix, iy, gx, gy, control of every point of an inclusive grid for each row of `snapshot` (teammates, opponents); null if
    either side is empty. A row's grid is made at once, and exploded then."""
    step_x, step_y = LENGTH / (nx - 1), WIDTH / (ny - 1)
    gx, gy = np.arange(nx) * step_x - LENGTH / 2, np.arange(ny) * step_y - WIDTH / 2
    rows_at_once = max(1, (1 << 21) // (nx * ny))

    def grids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows_at_once):
                some = whole.slice(at, rows_at_once)
                t = np.full((2, some.num_rows, nx * ny), np.nan)
                seen = np.zeros((2, some.num_rows), dtype=bool)
                for k, side in enumerate(("teammates", "opponents")):
                    for rows, times in soonest(some.column(side), gx, gy, params):
                        t[k, rows], seen[k, rows] = times.reshape(len(rows), -1), True
                with np.errstate(over="ignore"):
                    p = 1 / (1 + np.exp(-(t[1] - t[0]) / params.sigma))
                cells = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, nx * ny), pa.int32()), pa.array(p.ravel(), mask=~np.repeat(seen.all(axis=0), nx * ny)))
                yield pa.RecordBatch.from_arrays([*some.columns, cells], names=[*some.schema.names, "_cells"])

    made = snapshot.mapInArrow(grids, StructType([*snapshot.schema.fields]).add("_cells", ArrayType(DoubleType())))
    cells = made.select(*snapshot.columns, F.posexplode("_cells").alias("_i", "control"))
    cells = cells.withColumn("ix", F.expr(f"_i div {ny}").cast("int")).withColumn("iy", (F.col("_i") % ny).cast("int"))
    return cells.select(*snapshot.columns, "ix", (F.col("ix") * step_x - LENGTH / 2).alias("gx"), "iy", (F.col("iy") * step_y - WIDTH / 2).alias("gy"), "control")


def player_grid(snapshot: DataFrame, nx: int = 12, ny: int = 8, params: ControlParams = ControlParams()) -> DataFrame:
    """ix, iy, attackers, defenders, led: of the middle of each of nx x ny cells, when either side's first player is there in
    the mean of all rows of `snapshot` (teammates, opponents), and in how many the teammates are first. Rows without one of
    the sides do not count. Tasks give back sums alone."""
    gx, gy = (np.arange(nx) + 0.5) * LENGTH / nx - LENGTH / 2, (np.arange(ny) + 0.5) * WIDTH / ny - WIDTH / 2

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, led = np.zeros((2, nx, ny)), np.zeros((nx, ny), dtype=np.int64)
        n = np.zeros(2, dtype=np.int64)
        for b in batches:
            some = b.filter(pc.fill_null(pc.and_(pc.greater(pc.list_value_length(b.column(0)), 0), pc.greater(pc.list_value_length(b.column(1)), 0)), False))
            t = np.full((2, some.num_rows, nx, ny), np.nan)
            seen = np.zeros((2, some.num_rows), dtype=bool)
            for k in range(2):
                for rows, times in soonest(some.column(k), gx, gy, params):
                    t[k, rows], seen[k, rows] = times, True
                total[k] += t[k][seen[k]].sum(axis=0)
            n += seen.sum(axis=1)
            both = t[:, seen.all(axis=0)]
            led += (np.nan_to_num(both[0], nan=np.inf) < np.nan_to_num(both[1], nan=np.inf)).sum(axis=0)
        ix, iy = (i.ravel() for i in np.indices((nx, ny)))
        yield pa.RecordBatch.from_pydict({"ix": ix, "iy": iy, "_a": total[0].ravel(), "_d": total[1].ravel(), "_na": np.full(nx * ny, n[0]), "_nd": np.full(nx * ny, n[1]), "_led": led.ravel()})

    found = snapshot.select("teammates", "opponents").mapInArrow(sums, "ix long, iy long, _a double, _d double, _na long, _nd long, _led long")
    mean = lambda s, n: F.sum(s) / F.nullif(F.sum(n), F.lit(0))
    return found.groupBy("ix", "iy").agg(mean("_a", "_na").alias("attackers"), mean("_d", "_nd").alias("defenders"), F.sum("_led").alias("led"), F.max(F.greatest("_na", "_nd")).alias("_n")).where("_n > 0").drop("_n")


def choice_set(df: DataFrame, widest: float | None = None) -> DataFrame:
    """Candidates of each pass within `widest` metres of the passer; the receiver always stays."""
    near = distance(F.col("x"), F.col("y"), F.col("sx"), F.col("sy")) <= num(widest) if widest is not None else F.lit(True)
    return df.where(near | (F.col("id") == F.col("receiver")))
