"""Column expressions: coordinate frames, zones, guarded arithmetic, pitch control, names."""

from __future__ import annotations

import functools
import unicodedata
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

LENGTH, WIDTH = 105.0, 68.0  # metres
EVENT_LENGTH, EVENT_WIDTH = 120.0, 80.0  # units of the event provider


@dataclass(frozen=True)
class ControlParams:
    """Speed in m/s, reaction time in s, and the spread of arrival times."""

    max_speed: float = 5.0
    reaction_time: float = 0.7
    sigma: float = 0.45


def num(v: float) -> Column:
    return F.lit(float(v))


def clip(c: Column, low: float, high: float) -> Column:
    """Clipped to [low, high]; null stays null (least/greatest skip nulls, so a bare clip would invent a bound)."""
    return F.when(c.isNotNull(), F.least(num(high), F.greatest(num(low), c)))


def nan_to_null(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def safe_div(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b, and `default` where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(default).cast("double"))


def zone(v: Column, n: int) -> Column:
    """Cell 0 .. n-1 of a normalised coordinate; beyond the edge counts to the edge cell."""
    return F.least(F.floor(clip(v, 0.0, 0.999999) * n).cast("int"), F.lit(n - 1))


# coordinate frames: the two tracks differ in the direction of y
def tracking_to_metric(x: Column, y: Column) -> tuple[Column, Column]:
    return (x - 0.5) * LENGTH, (y - 0.5) * WIDTH


def metric_to_tracking(x: Column, y: Column) -> tuple[Column, Column]:
    return x / LENGTH + 0.5, y / WIDTH + 0.5


def events_to_metric(x: Column, y: Column) -> tuple[Column, Column]:
    return (x / EVENT_LENGTH - 0.5) * LENGTH, (num(0.5) - y / EVENT_WIDTH) * WIDTH


def metric_to_season(x: Column, y: Column) -> tuple[Column, Column]:
    return x / LENGTH + 0.5, num(0.5) - y / WIDTH


def mirror(x: Column, y: Column) -> tuple[Column, Column]:
    """A normalised place as the opponents see it (180 degrees)."""
    return num(1) - x, num(1) - y


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


@F.arrow_udf(DoubleType())
def length(dx: pa.Array, dy: pa.Array) -> pa.Array:
    """sqrt(dx ** 2 + dy ** 2) with the C library's pow, whose squares differ in the last bit from dx * dx once in some
    thousand: where a length is compared with a bound or with another length, this is what SQL engines compare."""
    return pc.sqrt(pc.add(pc.power(dx, 2.0), pc.power(dy, 2.0)))


@F.arrow_udf(StructType([StructField(c, DoubleType()) for c in "dxy"]))
def nearest_place(points: pa.Array, x: pa.Array, y: pa.Array) -> pa.Array:
    """The point of an array of struct<x, y> that is nearest to a place, by the C library's pow; the first of several at one
    distance; null of an empty array."""
    n = pc.fill_null(pc.list_value_length(points), 0).to_numpy(zero_copy_only=False)
    row, flat = np.repeat(np.arange(len(n)), n), points.flatten()
    px, py = (pc.struct_field(flat, c) for c in "xy")
    d = pc.sqrt(pc.add(pc.power(pc.subtract(px, x.take(pa.array(row))), 2.0), pc.power(pc.subtract(py, y.take(pa.array(row))), 2.0)))
    key = pc.if_else(pc.fill_null(pc.is_nan(d), False), np.inf, pc.fill_null(d, -np.inf)).to_numpy(zero_copy_only=False)  # a place that is not known sorts first
    starts = (np.cumsum(n) - n)[n > 0]
    least = np.repeat(np.minimum.reduceat(key, starts), n[n > 0]) if len(starts) else key
    at = np.flatnonzero(key == least)
    at = at[np.unique(row[at], return_index=True)[1]]
    where = np.full(len(n), -1)
    where[row[at]] = at
    pick = pa.array(where, mask=where < 0)
    return pa.StructArray.from_arrays([c.take(pick) for c in (d, px, py)], ["d", "x", "y"], mask=pa.array(where < 0))


def logistic(z: Column) -> Column:
    return num(1) / (num(1) + F.exp(-z))


# pitch control over arrays of struct<x, y[, vx, vy]>
def arrival(p: Column, tx: Column, ty: Column, params: ControlParams, moving: bool = False) -> Column:
    """Time until a player reaches a target: on for the reaction time as they run, then straight at full speed."""
    x, y = p["x"], p["y"]
    if moving:
        x = x + F.coalesce(p["vx"], num(0)) * params.reaction_time
        y = y + F.coalesce(p["vy"], num(0)) * params.reaction_time
    return num(params.reaction_time) + distance(tx, ty, x, y) / params.max_speed


def nearest_time(side: Column, tx: Column, ty: Column, params: ControlParams, moving: bool = False) -> Column:
    return F.array_min(F.transform(side, lambda p: arrival(p, tx, ty, params, moving)))


def control(attackers: Column, defenders: Column, tx: Column, ty: Column, params: ControlParams = ControlParams(), moving: bool = False) -> Column:
    """Chance that the attackers reach the target first; null if either side is empty."""
    lead = nearest_time(defenders, tx, ty, params, moving) - nearest_time(attackers, tx, ty, params, moving)
    return F.when((F.size(attackers) > 0) & (F.size(defenders) > 0), logistic(lead / params.sigma))


def nearest(points: Column, x: Column, y: Column) -> Column:
    """struct(d, i, p) of the nearest point of an array; the first of several at one distance."""
    return F.array_min(F.transform(points, lambda p, i: F.struct(distance(p["x"], p["y"], x, y).alias("d"), i.alias("i"), p.alias("p"))))


# names
#: Words of club names that do not tell clubs apart.
CLUB_WORDS = ["fc", "sc", "sv", "vfl", "vfb", "tsg", "spvgg", "bsc", "fsv", "1", "04", "05", "07", "98", "96", "1846", "1899", "1900", "borussia", "eintracht", "fussballclub", "fusballclub", "club", "de", "of"]
#: Granular positions of the event provider and their groups.
POSITION_GROUPS = {
    "GK": ["Goalkeeper"],
    "DEF": ["Center Back", "Left Center Back", "Right Center Back", "Left Back", "Right Back", "Left Wing Back", "Right Wing Back"],
    "MID": ["Center Defensive Midfield", "Left Defensive Midfield", "Right Defensive Midfield", "Left Center Midfield", "Right Center Midfield", "Left Midfield", "Right Midfield", "Center Attacking Midfield", "Left Attacking Midfield", "Right Attacking Midfield"],
    "FWD": ["Center Forward", "Left Center Forward", "Right Center Forward", "Left Wing", "Right Wing"],
}
POSITION_ORDER = ["GK", "DEF", "MID", "FWD"]


@functools.cache
def accents() -> dict[int, None]:
    """All combining marks, as `str.translate` drops them."""
    return dict.fromkeys(c for c in range(0x110000) if unicodedata.combining(chr(c)))


@F.pandas_udf(StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    """Accents folded, lower case, other marks as blanks, blanks collapsed; null as ''."""
    drop = accents()
    folded = names.fillna("").astype(str).str.normalize("NFKD").map(lambda s: s if s.isascii() else s.translate(drop)).str.lower()
    return folded.str.replace(r"[\W_]+", " ", regex=True).str.strip()


def words(name: Column) -> Column:
    return F.array_distinct(F.filter(F.split(name, " "), lambda w: w != ""))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two normalised names; 0 if either has none."""
    return set_jaccard(words(a), words(b))


def set_jaccard(ta: Column, tb: Column) -> Column:
    """Shared over all words of two arrays of words; 0 if either is empty."""
    shared = F.size(F.array_intersect(ta, tb))  # the arrays are sets
    return F.when((F.size(ta) > 0) & (F.size(tb) > 0), shared / (F.size(ta) + F.size(tb) - shared)).otherwise(num(0))


def surname_anchor(a: Column, b: Column, least: int = 4) -> Column:
    """Whether two normalised names share a word of four letters or more."""
    return F.coalesce(F.arrays_overlap(long_words(words(a), least), long_words(words(b), least)), F.lit(False))


def long_words(t: Column, least: int = 4) -> Column:
    return F.filter(t, lambda w: F.length(w) >= least)


def club_core(name: Column) -> Column:
    return F.array_except(words(name), F.array(*map(F.lit, CLUB_WORDS)))


def position_group(position: Column) -> Column:
    out = F.lit("UNK")
    for group, names in POSITION_GROUPS.items():
        out = F.when(position.isin(names), F.lit(group)).otherwise(out)
    return out


def position_order(group: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, g in enumerate(POSITION_ORDER):
        out = F.when(group == g, F.lit(k)).otherwise(out)
    return out


def position_by_depth(mean_x: Column) -> Column:
    """Group by mean position in metres along the pitch, before any normalisation."""
    return F.when(mean_x < -30, "GK").when(mean_x < -12, "DEF").when(mean_x < 12, "MID").otherwise("FWD")


def label_to_id(label: Column) -> Column:
    return F.trim(F.replace(label, F.lit("Player"), F.lit("")))


def years(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier) / num(365.25)


def r6(c: Column) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(c, 6) + num(0)


def r6_length(c: Column) -> Column:
    """`r6` by the SQL's own steps (times 1e6, the nearest whole number, halves up), where many millions of rows are rounded:
    `round` makes a decimal of each. Values that these steps do not hold for go by `r6`."""
    y = c * num(1e6)
    whole = F.floor(y)
    up = F.when(y - whole >= num(0.5), 1).otherwise(0)
    return F.when((c >= num(0)) & (c < num(2**32)), (whole + up) / num(1e6)).otherwise(r6(c))
