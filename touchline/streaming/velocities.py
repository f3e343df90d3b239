"""Smoothed velocities of a stream of positions, corrected as later and late frames come in."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Frames of a player and period that are remembered; a frame that is late by more of them is left out.
KEPT = 64


def smoothed(frames: pd.DataFrame, dt: float, half: int, limit: float) -> pd.Series:
    """First difference, centred mean over 2 half + 1 frames (of those that have one), in a second, clipped."""
    step = frames["x"].diff().rolling(2 * half + 1, center=True, min_periods=1).mean()
    return (step / dt).clip(-limit, limit)


def velocities(stream: DataFrame, dt: float = 0.04, half: int = 3, limit: float = 12.0, kept: int = KEPT) -> DataFrame:
    """player_id, period, frame, vx of a stream of (player_id, period, frame, x), in update mode: a frame is given when it
    comes, and again whenever a frame near it does, in whatever order; its last version is that of the batch operator.

    Each player and period keeps its last `kept` frames (and whether any went), packed; so state doesn't grow with time.
    """

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(parts))[["frame", "x"]]
        whole, old = True, pd.DataFrame({"frame": pd.Series(dtype="int64"), "x": pd.Series(dtype="float64")})
        if state.exists:
            (raw,) = state.get
            whole = raw[:1] == b"\1"
            pairs = list(struct.iter_unpack("<qd", raw[1:]))
            old = pd.DataFrame({"frame": pd.Series([p[0] for p in pairs], dtype="int64"), "x": pd.Series([p[1] for p in pairs], dtype="float64")})
        if not whole:  # what lies before the frames that are kept can't be placed any more
            new = new[new["frame"] > old["frame"].iloc[0]]
        if not len(new):
            return
        rows = pd.concat([old, new]).drop_duplicates("frame", keep="last").sort_values("frame", ignore_index=True)
        rows["vx"] = smoothed(rows, dt, half, limit)
        fresh = rows["frame"].isin(new["frame"])
        # a frame changes the difference of the next one, and these the means of the frames around
        touched = (fresh | fresh.shift(1, fill_value=False)).astype(float).rolling(2 * half + 1, center=True, min_periods=1).max() > 0
        if not whole:
            touched &= rows.index > half + 1
        tail = rows.iloc[-kept:]
        whole = whole and len(rows) <= kept
        state.update(((b"\1" if whole else b"\0") + b"".join(struct.pack("<qd", int(f), x) for f, x in zip(tail["frame"], tail["x"])),))
        out = rows[touched]
        yield pd.DataFrame({"player_id": key[0], "period": key[1], "frame": out["frame"], "vx": out["vx"].where(out["vx"].notna(), None)})

    return stream.groupBy("player_id", "period").applyInPandasWithState(update, "player_id int, period int, frame long, vx double", "packed binary", "update", GroupStateTimeout.NoTimeout)
