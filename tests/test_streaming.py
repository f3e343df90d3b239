"""Streams against the same operators over tables: several files, rows out of order and late."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from touchline.operators import motion
from touchline.streaming.sink import latest
from touchline.streaming.velocities import velocities
from touchline.streaming.zone_counts import zone_counts


def parts(spark, path, files, schema):
    """A file a micro-batch, in order."""
    for k, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{k:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_velocities_of_late_frames_are_corrected(spark, tmp_path):
    r = random.Random(3)
    schema = "player_id int, period int, frame long, x double"
    rows = [(p, h, f, None if r.random() < 0.1 else p + f * 0.1 + r.random()) for p in range(4) for h in (1, 2) for f in r.sample(range(200), 60)]
    order = sorted(rows, key=lambda x: x[2] + r.random() * 25)  # frames come up to 25 late
    files = [order[k : k + 40] for k in range(0, len(order), 40)]
    got = latest(velocities(parts(spark, str(tmp_path), files, schema)), ["player_id", "period", "frame"])
    want = motion.velocities(spark.createDataFrame(rows, schema), ["player_id", "period"], ["x"])
    a, b = ({(x.player_id, x.period, x.frame): x.vx for x in d.collect()} for d in (got, want))
    assert set(a) == set(b) and len(a) == 480
    for k in b:
        assert a[k] == (None if b[k] is None else pytest.approx(b[k], abs=1e-9)), k


def test_frames_later_than_what_is_kept_change_nothing(spark, tmp_path):
    schema = "player_id int, period int, frame long, x double"
    first = [(1, 1, f, f * 0.1) for f in range(10, 100)]
    got = {x.frame: x.vx for x in latest(velocities(parts(spark, str(tmp_path), [first, [(1, 1, 5, 99.0), (1, 1, 100, 10.0)]], schema), kept=20), ["player_id", "period", "frame"]).collect()}
    assert 5 not in got and len(got) == 91 and all(v == pytest.approx(2.5) for v in got.values())


def test_windowed_counts_with_late_rows(spark, tmp_path):
    r = random.Random(5)
    at = datetime(2024, 1, 1)
    schema = "ts timestamp, x double, y double"
    rows = [(at + timedelta(seconds=30 * k), r.random(), r.random()) for k in range(300)]
    files = [rows[100:182] + rows[190:200], rows[182:190] + rows[200:300], [(at, 0.5, 0.5)]]  # some late rows within ten minutes, one far later
    got = latest(zone_counts(parts(spark, str(tmp_path), files, schema)), ["start", "zone"])
    want = zone_counts(spark.createDataFrame([x for f in files[:2] for x in f], schema))
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()}
    assert got.agg(F.sum("n")).first()[0] == 200
