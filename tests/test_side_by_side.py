"""Fits of folds run side by side while their rows are few, one after another beyond."""

import threading

import pytest

from touchline.operators import models as M


def test_small_fits_run_at_once(spark):
    df, met = spark.range(10).toDF("v"), threading.Barrier(3)

    def fit(k):
        met.wait(60)  # ends only if all three are there
        return k, df.where(df.v < k).count()

    assert M.side_by_side(df, [lambda k=k: fit(k) for k in (3, 5, 7)]) == [(3, 3), (5, 5), (7, 7)]


def test_large_fits_run_one_by_one(spark, monkeypatch):
    monkeypatch.setattr(M, "ROWS_AT_ONCE", 15)
    here, most = [], []

    def fit():
        here.append(1)
        most.append(len(here))
        df.count()
        here.pop()

    df = spark.range(10)
    M.side_by_side(df, [fit] * 3)
    assert max(most) == 1


def test_an_error_of_a_fit_is_raised(spark):
    with pytest.raises(ZeroDivisionError):
        M.side_by_side(spark.range(3), [lambda: 1, lambda: 1 / 0])
