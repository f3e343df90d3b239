"""Resampled intervals against NumPy."""

import numpy as np
import pytest

from touchline.operators import bootstrap as B


def fit(x, y, w, penalty=1.0):
    """Newton's method for one weighted L2 logistic regression."""
    x = np.column_stack([np.ones(len(x)), x])
    ridge, beta = np.diag([0.0] + [penalty] * (x.shape[1] - 1)), np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-x @ beta))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (p - y)) + ridge @ beta)
        beta = beta - step
        if abs(step).max() < 1e-11:
            break
    return beta


@pytest.fixture(scope="module")
def rows():
    r = np.random.default_rng(4)
    x = np.column_stack([r.random(3000) * 0.3, r.random(3000)])
    y = (r.random(3000) < 1 / (1 + np.exp(2 - 4 * x[:, 0] - 1.2 * x[:, 1]))).astype(float)
    return x, y


def given(spark, x, y):
    return spark.createDataFrame([(k, *map(float, a), float(b)) for k, (a, b) in enumerate(zip(x, y))], "id long, zone double, control double, scored double")


def test_every_draw_equals_its_own_refit(spark, rows):
    x, y = rows
    df = given(spark, x, y).repartition(5)
    hashes = {r.id: r.h for r in df.selectExpr("id", "xxhash64(id) h").collect()}
    w = B.weights(np.array([hashes[k] for k in range(len(x))]), np.arange(6))
    got = {r.draw: (r.intercept, r.zone, r.control) for r in B.logistic_draws(df, ["zone", "control"], "scored", ["id"], draws=6).collect()}
    assert got[-1] == pytest.approx(fit(x, y, np.ones(len(x))), abs=1e-6)
    for d in range(6):
        assert got[d] == pytest.approx(fit(x, y, w[:, d]), abs=1e-6)


def test_intervals_are_those_of_drawing_rows(spark, rows):
    x, y = rows
    got = {r.name: r for r in B.coefficient_intervals(given(spark, x, y), ["zone", "control"], "scored", ["id"], 300).collect()}
    r = np.random.default_rng(0)
    again = np.array([fit(x, y, np.bincount(r.integers(0, len(x), len(x)), minlength=len(x)).astype(float)) for _ in range(300)])
    for k, name in enumerate(["intercept", "zone", "control"]):
        lo, hi = np.percentile(again[:, k], [2.5, 97.5])
        assert got[name].lo == pytest.approx(lo, abs=0.15 * (hi - lo)) and got[name].hi == pytest.approx(hi, abs=0.15 * (hi - lo))
        assert got[name].differs == (lo * hi > 0)


def test_rows_of_equal_value_are_drawn_apart(spark):
    df = spark.range(1000).selectExpr("id", "id % 2 team", "cast(id % 4 < 2 as double) v")
    for r in B.mean_intervals(df, ["team"], "v", ["id"], 400).collect():
        assert (r.n, r.mean) == (500, 0.5) and r.lo == pytest.approx(0.456, abs=0.008) and r.hi == pytest.approx(0.544, abs=0.008)


def test_weights_are_poisson():
    w = B.weights(np.arange(20_000), np.arange(50))
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
    assert (B.weights(np.arange(10), np.arange(5), 1) != B.weights(np.arange(10), np.arange(5), 2)).any()
