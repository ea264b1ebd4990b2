"""Yeo-Johnson lambdas against the derivative of the likelihood over all rows."""

import math

import numpy as np
import pytest

from custlens.operators.prep import ScaleTransformer, yeo_johnson_lambdas


def slope(x, lam):
    """Derivative of the profile log-likelihood by central differences of the exact variance."""
    def ll(v):
        with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
            pos = np.log1p(np.abs(x)) if abs(v) < 1e-12 else ((1 + np.abs(x)) ** v - 1) / v
            neg = -np.log1p(np.abs(x)) if abs(v - 2) < 1e-12 else -((1 + np.abs(x)) ** (2 - v) - 1) / (2 - v)
        y = np.where(x >= 0, pos, neg)
        return -len(x) / 2 * math.log(y.var()) + (v - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))
    return ll(lam)


def best(x, low, high):
    """Golden section in plain numpy, then the middle of the flat top."""
    g = (math.sqrt(5) - 1) / 2
    a, b = low, high
    while b - a > 1e-7:
        c, d = b - g * (b - a), a + g * (b - a)
        if slope(x, c) > slope(x, d):
            b = d
        else:
            a = c
    return (a + b) / 2


def test_lambdas_of_five_columns(spark):
    rng = np.random.default_rng(8)
    n = 4000
    x = np.column_stack([rng.lognormal(1, 0.6, n), rng.normal(0, 3, n), -rng.gamma(2, 2, n), rng.normal(50, 2, n) ** 3 / 1e4,
                         8 - rng.lognormal(0, 0.4, n)])
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None,) * 5], "a double, b double, c double, d double, e double")
    got = yeo_johnson_lambdas(df, df.columns)
    for i, c in enumerate(df.columns):
        want = best(x[:, i], got[c] - 3, got[c] + 3)
        assert got[c] == pytest.approx(want, abs=3e-6)
        # the derivative of the log-likelihood vanishes within 1e-6
        h = 1e-6
        left, right = slope(x[:, i], got[c] - 1e-3) - slope(x[:, i], got[c]), slope(x[:, i], got[c] + 1e-3) - slope(x[:, i], got[c])
        assert left < 0 and right < 0 and abs(left - right) < 4e-3 * abs(left) + 1e-6, (c, left, right, h)


def test_lambda_beyond_any_grid(spark):
    """Values close above one another far from zero want a lambda of tens."""
    rng = np.random.default_rng(1)
    x = (1 + 40 * rng.normal(3.0, 0.2, 3000)) ** (1 / 40) - 1          # its 40th power is normal
    x = x[np.isfinite(x)]
    got = yeo_johnson_lambdas(spark.createDataFrame([(float(v),) for v in x], "x double"), ["x"])["x"]
    assert got == pytest.approx(best(x, 0, 120), abs=1e-3) and got > 10


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(2.0, None, 1.0), (2.0, None, 1.5), (2.0, None, 9.0)], "a double, b double, c double")
    got = yeo_johnson_lambdas(df, ["a", "b", "c"])
    assert got["a"] == 1.0 and got["b"] == 1.0 and got["c"] < 0
    out = ScaleTransformer(method="yeo-johnson").fit(df).transform(df).collect()
    assert [r["a"] for r in out] == [0.0] * 3
