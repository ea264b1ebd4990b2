"""Covariances of many columns against numpy."""

import time

import numpy as np
from pyspark.sql import functions as F

from custlens.operators.gramian import gramian
from custlens.operators.prep import PerfectCollinearity
from custlens.operators.reports import correlation_matrix


def test_three_hundred_columns(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 300)) + 1e7
    x[:, 7] = x[:, 3] * 2 + 5
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(6)
    cols = [f"c {i}.x" for i in range(300)]
    df = df.select(*[F.col("v")[i].alias(c) for i, c in enumerate(cols)])
    t = time.time()
    got = gramian(df, cols)
    assert time.time() - t < 60
    assert np.allclose(got.cov, np.cov(x.T, ddof=0), atol=1e-8)
    assert np.allclose(got.corr(), np.corrcoef(x.T), atol=1e-8)
    assert PerfectCollinearity().fit(df).transform(df).columns == [c for c in cols if c != "c 3.x"]


def test_nulls_constants_and_no_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 12))
    x[:, 11] = 0.1
    gone = rng.random(x.shape) < 0.2
    df = spark.createDataFrame([tuple(None if g else float(v) for v, g in zip(a, b)) for a, b in zip(x, gone)],
                               ", ".join(f"c{i} double" for i in range(12)))
    cols = df.columns
    got = {(r["a"], r["b"]): r["corr"] for r in correlation_matrix(df, cols).collect()}
    for i in range(12):
        for j in range(12):
            both = ~gone[:, i] & ~gone[:, j]
            a, b = x[both, i], x[both, j]
            sd = x[~gone[:, i], i].std() * x[~gone[:, j], j].std()
            want = None if 11 in (i, j) else 1.0 if i == j else ((a * b).mean() - a.mean() * b.mean()) / sd
            assert got[f"c{i}", f"c{j}"] is None if want is None else abs(got[f"c{i}", f"c{j}"] - want) < 1e-12
    assert all(r["corr"] is None for r in correlation_matrix(df.limit(0), cols).collect())
