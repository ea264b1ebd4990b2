"""Invariants of the iterative fits and model search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from custlens.operators import clv as V
from custlens.operators.ml import split as SP


def _simulate_gg(n, p, q, v, seed=0):
    rng = np.random.default_rng(seed)
    nu = rng.gamma(q, 1.0 / v, n)
    x = rng.integers(2, 10, n)
    m = np.array([rng.gamma(p * xi, 1.0 / (nui * xi)) for xi, nui in zip(x, nu)])
    return x, m


def test_gamma_gamma_recovers_parameters(spark):
    x, m = _simulate_gg(3000, 6.0, 4.0, 15.0)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(x, m)], "uniq_freq int, uniq_mon double")
    gg, res = V.fit_gamma_gamma(df, penalizer=0.0)
    assert res.converged
    em = df.select(F.avg(V.expected_avg_value_expr(gg))).first()[0]
    assert em == pytest.approx(float(np.mean(m)), rel=0.05)
    assert 2.0 < gg.p < 15.0 and gg.q > 1.0


def test_bgnbd_fit_improves_likelihood(spark):
    from tests.conftest import MID
    from custlens.plans.q_rfm import orders_rfm
    r = V.clv_eligible(orders_rfm(spark, MID))
    bg, res = V.fit_bgnbd(r, max_rounds=15)
    base = r.select(F.sum(V.bgnbd_ll(0.1, 0.1 * 600, 0.1, 0.1, "uniq_freq", "uniq_rec", "uniq_age"))).first()[0]
    fitted = V.bgnbd_loglik(r, bg).first()["loglik"]
    assert math.isfinite(fitted) and fitted >= base


def test_clv_non_decreasing_in_months(spark):
    df = spark.createDataFrame([(3, 40, 100, 50.0), (0, 0, 30, 0.0)], "uniq_freq int, uniq_rec int, uniq_age int, uniq_mon double")
    bg, gg = V.BGNBDParams(0.243, 30.9, 0.793, 2.426), V.GammaGammaParams(6.25, 3.74, 15.44)
    a = [r[0] for r in df.select(V.clv_expr(bg, gg, months=6)).collect()]
    b = [r[0] for r in df.select(V.clv_expr(bg, gg, months=12)).collect()]
    assert all(y >= x for x, y in zip(a, b))


def test_stratified_split_shares(spark):
    df = spark.range(0, 2000).withColumn("label", (F.col("id") % 3).cast("string"))
    s = SP.stratified_split(df, "label", 0.2, seed=1, key="id")
    got = {r["label"]: r["n"] for r in s.where(F.col("split") == "test").groupBy("label").agg(F.count("*").alias("n")).collect()}
    tot = {r["label"]: r["n"] for r in df.groupBy("label").agg(F.count("*").alias("n")).collect()}
    for k in tot:
        assert got[k] == math.floor(tot[k] * 0.2 + 0.5)
    assert s.count() == 2000


def _simulate_bgnbd(n, r, alpha, a, b, T_max, seed=0):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        lam = rng.gamma(r, 1.0 / alpha)
        p = rng.beta(a, b)
        T = float(rng.integers(T_max // 2, T_max + 1))
        t, x, alive, last = 0.0, 0, True, 0.0
        while alive:
            t += rng.exponential(1.0 / lam)
            if t > T:
                break
            x += 1
            last = t
            alive = rng.random() > p
        out.append((x, last, T))
    return out


def test_bgnbd_recovers_parameters(spark):
    data = _simulate_bgnbd(4000, 0.5, 20.0, 1.5, 4.0, 200, seed=3)
    df = spark.createDataFrame([(int(x), float(t), float(T)) for x, t, T in data],
                               "uniq_freq int, uniq_rec double, uniq_age double")
    bg, res = V.fit_bgnbd(df, penalizer=0.0, max_rounds=40)
    assert res.converged
    assert bg.r == pytest.approx(0.5, rel=0.3)
    assert bg.alpha == pytest.approx(20.0, rel=0.4)


def test_clv_params_round_trip(spark, tmp_path):
    from custlens.sources import io as A
    p = {"r": 0.25, "alpha": 4.4, "a": 0.8, "b": 2.4}
    path = A.save_params(spark, p, str(tmp_path / "bg"))
    assert A.load_params(spark, path) == pytest.approx(p)


def test_composite_models_save_and_load(spark, tmp_path):
    from pyspark.ml.feature import VectorAssembler
    from custlens.operators.ml.ensemble import (AdaBoostRegressor, VotingClassifier, load_model, save_model)
    rng = np.random.default_rng(0)
    rows = [(float(a), float(b), float(int(a + b > 1)), float(2 * a - b)) for a, b in rng.random((120, 2))]
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        spark.createDataFrame(rows, "a double, b double, label double, y double"))
    for est, label in ((VotingClassifier(labelCol="label", dt__maxDepth=3), "label"),
                       (AdaBoostRegressor(labelCol="y", n_estimators=4), "y")):
        m = est.fit(df)
        path = save_model(m, str(tmp_path / type(est).__name__))
        back = load_model(path)
        a = [r[0] for r in m.transform(df).select("prediction").collect()]
        b = [r[0] for r in back.transform(df).select("prediction").collect()]
        assert a == b
