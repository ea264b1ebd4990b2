"""Column-expression special functions against the Python standard library."""

import math
from decimal import Decimal, localcontext
from statistics import NormalDist

import numpy as np
import pytest

from pyspark.sql import functions as F

from custlens.functions.special import erfc, hyp2f1, hyp2f1_scaled, lgamma, log_norm_cdf, norm_cdf, norm_ppf
from custlens.operators.stats import _score_sum, anderson_darling


def test_lgamma(spark):
    xs = [0.1, 0.5, 1.0, 2.5, 10.0, 123.4, 1e5]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in df.select(lgamma(df.x)).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


def test_hyp2f1_against_closed_form(spark):
    # 2F1(1, 1; 2; z) = -ln(1 - z) / z
    zs = [0.01, 0.3, 0.7, 0.95]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    got = [r[0] for r in df.select(hyp2f1(1.0, 1.0, 2.0, df.z)).collect()]
    for z, g in zip(zs, got):
        assert g == pytest.approx(-math.log(1 - z) / z, rel=1e-10)


def test_hyp2f1_near_one_and_nulls(spark):
    df = spark.createDataFrame([(0.9999,), (0.99999,), (0.0,), (None,)], "z double")
    got = [r[0] for r in df.select(hyp2f1(1.0, 1.0, 2.0, df.z)).collect()]
    for z, g in zip([0.9999, 0.99999], got):
        assert g == pytest.approx(-math.log(1 - z) / z, rel=1e-9)
    assert got[2:] == [1.0, None]


def test_normal(spark):
    ps = [1e-6, 0.01, 0.3, 0.5, 0.8, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(norm_ppf(df.p)).collect()]
    for p, g in zip(ps, got):
        assert g == pytest.approx(NormalDist().inv_cdf(p), rel=1e-13, abs=1e-13)
    xs = [-3.0, -1.0, 0.0, 0.5, 2.0]
    dx = spark.createDataFrame([(x,) for x in xs], "x double")
    got = [r[0] for r in dx.select(norm_cdf(dx.x)).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(NormalDist().cdf(x), rel=1e-14)
    got = [r[0] for r in dx.select(erfc(dx.x)).collect()]
    for x, g in zip(xs, got):
        assert g == pytest.approx(math.erfc(x), rel=1e-14)


def test_hyp2f1_large_parameters(spark):
    # 2F1(a, b; b; z) = (1 - z)^-a: slow convergence for large a and z near 1
    rows = [(25.0, 26.2, 0.9), (3.5, 4.0, 0.97), (60.0, 61.5, 0.5)]
    df = spark.createDataFrame(rows, "a double, b double, z double")
    got = [r[0] for r in df.select(hyp2f1(df.a, df.b, df.b, df.z)).collect()]
    for (a, _, z), g in zip(rows, got):
        assert g == pytest.approx((1 - z) ** -a, rel=1e-9)


@pytest.mark.parametrize("z", [0.08, 0.3, 0.6, 0.9, 0.99, 0.9999999, 1 - 1e-12])
def test_hyp2f1_closed_forms_to_one(z):
    """2F1(a, a+1/2; 2a; z) has a closed form, also for 2a in (-1, 0) where the sum is negative."""
    y = 1 - z
    for a in (-0.49, -0.2, 0.3, 4.5):
        want = y ** -0.5 * (2 / (1 + math.sqrt(y))) ** (2 * a - 1)
        assert scaled(a, a + 0.5, 2 * a, z) == pytest.approx(want, rel=1e-9)
    assert scaled(1, 1, 2, z) == pytest.approx(-math.log(y) / z, rel=1e-9)
    assert scaled(-0.5, 1.3, -0.5, z) == pytest.approx(y ** -1.3, rel=1e-9)
    assert scaled(2.5, 3, 3, z) == pytest.approx(y ** -2.5, rel=1e-9)


def scaled(a, b, c, z, power=0.0):
    one = np.ones(1)
    return hyp2f1_scaled(a * one, b * one, c * one, z * one, None, power * one)[0]


@pytest.mark.parametrize("abcz", [(6.47, 0.5, -0.4, 0.9), (6.47, 0.5, -0.4, 0.3), (6.551, 0.0195, -0.98, 0.08),
                                  (6.551, 0.0195, -0.98, 0.9), (0.7, 0.4, -0.02, 0.97), (50.3, 1.9, 1.3, 0.97),
                                  (300.2, 2.4, 2.0, 0.8), (1000.5, 1001.0, 1000.9, 0.5), (3.3, 2.4, 17.2, 0.999)])
def test_hyp2f1_against_long_sums(abcz):
    """Sixty-digit sums of the defining series."""
    with localcontext() as ctx:
        ctx.prec = 60
        a, b, c, z = map(Decimal, abcz)
        term = total = Decimal(1)
        for k in range(200_000):
            term *= (a + k) * (b + k) / ((c + k) * (k + 1)) * z
            total += term
            if k > 50 and abs(term) < abs(total) * Decimal(10) ** -25 * (1 - z):
                break
        assert abs(Decimal(float(scaled(*abcz))) / total - 1) < Decimal("1e-11")


def test_hyp2f1_scaled_products_and_poles():
    assert scaled(1500.5, 1001.0, 1001.0, 0.999, 1500.5) == pytest.approx(1.0, rel=1e-10)    # 1e4500 times 1e-4500
    assert math.isnan(scaled(1.0, 1.0, -2.0, 0.5)) and math.isnan(scaled(float("nan"), 1.0, 2.0, 0.5))
    with pytest.raises(ValueError):
        scaled(1.0, 1.0, 2.0, 1.0)


def test_expected_purchases_at_the_poles(spark):
    """a = 1 and a + b + x = 1 are poles of the factors, not of the product."""
    from custlens.operators.clv import BGNBDParams, expected_purchases
    df = spark.createDataFrame([(0, 0.0, 200.0), (2, 100.0, 200.0)], "uniq_freq int, uniq_rec double, uniq_age double")
    for at, near in ((BGNBDParams(2.0, 90.0, 1.0, 0.7), BGNBDParams(2.0, 90.0, 1.0 + 1e-5, 0.7)),
                     (BGNBDParams(2.0, 90.0, 0.25, 0.75), BGNBDParams(2.0, 90.0, 0.25, 0.75 + 1e-6))):
        got, want = ([r["exp_purchases"] for r in expected_purchases(df, p, 30.0).collect()] for p in (at, near))
        assert got == pytest.approx(want, rel=1e-4)
        assert all(0 < v < 30 for v in got)


def test_tails_of_the_normal(spark):
    """ln Φ over the whole range of doubles, and erfc at the seams of its three forms."""
    with localcontext() as ctx:
        ctx.prec = 40
        zs = [-200.0, -38.0, -10.0, -5.7, -1.0, -0.3, 0.0, 0.2, 0.66, 0.67, 3.0, 8.0, 12.0]
        got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(log_norm_cdf(F.col("z"))).collect()]
        for z, g in zip(zs, got):
            if z <= -10:    # asymptotic series of the tail
                total, term = Decimal(1), Decimal(1)
                for k in range(1, 30):
                    term *= -(2 * k - 1) / Decimal(z) ** 2
                    total += term
                want = -Decimal(z) ** 2 / 2 - (Decimal(-z) * (2 * Decimal(math.pi)).sqrt()).ln() + total.ln()
            else:
                want = Decimal(math.erfc(-z / math.sqrt(2)) / 2).ln() if z < 1 else \
                    Decimal(math.log1p(-math.erfc(z / math.sqrt(2)) / 2))
            assert float(want) == pytest.approx(g, rel=1e-13, abs=1e-300)
    xs = [-30.0, -4.0, -0.46875, -0.46, 0.0, 0.4687, 0.4688, 3.99, 4.01, 10.0, 26.0]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(erfc(F.col("x"))).collect()]
    assert got == pytest.approx([math.erfc(x) for x in xs], rel=2e-14)


def brute_anderson(xs):
    n, m = len(xs), sum(xs) / len(xs)
    sd = math.sqrt(sum((x - m) ** 2 for x in xs) / (n - 1))
    z = [(x - m) / sd for x in sorted(xs)]
    low = lambda v: math.log(math.erfc(-v / math.sqrt(2)) / 2) if v < 0 else math.log1p(-math.erfc(v / math.sqrt(2)) / 2)
    return -n - sum((2 * i + 1) * (low(z[i]) + low(-z[n - 1 - i])) for i in range(n)) / n


def test_anderson_darling_with_extremes(spark):
    for xs in ([float(v % 17) for v in range(300)], [0.1 * v for v in range(200)] + [400.0, -900.0],
               [1e9 + v * v for v in range(50)]):
        got = anderson_darling(spark.createDataFrame([(x,) for x in xs], "x double"), "x")["statistic"]
        assert got == pytest.approx(brute_anderson(xs), rel=1e-9)


@pytest.mark.parametrize("n,runs", [(50, 50), (700, 3), (9000, 2), (9000, 9000)])
def test_scores_of_tied_runs(spark, n, runs):
    """Runs of any length add the normal scores of their positions."""
    cuts = [n * k // runs for k in range(runs + 1)]
    df = spark.createDataFrame([(a + 1, b) for a, b in zip(cuts, cuts[1:])], "lo long, hi long")
    got = sorted((r["lo"], r["s"]) for r in df.select("lo", _score_sum(F.col("lo"), F.col("hi"), n).alias("s")).collect())
    inv = NormalDist().inv_cdf
    for (lo, s), b in zip(got, cuts[1:]):
        want = math.fsum(inv((i - 0.375) / (n + 0.25)) for i in range(lo, b + 1))
        assert s == pytest.approx(want, rel=1e-10, abs=1e-9)
