"""Statistical tests (H1-H7).  Each test is one or two aggregation passes;
p-values are computed from the resulting scalars on the driver.  Results are
rows ``(column, statistic, p_value, reject)`` instead of printed text."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import chi2_ppf, chi2_sf, let, log_norm_cdf, norm_ppf, t_sf_two_sided
from .ranking import grouped_quantiles, grouped_ranked, ranked_histogram


# H1
def chi2_statistic(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson chi-square of the a x b contingency table without building the
    full grid: cells never observed contribute their expected count, and the
    expected counts of all cells sum to N, so
    ``stat = N + sum_observed((o - e)^2 / e - e)``.  Returns one row
    ``statistic, dof, n`` (no Yates correction)."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = d.groupBy(a, b).agg(F.count(F.lit(1)).alias("o"))
    ra = d.groupBy(a).agg(F.count(F.lit(1)).alias("ra"))
    cb = d.groupBy(b).agg(F.count(F.lit(1)).alias("cb"))
    n = d.select(F.count(F.lit(1))).scalar()
    j = cells.join(ra, a).join(cb, b)
    e = F.col("ra") * F.col("cb") / n
    stat = n + F.sum((F.col("o") - e) * (F.col("o") - e) / e - e)
    dof = (ra.select(F.count(F.lit(1))).scalar() - 1) * (cb.select(F.count(F.lit(1))).scalar() - 1)
    return j.agg(stat.alias("statistic"), dof.cast("long").alias("dof"), F.first(F.lit(n)).cast("long").alias("n"))


def chi2_independence(df: DataFrame, a: str, b: str, prob: float = 0.95, correction: bool = True) -> dict:
    """Chi-square independence test.  With one degree of freedom (2x2) the
    continuity correction is applied over the four cells, as is customary."""
    r = chi2_statistic(df, a, b).first()
    stat, dof = float(r["statistic"]), int(r["dof"])
    if correction and dof == 1:
        cells = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).count().collect()
        ra, cb, n = {}, {}, 0
        for c in cells:
            ra[c[a]] = ra.get(c[a], 0) + c["count"]
            cb[c[b]] = cb.get(c[b], 0) + c["count"]
            n += c["count"]
        obs = {(c[a], c[b]): c["count"] for c in cells}
        stat = 0.0
        for ka, va in ra.items():
            for kb, vb in cb.items():
                e = va * vb / n
                o = obs.get((ka, kb), 0)
                diff = abs(o - e) - min(0.5, abs(o - e))
                stat += diff * diff / e
    p = chi2_sf(stat, dof) if dof > 0 else float("nan")
    critical = chi2_ppf(prob, dof) if dof > 0 else float("nan")
    return {"statistic": stat, "dof": dof, "p_value": p, "critical": critical,
            "reject": bool(abs(stat) >= critical)}


# H2
def rank_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Average ranks ``<col>_rank`` of several numeric columns, ranked together
    as groups of one histogram."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "v")
    ranks = grouped_ranked(long, ["column"], "v").select(
        "column", F.col("value").alias("__v"), (F.col("below") + (F.col("cnt") + 1) / 2.0).alias("__rank"))
    out = df
    for c in cols:
        mine = ranks.where(F.col("column") == c).select("__v", F.col("__rank").alias(f"{c}_rank"))
        out = out.join(mine, F.col(c).cast("double") == F.col("__v"), "left").drop("__v")
    return out


def pearson_expr(x: str, y: str):
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def spearman_rho(df: DataFrame, x: str, y: str) -> DataFrame:
    """Spearman correlation (average ranks, complete pairs only) as one row."""
    d = df.select(x, y).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    r = rank_columns(d, [x, y])
    return r.agg(pearson_expr(f"{x}_rank", f"{y}_rank").alias("rho"), F.count(F.lit(1)).alias("n"))


def spearman(df: DataFrame, x: str, y: str, alpha: float = 0.05) -> dict:
    row = spearman_rho(df, x, y).first()
    rho, n = row["rho"], row["n"]
    if rho is None or n < 3:
        return {"rho": rho, "p_value": float("nan"), "reject": False}
    if abs(rho) >= 1:
        p = 0.0
    else:
        t = rho * math.sqrt((n - 2) / (1 - rho * rho))
        p = t_sf_two_sided(t, n - 2)
    return {"rho": rho, "p_value": p, "reject": p < alpha}


# H4
def dagostino_k2(df: DataFrame, cols: list[str]) -> DataFrame:
    """D'Agostino-Pearson K^2 normality test per column from the sample
    skewness and kurtosis (one aggregation), all in closed form.  Rows:
    ``column, n, skew_z, kurt_z, statistic, p_value`` (chi-square, 2 dof)."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "v")
    m = long.where(F.col("v").isNotNull()).groupBy("column").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.skewness("v").alias("g1"),
        (F.kurtosis("v") + 3.0).alias("b2"))
    n, g1, b2 = F.col("n"), F.col("g1"), F.col("b2")
    # skewness test
    y = g1 * F.sqrt((n + 1) * (n + 3) / (6.0 * (n - 2)))
    beta2 = 3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.lit(-1.0) + F.sqrt(2 * (beta2 - 1))
    delta = 1 / F.sqrt(0.5 * F.log(w2))
    alpha = F.sqrt(2.0 / (w2 - 1))
    y = F.when(y == 0, F.lit(1.0)).otherwise(y)
    zs = delta * F.log(y / alpha + F.sqrt((y / alpha) * (y / alpha) + 1))
    # kurtosis test
    e = 3.0 * (n - 1) / (n + 1)
    varb2 = 24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5))
    xk = (b2 - e) / F.sqrt(varb2)
    sb1 = 6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6.0 + 8.0 / sb1 * (2.0 / sb1 + F.sqrt(1 + 4.0 / (sb1 * sb1)))
    term1 = 1 - 2 / (9.0 * a)
    denom = 1 + xk * F.sqrt(2 / (a - 4.0))
    term2 = F.signum(denom) * F.pow((1 - 2.0 / a) / F.abs(denom), F.lit(1 / 3.0))
    zk = (term1 - term2) / F.sqrt(2 / (9.0 * a))
    out = m.select("column", n.cast("long").alias("n"), zs.alias("skew_z"), zk.alias("kurt_z"))
    k2 = F.col("skew_z") * F.col("skew_z") + F.col("kurt_z") * F.col("kurt_z")
    return out.withColumn("statistic", k2).withColumn("p_value", F.exp(-k2 / 2))


# H3
#: Positions at either end whose scores are added one by one.
END_TERMS = 64


def _score_sum(lo, hi, n: int):
    """sum_{i=lo..hi} Φ⁻¹((i - 3/8) / (n + 1/4)) per histogram row, whatever the
    length of the run of tied values: positions near either end term by term (at
    most END_TERMS there), those between by the Euler-Maclaurin sum about the
    exact integral ``-c φ(Φ⁻¹)``, with its first two corrections."""
    c = n + 0.25
    at = lambda i: norm_ppf((i.cast("double") - 0.375) / F.lit(c))

    def some(a, b):
        return F.when(a <= b, F.aggregate(F.sequence(a, F.greatest(a, b)), F.lit(0.0), lambda acc, i: acc + at(i))) \
            .otherwise(F.lit(0.0))

    low, high = F.lit(min(END_TERMS, n)).cast("long"), F.lit(max(n - END_TERMS, min(END_TERMS, n))).cast("long")
    ends = some(lo, F.least(hi, low)) + some(F.greatest(lo, high + 1), hi)
    a, b = F.greatest(lo, low + 1), F.least(hi, high)

    def middle(edge):
        """Antiderivative of the sum at the boundary after position ``edge - 1/2``."""
        def of(z):
            dens = F.exp(-z * z / 2) / F.lit(math.sqrt(2 * math.pi))
            return let(dens, lambda d: F.lit(-c) * d - F.lit(1 / 24 / c) / d
                       + F.lit(7 / 5760 / c ** 3) * (F.lit(1.0) + F.lit(2.0) * z * z) / (d * d * d))
        return let(norm_ppf((edge - 0.875) / F.lit(c)), of)

    between = middle(b.cast("double") + 1) - middle(a.cast("double"))
    return ends + F.when(a <= b, between).otherwise(F.lit(0.0))


def shapiro(df: DataFrame, col: str) -> dict:
    """Shapiro-Wilk W with Royston's (1992) approximation of the weights and
    of the p-value.  Order statistics come from the ranked histogram; tied
    values share their block of weights; the normal-score sums run on the
    executors (``spark.range`` over the n positions), nothing of size n
    reaches the driver."""
    h = ranked_histogram(df, col)
    n = h.n
    if n < 3:
        raise ValueError("shapiro needs at least 3 values")
    nd = NormalDist()
    spark = df.sparkSession

    def m(i):
        return nd.inv_cdf((i - 0.375) / (n + 0.25))

    mm = spark.range(1, n + 1).agg(
        F.sum(F.pow(norm_ppf((F.col("id").cast("double") - 0.375) / (n + 0.25)), 2))).first()[0]
    u = 1 / math.sqrt(n)
    an = m(n) / math.sqrt(mm) + 0.221157 * u - 0.147981 * u ** 2 - 2.071190 * u ** 3 + 4.434685 * u ** 4 - 2.706056 * u ** 5
    special = {n: an, 1: -an}
    if n > 5:
        an1 = (m(n - 1) / math.sqrt(mm) + 0.042981 * u - 0.293762 * u ** 2 - 1.752461 * u ** 3
               + 5.682633 * u ** 4 - 3.582633 * u ** 5)
        phi = (mm - 2 * m(n) ** 2 - 2 * m(n - 1) ** 2) / (1 - 2 * an ** 2 - 2 * an1 ** 2)
        special.update({n - 1: an1, 2: -an1})
    else:
        phi = (mm - 2 * m(n) ** 2) / (1 - 2 * an ** 2)
    sp = math.sqrt(phi)
    lo, hi = F.col("below") + 1, F.col("below") + F.col("cnt")
    if n == 3:
        special = {1: -math.sqrt(0.5), 2: 0.0, 3: math.sqrt(0.5)}
        wsum = F.lit(0.0)
        for k, a in special.items():
            wsum = wsum + F.when((lo <= k) & (hi >= k), F.lit(a)).otherwise(0.0)
    else:
        wsum = _score_sum(lo, hi, n) / F.lit(sp)
        for k, a in special.items():
            inside = (lo <= k) & (hi >= k)
            wsum = wsum + F.when(inside, F.lit(a - m(k) / sp)).otherwise(0.0)
    mean = df.agg(F.avg(col)).first()[0]
    v = F.col("value").cast("double") - F.lit(float(mean))          # the weights add up to zero
    r = h.df.agg(F.sum(v * wsum).alias("num"), F.sum(F.col("cnt") * v * v).alias("ss")).first()
    ss = r["ss"]
    w = min(1.0, (r["num"] ** 2) / ss) if ss > 0 else 1.0
    ln = math.log(n)
    if n == 3:
        p = max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    elif n <= 11:
        gamma = 0.459 * n - 2.273
        mu = -0.0006714 * n ** 3 + 0.025054 * n ** 2 - 0.39978 * n + 0.5440
        sigma = math.exp(-0.0020322 * n ** 3 + 0.062767 * n ** 2 - 0.77857 * n + 1.3822)
        z = (-math.log(gamma - math.log1p(-w)) - mu) / sigma if w < 1 else -math.inf
        p = 1 - nd.cdf(z)
    else:
        mu = 0.0038915 * ln ** 3 - 0.083751 * ln ** 2 - 0.31082 * ln - 1.5861
        sigma = math.exp(0.0030302 * ln ** 2 - 0.082676 * ln - 0.4803)
        z = (math.log1p(-w) - mu) / sigma if w < 1 else -math.inf
        p = 1 - nd.cdf(z)
    return {"statistic": w, "p_value": p, "n": n, "reject": p < 0.05}


# H5
# fixed values: Anderson-Darling normal critical values at 15/10/5/2.5/1 %
AD_SIGNIFICANCE = [15.0, 10.0, 5.0, 2.5, 1.0]
AD_CRITICAL = [0.576, 0.656, 0.787, 0.918, 1.092]


def anderson_darling(df: DataFrame, col: str) -> dict:
    """Anderson-Darling normality statistic with sample mean / std (ddof 1).
    Tied values' position sums are closed forms, so one pass over the ranked
    histogram suffices."""
    h = ranked_histogram(df, col)
    n = h.n
    st = df.where(~F.isnan(F.col(col).cast("double"))).agg(F.avg(col).alias("m"), F.stddev_samp(col).alias("s")).first()
    if n < 2 or not st["s"]:
        raise ValueError("anderson_darling needs values that differ")
    z = (F.col("value").cast("double") - F.lit(float(st["m"]))) / F.lit(float(st["s"]))
    cnt, below = F.col("cnt").cast("double"), F.col("below").cast("double")
    s_a = cnt * (2.0 * below + cnt)                             # sum of (2i - 1) over the tied positions
    s_b = cnt * (F.lit(2.0 * n) - 2.0 * below - cnt)            # sum of (2n + 1 - 2i)
    tot = h.df.agg(F.sum(s_a * log_norm_cdf(z) + s_b * log_norm_cdf(-z))).first()[0]
    a2 = -n - tot / n
    crit = [round(c / (1 + 4.0 / n - 25.0 / (n * n)), 3) for c in AD_CRITICAL]
    return {"statistic": a2, "critical_values": crit, "significance_level": AD_SIGNIFICANCE,
            "reject_at_5pct": a2 > crit[2]}


# H6
def qq_points(df: DataFrame, col: str, n: int = 100) -> DataFrame:
    """``n`` Q-Q points: theoretical normal quantile vs exact sample quantile
    at probabilities ``(k - 0.5) / n``."""
    probs = [(k - 0.5) / n for k in range(1, n + 1)]
    names = [f"p{k}" for k in range(1, n + 1)]
    q = grouped_quantiles(df, [], col, probs, names)
    long = q.unpivot([], names, "k", "sample")
    pmap = F.create_map(*[x for nm, p in zip(names, probs) for x in (F.lit(nm), F.lit(float(p)))])
    long = long.withColumn("prob", F.element_at(pmap, F.col("k")))
    return long.select("prob", norm_ppf(F.col("prob")).alias("theoretical"), "sample")


# H7
def linear_fit(df: DataFrame, x: str, y: str, out: str = "fitted") -> DataFrame:
    """OLS line ``y ~ x`` (one aggregation), fitted values next to each row."""
    coef = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept")).first()
    return df.withColumn(out, F.lit(coef["intercept"]) + F.lit(coef["slope"]) * F.col(x)) \
             .withColumn("slope", F.lit(coef["slope"])).withColumn("intercept", F.lit(coef["intercept"]))
