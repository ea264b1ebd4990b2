"""Customer lifetime value with the BG/NBD purchase model (Fader, Hardie &
Lee 2005) and the Gamma-Gamma spend model (Fader & Hardie 2013) (F1-F12).

Fitting never moves customer rows: they are first compressed to their
sufficient statistics (``groupBy(x, t, T).count()`` resp. ``(x, m)``), and
every optimiser batch evaluates all candidate parameter vectors in one pass
over that table, exploded next to each of its rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.special import hyp2f1_multi, let, lgamma
from ..session import stage_table
from .optim import batch_minimize
from .ranking import ranked_histogram


@dataclass(frozen=True)
class BGNBDParams:
    r: float
    alpha: float
    a: float
    b: float


@dataclass(frozen=True)
class GammaGammaParams:
    p: float
    q: float
    v: float


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F1
def clv_eligible(df: DataFrame, freq: str = "uniq_freq", mon: str = "uniq_mon") -> DataFrame:
    """Customers used for fitting: more than one repeat purchase, positive spend."""
    return df.where((F.col(freq) > 1) & (F.col(mon) > 0))


# F3
def bgnbd_ll(r, alpha, a, b, x, t, T) -> Column:
    """Per-customer BG/NBD log-likelihood (log-sum-exp for the last term)."""
    r, alpha, a, b = _c(r), _c(alpha), _c(a), _c(b)
    x, t, T = _col(x).cast("double"), _col(t).cast("double"), _col(T).cast("double")
    a1 = lgamma(r + x) - lgamma(r) + r * F.log(alpha)
    a2 = lgamma(a + b) + lgamma(b + x) - lgamma(b) - lgamma(a + b + x)
    a3 = -(r + x) * F.log(alpha + T)
    a4 = F.log(a) - F.log(b + x - F.lit(1.0)) - (r + x) * F.log(alpha + t)
    # ln(e^a3 + [x>0] e^a4) = a3 + ln(1 + [x>0] e^(a4-a3)), written with one
    # copy of each term (log1p of the smaller ratio keeps it stable)
    d43 = a4 - a3
    lse = F.when(x > 0, F.greatest(a3, a4) + F.log1p(F.exp(-F.abs(d43)))).otherwise(a3)
    return a1 + a2 + lse


def bgnbd_loglik(df: DataFrame, params: BGNBDParams, x="uniq_freq", t="uniq_rec", T="uniq_age") -> DataFrame:
    return df.agg(F.sum(bgnbd_ll(params.r, params.alpha, params.a, params.b, x, t, T)).alias("loglik"),
                  F.count(F.lit(1)).alias("n"))


# F5
def gg_ll(p, q, v, x, m) -> Column:
    p, q, v = _c(p), _c(q), _c(v)
    x, m = _col(x).cast("double"), _col(m).cast("double")
    px = p * x
    return (lgamma(px + q) - lgamma(px) - lgamma(q) + q * F.log(v) + (px - F.lit(1.0)) * F.log(m)
            + px * F.log(x) - (px + q) * F.log(x * m + v))


def gg_loglik(df: DataFrame, params: GammaGammaParams, x="uniq_freq", m="uniq_mon") -> DataFrame:
    return df.agg(F.sum(gg_ll(params.p, params.q, params.v, x, m)).alias("loglik"), F.count(F.lit(1)).alias("n"))


def _batched_objective(suff: DataFrame, row_terms, fixed, penalizer: float):
    """Objective ``-mean(ll) + penalizer * sum(params^2)`` for a batch of
    log-parameter vectors in one job over the sufficient table.

    ``row_terms`` (Columns of one candidate's parameters) are what truly differs
    per row; ``fixed`` (a function of the parameters) is the rest of the sum,
    worked out from the small histogram of purchase counts.  The batch enters as
    data: a literal array of (cid, params) structs is exploded next to every
    sufficient-statistics row (a bounded fan-out of the batch size, typically
    15-21), the terms are written once over columns, and ``groupBy(cid)`` sums
    them with map-side partial aggregation.  The plan and its generated code are
    the same every round; only the literal array (a runtime reference) changes."""

    built: dict = {}
    weight = suff.agg(F.sum("n")).first()[0] or 0

    def f_batch(points):
        d = len(points[0])
        if d not in built:
            built[d] = F.sum(F.col("n") * row_terms(*[F.col(f"__c.p{j}") for j in range(d)])).alias("s")
        cands = F.array(*[F.struct(F.lit(i).alias("cid"),
                                   *[F.lit(float(math.exp(v))).alias(f"p{j}") for j, v in enumerate(lp)])
                          for i, lp in enumerate(points)])
        ex = suff.select("*", F.explode(cands).alias("__c"))
        got = {r["cid"]: r["s"] for r in ex.groupBy(F.col("__c.cid").alias("cid")).agg(built[d]).collect()}
        out = []
        for i, lp in enumerate(points):
            params = np.exp(lp)
            s = got.get(i)
            s = float("inf") if s is None else s + fixed(*params)
            out.append(-s / weight + penalizer * float(np.sum(params ** 2)) if weight and math.isfinite(s)
                       else float("inf"))
        return out
    return f_batch


def _count_histogram(suff: DataFrame, x: str) -> list[tuple[float, int]]:
    """(purchase count, customers): one entry per distinct count."""
    return [(r["x"], r["n"]) for r in suff.groupBy(F.col(x).alias("x")).agg(F.sum("n").alias("n")).collect()]


# F2
def fit_bgnbd(df: DataFrame, penalizer: float = 0.001, x="uniq_freq", t="uniq_rec", T="uniq_age",
              init=(0.1, 0.1, 0.1, 0.1), max_rounds: int = 40):
    """Maximum-likelihood BG/NBD fit.  Time is rescaled so that max(T) = 10
    during the fit (then alpha is scaled back), parameters are optimised on
    the log scale.  The gamma terms depend on the purchase count only and are
    summed over its histogram; rows carry the mixture term alone.  Returns
    ``(BGNBDParams, OptimResult)``; ``at_bound`` of the result names parameters
    that ended at the edge of the search box, where the likelihood has no inner
    maximum."""
    suff = (df.groupBy(F.col(x).cast("double").alias("sx"), F.col(t).cast("double").alias("st"),
                       F.col(T).cast("double").alias("sage"))
              .agg(F.count(F.lit(1)).alias("n")))
    suff = stage_table(suff, "bgnbd")
    max_T = suff.agg(F.max("sage")).first()[0] or 1.0
    scale = 10.0 / max_T
    scaled = suff.select("sx", (F.col("st") * scale).alias("st"), (F.col("sage") * scale).alias("sage"),
                         "n").persist()
    counts = _count_histogram(scaled, "sx")
    lg = math.lgamma

    def fixed(r, al, a, b):
        each = lg(a + b) - lg(b) - lg(r) + r * math.log(al)
        return sum(n * (each + lg(r + k) + lg(b + k) - lg(a + b + k)) for k, n in counts)

    def mixture(r, al, a, b):
        k, age, last = F.col("sx"), F.col("sage"), F.col("st")
        a3 = -(r + k) * F.log(al + age)
        a4 = F.log(a) - F.log(b + k - F.lit(1.0)) - (r + k) * F.log(al + last)
        return F.when(k > 0, F.greatest(a3, a4) + F.log1p(F.exp(-F.abs(a4 - a3)))).otherwise(a3)

    f_batch = _batched_objective(scaled, mixture, fixed, penalizer)
    res = batch_minimize(f_batch, np.log(np.asarray(init)), max_rounds=max_rounds, names=("r", "alpha", "a", "b"))
    scaled.unpersist()
    r, alpha, a, b = np.exp(res.x)
    return BGNBDParams(float(r), float(alpha / scale), float(a), float(b)), res


# F4
def fit_gamma_gamma(df: DataFrame, penalizer: float = 0.001, x="uniq_freq", m="uniq_mon",
                    init=(1.0, 1.0, 1.0), max_rounds: int = 40):
    """Maximum-likelihood Gamma-Gamma fit.  Gamma terms come from the histogram
    of purchase counts, the powers of the amounts from two sums; rows carry
    ``(p x + q) ln(x m + v)`` alone."""
    suff = (df.groupBy(F.col(x).cast("double").alias("x"), F.col(m).cast("double").alias("m"))
              .agg(F.count(F.lit(1)).alias("n")))
    suff = stage_table(suff, "gamma").persist()
    counts = _count_histogram(suff, "x")
    lnm, xlnm = suff.agg(F.sum(F.col("n") * F.log("m")), F.sum(F.col("n") * F.col("x") * F.log("m"))).first()
    lg = math.lgamma

    def fixed(p, q, v):
        each = q * math.log(v) - lg(q)
        return sum(n * (each + lg(p * k + q) - lg(p * k) + p * k * math.log(k)) for k, n in counts) + p * xlnm - lnm

    def spend(p, q, v):
        return -(p * F.col("x") + q) * F.log(F.col("x") * F.col("m") + v)

    f_batch = _batched_objective(suff, spend, fixed, penalizer)
    res = batch_minimize(f_batch, np.log(np.asarray(init)), max_rounds=max_rounds, names=("p", "q", "v"))
    suff.unpersist()
    p, q, v = np.exp(res.x)
    return GammaGammaParams(float(p), float(q), float(v)), res


# F7
def p_alive_expr(params: BGNBDParams, x="uniq_freq", t="uniq_rec", T="uniq_age") -> Column:
    r, al, a, b = (F.lit(params.r), F.lit(params.alpha), F.lit(params.a), F.lit(params.b))
    x, t, T = _col(x).cast("double"), _col(t).cast("double"), _col(T).cast("double")
    ratio = (a / (b + x - F.lit(1.0))) * F.pow((al + T) / (al + t), r + x)
    return F.lit(1.0) / (F.lit(1.0) + F.when(x > 0, ratio).otherwise(F.lit(0.0)))


def p_alive(df: DataFrame, params: BGNBDParams, x="uniq_freq", t="uniq_rec", T="uniq_age",
            compat: bool = False) -> DataFrame:
    """Probability the customer is still active; ``p_churn = 1 - p_alive``.
    ``compat=True`` stores P(alive) under the name ``p_churn`` as the original
    report did."""
    pa = p_alive_expr(params, x, t, T)
    if compat:
        return df.withColumn("p_churn", pa)
    return df.withColumn("p_alive", pa).withColumn("p_churn", F.lit(1.0) - F.col("p_alive"))


# F6
def _purchase_terms(params: BGNBDParams, horizons: list, x, T):
    """``(first, kept)`` of ``E[X(s)] = first * (1 - kept_s) * P(alive)``:
    ``first = (a + b + x - 1) / (a - 1)`` and, for every horizon s, ``kept_s =
    (1 - z)^(r + x) 2F1(r + x, b + x; a + b + x - 1; z)`` with ``z = s / (alpha +
    T + s)``, one array.  At ``a = 1`` and ``a + b + x = 1`` both factors have a
    pole that their product lacks; there the parameter is moved by 1e-7 (a) or
    1e-12 (a + b + x - 1)."""
    a_ = params.a if abs(params.a - 1.0) >= 1e-7 else 1.0 + 1e-7
    r, al, a, b = (F.lit(v) for v in (params.r, params.alpha, a_, params.b))
    xc, Tc = _col(x).cast("double"), _col(T).cast("double")
    c = a + b + xc - F.lit(1.0)
    c = F.when(F.abs(c) < 1e-12, F.lit(1e-12)).otherwise(c)
    ends = [al + Tc + s for s in horizons]
    kept = hyp2f1_multi(r + xc, b + xc, c, [s / e for s, e in zip(horizons, ends)], [(al + Tc) / e for e in ends],
                        r + xc)
    return c / (a - F.lit(1.0)), kept


def expected_purchases_expr(params: BGNBDParams, s, x="uniq_freq", t="uniq_rec", T="uniq_age") -> Column:
    """Expected repeat purchases in the next ``s`` days given (x, t, T)."""
    s = _c(s)
    first, kept = _purchase_terms(params, [s], x, T)
    return F.when(s == 0, F.lit(0.0)).otherwise(first * (F.lit(1.0) - kept[0]) * p_alive_expr(params, x, t, T))


def expected_purchases(df: DataFrame, params: BGNBDParams, s: float = 1, out: str = "exp_purchases",
                       x="uniq_freq", t="uniq_rec", T="uniq_age") -> DataFrame:
    return df.withColumn(out, expected_purchases_expr(params, s, x, t, T))


# F8
def expected_avg_value_expr(params: GammaGammaParams, x="uniq_freq", m="uniq_mon") -> Column:
    p, q, v = F.lit(params.p), F.lit(params.q), F.lit(params.v)
    x, m = _col(x).cast("double"), _col(m).cast("double")
    w = p * x / (p * x + q - F.lit(1.0))
    return (F.lit(1.0) - w) * v * p / (q - F.lit(1.0)) + w * m


def expected_avg_value(df: DataFrame, params: GammaGammaParams, out: str = "predicted_sales",
                       x="uniq_freq", m="uniq_mon") -> DataFrame:
    return df.withColumn(out, expected_avg_value_expr(params, x, m))


# F9
def clv_expr(bg: BGNBDParams, gg: GammaGammaParams, months: int = 12, rate: float = 0.01,
             days_per_month: int = 30, x="uniq_freq", t="uniq_rec", T="uniq_age", m="uniq_mon") -> Column:
    """Discounted value of the next ``months`` months:
    ``E[M] * sum_i (E[X(30 i)] - E[X(30 (i-1))]) / (1+rate)^i``."""
    em = expected_avg_value_expr(gg, x, m)
    first, kept = _purchase_terms(bg, [F.lit(float(i * days_per_month)) for i in range(1, months + 1)], x, T)
    pa = p_alive_expr(bg, x, t, T)
    # sum_i (E_i - E_{i-1}) w_i with E_0 = 0 telescopes to
    # sum_{i<n} E_i (w_i - w_{i+1}) + E_n w_n
    w = [(1.0 + rate) ** -i for i in range(1, months + 2)]

    def body(st):
        total = F.lit(0.0)
        for i in range(1, months + 1):
            wi = w[i - 1] - w[i] if i < months else w[i - 1]
            total = total + (F.lit(1.0) - st[i - 1]) * F.lit(wi)
        return total
    return em * pa * first * let(kept, body)


def customer_lifetime_value(df: DataFrame, bg: BGNBDParams, gg: GammaGammaParams, months: int = 12,
                            rate: float = 0.01, out: str = "LTV", **cols) -> DataFrame:
    return df.withColumn(out, clv_expr(bg, gg, months, rate, **cols))


# F10
def calculate_ltv(df: DataFrame, spec=None, profit_margin: float | None = 1.0, as_of=None,
                  penalizer: float = 0.001, segment: bool = True, compat: bool = False,
                  horizon_days: float = 1.0):
    """Transactions (or a summary table) -> one keyed frame with RFM columns,
    ML segment, LTV, P(alive)/p_churn and expected purchases.  Models are
    fitted on eligible customers only and applied to all of them.
    Returns ``(frame, bg_params, gg_params)``."""
    from .rfm import build_rfm
    from .segment import ml_segment
    rfm = build_rfm(df, spec, as_of=as_of) if spec is not None else df
    rfm = stage_table(rfm, "rfm")
    if segment:
        rfm = ml_segment(rfm, "recency", "frequency", "monetary")
    elig = clv_eligible(rfm)
    bg, _ = fit_bgnbd(elig, penalizer)
    gg, _ = fit_gamma_gamma(elig, penalizer)
    margin = profit_margin if profit_margin else 1.0
    out = rfm.withColumn("LTV", F.coalesce(F.try_multiply(clv_expr(bg, gg), F.lit(float(margin))), F.lit(0.0)))
    out = p_alive(out, bg, compat=compat)
    out = expected_purchases(out, bg, horizon_days)
    return out, bg, gg


# F11
def time_split(df: DataFrame, date_col: str, test_size: float, tie_col: str, out: str = "split") -> DataFrame:
    """Time-ordered hold-out: the last ``ceil(test_size * n)`` rows by ``(date,
    tie_col)`` are ``test``; rows without a date get NULL.  The cut-off comes
    from ranked histograms: of the dates, then of ``tie_col`` on the cut-off
    date, then of a hash of the whole row among equal ties (rows that agree in
    every column go to the same side).  Three cut values reach the driver and
    rows are labelled by comparing with them: no global sort, window or join."""
    dated = df.where(F.col(date_col).isNotNull())
    n = dated.count()
    keep = n - math.ceil(test_size * n)                     # rows that train
    if keep >= n:
        return df.withColumn(out, F.when(F.col(date_col).isNotNull(), "train"))
    whole = F.xxhash64(*df.columns)
    label = F.lit("test")
    steps = []
    rest, left = dated.withColumn("__row", whole), keep
    for c in (date_col, tie_col, "__row"):
        # a null tie comes first
        none = rest.where(F.col(c).isNull()).count() if c == tie_col else 0
        if left < none:
            steps.append((c, None))
            rest = rest.where(F.col(c).isNull())
            continue
        left -= none
        h = ranked_histogram(rest, c)
        row = h.df.where((F.col("below") <= left) & (F.col("below") + F.col("cnt") > left)).first()
        steps.append((c, row["value"]))
        left -= row["below"]
        rest = rest.where(F.col(c) == F.lit(row["value"]))
        if left == 0:                                       # the cut lies before this value
            break
    for c, cut in reversed(steps):
        x = whole if c == "__row" else F.col(c)
        label = F.when(x.isNotNull(), "test").otherwise(label) if cut is None else \
            F.when(x.isNull() | (x < F.lit(cut)), "train").when(x > F.lit(cut), "test").otherwise(label)
    return df.withColumn(out, F.when(F.col(date_col).isNotNull(), label))


# F12
def prediction_error(df: DataFrame, y: str, yhat: str) -> DataFrame:
    d = F.col(y) - F.col(yhat)
    return df.agg(F.avg(d * d).alias("mse"), F.avg(y).alias("mean_actual"), F.avg(yhat).alias("mean_predicted"))
