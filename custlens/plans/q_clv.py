"""Catalogue: lifetime-value model pieces (F).  Likelihoods and predictions
are checked at fixed published-style parameter values, so the SQL twin is
exact; the fits themselves are checked for invariants in the tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clv as V
from ..operators import segment as S
from ..sources.tables import Tables
from .q_rfm import RFM_ORDERS_SQL, orders_rfm
from .registry import fx_df, fx_sql, query

BG = V.BGNBDParams(r=0.243, alpha=30.9, a=0.793, b=2.426)
GG = V.GammaGammaParams(p=6.25, q=3.74, v=15.44)


def _bg_sql_parts(x="uniq_freq", t="uniq_rec", T="uniq_age", bg=BG):
    r, al, a, b = bg.r, bg.alpha, bg.a, bg.b
    xd, td, Td = f"CAST({x} AS DOUBLE)", f"CAST({t} AS DOUBLE)", f"CAST({T} AS DOUBLE)"
    palive = (f"(1.0 / (1.0 + CASE WHEN {xd} > 0 THEN ({a} / ({b} + {xd} - 1.0)) * "
              f"pow(({al} + {Td}) / ({al} + {td}), {r} + {xd}) ELSE 0.0 END))")
    return xd, td, Td, palive


def hyp2f1_sql(a: str, b: str, c: str, z: str) -> str:
    """Series of 2F1 after its first term, ``1 + a b z / c * sum (a+1)_k (b+1)_k
    / ((c+1)_k (2)_k) z^k``: gamma values stay positive for c > -1."""
    g = f"greatest(({a}) + ({b}) - ({c}), 0.0)"
    k = f"CAST(greatest(ceil(({g} + 6.0 * sqrt({g}) + 40.0) / (1.0 - ({z}))), 30) AS BIGINT)"
    term = (f"exp(lgamma(({a}) + 1 + k) - lgamma(({a}) + 1) + lgamma(({b}) + 1 + k) - lgamma(({b}) + 1) "
            f"- lgamma(({c}) + 1 + k) + lgamma(({c}) + 1) - lgamma(k + 2) + k * ln({z}))")
    return f"(1.0 + ({a}) * ({b}) * ({z}) / ({c}) * list_sum(list_transform(range(0, {k}), lambda k: {term})))"


def exp_purchases_sql(s: float, bg=BG) -> str:
    r, al, a, b = bg.r, bg.alpha, bg.a, bg.b
    xd, td, Td, palive = _bg_sql_parts(bg=bg)
    if s == 0:
        return "0.0"
    z = f"({s} / ({al} + {Td} + {s}))"
    h = hyp2f1_sql(f"{r} + {xd}", f"{b} + {xd}", f"{a} + {b} + {xd} - 1.0", z)
    first = f"(({a} + {b} + {xd} - 1.0) / ({a} - 1.0))"
    second = f"(1.0 - {h} * pow(({al} + {Td}) / ({al} + {Td} + {s}), {r} + {xd}))"
    return f"({first} * {second} * {palive})"


def exp_value_sql(gg=GG, x="uniq_freq", m="uniq_mon") -> str:
    p, q, v = gg.p, gg.q, gg.v
    w = f"({p} * {x} / ({p} * {x} + {q} - 1.0))"
    return f"((1.0 - {w}) * {v} * {p} / ({q} - 1.0) + {w} * {m})"


@query("f1_clv_eligible", fx_sql(f"SELECT * FROM ({RFM_ORDERS_SQL}) WHERE uniq_freq > 1 AND uniq_mon > 0",
                                 ["monetary", "uniq_mon"]))
def f1_clv_eligible(spark, sf_dir):
    return fx_df(V.clv_eligible(orders_rfm(spark, sf_dir)))


def _bg_ll_sql():
    r, al, a, b = BG.r, BG.alpha, BG.a, BG.b
    x, t, T = "CAST(uniq_freq AS DOUBLE)", "CAST(uniq_rec AS DOUBLE)", "CAST(uniq_age AS DOUBLE)"
    a1 = f"(lgamma({r} + {x}) - lgamma({r}) + {r} * ln({al}))"
    a2 = f"(lgamma({a} + {b}) + lgamma({b} + {x}) - lgamma({b}) - lgamma({a} + {b} + {x}))"
    a3 = f"(-({r} + {x}) * ln({al} + {T}))"
    a4 = f"(ln({a}) - ln({b} + {x} - 1.0) - ({r} + {x}) * ln({al} + {t}))"
    return f"({a1} + {a2} + ln(exp({a3}) + CASE WHEN {x} > 0 THEN exp({a4}) ELSE 0.0 END))"


@query("f3_bgnbd_loglik", fx_sql(f"""
SELECT sum({_bg_ll_sql()}) AS loglik, CAST(count(*) AS BIGINT) AS n
FROM ({RFM_ORDERS_SQL}) WHERE uniq_freq > 1 AND uniq_mon > 0""", ["loglik"]))
def f3_bgnbd_loglik(spark, sf_dir):
    return fx_df(V.bgnbd_loglik(V.clv_eligible(orders_rfm(spark, sf_dir)), BG))


def _gg_ll_sql():
    p, q, v = GG.p, GG.q, GG.v
    x, m = "CAST(uniq_freq AS DOUBLE)", "uniq_mon"
    return (f"(lgamma({p} * {x} + {q}) - lgamma({p} * {x}) - lgamma({q}) + {q} * ln({v}) "
            f"+ ({p} * {x} - 1.0) * ln({m}) + {p} * {x} * ln({x}) - ({p} * {x} + {q}) * ln({x} * {m} + {v}))")


@query("f5_gamma_gamma_loglik", fx_sql(f"""
SELECT sum({_gg_ll_sql()}) AS loglik, CAST(count(*) AS BIGINT) AS n
FROM ({RFM_ORDERS_SQL}) WHERE uniq_freq > 1 AND uniq_mon > 0""", ["loglik"]))
def f5_gamma_gamma_loglik(spark, sf_dir):
    return fx_df(V.gg_loglik(V.clv_eligible(orders_rfm(spark, sf_dir)), GG))


@query("f6_expected_purchases", fx_sql(f"""
SELECT cust_id, {exp_purchases_sql(1.0)} AS exp_1d, {exp_purchases_sql(360.0)} AS exp_360d
FROM ({RFM_ORDERS_SQL})""", ["exp_1d", "exp_360d"]))
def f6_expected_purchases(spark, sf_dir):
    r = orders_rfm(spark, sf_dir)
    r = V.expected_purchases(r, BG, 1.0, "exp_1d")
    r = V.expected_purchases(r, BG, 360.0, "exp_360d")
    return fx_df(r.select("cust_id", "exp_1d", "exp_360d"))


@query("f7_p_alive", fx_sql(f"""
SELECT cust_id, {_bg_sql_parts()[3]} AS p_alive, 1.0 - {_bg_sql_parts()[3]} AS p_churn
FROM ({RFM_ORDERS_SQL})""", ["p_alive", "p_churn"]))
def f7_p_alive(spark, sf_dir):
    return fx_df(V.p_alive(orders_rfm(spark, sf_dir), BG).select("cust_id", "p_alive", "p_churn"))


@query("f8_expected_avg_value", fx_sql(f"""
SELECT cust_id, {exp_value_sql()} AS predicted_sales FROM ({RFM_ORDERS_SQL})""", ["predicted_sales"]))
def f8_expected_avg_value(spark, sf_dir):
    return fx_df(V.expected_avg_value(orders_rfm(spark, sf_dir), GG).select("cust_id", "predicted_sales"))


def _clv_sql(months=12, rate=0.01, bg=BG):
    terms = []
    for i in range(1, months + 1):
        cur = exp_purchases_sql(float(30 * i), bg)
        prev = exp_purchases_sql(float(30 * (i - 1)), bg)
        terms.append(f"({cur} - {prev}) / {(1.0 + rate) ** i!r}")
    return f"({exp_value_sql()} * ({' + '.join(terms)}))"


@query("f9_customer_lifetime_value", fx_sql(f"""
SELECT cust_id, {_clv_sql()} AS LTV FROM ({RFM_ORDERS_SQL})""", ["LTV"]))
def f9_customer_lifetime_value(spark, sf_dir):
    return fx_df(V.customer_lifetime_value(orders_rfm(spark, sf_dir), BG, GG).select("cust_id", "LTV"))


@query("f11_time_split", """
WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY d, o_orderkey) AS rn, count(*) OVER () AS n FROM o)
SELECT o_orderkey, CASE WHEN rn > n - ceil(0.2 * n) THEN 'test' ELSE 'train' END AS split FROM r""")
def f11_time_split(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return V.time_split(o, "d", 0.2, "o_orderkey").select("o_orderkey", "split")


#: As fitted to customers who hardly ever leave: a + b < 1 makes the 2F1's third argument negative at x = 0.
BG_LOYAL = V.BGNBDParams(r=6.551, alpha=1537.2, a=1e-8, b=0.0195)


@query("f6_expected_purchases_loyal", fx_sql(f"""
SELECT cust_id, {exp_purchases_sql(1.0, BG_LOYAL)} AS exp_1d, {exp_purchases_sql(360.0, BG_LOYAL)} AS exp_360d
FROM ({RFM_ORDERS_SQL})""", ["exp_1d", "exp_360d"]))
def f6_expected_purchases_loyal(spark, sf_dir):
    r = orders_rfm(spark, sf_dir)
    r = V.expected_purchases(r, BG_LOYAL, 1.0, "exp_1d")
    r = V.expected_purchases(r, BG_LOYAL, 360.0, "exp_360d")
    return fx_df(r.select("cust_id", "exp_1d", "exp_360d"))


@query("f9_customer_lifetime_value_loyal", fx_sql(f"""
SELECT cust_id, {_clv_sql(bg=BG_LOYAL)} AS LTV FROM ({RFM_ORDERS_SQL})""", ["LTV"]))
def f9_customer_lifetime_value_loyal(spark, sf_dir):
    return fx_df(V.customer_lifetime_value(orders_rfm(spark, sf_dir), BG_LOYAL, GG).select("cust_id", "LTV"))


@query("f12_prediction_error", fx_sql(f"""
SELECT avg((uniq_mon - ps) * (uniq_mon - ps)) AS mse, avg(uniq_mon) AS mean_actual, avg(ps) AS mean_predicted
FROM (SELECT uniq_mon, {exp_value_sql()} AS ps FROM ({RFM_ORDERS_SQL}))""",
                                      ["mse", "mean_actual", "mean_predicted"]))
def f12_prediction_error(spark, sf_dir):
    r = V.expected_avg_value(orders_rfm(spark, sf_dir), GG, "ps")
    return fx_df(V.prediction_error(r, "uniq_mon", "ps"))


@query("f2_fit_bgnbd")
def f2_fit_bgnbd(spark, sf_dir):
    """BG/NBD parameters fitted on the eligible customers (one row)."""
    bg, res = V.fit_bgnbd(V.clv_eligible(orders_rfm(spark, sf_dir)))
    return spark.createDataFrame([(bg.r, bg.alpha, bg.a, bg.b, res.fun, res.rounds, res.converged,
                                   ",".join(res.at_bound))],
                                 "r double, alpha double, a double, b double, objective double, "
                                 "rounds int, converged boolean, at_bound string")


@query("f4_fit_gamma_gamma")
def f4_fit_gamma_gamma(spark, sf_dir):
    gg, res = V.fit_gamma_gamma(V.clv_eligible(orders_rfm(spark, sf_dir)))
    return spark.createDataFrame([(gg.p, gg.q, gg.v, res.fun, res.rounds, res.converged)],
                                 "p double, q double, v double, objective double, rounds int, converged boolean")


@query("f10_calculate_ltv")
def f10_calculate_ltv(spark, sf_dir):
    """Full LTV frame: RFM, ML segment, LTV, P(alive), expected purchases."""
    from ..operators.rfm import RFMSpec
    spec = RFMSpec(id_col="o_custkey", trans_col="o_totalprice", trans_date_col="o_orderdate")
    o = Tables(spark, sf_dir).orders.select("o_custkey", "o_orderdate", "o_totalprice")
    out, _, _ = V.calculate_ltv(o, spec)
    return out


@query("e8_kmedoids_1d")
def e8_kmedoids_1d(spark, sf_dir):
    """1-D k-medoids labels of monetary value per customer."""
    r = orders_rfm(spark, sf_dir)
    lab, _ = S.kmedoids_1d(r, "monetary", k=5)
    return lab.select("cust_id", "monetary", "monetary_cluster")


@query("e10_ml_segment")
def e10_ml_segment(spark, sf_dir):
    return S.ml_segment(orders_rfm(spark, sf_dir), keep_code=True).select("cust_id", "ml_code", "ml_label")


# ---------------------------------------------------------------- E8 / E10 in SQL
def kmedoids_sql(src: str, col: str, k: int = 5, iters: int = 20, prefix: str = "km") -> tuple[str, str]:
    """Unrolled SQL twin of ``kmedoids_1d``: quantile-position initialisation,
    then ``iters`` rounds of nearest-medoid assignment and lower-median
    update.  Returns (CTE text, name of the final medoid-list CTE)."""
    ctes = [f"""{prefix}_d AS (SELECT CAST({col} AS DOUBLE) AS v FROM {src} WHERE {col} IS NOT NULL),
{prefix}_n AS (SELECT count(*) AS n, list_sort(list(v)) AS s FROM {prefix}_d),
{prefix}_0 AS (SELECT list_sort(list_distinct([{', '.join(f's[CAST(floor((n - 1) * {(i + 0.5) / k!r}) AS BIGINT) + 1]' for i in range(k))}])) AS m FROM {prefix}_n)"""]
    for it in range(1, iters + 1):
        prev = f"{prefix}_{it - 1}"
        ctes.append(f"""{prefix}_{it} AS (
  SELECT list_sort(list_distinct(list(med))) AS m FROM (
    SELECT c, quantile_disc(v, 0.5) AS med FROM (
      SELECT v, len(list_filter(list_transform(range(1, len(m)), lambda j: (m[j] + m[j + 1]) / 2.0), lambda b: v > b)) AS c
      FROM {prefix}_d CROSS JOIN {prev}) GROUP BY c))""")
    return ",\n".join(ctes), f"{prefix}_{iters}"


def _cluster_of(col: str, mcte: str) -> str:
    return (f"len(list_filter(list_transform(range(1, len({mcte}.m)), "
            f"lambda j: ({mcte}.m[j] + {mcte}.m[j + 1]) / 2.0), lambda b: CAST({col} AS DOUBLE) > b))")


_KM = kmedoids_sql("r", "monetary", 5, 20)


@query("e8_kmedoids_1d_sql", f"""
WITH r AS ({RFM_ORDERS_SQL}), {_KM[0]}
SELECT cust_id, monetary, CAST({_cluster_of('monetary', _KM[1])} AS INTEGER) AS monetary_cluster
FROM r CROSS JOIN {_KM[1]}""")
def e8_kmedoids_1d_sql(spark, sf_dir):
    """k-medoids with 20 iterations, checked against its unrolled SQL twin."""
    r = orders_rfm(spark, sf_dir)
    lab, _ = S.kmedoids_1d(r, "monetary", k=5, max_iter=20)
    return lab.select("cust_id", "monetary", "monetary_cluster")


def _ml_segment_sql():
    parts, sel = [], []
    for col, asc, tag in (("recency", False, "r"), ("frequency", True, "f"), ("monetary", True, "m")):
        c, last = kmedoids_sql("r", col, 5, 20, f"k{tag}")
        parts.append(c)
        idx = _cluster_of(col, last)
        sel.append(idx if asc else f"(len({last}.m) - 1 - {idx})")
    from ..functions.labels import SEGMENT_BY_RF
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SEGMENT_BY_RF.items())
    code = " || ".join(f"CAST({s} AS VARCHAR)" for s in sel)
    return f"""
WITH r AS ({RFM_ORDERS_SQL}), {', '.join(parts)},
c AS (SELECT cust_id, {code} AS ml_code FROM r CROSS JOIN kr_20 CROSS JOIN kf_20 CROSS JOIN km_20)
SELECT cust_id, ml_code, coalesce(CASE substr(ml_code, 1, 2) {arms} END, ml_code) AS ml_label FROM c"""


@query("e10_ml_segment_sql", _ml_segment_sql())
def e10_ml_segment_sql(spark, sf_dir):
    """ML segment labels (20 k-medoid iterations per column) against SQL."""
    return S.ml_segment(orders_rfm(spark, sf_dir), max_iter=20, keep_code=True).select("cust_id", "ml_code", "ml_label")
