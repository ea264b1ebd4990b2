"""Catalogue: statistical tests (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as H
from ..sources.tables import Tables
from .registry import fx_df, fx_sql, query


@query("h1_chi2_statistic", fx_sql("""
WITH d AS (SELECT c_mktsegment AS a, c_nationkey AS b FROM customer),
n AS (SELECT count(*) AS n FROM d),
ra AS (SELECT a, count(*) AS ra FROM d GROUP BY a), cb AS (SELECT b, count(*) AS cb FROM d GROUP BY b),
o AS (SELECT a, b, count(*) AS o FROM d GROUP BY a, b),
g AS (SELECT ra.a, cb.b, ra.ra * cb.cb / n.n AS e, coalesce(o.o, 0) AS o
      FROM ra CROSS JOIN cb CROSS JOIN n LEFT JOIN o ON o.a = ra.a AND o.b = cb.b)
SELECT sum((o - e) * (o - e) / e) AS statistic,
       CAST(((SELECT count(*) FROM ra) - 1) * ((SELECT count(*) FROM cb) - 1) AS BIGINT) AS dof,
       CAST((SELECT n FROM n) AS BIGINT) AS n
FROM g""", ["statistic"]))
def h1_chi2_statistic(spark, sf_dir):
    return fx_df(H.chi2_statistic(Tables(spark, sf_dir).customer, "c_mktsegment", "c_nationkey"))


@query("h1_chi2_independence")
def h1_chi2_independence(spark, sf_dir):
    """Full test (statistic, dof, p-value, critical value, decision)."""
    r = H.chi2_independence(Tables(spark, sf_dir).lineitem, "l_returnflag", "l_linestatus")
    return spark.createDataFrame([(r["statistic"], r["dof"], r["p_value"], r["critical"], r["reject"])],
                                 "statistic double, dof int, p_value double, critical double, reject boolean")


def _avg_rank(col):
    return f"(rank() OVER (ORDER BY {col}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)"


@query("h2_spearman_rho", fx_sql(f"""
WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL),
r AS (SELECT {_avg_rank('x')} AS rx, {_avg_rank('y')} AS ry FROM d)
SELECT covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS rho, CAST(count(*) AS BIGINT) AS n FROM r""", ["rho"]))
def h2_spearman_rho(spark, sf_dir):
    return fx_df(H.spearman_rho(Tables(spark, sf_dir).lineitem, "l_quantity", "l_extendedprice"))


@query("h2_spearman_test")
def h2_spearman_test(spark, sf_dir):
    r = H.spearman(Tables(spark, sf_dir).customer, "c_acctbal", "c_nationkey")
    return spark.createDataFrame([(r["rho"], r["p_value"], r["reject"])], "rho double, p_value double, reject boolean")


_K2_COLS = ["l_quantity", "l_extendedprice", "l_discount"]


def _k2_sql():
    parts = []
    for c in _K2_COLS:
        parts.append(f"""
SELECT '{c}' AS column, CAST(count(v) AS DOUBLE) AS n,
       avg(pow(v - mu, 3)) / pow(avg(pow(v - mu, 2)), 1.5) AS g1,
       avg(pow(v - mu, 4)) / pow(avg(pow(v - mu, 2)), 2) AS b2
FROM (SELECT CAST({c} AS DOUBLE) AS v, avg(CAST({c} AS DOUBLE)) OVER () AS mu FROM lineitem WHERE {c} IS NOT NULL)""")
    m = " UNION ALL ".join(parts)
    return f"""
WITH m AS ({m}),
s AS (SELECT "column", n, g1, b2,
        CASE WHEN g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) = 0 THEN 1.0 ELSE g1 * sqrt((n + 1) * (n + 3) / (6.0 * (n - 2))) END AS y,
        3.0 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9)) AS beta2,
        3.0 * (n - 1) / (n + 1) AS e,
        24.0 * n * (n - 2) * (n - 3) / ((n + 1) * (n + 1) * (n + 3) * (n + 5)) AS varb2,
        6.0 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * sqrt(6.0 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3))) AS sb1
      FROM m),
t AS (SELECT *, -1.0 + sqrt(2 * (beta2 - 1)) AS w2, (b2 - e) / sqrt(varb2) AS xk,
             6.0 + 8.0 / sb1 * (2.0 / sb1 + sqrt(1 + 4.0 / (sb1 * sb1))) AS a FROM s),
u AS (SELECT "column", n,
        (1 / sqrt(0.5 * ln(w2))) * ln(y / sqrt(2.0 / (w2 - 1)) + sqrt((y / sqrt(2.0 / (w2 - 1))) * (y / sqrt(2.0 / (w2 - 1))) + 1)) AS skew_z,
        ((1 - 2 / (9.0 * a)) - sign(1 + xk * sqrt(2 / (a - 4.0))) * pow((1 - 2.0 / a) / abs(1 + xk * sqrt(2 / (a - 4.0))), 1 / 3.0))
          / sqrt(2 / (9.0 * a)) AS kurt_z
      FROM t)
SELECT "column", CAST(n AS BIGINT) AS n, skew_z, kurt_z, skew_z * skew_z + kurt_z * kurt_z AS statistic,
       exp(-(skew_z * skew_z + kurt_z * kurt_z) / 2) AS p_value FROM u"""


@query("h4_dagostino_k2", fx_sql(_k2_sql(), ["skew_z", "kurt_z", "statistic", "p_value"]))
def h4_dagostino_k2(spark, sf_dir):
    return fx_df(H.dagostino_k2(Tables(spark, sf_dir).lineitem, _K2_COLS))


@query("h3_shapiro")
def h3_shapiro(spark, sf_dir):
    r = H.shapiro(Tables(spark, sf_dir).customer, "c_acctbal")
    return spark.createDataFrame([(r["statistic"], r["p_value"], r["n"], r["reject"])],
                                 "statistic double, p_value double, n long, reject boolean")


@query("h5_anderson_darling")
def h5_anderson_darling(spark, sf_dir):
    r = H.anderson_darling(Tables(spark, sf_dir).customer, "c_acctbal")
    return spark.createDataFrame([(r["statistic"], r["critical_values"], r["reject_at_5pct"])],
                                 "statistic double, critical_values array<double>, reject_at_5pct boolean")


@query("h6_qq_points")
def h6_qq_points(spark, sf_dir):
    return H.qq_points(Tables(spark, sf_dir).customer, "c_acctbal", 100)


@query("h6_qq_samples", fx_sql(" UNION ALL ".join(
    f"SELECT {(k - 0.5) / 20!r} AS prob, quantile_cont(c_acctbal, {(k - 0.5) / 20!r}) AS sample FROM customer"
    for k in range(1, 21)), ["prob", "sample"]))
def h6_qq_samples(spark, sf_dir):
    """The sample side of the Q-Q points (the theoretical one is a normal quantile)."""
    return fx_df(H.qq_points(Tables(spark, sf_dir).customer, "c_acctbal", 20).select("prob", "sample"))


@query("h7_linear_fit", fx_sql("""
SELECT o_orderkey, regr_intercept(o_totalprice, CAST(o_custkey AS DOUBLE)) OVER () + regr_slope(o_totalprice, CAST(o_custkey AS DOUBLE)) OVER () * o_custkey AS fitted
FROM orders""", ["fitted"]))
def h7_linear_fit(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double"))
    return fx_df(H.linear_fit(o, "o_custkey", "o_totalprice").select("o_orderkey", "fitted"))
