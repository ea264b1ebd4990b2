"""Catalogue: RFM tables (D) and segmentation (E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rfm as R
from ..operators import segment as S
from ..functions.labels import regex_label
from ..sources.tables import Tables
from .registry import fx, fx_df, fx_sql, query

# ---------------------------------------------------------------- shared SQL
# Transactions: one row per order (customer, order day, order total).
ORDERS_TX_SQL = """
SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS d, o_totalprice AS amt
FROM orders
WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL
  AND NOT isnan(o_totalprice)
"""

# Line-level transactions with returns negated (amount < 0 for flag R).
LINES_TX_SQL = """
SELECT o.o_custkey AS id, CAST(o.o_orderdate AS DATE) AS d,
       CASE WHEN l.l_returnflag = 'R' THEN -l.l_extendedprice ELSE l.l_extendedprice END AS amt,
       l.l_orderkey AS l_orderkey, l.l_linenumber AS l_linenumber
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""


def rfm_sql(tx: str, extra_cols: str = "") -> str:
    """RFM over a transactions CTE with columns id, d, amt (+ extra columns
    that take part in the full-row de-duplication)."""
    distinct_cols = "id, d, amt" + (", " + extra_cols if extra_cols else "")
    return f"""
WITH t AS ({tx}),
t2 AS (SELECT * FROM t WHERE id IS NOT NULL AND d IS NOT NULL AND amt IS NOT NULL),
a AS (SELECT max(d) AS as_of_d FROM t2),
dd AS (SELECT id, count(*) AS freq FROM (SELECT DISTINCT {distinct_cols} FROM t2) GROUP BY id),
g AS (SELECT id, min(d) AS f, max(d) AS l, count(DISTINCT d) AS nd, sum(amt) AS money
      FROM t2 GROUP BY id),
j AS (SELECT g.*, dd.freq, a.as_of_d, coalesce(g.money / dd.freq, 0.0) AS per
      FROM g JOIN dd ON g.id = dd.id CROSS JOIN a)
SELECT id AS cust_id,
       CAST(date_diff('day', f, as_of_d) AS BIGINT) AS uniq_age,
       CAST(date_diff('day', l, as_of_d) AS BIGINT) AS recency,
       CAST(date_diff('day', f, l) AS BIGINT) AS uniq_rec,
       CAST(freq AS BIGINT) AS frequency,
       CAST(nd - 1 AS BIGINT) AS uniq_freq,
       CAST(CASE WHEN per < 0 THEN 0.0 ELSE money END AS DOUBLE) AS monetary,
       CAST(CASE WHEN per < 0 THEN 0.0 ELSE per END AS DOUBLE) AS uniq_mon
FROM j"""


def orders_tx(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    return o.select("o_custkey", "o_orderdate", "o_totalprice")


def lines_tx(spark, sf_dir):
    t = Tables(spark, sf_dir)
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    j = li.join(o, li.l_orderkey == o.o_orderkey)
    return j.select(
        F.col("o_custkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"),
        F.when(F.col("l_returnflag") == "R", -F.col("l_extendedprice"))
         .otherwise(F.col("l_extendedprice")).alias("amt"),
        "l_orderkey", "l_linenumber")


def orders_rfm(spark, sf_dir):
    return R.rfm_from_transactions(orders_tx(spark, sf_dir), "o_custkey", "o_totalprice", "o_orderdate")


RFM_ORDERS_SQL = rfm_sql(ORDERS_TX_SQL)


@query("d1_rfm_from_transactions", fx_sql(RFM_ORDERS_SQL, ["monetary", "uniq_mon"]))
def d1_rfm_from_transactions(spark, sf_dir):
    return fx_df(orders_rfm(spark, sf_dir))


@query("d1_rfm_lines_with_returns",
       fx_sql(rfm_sql(LINES_TX_SQL, "l_orderkey, l_linenumber"), ["monetary", "uniq_mon"]))
def d1_rfm_lines_with_returns(spark, sf_dir):
    """Line-level transactions with returned lines negated: exercises the
    full-row de-duplication and the negative-average clamp."""
    return fx_df(R.rfm_from_transactions(lines_tx(spark, sf_dir), "id", "amt", "d"))


# ---------------------------------------------------------------- D2-D4
CUST_SUMMARY_SQL = """
SELECT o_custkey AS id,
       CAST(count(*) AS BIGINT) AS n_orders,
       sum(o_totalprice) AS total,
       CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), DATE '2001-12-31') AS BIGINT) AS age_days,
       CAST(date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2001-12-31') AS BIGINT) AS rec_days
FROM orders GROUP BY o_custkey
"""


def cust_summary(spark, sf_dir):
    """Per-customer summary table (one row per id) derived from orders."""
    o = orders_tx(spark, sf_dir)
    d = F.to_date("o_orderdate")
    end = F.lit("2001-12-31").cast("date")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count(F.lit(1)).cast("long").alias("n_orders"),
        F.sum("o_totalprice").alias("total"),
        F.datediff(end, F.min(d)).cast("long").alias("age_days"),
        F.datediff(end, F.max(d)).cast("long").alias("rec_days"))


@query("d2_rfm_from_precomputed", fx_sql(f"""
SELECT id AS cust_id, age_days AS uniq_age, rec_days AS recency, rec_days AS uniq_rec,
       n_orders AS frequency, n_orders AS uniq_freq,
       CAST(total AS DOUBLE) AS monetary, CAST(total AS DOUBLE) AS uniq_mon
FROM ({CUST_SUMMARY_SQL})""", ["monetary", "uniq_mon"]))
def d2_rfm_from_precomputed(spark, sf_dir):
    spec = R.RFMSpec(id_col="id", age_col="age_days", cal_rec="rec_days", cal_freq="n_orders",
                     cal_mon="total")
    return fx_df(R.rfm_from_summary(cust_summary(spark, sf_dir), spec))


@query("d3_rfm_from_raw_summary", fx_sql(f"""
SELECT id AS cust_id, age_days AS uniq_age, rec_days AS recency, age_days - rec_days AS uniq_rec,
       n_orders AS frequency, n_orders - 1 AS uniq_freq,
       CAST(total AS DOUBLE) AS monetary, CAST(total / n_orders AS DOUBLE) AS uniq_mon
FROM ({CUST_SUMMARY_SQL})""", ["monetary", "uniq_mon"]))
def d3_rfm_from_raw_summary(spark, sf_dir):
    spec = R.RFMSpec(id_col="id", age_col="age_days", recency_col="rec_days",
                     frequency_col="n_orders", monetary_col="total")
    return fx_df(R.rfm_from_summary(cust_summary(spark, sf_dir), spec))


@query("d4_rfm_mixed_resolution", fx_sql(f"""
WITH r AS ({RFM_ORDERS_SQL}), s AS ({CUST_SUMMARY_SQL})
SELECT r.cust_id, r.uniq_age, s.rec_days AS recency, r.uniq_age - s.rec_days AS uniq_rec,
       r.frequency, r.uniq_freq, r.monetary, r.uniq_mon
FROM r JOIN s ON r.cust_id = s.id""", ["monetary", "uniq_mon"]))
def d4_rfm_mixed_resolution(spark, sf_dir):
    """Dates give age, frequency and money; recency comes from a raw column."""
    tx = orders_tx(spark, sf_dir)
    summ = cust_summary(spark, sf_dir).select(F.col("id").alias("o_custkey"), "rec_days")
    joined = tx.join(summ, "o_custkey")
    spec = R.RFMSpec(id_col="o_custkey", trans_col="o_totalprice", trans_date_col="o_orderdate",
                     recency_col="rec_days")
    return fx_df(R.build_rfm(joined, spec))


@query("d5_clv_summary", fx_sql("""
WITH t AS (SELECT o_custkey AS id, CAST(o_orderdate AS DATE) AS d, o_totalprice AS amt FROM orders),
e AS (SELECT max(d) AS e FROM t),
pd AS (SELECT id, d, sum(amt) AS amt FROM t GROUP BY id, d),
g AS (SELECT id, min(d) AS f, max(d) AS l, count(*) AS nd, sum(amt) AS tot,
             arg_min(amt, d) AS first_amt FROM pd GROUP BY id)
SELECT id AS o_custkey, CAST(nd - 1 AS DOUBLE) AS frequency,
       CAST(date_diff('day', f, l) AS DOUBLE) AS recency,
       CAST(date_diff('day', f, e.e) AS DOUBLE) AS T,
       CASE WHEN nd > 1 THEN (tot - first_amt) / (nd - 1) ELSE 0.0 END AS monetary_value
FROM g CROSS JOIN e""", ["monetary_value"]))
def d5_clv_summary(spark, sf_dir):
    return fx_df(R.clv_summary(orders_tx(spark, sf_dir), "o_custkey", "o_orderdate", "o_totalprice"))


@query("d6_clv_frame", fx_sql(f"""
WITH s AS ({CUST_SUMMARY_SQL}),
c AS (SELECT s.*, CAST(DATE '2001-12-31' - CAST(age_days AS INTEGER) AS DATE) AS since FROM s),
m AS (SELECT max(since) AS mx FROM c)
SELECT id, CAST(date_diff('day', since, mx) AS BIGINT) AS AGE, n_orders - 1 AS FREQUENCY,
       CAST(date_diff('day', since, mx) AS BIGINT) - rec_days AS RECENCY,
       CAST(total AS DOUBLE) / n_orders AS MONETARY
FROM c CROSS JOIN m""", ["MONETARY"]))
def d6_clv_frame(spark, sf_dir):
    s = cust_summary(spark, sf_dir).withColumn(
        "since", F.date_sub(F.lit("2001-12-31").cast("date"), F.col("age_days").cast("int")))
    return fx_df(R.clv_frame(s, "id", "since", "rec_days", "n_orders", "total"))


WIDE_SQL = """
SELECT o_custkey AS id,
       count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS n_urgent,
       count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS n_high,
       count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS n_other,
       coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F'), 0.0) AS amt_f,
       coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus <> 'F'), 0.0) AS amt_other,
       CAST(date_diff('day', max(CAST(o_orderdate AS DATE)), DATE '2001-12-31') AS BIGINT) AS rec_days
FROM orders GROUP BY o_custkey
"""


def wide_customers(spark, sf_dir):
    """Wide per-customer table (counts and amounts in separate columns)."""
    o = Tables(spark, sf_dir).orders
    pr = F.col("o_orderpriority")
    st = F.col("o_orderstatus")
    return o.groupBy(F.col("o_custkey").alias("id")).agg(
        F.count_if(pr == "1-URGENT").alias("n_urgent"),
        F.count_if(pr == "2-HIGH").alias("n_high"),
        F.count_if(~pr.isin("1-URGENT", "2-HIGH")).alias("n_other"),
        F.coalesce(F.sum(F.when(st == "F", F.col("o_totalprice"))), F.lit(0.0)).alias("amt_f"),
        F.coalesce(F.sum(F.when(st != "F", F.col("o_totalprice"))), F.lit(0.0)).alias("amt_other"),
        F.datediff(F.lit("2001-12-31").cast("date"), F.max(F.to_date("o_orderdate"))).cast("long").alias("rec_days"))


@query("d7_rfm_from_wide", fx_sql(f"""
SELECT id AS ID, rec_days AS RECENCY, n_urgent + n_high + n_other AS FREQUENCY,
       amt_f + amt_other AS MONETARY
FROM ({WIDE_SQL}) WHERE n_urgent + n_high + n_other > 1 AND amt_f + amt_other > 0""", ["MONETARY"]))
def d7_rfm_from_wide(spark, sf_dir):
    return fx_df(R.rfm_from_wide(wide_customers(spark, sf_dir), "id", ["n_urgent", "n_high", "n_other"],
                                 ["amt_f", "amt_other"], "rec_days"))


# ---------------------------------------------------------------- E1-E7
def _avg_rank_sql(col: str, desc: bool = False) -> str:
    order = f"{col} DESC" if desc else col
    return (f"(rank() OVER (ORDER BY {order}) + (count(*) OVER (PARTITION BY {col}) - 1) / 2.0)")


@query("e1_average_rank", fx_sql(f"""
WITH r AS ({RFM_ORDERS_SQL})
SELECT cust_id, {_avg_rank_sql('monetary')} AS monetary_rank,
       {_avg_rank_sql('recency', True)} AS recency_rank,
       {_avg_rank_sql('frequency')} AS frequency_rank
FROM r""", ["monetary_rank", "recency_rank", "frequency_rank"]))
def e1_average_rank(spark, sf_dir):
    r = orders_rfm(spark, sf_dir).select("cust_id", "monetary", "recency", "frequency").persist()
    r = S.average_rank(r, "monetary", True, "monetary_rank")
    r = S.average_rank(r, "recency", False, "recency_rank")
    r = S.average_rank(r, "frequency", True, "frequency_rank")
    return fx_df(r.select("cust_id", "monetary_rank", "recency_rank", "frequency_rank"))


def rfm_score_sql(base_sql: str, compat: bool = False) -> str:
    r2 = lambda e: fx(e, 2)
    m_num = "F_rank" if compat else "M_rank"
    return f"""
WITH b AS ({base_sql}),
k AS (SELECT *, {_avg_rank_sql('recency', True)} AS R_rank,
             {_avg_rank_sql('frequency')} AS F_rank, {_avg_rank_sql('monetary')} AS M_rank FROM b),
n AS (SELECT *, max(R_rank) OVER () AS rmax, max(F_rank) OVER () AS fmax, max(M_rank) OVER () AS mmax FROM k),
s AS (SELECT *, {r2(f"(0.15 * (R_rank / rmax * 100) + 0.28 * (F_rank / fmax * 100) + 0.57 * ({m_num} / mmax * 100)) * 0.05")} AS RFM_Score FROM n)
SELECT cust_id, uniq_age, recency, uniq_rec, frequency, uniq_freq,
       {r2('monetary')} AS monetary, {r2('uniq_mon')} AS uniq_mon, RFM_Score,
       CASE WHEN RFM_Score >= 4.5 THEN 'Champion' WHEN RFM_Score > 4 THEN 'Potential loyalist'
            WHEN RFM_Score > 3 THEN 'Need attention' WHEN RFM_Score > 1.6 THEN 'At risk'
            ELSE 'Lost' END AS score_label
FROM s"""


@query("e3_rfm_score", fx_sql(rfm_score_sql(RFM_ORDERS_SQL), ["monetary", "uniq_mon", "RFM_Score"]))
def e3_rfm_score(spark, sf_dir):
    return fx_df(S.rfm_score(orders_rfm(spark, sf_dir)))


@query("e2_rfm_score_compat", fx_sql(rfm_score_sql(RFM_ORDERS_SQL, compat=True),
                                     ["monetary", "uniq_mon", "RFM_Score"]))
def e2_rfm_score_compat(spark, sf_dir):
    """Rank normalisation reproducing the original monetary-term bug."""
    return fx_df(S.rfm_score(orders_rfm(spark, sf_dir), compat=True))


@query("e4_score_label_counts", f"""
WITH s AS ({rfm_score_sql(RFM_ORDERS_SQL)})
SELECT score_label, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY score_label""")
def e4_score_label_counts(spark, sf_dir):
    s = S.rfm_score(orders_rfm(spark, sf_dir))
    return s.groupBy("score_label").agg(F.count(F.lit(1)).alias("n"))


def _qcut_sql(col: str, q: int, first: int) -> str:
    probs = ", ".join(str(i / q) for i in range(1, q))
    terms = " + ".join(f"CAST({col} > e.q[{i}] AS INTEGER)" for i in range(1, q))
    return (f"(SELECT quantile_cont({col}, [{probs}]) AS q FROM r) AS e",
            f"({first} + {terms})")


_MQ = _qcut_sql("monetary", 5, 1)


@query("e5_qcut", f"""
WITH r AS ({RFM_ORDERS_SQL})
SELECT cust_id, CAST({_MQ[1]} AS INTEGER) AS m_score FROM r CROSS JOIN {_MQ[0]}""")
def e5_qcut(spark, sf_dir):
    r = orders_rfm(spark, sf_dir)
    return S.qcut(r, "monetary", 5, out="m_score", first_label=1).select("cust_id", "m_score")


def _quant_codes_sql(first: int) -> str:
    parts = []
    for col, name in (("frequency", "f"), ("recency", "r"), ("monetary", "m")):
        probs = ", ".join(str(i / 5) for i in range(1, 5))
        parts.append((name, col, probs))
    ctes = ", ".join(f"e{n} AS (SELECT quantile_cont(CAST({c} AS DOUBLE), [{p}]) AS q FROM w)" for n, c, p in parts)
    sel = ", ".join(
        f"({first} + " + " + ".join(f"CAST({c} > e{n}.q[{i}] AS INTEGER)" for i in range(1, 5)) + f") AS {n}_score"
        for n, c, _ in parts)
    return ctes, sel


WIDE_RFM_SQL = f"""
SELECT id, rec_days AS recency, n_urgent + n_high + n_other AS frequency, amt_f + amt_other AS monetary
FROM ({WIDE_SQL}) WHERE n_urgent + n_high + n_other > 1 AND amt_f + amt_other > 0"""


def wide_rfm(spark, sf_dir):
    w = R.rfm_from_wide(wide_customers(spark, sf_dir), "id", ["n_urgent", "n_high", "n_other"],
                        ["amt_f", "amt_other"], "rec_days")
    return w.select(F.col("ID").alias("id"), F.col("RECENCY").alias("recency"),
                    F.col("FREQUENCY").alias("frequency"), F.col("MONETARY").alias("monetary"))


def _quantile_codes(spark, sf_dir, first: int):
    w = wide_rfm(spark, sf_dir).persist()
    # recency / monetary are near-continuous; frequency has ties, so its
    # duplicate edges are dropped (fewer bins) instead of raising.
    x = S.qcut(w, "frequency", 5, out="f_score", first_label=first, duplicates="drop")
    x = S.qcut(x, "recency", 5, out="r_score", first_label=first, duplicates="drop")
    x = S.qcut(x, "monetary", 5, out="m_score", first_label=first, duplicates="drop")
    return x.withColumn("rfm_score", S.composite_code("f_score", "r_score", "m_score"))


def _dedup_qcut_sql(first: int) -> str:
    """qcut with duplicate edges dropped, in SQL: bins between distinct edges."""
    cols = (("frequency", "f"), ("recency", "r"), ("monetary", "m"))
    probs = "[0.0, 0.2, 0.4, 0.6, 0.8, 1.0]"
    ctes = ",\n".join(
        f"e{n} AS (SELECT list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), {probs}))) AS q FROM w)"
        for c, n in cols)
    sel = ",\n".join(
        f"CAST({first} + len(list_filter(e{n}.q[2:len(e{n}.q) - 1], lambda x: CAST({c} AS DOUBLE) > x)) AS INTEGER) AS {n}_score"
        for c, n in cols)
    return ctes, sel


_QC = _dedup_qcut_sql(1)
_QC0 = _dedup_qcut_sql(0)


@query("e6_composite_code", f"""
WITH w AS ({WIDE_RFM_SQL}), {_QC[0]},
s AS (SELECT id, {_QC[1]} FROM w CROSS JOIN ef CROSS JOIN er CROSS JOIN em)
SELECT id, f_score, r_score, m_score,
       CAST(f_score AS VARCHAR) || CAST(r_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_score
FROM s""")
def e6_composite_code(spark, sf_dir):
    return _quantile_codes(spark, sf_dir, 1).select("id", "f_score", "r_score", "m_score", "rfm_score")


def _regex_label_sql(col: str) -> str:
    from ..functions.labels import QUANTILE_CODE_PATTERNS
    arms = " ".join(f"WHEN regexp_matches({col}, '^(?:{p})') THEN '{lab}'" for p, lab in QUANTILE_CODE_PATTERNS)
    return f"CASE {arms} ELSE {col} END"


@query("e7_regex_label", f"""
WITH w AS ({WIDE_RFM_SQL}), {_QC0[0]},
s AS (SELECT id, {_QC0[1]} FROM w CROSS JOIN ef CROSS JOIN er CROSS JOIN em),
c AS (SELECT id, CAST(f_score AS VARCHAR) || CAST(r_score AS VARCHAR) || CAST(m_score AS VARCHAR) AS rfm_score FROM s)
SELECT id, rfm_score, {_regex_label_sql('rfm_score')} AS Label FROM c""")
def e7_regex_label(spark, sf_dir):
    x = _quantile_codes(spark, sf_dir, 0)
    return x.select("id", "rfm_score", regex_label("rfm_score").alias("Label"))


# ---------------------------------------------------------------- E9, E11-E14
@query("e9_order_clusters", """
WITH m AS (SELECT c_mktsegment, avg(c_acctbal) AS m FROM customer GROUP BY 1),
r AS (SELECT c_mktsegment, CAST(row_number() OVER (ORDER BY m, c_mktsegment) - 1 AS INTEGER) AS seg_rank FROM m)
SELECT c.c_custkey, r.seg_rank FROM customer c JOIN r ON c.c_mktsegment = r.c_mktsegment""")
def e9_order_clusters(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    return S.order_clusters(c, "c_mktsegment", "c_acctbal", True, out="seg_rank").select("c_custkey", "seg_rank")


@query("e14_cluster_profile", fx_sql("""
SELECT c_mktsegment, avg(c_acctbal) AS avg_c_acctbal, avg(c_nationkey) AS avg_c_nationkey,
       CAST(count(*) AS BIGINT) AS size FROM customer GROUP BY 1""", ["avg_c_acctbal", "avg_c_nationkey"]))
def e14_cluster_profile(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    return fx_df(S.cluster_profile(c, "c_mktsegment", ["c_acctbal", "c_nationkey"]))


@query("e11_rfm_kmeans")
def e11_rfm_kmeans(spark, sf_dir):
    """Min-max scaled RFM columns clustered with k-means (k=5, 50 starts, seed 42)."""
    r = orders_rfm(spark, sf_dir)
    lab, _ = S.rfm_kmeans(r, ["recency", "frequency", "monetary"], k=5, seed=42)
    return lab.select("cust_id", "cluster")


@query("e12_elbow")
def e12_elbow(spark, sf_dir):
    return S.elbow(orders_rfm(spark, sf_dir), ["recency", "frequency", "monetary"], range(1, 11))


@query("e13_silhouette")
def e13_silhouette(spark, sf_dir):
    return S.silhouette(orders_rfm(spark, sf_dir), ["recency", "frequency", "monetary"], range(2, 11))
