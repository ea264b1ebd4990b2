"""Catalogue: segment and profile reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as G
from ..operators import segment as S
from ..sources.tables import Tables
from .q_rfm import RFM_ORDERS_SQL, orders_rfm, rfm_score_sql
from .registry import fx, fx_df, fx_sql, query

SCORED_SQL = rfm_score_sql(RFM_ORDERS_SQL)


def scored(spark, sf_dir):
    return S.rfm_score(orders_rfm(spark, sf_dir))


@query("g2_segment_counts", f"""
WITH s AS ({SCORED_SQL}), c AS (SELECT score_label, count(*) AS n FROM s GROUP BY score_label)
SELECT score_label, CAST(n AS BIGINT) AS count, CAST(floor(n * 100 / (SELECT sum(n) FROM c)) AS BIGINT) AS share_pct,
       lower(score_label) IN ('champion', 'loyal') AS highlight FROM c""")
def g2_segment_counts(spark, sf_dir):
    return G.segment_counts(scored(spark, sf_dir), "score_label")


@query("g3_treemap_data", f"""
WITH s AS ({SCORED_SQL}),
d AS (SELECT score_label, round(avg(monetary), 1) AS v, count(*) AS n FROM s GROUP BY score_label)
SELECT score_label AS label, score_label || chr(10) || ' LTV: ' || CAST(CAST(v AS DECIMAL(38,1)) AS VARCHAR) AS text,
       CAST(n AS BIGINT) AS size FROM d""")
def g3_treemap_data(spark, sf_dir):
    d = G.describe_segments(scored(spark, sf_dir), "score_label", ["monetary"], digits=None)
    d = d.withColumn("monetary_mean", F.round(F.col("monetary_mean"), 1).cast("decimal(38,1)"))
    return G.treemap_data(d, "score_label", "monetary_mean", "count")


@query("g4_clv_summary_stats", fx_sql(f"""
WITH r AS ({RFM_ORDERS_SQL})
SELECT CAST(count(monetary) AS BIGINT) AS n, round(avg(monetary), 2) AS avg, min(monetary) AS min,
       max(monetary) AS max, quantile_cont(monetary, 0.25) AS p25, quantile_cont(monetary, 0.5) AS p50,
       quantile_cont(monetary, 0.75) AS p75 FROM r""", ["avg", "min", "max", "p25", "p50", "p75"]))
def g4_clv_summary_stats(spark, sf_dir):
    return fx_df(G.clv_summary_stats(orders_rfm(spark, sf_dir), "monetary"))


# Operations log derived from events: one project per user, error events are
# exception records, everything else info records.
LOGS_SQL = """
SELECT user_id AS project_id, CASE WHEN event_type = 'error' THEN 'exception' ELSE 'info' END AS kind, ts, event_id
FROM events"""


def event_logs(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.select(F.col("user_id").alias("project_id"),
                    F.when(F.col("event_type") == "error", "exception").otherwise("info").alias("kind"),
                    "ts", "event_id")


@query("g5_project_rollup", f"""
WITH l AS ({LOGS_SQL}),
d AS (SELECT DISTINCT c_custkey AS project_id, c_mktsegment AS train_tag FROM customer),
c AS (SELECT project_id, count(*) FILTER (WHERE kind = 'info') AS s, count(*) FILTER (WHERE kind = 'exception') AS x
      FROM l GROUP BY project_id)
SELECT d.project_id, d.train_tag, CAST(coalesce(c.s, 0) AS BIGINT) AS success_logs,
       CAST(coalesce(c.x, 0) AS BIGINT) AS exception_logs
FROM d LEFT JOIN c ON d.project_id = c.project_id""")
def g5_project_rollup(spark, sf_dir):
    """Project details (here: every customer key as a project id with its
    segment as tag) next to their success / exception log counts."""
    det = Tables(spark, sf_dir).customer.select(
        F.col("c_custkey").alias("project_id"), F.col("c_mktsegment").alias("train_tag")).distinct()
    return G.project_rollup(event_logs(spark, sf_dir), det)


@query("g6_latest_status", """
WITH r AS (SELECT user_id, event_type, ts,
                  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events)
SELECT user_id, status, ts AS last_update, status IN ('failed', 'validated', 'completed') AS runnable
FROM (SELECT *, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'arrived'
      ELSE 'progress' END AS status FROM r WHERE rn = 1)""")
def g6_latest_status(spark, sf_dir):
    tag = (F.when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "error", "failed")
           .when(F.col("event_type") == "signup", "arrived").otherwise("progress"))
    e = Tables(spark, sf_dir).events.withColumns({"tag": tag, "ord": F.struct("ts", "event_id")})
    s = G.latest_status(e, "user_id", "ord").withColumn("last_update", F.col("last_update.ts"))
    return s.withColumn("runnable", G.can_run("status"))


@query("g7_metrics_table", fx_sql("""
WITH p AS (SELECT l.l_extendedprice AS y, l.l_quantity * p.p_retailprice AS yhat_a,
                  l.l_quantity * p.p_retailprice * (1 - l.l_discount) AS yhat_b
           FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
m AS (SELECT avg(abs(y - yhat_a)) AS mae_a, avg((y - yhat_a) * (y - yhat_a)) AS mse_a,
             avg(abs(y - yhat_b)) AS mae_b, avg((y - yhat_b) * (y - yhat_b)) AS mse_b FROM p)
SELECT 'mae' AS metric, mae_a AS list_price, mae_b AS discounted FROM m
UNION ALL SELECT 'mse', mse_a, mse_b FROM m""", ["list_price", "discounted"]))
def g7_metrics_table(spark, sf_dir):
    """Metric x model table for two price predictors of the line amount."""
    t = Tables(spark, sf_dir)
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    ya = F.col("l_quantity") * F.col("p_retailprice")
    yb = ya * (1 - F.col("l_discount"))
    y = F.col("l_extendedprice")
    m = j.agg(F.avg(F.abs(y - ya)).alias("mae_list_price"), F.avg((y - ya) * (y - ya)).alias("mse_list_price"),
              F.avg(F.abs(y - yb)).alias("mae_discounted"), F.avg((y - yb) * (y - yb)).alias("mse_discounted"))
    long = m.unpivot([], m.columns, "k", "value").select(
        F.split("k", "_", 2)[0].alias("metric"), F.split("k", "_", 2)[1].alias("family"), "value")
    return fx_df(G.metrics_table(long, families=["list_price", "discounted"]))


@query("g8_duplicates_of", """
SELECT c_custkey, c_name FROM customer
WHERE c_nationkey < 5 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def g8_duplicates_of(spark, sf_dir):
    t = Tables(spark, sf_dir)
    new = t.customer.where(F.col("c_nationkey") < 5).select("c_custkey", "c_name")
    existing = t.orders.where(F.col("o_orderpriority") == "1-URGENT").select(F.col("o_custkey").alias("c_custkey"))
    return G.duplicates_of(existing, new, "c_custkey")


@query("g9_value_counts", "SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS count FROM orders GROUP BY 1")
def g9_value_counts(spark, sf_dir):
    return G.value_counts(Tables(spark, sf_dir).orders, "o_orderpriority")


_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("g10_describe_numeric", fx_sql(" UNION ALL ".join(f"""
SELECT '{c}' AS column, CAST(count({c}) AS BIGINT) AS count, avg({c}) AS mean, stddev_samp({c}) AS std,
       CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50,
       quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM lineitem""" for c in _NUM),
    ["mean", "std", "min", "p25", "p50", "p75", "max"]))
def g10_describe_numeric(spark, sf_dir):
    return fx_df(G.describe_numeric(Tables(spark, sf_dir).lineitem, _NUM))


@query("g11_describe_categorical", " UNION ALL ".join(f"""
SELECT * FROM (WITH v AS (SELECT {c} AS v, count(*) AS c FROM customer WHERE {c} IS NOT NULL GROUP BY 1)
SELECT '{c}' AS column, CAST(sum(c) AS BIGINT) AS count, CAST(count(*) AS BIGINT) AS unique,
       (SELECT v FROM v ORDER BY c DESC, v ASC LIMIT 1) AS top, CAST(max(c) AS BIGINT) AS freq FROM v)"""
                                                     for c in ["c_mktsegment", "c_name"]))
def g11_describe_categorical(spark, sf_dir):
    return G.describe_categorical(Tables(spark, sf_dir).customer, ["c_mktsegment", "c_name"])


@query("g12_null_counts", """
WITH d AS (SELECT CASE WHEN event_id % 2 = 0 THEN NULL ELSE user_id END AS user_id,
                  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
                  CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value FROM events)
SELECT 'user_id' AS column, CAST(count(*) FILTER (WHERE user_id IS NULL) AS BIGINT) AS nulls FROM d
UNION ALL SELECT 'event_type', CAST(count(*) FILTER (WHERE event_type IS NULL) AS BIGINT) FROM d
UNION ALL SELECT 'value', CAST(count(*) FILTER (WHERE value IS NULL) AS BIGINT) FROM d""")
def g12_null_counts(spark, sf_dir):
    from .q_clean import dirty_events
    d = dirty_events(spark, sf_dir)
    e = Tables(spark, sf_dir).events
    d = e.select(F.when(F.col("event_id") % 2 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
                 F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
                 F.when(F.col("event_id") % 11 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))
    return G.null_counts(d)


@query("g13_n_unique", "SELECT CAST(count(DISTINCT o_custkey) AS BIGINT) AS n_unique FROM orders")
def g13_n_unique(spark, sf_dir):
    return G.n_unique(Tables(spark, sf_dir).orders, "o_custkey")


@query("g14_crosstab", """
SELECT l_returnflag, CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS BIGINT) AS F,
       CAST(count(*) FILTER (WHERE l_linestatus = 'O') AS BIGINT) AS O FROM lineitem GROUP BY l_returnflag""")
def g14_crosstab(spark, sf_dir):
    return G.crosstab(Tables(spark, sf_dir).lineitem, "l_returnflag", "l_linestatus", ["F", "O"])


@query("g15_totals", fx_sql("""
SELECT 'l_quantity' AS column, CAST(sum(l_quantity) AS DOUBLE) AS total FROM lineitem
UNION ALL SELECT 'l_extendedprice', CAST(sum(l_extendedprice) AS DOUBLE) FROM lineitem""", ["total"]))
def g15_totals(spark, sf_dir):
    return fx_df(G.totals(Tables(spark, sf_dir).lineitem, ["l_quantity", "l_extendedprice"]))


@query("g16_share_by", fx_sql("""
SELECT c_mktsegment, sum(c_acctbal) AS sum, sum(c_acctbal) / (SELECT sum(c_acctbal) FROM customer) AS share
FROM customer GROUP BY c_mktsegment""", ["sum", "share"]))
def g16_share_by(spark, sf_dir):
    return fx_df(G.share_by(Tables(spark, sf_dir).customer, "c_mktsegment", "c_acctbal"))


@query("g17_count_compare", """
SELECT CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS n_finished,
       CAST(count(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS n_open FROM orders""")
def g17_count_compare(spark, sf_dir):
    s = F.col("o_orderstatus")
    return G.count_compare(Tables(spark, sf_dir).orders, s == "F", s == "O", ("finished", "open"))


_HIST_SQL = """
WITH m AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem),
b AS (SELECT l_returnflag, CAST(least(floor((l_extendedprice - mn) / ((mx - mn) / 10)), 9) AS INTEGER) AS bin, mn, mx
      FROM lineitem CROSS JOIN m WHERE l_extendedprice IS NOT NULL)
"""


@query("g18_histogram", fx_sql(_HIST_SQL + """
SELECT bin, CAST(count(*) AS BIGINT) AS count, any_value(mn) + bin * (any_value(mx) - any_value(mn)) / 10 AS lo,
       any_value(mn) + (bin + 1) * (any_value(mx) - any_value(mn)) / 10 AS hi FROM b GROUP BY bin""", ["lo", "hi"]))
def g18_histogram(spark, sf_dir):
    return fx_df(G.histogram(Tables(spark, sf_dir).lineitem, "l_extendedprice", 10))


@query("g18_histogram_by_group", fx_sql(_HIST_SQL + """, c AS (SELECT bin, l_returnflag, count(*) AS n FROM b GROUP BY 1, 2)
SELECT bin, l_returnflag, CAST(n AS BIGINT) AS count, n * 100.0 / sum(n) OVER (PARTITION BY l_returnflag) AS pct FROM c""",
                                        ["pct"]))
def g18_histogram_by_group(spark, sf_dir):
    h = G.histogram(Tables(spark, sf_dir).lineitem, "l_extendedprice", 10, by="l_returnflag")
    return fx_df(h.drop("lo", "hi"))


@query("g18_avg_by", fx_sql("SELECT l_quantity, avg(l_extendedprice) AS avg_l_extendedprice FROM lineitem GROUP BY 1",
                            ["l_quantity", "avg_l_extendedprice"]))
def g18_avg_by(spark, sf_dir):
    return fx_df(G.avg_by(Tables(spark, sf_dir).lineitem, "l_quantity", "l_extendedprice"))


def _box_sql(by: str | None) -> str:
    g = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    join = f"JOIN q USING ({by})" if by else "CROSS JOIN q"
    return f"""
WITH q AS (SELECT {g}quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS median,
                  quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem {grp}),
j AS (SELECT {g}CAST(l_quantity AS DOUBLE) AS v, q1, median, q3 FROM lineitem {join} WHERE l_quantity IS NOT NULL)
SELECT {g}any_value(q1) AS q1, any_value(median) AS median, any_value(q3) AS q3,
       min(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_lo,
       max(v) FILTER (WHERE v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)) AS whisker_hi,
       CAST(count(*) FILTER (WHERE NOT (v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS outliers
FROM j {grp}"""


_BOX_COLS = ["q1", "median", "q3", "whisker_lo", "whisker_hi"]


@query("g19_box_stats", fx_sql(_box_sql(None), _BOX_COLS))
def g19_box_stats(spark, sf_dir):
    return fx_df(G.box_stats(Tables(spark, sf_dir).lineitem, "l_quantity"))


@query("g19_box_stats_by_group", fx_sql(_box_sql("l_returnflag"), _BOX_COLS))
def g19_box_stats_by_group(spark, sf_dir):
    return fx_df(G.box_stats(Tables(spark, sf_dir).lineitem, "l_quantity", by="l_returnflag"))


@query("g20_count_by", """
SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS count FROM lineitem GROUP BY 1, 2""")
def g20_count_by(spark, sf_dir):
    return G.count_by(Tables(spark, sf_dir).lineitem, ["l_returnflag", "l_linestatus"])


@query("g21_snake_profile", fx_sql(f"""
WITH s AS ({SCORED_SQL}),
st AS (SELECT avg(recency) AS mr, stddev_pop(recency) AS sr, avg(frequency) AS mf, stddev_pop(frequency) AS sf,
              avg(monetary) AS mm, stddev_pop(monetary) AS sm FROM s),
z AS (SELECT score_label, (recency - mr) / sr AS recency, (frequency - mf) / sf AS frequency,
             (monetary - mm) / sm AS monetary FROM s CROSS JOIN st),
l AS (UNPIVOT z ON recency, frequency, monetary INTO NAME metric VALUE value)
SELECT score_label, metric, avg(value) AS value FROM l GROUP BY 1, 2""", ["value"]))
def g21_snake_profile(spark, sf_dir):
    return fx_df(G.snake_profile(scored(spark, sf_dir), "score_label", ["recency", "frequency", "monetary"]))


def _corr_sql(cols):
    parts = []
    for a in cols:
        for b in cols:
            if a == b:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END AS corr FROM lineitem")
            else:
                parts.append(f"SELECT '{a}' AS a, '{b}' AS b, covar_pop({a}, {b}) / "
                             f"nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS corr FROM lineitem")
    return " UNION ALL ".join(parts)


@query("g22_correlation_matrix", fx_sql(_corr_sql(_NUM), ["corr"]))
def g22_correlation_matrix(spark, sf_dir):
    return fx_df(G.correlation_matrix(Tables(spark, sf_dir).lineitem, _NUM))


__all__ = ["fx"]


#: Twenty-odd columns of lineitem: powers and products, one constant, some with nulls.
_WIDE = {f"{c[2:]}_{k}": e for c in _NUM for k, e in {
    "1": c, "sq": f"{c} * {c}", "gap": f"CASE WHEN l_linenumber > 2 THEN {c} END", "x": f"{c} * l_linenumber"}.items()}
_WIDE["one"] = "1.5"
_WIDE_SQL = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in _WIDE.items())


def _wide_corr_sql():
    cells = [f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END AS \"{a}|{b}\"" if a == b else
             f"covar_pop({a}, {b}) / nullif(stddev_pop({a}) * stddev_pop({b}), 0) AS \"{a}|{b}\""
             for a in _WIDE for b in _WIDE]
    return f"""WITH m AS (SELECT {', '.join(cells)} FROM (SELECT {_WIDE_SQL} FROM lineitem) AS w)
SELECT split_part(name, '|', 1) AS a, split_part(name, '|', 2) AS b, corr
FROM m UNPIVOT INCLUDE NULLS (corr FOR name IN (COLUMNS(*)))"""


@query("g22_correlation_wide", fx_sql(_wide_corr_sql(), ["corr"]))
def g22_correlation_wide(spark, sf_dir):
    """More columns than are taken pair by pair: the Gramian, over each pair's present rows."""
    wide = Tables(spark, sf_dir).lineitem.selectExpr(*[f"CAST({e} AS DOUBLE) AS {n}" for n, e in _WIDE.items()])
    return fx_df(G.correlation_matrix(wide, list(_WIDE)))
