"""Catalogue: preprocessing estimators (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep as P
from ..sources.tables import Tables
from .q_clean import DIRTY_EVENTS_SQL, dirty_events
from .registry import fx_df, fx_sql, query


def _dirty_features(spark, sf_dir):
    return dirty_events(spark, sf_dir).select("event_id", "user_id", "event_type", "value")


@query("i1_impute_mean", fx_sql(f"""
WITH d AS (SELECT event_id, user_id, event_type, value FROM ({DIRTY_EVENTS_SQL}))
SELECT event_id, coalesce(CAST(user_id AS DOUBLE), (SELECT avg(user_id) FROM d)) AS user_id,
       event_type, coalesce(value, (SELECT avg(value) FROM d)) AS value FROM d""", ["user_id", "value"]))
def i1_impute_mean(spark, sf_dir):
    """Mean fill (event_type is the target here, so it is left alone); the
    integer column becomes a double."""
    d = _dirty_features(spark, sf_dir)
    m = P.Imputation(target="event_type", num_strategy="mean").fit(d.drop("event_id"))
    return fx_df(m.transform(d))


@query("i1_impute_median", fx_sql(f"""
WITH d AS (SELECT event_id, user_id, event_type, value FROM ({DIRTY_EVENTS_SQL}))
SELECT event_id, event_type, coalesce(value, (SELECT quantile_cont(value, 0.5) FROM d)) AS value FROM d""", ["value"]))
def i1_impute_median(spark, sf_dir):
    d = _dirty_features(spark, sf_dir).select("event_id", "event_type", "value")
    m = P.Imputation(target="event_type", num_strategy="median").fit(d.drop("event_id"))
    return fx_df(m.transform(d.withColumnRenamed("event_id", "__id")).withColumnRenamed("__id", "event_id")
                 .select("event_id", "event_type", "value"))


@query("i2_impute_categorical", f"""
WITH d AS (SELECT event_id, event_type FROM ({DIRTY_EVENTS_SQL})),
t AS (SELECT event_type AS top FROM d WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT event_id, coalesce(event_type, (SELECT top FROM t)) AS event_type FROM d""")
def i2_impute_categorical(spark, sf_dir):
    d = _dirty_features(spark, sf_dir).select("event_id", "event_type")
    m = P.Imputation(target="event_id", cat_strategy="most_frequent").fit(d)
    return m.transform(d)


_SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("i3_one_hot", """
SELECT c_custkey, c_acctbal, """ + ", ".join(
    f"CAST(CASE WHEN c_mktsegment = '{v}' AND '{v}' IN (SELECT c_mktsegment FROM customer WHERE c_nationkey < 12) "
    f"THEN 1.0 ELSE 0.0 END AS FLOAT) AS c_mktsegment_{v}" for v in _SEGMENTS) + " FROM customer")
def i3_one_hot(spark, sf_dir):
    """Fit on one group of nations, encode every customer; the c_name column
    (unique per row) is dropped as an identifier."""
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal", "c_nationkey")
    m = P.CatDummies(target="c_custkey").fit(c.where(F.col("c_nationkey") < 12).drop("c_nationkey"))
    out = m.transform(c.drop("c_nationkey"))
    for v in _SEGMENTS:  # levels absent at fit time produce no column; show them as zeros
        if f"c_mktsegment_{v}" not in out.columns:
            out = out.withColumn(f"c_mktsegment_{v}", F.lit(0.0).cast("float"))
    return out.select("c_custkey", "c_acctbal", *[f"c_mktsegment_{v}" for v in _SEGMENTS])


_LNUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scale_sql(kind: str) -> str:
    if kind == "zscore":
        e = [f"CASE WHEN stddev_pop({c}) OVER () > 0 THEN ({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () ELSE 0.0 END AS {c}" for c in _LNUM]
    else:
        e = [f"CASE WHEN max({c}) OVER () > min({c}) OVER () THEN ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) ELSE 0.0 END AS {c}" for c in _LNUM]
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(e) + ", 0.0 AS k FROM lineitem"


def _scaled(spark, sf_dir, method):
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", *_LNUM).withColumn("k", F.lit(3.0))
    m = P.ScaleTransformer(target="l_orderkey", method=method).fit(li.drop("l_linenumber"))
    return fx_df(m.transform(li))


@query("i4_zscore", fx_sql(_scale_sql("zscore"), _LNUM + ["k"]))
def i4_zscore(spark, sf_dir):
    return _scaled(spark, sf_dir, "zscore")


@query("i5_minmax", fx_sql(_scale_sql("minmax"), _LNUM + ["k"]))
def i5_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query("i6_yeo_johnson")
def i6_yeo_johnson(spark, sf_dir):
    return _scaled(spark, sf_dir, "yeo-johnson")


@query("i7_quantile_normal")
def i7_quantile_normal(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity")
    m = P.ScaleTransformer(target="l_orderkey", method="quantile").fit(li.drop("l_linenumber"))
    return m.transform(li)


@query("i8_perfect_collinearity", fx_sql("""
SELECT l_orderkey, l_extendedprice, l_discount, 2 * l_quantity + 1 AS q2 FROM lineitem""",
                                         ["l_extendedprice", "l_discount", "q2"]))
def i8_perfect_collinearity(spark, sf_dir):
    """``q2 = 2 * l_quantity + 1`` duplicates l_quantity: the earlier column
    of the pair (l_quantity) is dropped."""
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount") \
        .withColumn("q2", 2 * F.col("l_quantity") + 1)
    m = P.PerfectCollinearity(target="l_orderkey").fit(li)
    return fx_df(m.transform(li))


@query("i9_target_null_drop", fx_sql(f"""
SELECT event_id, value, event_type FROM ({DIRTY_EVENTS_SQL}) WHERE event_type IS NOT NULL""", ["value"]))
def i9_target_null_drop(spark, sf_dir):
    d = _dirty_features(spark, sf_dir).select("event_id", "value", "event_type")
    m = P.TargetTreat(target="event_type", ml_type="regression").fit(d)
    return fx_df(m.transform(d))


@query("i10_label_encoding", """
SELECT l_orderkey, l_linenumber, l_quantity, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS l_returnflag
FROM lineitem""")
def i10_label_encoding(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return P.TargetTreat(target="l_returnflag", ml_type="classification").fit(li).transform(li)


@query("i11_inverse_label", "SELECT l_orderkey, l_linenumber, l_returnflag AS label FROM lineitem")
def i11_inverse_label(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    m = P.TargetTreat(target="l_returnflag", ml_type="classification").fit(li)
    enc = m.transform(li)
    return P.inverse_label(enc, m._state()["labels"], "l_returnflag", "label").drop("l_returnflag")


@query("i12_preprocess_default")
def i12_preprocess_default(spark, sf_dir):
    """Full default pipeline on customer features, target c_mktsegment."""
    c = Tables(spark, sf_dir).customer.select("c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    model = P.preprocess_pipeline("classification", "c_mktsegment").fit(c)
    return model.transform(c)


@query("e15_cluster_feature")
def e15_cluster_feature(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select("l_quantity", "l_extendedprice", "l_discount")
    return P.ClusterData(k=5, seed=42).fit(li).transform(li)
