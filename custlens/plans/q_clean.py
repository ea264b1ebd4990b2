"""Catalogue: cleaning, projection and filter operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C
from ..sources.tables import Tables
from .registry import fx_df, fx_sql, query

# Dirty copy of events, derived in the query itself: value NULL where
# event_id % 11 = 0, event_type NULL where % 7 = 0, user_id NULL where
# % 2 = 0, and every 'click' event present twice.
DIRTY_EVENTS_SQL = """
WITH base AS (
  SELECT event_id, ts,
         CASE WHEN event_id % 2 = 0 THEN NULL ELSE user_id END AS user_id,
         CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_type END AS event_type,
         CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS value
  FROM events)
SELECT * FROM base UNION ALL SELECT * FROM base WHERE event_type = 'click'
"""


def dirty_events(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    eid = F.col("event_id")
    d = e.select(
        "event_id", "ts",
        F.when(eid % 2 == 0, F.lit(None)).otherwise(F.col("user_id")).alias("user_id"),
        F.when(eid % 7 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
        F.when(eid % 11 == 0, F.lit(None)).otherwise(F.col("value")).alias("value"))
    return d.unionByName(d.where(F.col("event_type") == "click"))


INF_EVENTS_SQL = """
SELECT event_id, user_id, event_type,
       CASE WHEN event_id % 11 = 0 THEN CAST('inf' AS DOUBLE)
            WHEN event_id % 17 = 0 THEN CAST('-inf' AS DOUBLE) ELSE value END AS value
FROM events
"""


def inf_events(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    eid = F.col("event_id")
    return e.select("event_id", "user_id", "event_type",
                    F.when(eid % 11 == 0, F.lit(float("inf")))
                     .when(eid % 17 == 0, F.lit(float("-inf")))
                     .otherwise(F.col("value")).alias("value"))


@query("c1_drop_null_rows", fx_sql(f"SELECT * FROM ({DIRTY_EVENTS_SQL}) WHERE user_id IS NOT NULL "
                                   "AND event_type IS NOT NULL AND value IS NOT NULL", ["value"]))
def c1_drop_null_rows(spark, sf_dir):
    return fx_df(C.drop_null_rows(dirty_events(spark, sf_dir)))


@query("c2_inf_to_null", fx_sql(f"""
SELECT event_id, user_id, event_type, CASE WHEN isinf(value) THEN NULL ELSE value END AS value
FROM ({INF_EVENTS_SQL})""", ["value"]))
def c2_inf_to_null(spark, sf_dir):
    return fx_df(C.inf_to_null(inf_events(spark, sf_dir)))


@query("c3_fill_constant", fx_sql(f"""
SELECT event_id, ts, coalesce(user_id, 0) AS user_id, coalesce(event_type, 'NULL') AS event_type,
       coalesce(value, 0.0) AS value FROM ({DIRTY_EVENTS_SQL})""", ["value"]))
def c3_fill_constant(spark, sf_dir):
    d = dirty_events(spark, sf_dir)
    return fx_df(C.fill(C.fill(d, 0, ["user_id", "value"]), "NULL", ["event_type"]))


@query("c4_fill_nulls_thresholded", fx_sql(f"""
WITH d AS ({DIRTY_EVENTS_SQL}),
md AS (SELECT quantile_cont(value, 0.5) AS med FROM d),
mo AS (SELECT event_type AS top FROM d WHERE event_type IS NOT NULL
       GROUP BY event_type ORDER BY count(*) DESC, event_type ASC LIMIT 1)
SELECT event_id, ts, user_id, coalesce(event_type, mo.top) AS event_type,
       coalesce(value, md.med) AS value
FROM d CROSS JOIN md CROSS JOIN mo""", ["value"]))
def c4_fill_nulls_thresholded(spark, sf_dir):
    """value (~9 % NULL) gets the exact median, event_type (~14 %) the mode;
    user_id (50 % NULL) is over the 30 % limit and stays as it is."""
    return fx_df(C.fill_nulls_thresholded(dirty_events(spark, sf_dir), 30.0,
                                          ["user_id", "event_type", "value"]))


@query("c5_drop_duplicate_rows", fx_sql(f"SELECT DISTINCT * FROM ({DIRTY_EVENTS_SQL})", ["value"]))
def c5_drop_duplicate_rows(spark, sf_dir):
    return fx_df(C.drop_duplicate_rows(dirty_events(spark, sf_dir)))


@query("c6_drop_duplicate_columns", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def c6_drop_duplicate_columns(spark, sf_dir):
    o = Tables(spark, sf_dir).orders
    dup = o.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderstatus").alias("o_custkey"))
    return C.drop_duplicate_columns(dup)


@query("c7_drop_datetime_columns",
       "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def c7_drop_datetime_columns(spark, sf_dir):
    return C.drop_datetime_columns(Tables(spark, sf_dir).orders)


@query("c8_require_columns", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def c8_require_columns(spark, sf_dir):
    return C.require_columns(Tables(spark, sf_dir).customer, ["c_custkey", "c_acctbal", "c_mktsegment"])


@query("c9_drop_zero_variance", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def c9_drop_zero_variance(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return C.drop_zero_variance(c.withColumn("constant_k", F.lit(1.0)))


@query("c10_drop_unique_categoricals", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def c10_drop_unique_categoricals(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return c.drop(*C.unique_valued_columns(c))


@query("c11_derived_columns", fx_sql("""
SELECT l_orderkey, l_linenumber, l_quantity * l_extendedprice AS spent_total,
       l_quantity + l_discount + l_tax AS qdt,
       CAST(date_diff('day', CAST(l_shipdate AS DATE), DATE '2000-01-01') AS BIGINT) AS age_days,
       2000 - year(l_shipdate) AS age_years
FROM lineitem""", ["spent_total", "qdt"]))
def c11_derived_columns(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.withColumn("ship_year", F.year("l_shipdate"))
    x = C.with_line_total(li, "l_quantity", "l_extendedprice")
    x = C.sum_columns(x, ["l_quantity", "l_discount", "l_tax"], "qdt")
    x = C.age_days(x, "l_shipdate", "2000-01-01")
    x = C.age_years(x, "ship_year", 2000, "age_years")
    return fx_df(x.select("l_orderkey", "l_linenumber", "spent_total", "qdt", "age_days", "age_years"))


SEGMENT_CODES = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}


@query("c12_map_values", """
SELECT c_custkey, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 1 WHEN 'BUILDING' THEN 2
  WHEN 'FURNITURE' THEN 3 WHEN 'HOUSEHOLD' THEN 4 WHEN 'MACHINERY' THEN 5 END AS segment_code
FROM customer""")
def c12_map_values(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_mktsegment")
    return C.map_values(c, "c_mktsegment", SEGMENT_CODES, out="segment_code", on_missing="null").drop("c_mktsegment")


@query("c13_outlier_filter", fx_sql("SELECT * FROM customer WHERE c_acctbal <= 9000 AND c_acctbal >= -500",
                                    ["c_acctbal"]))
def c13_outlier_filter(spark, sf_dir):
    return fx_df(C.outlier_filter(Tables(spark, sf_dir).customer, "c_acctbal", upper=9000, lower=-500))


@query("c14_rename", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer")
def c14_rename(spark, sf_dir):
    c = Tables(spark, sf_dir).customer.select("c_custkey", "c_mktsegment")
    return C.rename(c, {"c_custkey": "id", "c_mktsegment": "segment"})


@query("c15_melt", fx_sql("""
SELECT c_custkey, 'c_acctbal' AS variable, CAST(c_acctbal AS DOUBLE) AS value FROM customer
UNION ALL SELECT c_custkey, 'c_nationkey', CAST(c_nationkey AS DOUBLE) FROM customer""", ["value"]))
def c15_melt(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    c = c.select("c_custkey", F.col("c_acctbal").cast("double"), F.col("c_nationkey").cast("double"))
    return fx_df(C.melt(c, ["c_custkey"], ["c_acctbal", "c_nationkey"]))


@query("c16_to_day", """
SELECT event_id, CAST(ts AS DATE) AS day FROM events""")
def c16_to_day(spark, sf_dir):
    """Days parsed from text in two layouts (ISO and day/month/year)."""
    e = Tables(spark, sf_dir).events
    txt = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")) \
           .otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
    return e.select("event_id", C.to_day(txt, ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss"]).alias("day"))


@query("c17_round_numeric", """
SELECT l_orderkey, l_linenumber,
       CAST(round(TRY_CAST(l_extendedprice / 7 AS DECIMAL(38,9)), 2) AS DOUBLE) AS price7,
       CAST(round(TRY_CAST(l_discount * 3.3 AS DECIMAL(38,9)), 2) AS DOUBLE) AS disc
FROM lineitem""")
def c17_round_numeric(spark, sf_dir):
    li = Tables(spark, sf_dir).lineitem.select(
        "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 7).alias("price7"),
        (F.col("l_discount") * 3.3).alias("disc"))
    return C.round_numeric(li, 2)


@query("c18_cast", """
SELECT p_partkey, TRY_CAST(regexp_extract(p_name, '[0-9]+', 0) AS BIGINT) AS name_num,
       CAST(p_size AS VARCHAR) AS size_txt FROM part""")
def c18_cast(spark, sf_dir):
    p = Tables(spark, sf_dir).part.select(
        "p_partkey", F.regexp_extract("p_name", "[0-9]+", 0).alias("name_num"), F.col("p_size").alias("size_txt"))
    p = p.withColumn("name_num", F.when(F.col("name_num") != "", F.col("name_num")))
    return C.cast_columns(p, {"name_num": "bigint", "size_txt": "string"})


@query("c19_sort", fx_sql("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey",
                          ["o_totalprice"]))
def c19_sort(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_totalprice")
    return fx_df(C.sort(o, ["o_totalprice", "o_orderkey"], [False, True]))


@query("c20_top_n", fx_sql("""
SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey ASC LIMIT 20""",
                           ["o_totalprice"]))
def c20_top_n(spark, sf_dir):
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    return fx_df(C.top_n(o, ["o_totalprice", "o_orderkey"], 20, [False, True]))


@query("c21_join", fx_sql("""
SELECT o.o_orderkey, o.o_custkey, c.c_mktsegment, o.o_totalprice
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""", ["o_totalprice"]))
def c21_join(spark, sf_dir):
    t = Tables(spark, sf_dir)
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice")
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return fx_df(C.join_on(o, c, "o_custkey"))
