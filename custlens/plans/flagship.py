"""Flagship flow: transactions -> RFM -> score labels -> segment report."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import segment as S
from .q_rfm import RFM_ORDERS_SQL, orders_rfm, rfm_score_sql
from .registry import fx_df, fx_sql, query


def segment_report(spark, sf_dir):
    scored = S.rfm_score(orders_rfm(spark, sf_dir))
    return fx_df(scored.groupBy("score_label").agg(
        F.count(F.lit(1)).alias("customers"),
        F.avg("recency").alias("avg_recency"),
        F.avg("frequency").alias("avg_frequency"),
        F.avg("monetary").alias("avg_monetary"),
        F.avg("RFM_Score").alias("avg_score")))


FLAGSHIP_SQL = fx_sql(f"""
WITH s AS ({rfm_score_sql(RFM_ORDERS_SQL)})
SELECT score_label, CAST(count(*) AS BIGINT) AS customers, avg(recency) AS avg_recency,
       avg(frequency) AS avg_frequency, avg(monetary) AS avg_monetary, avg(RFM_Score) AS avg_score
FROM s GROUP BY score_label""", ["avg_recency", "avg_frequency", "avg_monetary", "avg_score"])

query("g1_segment_report", FLAGSHIP_SQL)(segment_report)
