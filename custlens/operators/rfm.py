"""Recency / frequency / monetary feature tables.

Output schema of the RFM builders (one row per customer, keyed by id —
never aligned by row position):

    cust_id, uniq_age, recency, uniq_rec, frequency, uniq_freq, monetary, uniq_mon
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from .clean import sum_columns, to_day

RFM_COLUMNS = ["cust_id", "uniq_age", "recency", "uniq_rec", "frequency",
               "uniq_freq", "monetary", "uniq_mon"]


@dataclass(frozen=True)
class RFMSpec:
    """Column roles.  ``cal_*`` columns are already-computed model inputs,
    ``*_col`` raw per-customer summary columns; anything left unset is derived
    from the transactions (``trans_col`` amount, ``trans_date_col`` date)."""

    id_col: str
    trans_col: str | None = None
    trans_date_col: str | None = None
    recency_col: str | None = None
    frequency_col: str | None = None
    monetary_col: str | None = None
    age_col: str | None = None
    cal_rec: str | None = None
    cal_freq: str | None = None
    cal_mon: str | None = None


def _as_of_col(df: DataFrame, date_col: str, as_of) -> Column:
    if as_of is None:
        # Scalar subquery: one cheap column scan with partial max.
        return df.agg(F.max(date_col)).scalar()
    return as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")


def _clamp_money(monetary: Column, frequency: Column) -> tuple[Column, Column]:
    per = F.coalesce(F.try_divide(monetary, frequency), F.lit(0.0))
    neg = per < 0
    return (F.when(neg, F.lit(0.0)).otherwise(monetary).cast("double"),
            F.when(neg, F.lit(0.0)).otherwise(per).cast("double"))


def transaction_aggregates(df: DataFrame, id_col: str, amount_col: str, date_col: str,
                           drop_nulls: bool = True) -> DataFrame:
    """Per customer: first/last day, distinct days, de-duplicated row count and
    amount total (over all rows, duplicates included).

    Three aggregations, each shuffle smaller than the one before:
    full-row de-duplication (hash on every column, so one hot customer is
    spread over many tasks), then ``(id, day)``, then ``id``; every step is a
    partial (map-side) aggregation first.  The number of partitions of the
    first grows with the input files, so a task's tables do not.
    """
    t = df.na.drop() if drop_nulls else df.where(F.col(id_col).isNotNull() & F.col(date_col).isNotNull())
    t = t.withColumn(date_col, to_day(date_col))
    dedup = spread(t, *t.columns).groupBy(*t.columns).agg(F.count(F.lit(1)).alias("__dup"))
    per_day = dedup.groupBy(id_col, date_col).agg(
        F.count(F.lit(1)).alias("__rows"),
        (F.sum(F.col(amount_col) * F.col("__dup")) if amount_col else F.lit(None).cast("double")).alias("__amt"))
    return per_day.groupBy(id_col).agg(
        F.min(date_col).alias("__first"), F.max(date_col).alias("__last"),
        F.count(F.lit(1)).alias("__days"), F.sum("__rows").alias("__freq"),
        F.sum("__amt").alias("__money")), t


# D1
def rfm_from_transactions(df: DataFrame, id_col: str, amount_col: str, date_col: str,
                          as_of=None) -> DataFrame:
    """RFM table from raw transactions.  ``as_of`` defaults to the last
    transaction day over all customers."""
    agg, t = transaction_aggregates(df, id_col, amount_col, date_col)
    asof = _as_of_col(t, date_col, as_of)
    money, per = _clamp_money(F.col("__money"), F.col("__freq"))
    return agg.select(
        F.col(id_col).alias("cust_id"),
        F.datediff(asof, F.col("__first")).cast("long").alias("uniq_age"),
        F.datediff(asof, F.col("__last")).cast("long").alias("recency"),
        F.datediff(F.col("__last"), F.col("__first")).cast("long").alias("uniq_rec"),
        F.col("__freq").cast("long").alias("frequency"),
        (F.col("__days") - 1).cast("long").alias("uniq_freq"),
        money.alias("monetary"), per.alias("uniq_mon"))


# D2 / D3 / D4
def build_rfm(df: DataFrame, spec: RFMSpec, as_of=None) -> DataFrame:
    """Resolve each of age / recency / frequency / monetary separately:
    ``cal_*`` first, then derived from dates when the raw ``*_col`` is unset,
    then the raw ``*_col``.  Summary columns are read per id (``max`` over the
    id's rows, so one row per id is expected)."""
    s = spec
    derived = None
    if s.trans_date_col is not None:
        agg, t = transaction_aggregates(df.select(*[c for c in df.columns]), s.id_col,
                                        s.trans_col, s.trans_date_col)
        asof = _as_of_col(t, s.trans_date_col, as_of)
        derived = agg.select(
            F.col(s.id_col).alias("cust_id"),
            F.datediff(asof, F.col("__first")).cast("long").alias("d_age"),
            F.datediff(asof, F.col("__last")).cast("long").alias("d_rec"),
            F.datediff(F.col("__last"), F.col("__first")).cast("long").alias("d_urec"),
            F.col("__freq").cast("long").alias("d_freq"),
            (F.col("__days") - 1).cast("long").alias("d_ufreq"),
            F.col("__money").cast("double").alias("d_money"))
    summary_cols = [c for c in (s.recency_col, s.frequency_col, s.monetary_col, s.age_col,
                                s.cal_rec, s.cal_freq, s.cal_mon) if c]
    base = None
    if summary_cols:
        src = df.na.drop()
        base = src.groupBy(F.col(s.id_col).alias("cust_id")).agg(
            *[F.max(c).alias(f"s_{c}") for c in dict.fromkeys(summary_cols)])
    if base is not None and derived is not None:
        frame = base.join(derived, "cust_id", "inner")
    else:
        frame = base if base is not None else derived
    if frame is None:
        raise ValueError("RFMSpec needs a transaction date column or summary columns")

    def sc(c):
        return F.col(f"s_{c}")

    # age
    if s.age_col:
        age = sc(s.age_col)
    elif s.trans_date_col:
        age = F.col("d_age")
    else:
        age = F.lit(None)
    # recency
    if s.cal_rec:
        urec, rec = sc(s.cal_rec), sc(s.cal_rec)
    elif s.recency_col is None and s.trans_date_col:
        urec, rec = F.col("d_urec"), F.col("d_rec")
    elif s.recency_col:
        urec, rec = age - sc(s.recency_col), sc(s.recency_col)
    else:
        urec, rec = F.lit(None), F.lit(None)
    # frequency
    if s.cal_freq:
        ufreq, freq = sc(s.cal_freq), sc(s.cal_freq)
    elif s.frequency_col is None and s.trans_date_col:
        ufreq, freq = F.col("d_ufreq"), F.col("d_freq")
    elif s.frequency_col:
        ufreq, freq = sc(s.frequency_col) - 1, sc(s.frequency_col)
    else:
        ufreq, freq = F.lit(None), F.lit(None)
    # monetary
    if s.cal_mon:
        money, umon = sc(s.cal_mon).cast("double"), sc(s.cal_mon).cast("double")
    elif s.monetary_col is None and s.trans_date_col:
        money, umon = _clamp_money(F.col("d_money"), freq)
    elif s.monetary_col:
        money = sc(s.monetary_col).cast("double")
        umon = F.try_divide(sc(s.monetary_col), freq).cast("double")
    else:
        money, umon = F.lit(None).cast("double"), F.lit(None).cast("double")
    return frame.select(F.col("cust_id"), age.alias("uniq_age"), rec.alias("recency"),
                        urec.alias("uniq_rec"), freq.alias("frequency"),
                        ufreq.alias("uniq_freq"), money.alias("monetary"), umon.alias("uniq_mon"))


def rfm_from_summary(df: DataFrame, spec: RFMSpec) -> DataFrame:
    """Every role comes from summary columns (no transaction dates)."""
    if spec.trans_date_col:
        raise ValueError("rfm_from_summary takes no transaction date column")
    return build_rfm(df, spec)


# D5
def clv_summary(df: DataFrame, id_col: str, date_col: str, amount_col: str | None = None,
                end=None) -> DataFrame:
    """Transactions -> (frequency, recency, T[, monetary_value]) in days, as in
    the BG/NBD literature: repeat purchase days, last-first, end-first.
    ``monetary_value`` is the mean day total over repeat days (0 if none)."""
    t = df.where(F.col(id_col).isNotNull() & F.col(date_col).isNotNull()).withColumn(date_col, to_day(date_col))
    end_c = _as_of_col(t, date_col, end)
    aggs = [F.count(F.lit(1)).alias("__days")]
    if amount_col:
        per_day = t.groupBy(id_col, date_col).agg(F.sum(amount_col).alias("__amt"))
    else:
        per_day = t.groupBy(id_col, date_col).agg(F.lit(0.0).alias("__amt"))
    per = per_day.groupBy(id_col).agg(
        F.min(date_col).alias("__first"), F.max(date_col).alias("__last"),
        F.count(F.lit(1)).alias("__days"),
        F.min_by("__amt", date_col).alias("__first_amt"), F.sum("__amt").alias("__tot"))
    cols = [F.col(id_col),
            (F.col("__days") - 1).cast("double").alias("frequency"),
            F.datediff(F.col("__last"), F.col("__first")).cast("double").alias("recency"),
            F.datediff(end_c, F.col("__first")).cast("double").alias("T")]
    if amount_col:
        cols.append(F.coalesce(F.try_divide(F.col("__tot") - F.col("__first_amt"), F.col("__days") - 1),
                               F.lit(0.0)).alias("monetary_value"))
    del aggs
    return per.select(*cols)


# D6
def clv_frame(df: DataFrame, id_col: str, since_col: str, recency_col: str,
              frequency_col: str, monetary_col: str) -> DataFrame:
    """Summary-table CLV inputs: AGE = max(since) - since (days),
    FREQUENCY = F - 1, RECENCY = AGE - R, MONETARY = M / F."""
    d = to_day(since_col)
    mx = df.agg(F.max(d)).scalar()
    age = F.datediff(mx, d).cast("long")
    return df.select(
        F.col(id_col),
        age.alias("AGE"),
        (F.col(frequency_col) - 1).alias("FREQUENCY"),
        (age - F.col(recency_col)).alias("RECENCY"),
        F.try_divide(F.col(monetary_col).cast("double"), F.col(frequency_col)).alias("MONETARY"))


# D7
def rfm_from_wide(df: DataFrame, id_col: str, freq_cols: list[str], amount_cols: list[str],
                  recency_col: str, min_frequency: int = 1, min_monetary: float = 0.0) -> DataFrame:
    """Wide campaign table -> (ID, RECENCY, FREQUENCY, MONETARY): purchases and
    amounts summed across columns, rows with frequency <= ``min_frequency``
    or monetary <= ``min_monetary`` dropped.  One projection; no self-joins."""
    w = sum_columns(sum_columns(df, freq_cols, "__f"), amount_cols, "__m")
    w = w.where((F.col("__f") > min_frequency) & (F.col("__m") > min_monetary))
    return w.select(F.col(id_col).alias("ID"), F.col(recency_col).alias("RECENCY"),
                    F.col("__f").alias("FREQUENCY"), F.col("__m").alias("MONETARY"))
