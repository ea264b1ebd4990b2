"""Segment, profile and project reports (G1-G22).  Every report is an
aggregation; only bounded results (a few rows per column or group) are ever
brought to the driver."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import categorical_columns, numeric_columns
from .gramian import gramian
from .ranking import grouped_quantiles

HIGHLIGHT_SEGMENTS = ("champion", "loyal")


# G1
def describe_segments(df: DataFrame, label: str = "ml_label",
                      cols=("recency", "frequency", "monetary", "LTV", "p_churn", "exp_purchases"),
                      digits: int | None = 1) -> DataFrame:
    cols = [c for c in cols if c in df.columns]
    aggs = []
    for c in cols:
        a = F.avg(c)
        aggs.append((F.round(a, digits) if digits is not None else a).alias(f"{c}_mean"))
    aggs.append(F.count(F.lit(1)).alias("count"))
    return df.groupBy(label).agg(*aggs)


# G2
def segment_counts(df: DataFrame, label: str = "ml_label") -> DataFrame:
    """Customers per segment, share of all customers (truncated percent) and
    whether the segment is highlighted (champion / loyal)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    total = df.select(F.count(F.lit(1))).scalar()
    return counts.select(
        label, "count",
        F.floor(F.col("count") * 100 / total).cast("long").alias("share_pct"),
        F.lower(F.col(label)).isin(*HIGHLIGHT_SEGMENTS).alias("highlight"))


# G3
def treemap_data(desc: DataFrame, label: str, value: str, size: str = "count") -> DataFrame:
    return desc.select(
        F.col(label).alias("label"),
        F.concat(F.col(label).cast("string"), F.lit("\n LTV: "), F.col(value).cast("string")).alias("text"),
        F.col(size).alias("size"))


# G4
def clv_summary_stats(df: DataFrame, ltv: str = "LTV") -> DataFrame:
    q = grouped_quantiles(df, [], ltv, [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    s = df.agg(F.count(ltv).alias("n"), F.round(F.avg(ltv), 2).alias("avg"),
               F.min(ltv).alias("min"), F.max(ltv).alias("max"))
    r = q.first()
    return s.withColumns({k: F.lit(r[k]).cast("double") for k in ("p25", "p50", "p75")})


# G5
def project_rollup(logs: DataFrame, details: DataFrame, key: str = "project_id",
                   kind: str = "kind") -> DataFrame:
    """Success / exception log counts per project next to its status tags."""
    c = logs.groupBy(key).agg(
        F.count_if(F.col(kind) == "info").alias("success_logs"),
        F.count_if(F.col(kind) == "exception").alias("exception_logs"))
    return details.join(c, key, "left").na.fill(0, ["success_logs", "exception_logs"])


# G6
STATUS_ORDER = ("arrived", "progress", "validated", "failed", "completed")
RUNNABLE = ("failed", "validated", "completed")


def latest_status(events: DataFrame, key: str, ts: str, tag: str = "tag") -> DataFrame:
    return events.groupBy(key).agg(F.max_by(tag, ts).alias("status"), F.max(ts).alias("last_update"))


def can_run(status: Column | str) -> Column:
    s = F.col(status) if isinstance(status, str) else status
    return s.isin(*RUNNABLE)


# G7
def metrics_table(scores: DataFrame, family: str = "family", metric: str = "metric",
                  value: str = "value", families: list[str] | None = None) -> DataFrame:
    """Long (family, metric, value) -> one row per metric, one column per family."""
    g = scores.groupBy(metric)
    g = g.pivot(family, families) if families else g.pivot(family)
    return g.agg(F.first(value))


def metrics_frame(spark, scores: dict) -> DataFrame:
    rows = [(fam, m, float(v)) for fam, d in scores.items() for m, v in d.items()]
    return spark.createDataFrame(rows, "family string, metric string, value double")


# G8
def duplicates_of(existing: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    return new.join(existing, key, "left_semi")


def assert_unique(existing: DataFrame, new: DataFrame, key: str | list[str]) -> DataFrame:
    clash = duplicates_of(existing, new, key)
    if not clash.isEmpty():
        raise ValueError(f"{key} already exists")
    return new


# G9
def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), F.asc(col))


# G10
def describe_numeric(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, mean, std (sample), min, exact quartiles, max — one row per
    column (long form built by unpivot, quartiles per column exact)."""
    cols = cols or numeric_columns(df)
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "v")
    base = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    q = grouped_quantiles(long, ["column"], "v", [0.25, 0.5, 0.75], ["p25", "p50", "p75"])
    return base.join(q, "column", "left").select("column", "count", "mean", "std", "min",
                                                 "p25", "p50", "p75", "max")


# G11
def describe_categorical(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """count, unique, top (smallest on ties), freq per string column."""
    cols = cols or categorical_columns(df)
    long = df.select(*cols).unpivot([], cols, "column", "v").where(F.col("v").isNotNull())
    per = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("column").agg(
        F.sum("c").alias("count"), F.count(F.lit(1)).alias("unique"),
        F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("top"),
        F.max("c").alias("freq"))


# G12
def null_counts(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    cols = cols or df.columns
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return row.unpivot([], cols, "column", "nulls")


# G13
def n_unique(df: DataFrame, col: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    f = F.approx_count_distinct(col, rsd) if approx else F.count_distinct(col)
    return df.agg(f.alias("n_unique"))


# G14
def crosstab(df: DataFrame, a: str, b: str, values: list | None = None) -> DataFrame:
    g = df.groupBy(a)
    g = g.pivot(b, values) if values is not None else g.pivot(b)
    return g.agg(F.count(F.lit(1))).na.fill(0)


# G15
def totals(df: DataFrame, cols: list[str]) -> DataFrame:
    row = df.agg(*[F.sum(c).cast("double").alias(c) for c in cols])
    return row.unpivot([], cols, "column", "total")


# G16
def share_by(df: DataFrame, group: str, value: str) -> DataFrame:
    g = df.groupBy(group).agg(F.sum(value).alias("sum"))
    total = df.select(F.sum(value)).scalar()
    return g.withColumn("share", F.try_divide(F.col("sum"), total))


# G17
def count_compare(df: DataFrame, cond_a: Column, cond_b: Column, names=("a", "b")) -> DataFrame:
    return df.agg(F.count_if(cond_a).alias(f"n_{names[0]}"), F.count_if(cond_b).alias(f"n_{names[1]}"))


# G18
def histogram(df: DataFrame, col: str, bins: int = 10, by: str | None = None) -> DataFrame:
    """Equal-width bins over [min, max], last bin closed (numpy rule); with
    ``by``, counts per (bin, group) and the percent of the group."""
    mn = df.select(F.min(col)).scalar()
    mx = df.select(F.max(col)).scalar()
    v = F.col(col).cast("double")
    width = (mx - mn).cast("double") / F.lit(bins)
    raw = F.when(width == 0, F.lit(0)).otherwise(F.floor((v - mn) / width))
    b = F.least(raw, F.lit(bins - 1)).cast("int")
    keys = [b.alias("bin")] + ([F.col(by)] if by else [])
    out = df.where(F.col(col).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    out = out.withColumn("lo", mn + F.col("bin") * width).withColumn("hi", mn + (F.col("bin") + 1) * width)
    if by:
        from pyspark.sql import Window
        out = out.withColumn("pct", F.col("count") * 100.0 / F.sum("count").over(Window.partitionBy(by)))
    return out


def avg_by(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.groupBy(x).agg(F.avg(y).alias(f"avg_{y}"))


# G19
def box_stats(df: DataFrame, col: str, by: str | None = None) -> DataFrame:
    """Quartiles (exact), whiskers at the most extreme values within
    1.5 IQR of the box, and the number of outliers."""
    groups = [by] if by else []
    q = grouped_quantiles(df, groups, col, [0.25, 0.5, 0.75], ["q1", "median", "q3"])
    j = df.select(*groups, F.col(col).cast("double").alias("__v")).where(F.col("__v").isNotNull())
    if groups:
        j = j.join(q, groups, "inner")
    else:
        r = q.first()
        j = j.withColumns({k: F.lit(r[k]).cast("double") for k in ("q1", "median", "q3")})
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr
    inside = (F.col("__v") >= lo_f) & (F.col("__v") <= hi_f)
    agg = [F.first("q1").alias("q1"), F.first("median").alias("median"), F.first("q3").alias("q3"),
           F.min(F.when(inside, F.col("__v"))).alias("whisker_lo"),
           F.max(F.when(inside, F.col("__v"))).alias("whisker_hi"),
           F.count_if(~inside).alias("outliers")]
    return j.groupBy(*groups).agg(*agg) if groups else j.agg(*agg)


# G20
def count_by(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


# G21
def snake_profile(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    """Population z-score of each metric, long form, mean per (label, metric)."""
    st = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols])
    row = st.first()
    zcols = {}
    for c in cols:
        m, s = row[f"m_{c}"], row[f"s_{c}"]
        zcols[c] = F.lit(0.0) if not s else (F.col(c) - F.lit(m)) / F.lit(s)
    z = df.select(label, *[zcols[c].alias(c) for c in cols])
    long = z.unpivot([label], cols, "metric", "value")
    return long.groupBy(label, "metric").agg(F.avg("value").alias("value"))


# G22
#: Columns up to which pairs are plain aggregates; more go through the Gramian.
PAIR_COLUMNS = 8


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson correlation of every column pair, long form ``(a, b, corr)``;
    constant columns give NULL (no ANSI division error).  A few columns are
    one aggregation of pairs, many a distributed Gramian."""
    if len(cols) > PAIR_COLUMNS:
        corr = gramian(df, cols).corr()
        rows = [(a, b, 1.0 if i == j and corr[i, i] == corr[i, i] else
                 None if corr[i, j] != corr[i, j] else float(corr[i, j]))
                for i, a in enumerate(cols) for j, b in enumerate(cols)]
        return df.sparkSession.createDataFrame(rows, "a string, b string, corr double")
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols])
    aggs = [F.stddev_pop(f"`{c}`").alias(f"s__{i}") for i, c in enumerate(cols)]
    pairs = list(combinations(range(len(cols)), 2))
    aggs += [F.covar_pop(f"`{cols[a]}`", f"`{cols[b]}`").alias(f"c__{i}") for i, (a, b) in enumerate(pairs)]
    r = d.agg(*aggs)
    rows = []
    for i, c in enumerate(cols):
        s = F.col(f"s__{i}")
        rows.append(F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"),
                             F.when(s > 0, F.lit(1.0)).alias("corr")))
    for i, (a, b) in enumerate(pairs):
        v = F.try_divide(F.col(f"c__{i}"), F.col(f"s__{a}") * F.col(f"s__{b}"))
        rows.append(F.struct(F.lit(cols[a]).alias("a"), F.lit(cols[b]).alias("b"), v.alias("corr")))
        rows.append(F.struct(F.lit(cols[b]).alias("a"), F.lit(cols[a]).alias("b"), v.alias("corr")))
    return r.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
