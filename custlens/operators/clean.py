"""Row and column cleaning operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .ranking import grouped_quantiles

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType,
                 T.DoubleType, T.DecimalType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def numeric_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NUMERIC_TYPES) and f.name not in exclude]


def categorical_columns(df: DataFrame, exclude=()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in exclude]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, DATETIME_TYPES)]


# C1
def drop_null_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL (or NaN) in any column of ``subset`` (all by default)."""
    return df.na.drop(how="any", subset=subset)


# C2
def inf_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Replace NaN and +-inf by NULL in float columns."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    cols = [c for c in (cols or floats) if c in floats]
    exprs = {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))), F.lit(None))
             .otherwise(F.col(c)) for c in cols}
    return df.withColumns(exprs) if exprs else df


# C3
def fill(df: DataFrame, value, cols: list[str] | None = None) -> DataFrame:
    return df.na.fill(value, subset=cols)


# C4
def fill_nulls_thresholded(df: DataFrame, max_null_pct: float = 30.0,
                           cols: list[str] | None = None) -> DataFrame:
    """Columns with at most ``max_null_pct`` % NULLs are filled: numeric with
    the exact median, string with the most frequent value (smallest on ties).
    One aggregation pass counts the NULLs of every column."""
    cols = cols or df.columns
    num = set(numeric_columns(df))
    cat = set(categorical_columns(df))
    cols = [c for c in cols if c in num or c in cat]
    if not cols:
        return df
    stats = df.agg(F.count(F.lit(1)).alias("__n"),
                   *[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    n = stats["__n"]
    chosen = [c for c in cols if n and 0 < stats[c] and 100.0 * stats[c] / n <= max_null_pct]
    num_cols = [c for c in chosen if c in num]
    cat_cols = [c for c in chosen if c in cat]
    fills = {}
    if num_cols:   # exact medians of all chosen columns from one grouped ranking
        long = df.select(*[F.col(c).cast("double").alias(c) for c in num_cols]).unpivot([], num_cols, "column", "v")
        for r in grouped_quantiles(long, ["column"], "v", [0.5], ["med"]).collect():
            if r["med"] is not None:
                fills[r["column"]] = float(r["med"])
    for c in cat_cols:
        fills[c] = most_frequent(df, c)
    out = df
    for c, v in fills.items():
        if v is not None:
            cast_to = df.schema[c].dataType
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit(v).cast(cast_to)))
    return out


def most_frequent(df: DataFrame, col: str):
    """Most frequent non-null value, smallest value on ties."""
    r = (df.where(F.col(col).isNotNull()).groupBy(col).count()
           .orderBy(F.desc("count"), F.asc(col)).limit(1).collect())
    return r[0][col] if r else None


# C5
def drop_duplicate_rows(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    return df.dropDuplicates(subset) if subset else df.dropDuplicates()


# C6
def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first of columns sharing a name (positional rename first)."""
    names = df.columns
    tmp = [f"__c{i}" for i in range(len(names))]
    seen, keep = set(), []
    for i, n in enumerate(names):
        if n not in seen:
            seen.add(n)
            keep.append(F.col(tmp[i]).alias(n))
    return df.toDF(*tmp).select(*keep)


# C7
def drop_datetime_columns(df: DataFrame) -> DataFrame:
    return df.drop(*datetime_columns(df))


# C8
def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """Select ``cols`` (dropping extras); raise if any is missing."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise TypeError(f"data does not have column(s) {missing}")
    return df.select(*cols)


# C9
def zero_variance_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """Numeric columns whose sample std is exactly 0 (one row -> NULL -> kept)."""
    cols = cols or numeric_columns(df)
    if not cols:
        return []
    r = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if r[c] is not None and r[c] == 0.0]


def drop_zero_variance(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return df.drop(*zero_variance_columns(df, cols))


# C10
def unique_valued_columns(df: DataFrame, cols: list[str] | None = None) -> list[str]:
    """String columns whose distinct count reaches the row count (ids).
    One pass of HyperLogLog sketches screens the columns; only those whose
    estimate is within the sketch error of the row count get an exact
    distinct count (each a separate two-phase aggregation, never the
    multi-distinct expansion of all columns at once)."""
    cols = cols or categorical_columns(df)
    if not cols:
        return []
    r = df.agg(F.count(F.lit(1)).alias("__n"),
               *[F.approx_count_distinct(c, 0.01).alias(c) for c in cols]).first()
    n = r["__n"]
    candidates = [c for c in cols if r[c] >= 0.95 * n]
    return [c for c in candidates if df.select(F.count_distinct(c)).first()[0] >= n]


# C11
def with_line_total(df: DataFrame, qty: str, price: str, out: str = "spent_total") -> DataFrame:
    return df.withColumn(out, F.col(qty) * F.col(price))


def sum_columns(df: DataFrame, cols: list[str], out: str) -> DataFrame:
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(c) for c in cols]))


def age_years(df: DataFrame, year_col: str, as_of_year: int, out: str = "Age") -> DataFrame:
    return df.withColumn(out, F.lit(as_of_year) - F.col(year_col))


def age_days(df: DataFrame, date_col: str, as_of, out: str = "age_days") -> DataFrame:
    ref = as_of if isinstance(as_of, Column) else F.lit(as_of).cast("date")
    return df.withColumn(out, F.datediff(ref, F.to_date(F.col(date_col))).cast("long"))


# C12
def map_values(df: DataFrame, col: str, mapping: dict, out: str | None = None,
               on_missing: str = "error") -> DataFrame:
    """Dictionary lookup as a literal map; unknown keys raise
    (``on_missing='error'``) or become NULL."""
    m = F.create_map(*[x for k, v in mapping.items() for x in (F.lit(k), F.lit(v))])
    looked = F.try_element_at(m, F.col(col))
    if on_missing == "error":
        looked = F.when(F.col(col).isNull() | looked.isNotNull(), looked).otherwise(
            F.raise_error(F.concat(F.lit(f"unmapped value in {col}: "), F.col(col).cast("string"))))
    return df.withColumn(out or col, looked)


# C13
def outlier_filter(df: DataFrame, col: str, upper=None, lower=None) -> DataFrame:
    cond = F.lit(True)
    if upper is not None:
        cond = cond & (F.col(col) <= F.lit(upper))
    if lower is not None:
        cond = cond & (F.col(col) >= F.lit(lower))
    return df.where(cond)


# C14
def rename(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(mapping)


# C15
def melt(df: DataFrame, ids: list[str], cols: list[str], variable: str = "variable",
         value: str = "value") -> DataFrame:
    return df.unpivot(ids, cols, variable, value)


# C16
def to_day(c: Column | str, fmts: list[str] | None = None) -> Column:
    """Parse to a calendar day (midnight).  Timestamps are truncated; strings
    are tried against explicit formats in order (no per-value inference)."""
    c = F.col(c) if isinstance(c, str) else c
    if not fmts:
        return F.to_date(c)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("date") for f in fmts])


# C17
def round_numeric(df: DataFrame, digits: int = 2, cols: list[str] | None = None) -> DataFrame:
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType, T.DecimalType))]
    cols = [c for c in (cols or floats) if c in floats]
    return df.withColumns({c: F.round(F.col(c).try_cast("decimal(38,9)"), digits).cast("double") for c in cols})


# C18
def cast_columns(df: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast(t) if strict else F.col(c).try_cast(t)) for c, t in types.items()})


# C19 / C20
def sort(df: DataFrame, by: list[str], ascending: bool | list[bool] = True) -> DataFrame:
    return df.orderBy(*by, ascending=ascending)


def top_n(df: DataFrame, by: list[str], n: int, ascending: bool | list[bool] = False) -> DataFrame:
    """Top-k report: ``orderBy().limit()`` plans as TakeOrderedAndProject
    (per-partition top-k then merge), never a full sort."""
    return df.orderBy(*by, ascending=ascending).limit(n)


# C21
def join_on(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Equi-join; AQE picks broadcast vs sort-merge from runtime sizes."""
    return left.join(right, on=on, how=how)
