"""Registration of catalogue queries: each has a Spark builder
``(spark, sf_dir) -> DataFrame`` and, where SQL can express it, a DuckDB
oracle over the same tables.  Doubles are rounded the same way on both sides
(``fixed``: 9-decimal normalisation, then half-away rounding)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ..functions.numeric import fixed

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise KeyError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return deco


def fx_df(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round every double/float column with ``fixed``."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: fixed(c, digits) for c in cols}) if cols else df


def fx(expr: str, digits: int = 4) -> str:
    """SQL twin of ``fixed``."""
    return f"CAST(round(TRY_CAST(({expr}) AS DECIMAL(38,9)), {digits}) AS DOUBLE)"


def fx_sql(inner: str, cols: list[str], digits: int = 4) -> str:
    """Wrap a SELECT so the listed double columns are rounded like ``fx_df``."""
    if not cols:
        return inner
    rep = ", ".join(f"{fx(c, digits)} AS {c}" for c in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) AS __q"
