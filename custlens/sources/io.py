"""Scans and sinks.

Scratch output of the catalogue queries goes under the shared checkpoint
folder the cluster names in ``spark.checkpoint.dir`` (never a machine-local
temporary folder)."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir

READERS = {"csv", "parquet", "json", "orc", "sql", "txt"}
NOT_SUPPORTED = {"h5": "HDF5", "xlx": "Excel", "xlsx": "Excel", "html": "HTML tables"}


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh folder under the shared checkpoint directory."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/custlens-{name}/{uuid.uuid4().hex}"


# A1
def read_table(spark: SparkSession, path: str, fmt: str | None = None, schema: T.StructType | None = None,
               header: bool = True, jdbc_options: dict | None = None) -> DataFrame:
    """Read by extension (or ``fmt``): csv, parquet, json, orc; ``sql`` reads a
    JDBC table described by ``jdbc_options``.  Single-machine formats (HDF5,
    Excel, HTML) are not supported and raise."""
    ext = (fmt or path.rstrip("/").rsplit(".", 1)[-1]).lower()
    if ext in NOT_SUPPORTED:
        raise ValueError(f"{NOT_SUPPORTED[ext]} files are not read by this library; convert them to parquet or csv")
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if ext == "csv":
        return r.option("header", header).csv(path) if schema is not None else \
            r.option("header", header).option("inferSchema", True).csv(path)
    if ext == "parquet":
        return r.parquet(path)
    if ext == "json":
        return r.json(path)
    if ext == "orc":
        return r.orc(path)
    if ext == "sql":
        if not jdbc_options:
            raise ValueError("reading 'sql' needs jdbc_options (url, dbtable, ...)")
        return r.format("jdbc").options(**jdbc_options).load()
    raise ValueError(f"file must have one of these extensions: {sorted(READERS)}")


# A2
def load_csv(spark: SparkSession, path: str, schema: T.StructType, mode: str = "FAILFAST",
             header: bool = True) -> DataFrame:
    """Schema-enforced CSV load: ``FAILFAST`` raises on a bad record,
    ``PERMISSIVE`` keeps it with NULLs, ``DROPMALFORMED`` drops it."""
    return spark.read.schema(schema).option("header", header).option("mode", mode).csv(path)


# A3
def union_files(dfs: list[DataFrame]) -> DataFrame:
    """Append tables row-wise by column name (missing columns become NULL)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


# A4 / A6
def replace_table(df: DataFrame, name: str, fmt: str = "parquet", path: str | None = None) -> None:
    w = df.write.mode("overwrite").format(fmt)
    if path:
        w = w.option("path", path)
    w.saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


# A5 / A16
def export_csv(df: DataFrame, path: str, header: bool = True, single_file: bool = False) -> str:
    """CSV export (multi-part; one part only when asked, via coalesce)."""
    out = df.coalesce(1) if single_file else df
    out.write.mode("overwrite").option("header", header).csv(path)
    return path


def write_predictions(df: DataFrame, path: str, key: list[str], fmt: str = "parquet") -> str:
    """Prediction sink: the row key next to ``prediction``."""
    df.select(*key, "prediction").write.mode("overwrite").format(fmt).option("header", True).save(path)
    return path


# A7
def to_columnar(spark: SparkSession, src: str, dst: str, schema: T.StructType | None = None) -> str:
    """CSV -> parquet (splittable input, so no manual chunking)."""
    df = read_table(spark, src, "csv", schema)
    df.write.mode("overwrite").parquet(dst)
    return dst


# A8 / A11 / A12
def read_collection(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def write_collection(df: DataFrame, path: str, mode: str = "overwrite") -> str:
    df.write.mode(mode).json(path)
    return path


def append(df: DataFrame, path: str, fmt: str = "json") -> str:
    df.write.mode("append").format(fmt).save(path)
    return path


# A9 / A10
def _match(query: dict):
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in query.items()], F.lit(True))


def find(df: DataFrame, query: dict) -> DataFrame:
    """Conjunction of equalities (an empty query matches everything)."""
    return df.where(_match(query))


def find_first(df: DataFrame, query: dict, order_by: list[str]) -> DataFrame:
    """First match under a deterministic order (top-1, not a full sort)."""
    return df.where(_match(query)).orderBy(*order_by).limit(1)


# A13
def apply_updates(base: DataFrame, changes: DataFrame, keys: list[str], set_cols: list[str] | None = None,
                  inc_cols: list[str] | None = None, ts: str = "ts") -> DataFrame:
    """``$set`` / ``$inc`` style updates: per key, the latest change (by
    ``ts``) of each set-column wins and increments are summed; keys without
    changes are unchanged (left join, no row leaves its partition)."""
    set_cols, inc_cols = set_cols or [], inc_cols or []
    aggs = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"__set_{c}") for c in set_cols]
    aggs += [F.sum(c).alias(f"__inc_{c}") for c in inc_cols]
    red = changes.groupBy(*keys).agg(*aggs)
    j = base.join(red, keys, "left")
    out = {c: F.coalesce(F.col(f"__set_{c}"), F.col(c)) for c in set_cols}
    out.update({c: F.col(c) + F.coalesce(F.col(f"__inc_{c}"), F.lit(0)) for c in inc_cols})
    return j.withColumns(out).select(*base.columns)


# A14
def delete_where(df: DataFrame, query: dict) -> DataFrame:
    return df.where(~_match(query))


def delete_keys(df: DataFrame, keys_df: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(keys_df.select(*keys), keys, "left_anti")


# A15
def file_inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files under ``root`` (recursive), metadata only: the binary reader is
    asked for path, length and modification time, never the content."""
    df = (spark.read.format("binaryFile").option("pathGlobFilter", glob)
          .option("recursiveFileLookup", "true").load(root))
    return df.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "modificationTime")


# A17
def save_model(model, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_pipeline(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)


def save_params(spark: SparkSession, params: dict, path: str) -> str:
    """Fitted model parameters (e.g. BG/NBD, Gamma-Gamma) as a 1-row parquet."""
    spark.createDataFrame([tuple(float(v) for v in params.values())],
                          ", ".join(f"{k} double" for k in params)).write.mode("overwrite").parquet(path)
    return path


def load_params(spark: SparkSession, path: str) -> dict:
    return spark.read.parquet(path).first().asDict()


# A18
LOG_SCHEMA = T.StructType([
    T.StructField("user_id", T.StringType()), T.StructField("project_id", T.StringType()),
    T.StructField("message", T.StringType()), T.StructField("date", T.StringType()),
    T.StructField("time", T.StringType()), T.StructField("exec_id", T.StringType()),
    T.StructField("traceback", T.StructType([
        T.StructField("exception_type", T.StringType()), T.StructField("filename", T.StringType()),
        T.StructField("line_no", T.LongType())])),
])


def log_records(df: DataFrame, path: str | None = None) -> DataFrame:
    """Shape rows into the log schema (info records have a NULL traceback) and
    optionally append them, partitioned by ``date``."""
    cols = []
    for f in LOG_SCHEMA.fields:
        cols.append((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name))
    out = df.select(*cols)
    if path:
        out.write.mode("append").partitionBy("date").parquet(path)
    return out


def local_path(p: str) -> str:
    return p[len("file:"):] if p.startswith("file:") else p

