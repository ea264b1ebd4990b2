"""File validation and quarantine.

Each check is a column expression over a DataFrame of file names or file
headers, so thousands of uploaded files are validated by one job, and the
routing into good / bad is two filters over one status frame."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TYPE_NAMES = {"string": T.StringType(), "str": T.StringType(), "varchar": T.StringType(),
              "float": T.DoubleType(), "double": T.DoubleType(), "integer": T.LongType(), "int": T.LongType(),
              "bigint": T.LongType(), "long": T.LongType(), "boolean": T.BooleanType(), "date": T.DateType(),
              "timestamp": T.TimestampType()}


# B1
@dataclass
class SchemaSpec:
    sample_file_name: str | None
    date_len: int
    time_len: int
    n_columns: int
    columns: dict = field(default_factory=dict)
    target: str | None = None
    rfm_cols: dict | None = None

    @classmethod
    def from_json(cls, text: str) -> "SchemaSpec":
        """Parse a schema document (single quotes tolerated)."""
        d = json.loads(text.replace("'", '"')) if isinstance(text, str) else dict(text)
        return cls(d.get("SampleFileName"), int(d["LengthOfDateStampInFile"]), int(d["LengthOfTimeStampInFile"]),
                   int(d["NumberofColumns"]), dict(d["ColName"]), d.get("Target"), d.get("RFMCols"))

    @classmethod
    def for_kind(cls, project: dict, kind: str) -> "SchemaSpec":
        """Train schema for ``kind == 'train'``, test schema otherwise."""
        return cls.from_json(project["train_schema"] if kind == "train" else project["test_schema"])

    def struct_type(self) -> T.StructType:
        fields = []
        for name, typ in self.columns.items():
            dt = TYPE_NAMES.get(str(typ).lower())
            if dt is None:
                raise ValueError(f"unknown column type {typ!r} for {name}")
            fields.append(T.StructField(name, dt, True))
        return T.StructType(fields)


# B2-B4
def filename_status(file_col: str, regex: str, date_len: int, time_len: int):
    """(status, reason) for a file name: anchored regex match first, then
    ``name_date_time`` structure (exactly three ``_`` parts before the first
    dot), then the stamp lengths."""
    f = F.col(file_col)
    stem = F.substring_index(f, ".", 1)
    parts = F.split(stem, "_")
    regex_ok = f.rlike("^(?:" + regex + ")")
    name_ok = F.size(parts) == 3
    stamp_ok = (F.length(F.element_at(parts, 2)) == date_len) & (F.length(F.element_at(parts, 3)) == time_len)
    reason = (F.when(~regex_ok, "regex").when(~name_ok, "name").when(~stamp_ok, "datestamp"))
    status = F.when(reason.isNull(), "good").otherwise("bad")
    return status, reason


def validate_filenames(files: DataFrame, spec: SchemaSpec, regex: str, file_col: str = "file") -> DataFrame:
    status, reason = filename_status(file_col, regex, spec.date_len, spec.time_len)
    return files.withColumn("status", status).withColumn("reason", reason)


# B5-B6
FILE = "path string, uri string, file string, length long"


def empty_files(spark: SparkSession, root: str, glob: str = "*") -> list[tuple]:
    """(path, uri, file, 0) of the files without a byte, which Spark's readers
    leave out: from the file system's own listing, names only."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    match, found = hadoop.GlobFilter(glob), []
    files = fs.listFiles(top, True)
    while files.hasNext():
        f = files.next()
        path, name = f.getPath(), f.getPath().getName()
        if f.getLen() == 0 and match.accept(path) and name[0] not in "._":
            found.append((path.toString(), path.toUri().toString(), name, 0))
    return sorted(found)


def list_files(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """path, uri, file, length of every file under ``root``, empty ones too;
    contents are not read."""
    full = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
            .load(root).select("path", F.col("_metadata.file_path").alias("uri"),
                               F.col("_metadata.file_name").alias("file"), "length"))
    return full.unionByName(spark.createDataFrame(empty_files(spark, root, glob), FILE))


def first_lines(spark: SparkSession, paths: str | list[str], glob: str = "*") -> DataFrame:
    """uri, header: the first line of every file that has one.  Rows of the
    block at offset 0 come in file order inside a task, so the header is the
    row of the least row number; one row per file and task is shuffled."""
    lines = (spark.read.format("text").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(paths)
             .select("value", F.col("_metadata.file_path").alias("uri"),
                     F.col("_metadata.file_block_start").alias("start")))
    return (lines.withColumn("row", F.monotonically_increasing_id()).where(F.col("start") == 0)
            .groupBy("uri").agg(F.min_by("value", "row").alias("header")))


def file_headers(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """path, file, header of every file under ``root``; an empty file has a
    null header."""
    files = list_files(spark, root, glob)
    return files.join(first_lines(spark, root, glob), "uri", "left").select("path", "file", "header")


def header_names(header, sep: str = ","):
    """Column names of a header line (none of a null one)."""
    names = F.transform(F.split(header, sep, -1), lambda c: F.trim(F.regexp_replace(c, '"', "")))
    return F.coalesce(names, F.array().cast("array<string>"))


def validate_columns(headers: DataFrame, spec: SchemaSpec, sep: str = ",") -> DataFrame:
    """Column count must equal the spec; every declared name must be present."""
    names = header_names(F.col("header"), sep)
    expected = F.array(*[F.lit(c) for c in spec.columns])
    missing = F.array_except(expected, names)
    count_ok = F.size(names) == spec.n_columns
    reason = F.when(~count_ok, "columns").when(F.size(missing) > 0, "column_names")
    return headers.withColumn("n_columns", F.size(names)).withColumn("missing", missing) \
        .withColumn("status", F.when(reason.isNull(), "good").otherwise("bad")).withColumn("reason", reason)


def check_files(files: DataFrame, spec: SchemaSpec, regex: str, sep: str = ",") -> DataFrame:
    """B2-B6 for listed files (path, uri, file, length): status, reason, header
    (array of names) and missing names.  Only files with a good name are opened."""
    spark = files.sparkSession
    named, misnamed = route(validate_filenames(files, spec, regex))
    paths = [r[0] for r in named.select("path").collect()]
    heads = first_lines(spark, paths) if paths else spark.createDataFrame([], "uri string, header string")
    seen = validate_columns(named.drop("status", "reason").join(heads, "uri", "left"), spec, sep)
    seen = seen.select("path", "file", "length", "status", "reason", header_names(F.col("header"), sep).alias("header"),
                       "missing")
    none = F.array().cast("array<string>")
    return seen.unionByName(misnamed.select("path", "file", "length", "status", "reason", none.alias("header"),
                                            none.alias("missing")))


# B7
def fill_null_literal(df: DataFrame, token: str = "NULL") -> DataFrame:
    """Text export form: every column as string, NULL -> ``token``."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit(token)).alias(c) for c in df.columns])


# B8 / B9
def route(status: DataFrame) -> tuple[DataFrame, DataFrame]:
    return status.where(F.col("status") == "good"), status.where(F.col("status") == "bad")


def write_quarantine(bad: DataFrame, path: str, mode: str = "append") -> str:
    """Rejected files, one folder per reason."""
    bad.write.mode(mode).partitionBy("reason").parquet(path)
    return path


def require_good(good: DataFrame) -> DataFrame:
    if good.isEmpty():
        raise ValueError("no good files to load")
    return good


# B10
def read_rows(spark: SparkSession, paths, spec: SchemaSpec, names: list[str] | None = None,
              header: bool = True) -> DataFrame:
    """Schema-enforced CSV read in the column order ``names`` (the spec's if
    not given): the spec's columns, ``_corrupt_record`` and ``_file``."""
    by_name = {f.name: f for f in spec.struct_type().fields}
    st = T.StructType([by_name.get(c, T.StructField(c, T.StringType())) for c in names or by_name])
    df = (spark.read.schema(st.add("_corrupt_record", T.StringType())).option("header", header)
          .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(paths)
          .withColumn("_file", F.col("_metadata.file_name")))
    return df.select(*by_name, "_corrupt_record", "_file")


def load_with_quarantine(spark: SparkSession, path: str, spec: SchemaSpec, header: bool = True):
    """Schema-enforced CSV read that keeps malformed rows aside instead of
    failing: returns ``(rows, bad_rows)``; bad rows carry the raw text and
    the source file.  Both read one persisted scan; ``unpersist`` on either
    frame's ``_scan`` lets it go."""
    df = read_rows(spark, path, spec, header=header).persist()  # the corrupt column needs a materialised scan
    good = df.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    bad = df.where(F.col("_corrupt_record").isNotNull()).select("_file", "_corrupt_record")
    good._scan = bad._scan = df
    return good, bad
