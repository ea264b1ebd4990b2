"""Catalogue: sources, sinks, validation and ingest (A, B).  Files are
derived from the benchmark tables and written under the shared checkpoint
folder (``spark.checkpoint.dir``)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import ingest as B
from ..sources import io as A
from ..sources.tables import Tables
from .q_clean import DIRTY_EVENTS_SQL, dirty_events
from .registry import fx_df, fx_sql, query

ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query("a1_read_table", fx_sql("SELECT o_orderkey, o_custkey, o_totalprice FROM orders", ["o_totalprice"]))
def a1_read_table(spark, sf_dir):
    return fx_df(A.read_table(spark, f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice"))


CUSTOMER_SCHEMA = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("c_name", T.StringType()),
                                T.StructField("c_nationkey", T.LongType()), T.StructField("c_acctbal", T.DoubleType()),
                                T.StructField("c_mktsegment", T.StringType())])


def _customer_csv(spark, sf_dir):
    path = A.scratch_dir(spark, "csv")
    A.export_csv(Tables(spark, sf_dir).customer, path)
    return path


@query("a2_load_csv", fx_sql("SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment FROM customer",
                             ["c_acctbal"]))
def a2_load_csv(spark, sf_dir):
    """A5 export then A2 schema-enforced load of the written files."""
    return fx_df(A.load_csv(spark, _customer_csv(spark, sf_dir), CUSTOMER_SCHEMA))


@query("a3_union_files", fx_sql("""
SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_nationkey < 12
UNION ALL SELECT c_custkey, c_acctbal, NULL FROM customer WHERE c_nationkey >= 12""", ["c_acctbal"]))
def a3_union_files(spark, sf_dir):
    c = Tables(spark, sf_dir).customer
    a = c.where(F.col("c_nationkey") < 12).select("c_custkey", "c_acctbal", "c_mktsegment")
    b = c.where(F.col("c_nationkey") >= 12).select("c_custkey", "c_acctbal")
    return fx_df(A.union_files([a, b]))


@query("a4_replace_and_drop_table", "SELECT CAST(count(*) AS BIGINT) AS rows, false AS still_exists FROM nation")
def a4_replace_and_drop_table(spark, sf_dir):
    """A4 create-or-replace (external table in the shared folder), read back,
    then A6 drop."""
    name = "custlens_nation_copy"
    A.replace_table(Tables(spark, sf_dir).nation, name, path=A.scratch_dir(spark, "table"))
    rows = spark.table(name).count()
    A.drop_table(spark, name)
    return spark.createDataFrame([(rows, name in [t.name for t in spark.catalog.listTables()])],
                                 "rows long, still_exists boolean")


@query("a7_to_columnar", fx_sql("SELECT c_custkey, c_acctbal, c_mktsegment FROM customer", ["c_acctbal"]))
def a7_to_columnar(spark, sf_dir):
    dst = A.scratch_dir(spark, "parquet")
    A.to_columnar(spark, _customer_csv(spark, sf_dir), dst, CUSTOMER_SCHEMA)
    return fx_df(spark.read.parquet(dst).select("c_custkey", "c_acctbal", "c_mktsegment"))


EVENT_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                             T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                             T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


@query("a8_read_collection", fx_sql("SELECT event_id, user_id, event_type, value FROM events", ["value"]))
def a8_read_collection(spark, sf_dir):
    """A11 write as JSON documents, A12 append a second batch, A8 read back."""
    e = Tables(spark, sf_dir).events
    path = A.scratch_dir(spark, "json")
    A.write_collection(e.where(F.col("event_type") != "click"), path)
    A.append(e.where(F.col("event_type") == "click"), path)
    return fx_df(A.read_collection(spark, path, EVENT_SCHEMA).select("event_id", "user_id", "event_type", "value"))


@query("a9_find", fx_sql("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'", ["value"]))
def a9_find(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return fx_df(A.find(e, {"event_type": "purchase"}).select("event_id", "user_id", "value"))


@query("a10_find_first", "SELECT event_id, user_id FROM events WHERE event_type = 'signup' ORDER BY ts, event_id LIMIT 1")
def a10_find_first(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return A.find_first(e, {"event_type": "signup"}, ["ts", "event_id"]).select("event_id", "user_id")


@query("a13_apply_updates", fx_sql("""
WITH ch AS (SELECT o_custkey AS c_custkey, o_orderpriority, o_totalprice, o_orderdate, o_orderkey FROM orders),
r AS (SELECT c_custkey, arg_max(o_orderpriority, (o_orderdate, o_orderkey)) AS seg, sum(o_totalprice) AS inc
      FROM ch GROUP BY c_custkey)
SELECT c.c_custkey, coalesce(r.seg, c.c_mktsegment) AS c_mktsegment, c.c_acctbal + coalesce(r.inc, 0) AS c_acctbal
FROM customer c LEFT JOIN r ON c.c_custkey = r.c_custkey""", ["c_acctbal"]))
def a13_apply_updates(spark, sf_dir):
    """Set each customer's segment to the priority of its latest order and
    add the order totals to its balance."""
    t = Tables(spark, sf_dir)
    base = t.customer.select("c_custkey", "c_mktsegment", "c_acctbal")
    ch = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("c_mktsegment"),
                         F.col("o_totalprice").alias("c_acctbal"), F.struct("o_orderdate", "o_orderkey").alias("ts"))
    return fx_df(A.apply_updates(base, ch, ["c_custkey"], ["c_mktsegment"], ["c_acctbal"], "ts"))


@query("a14_delete_where", "SELECT event_id FROM events WHERE event_type IS DISTINCT FROM 'error'")
def a14_delete_where(spark, sf_dir):
    return A.delete_where(Tables(spark, sf_dir).events, {"event_type": "error"}).select("event_id")


@query("a14_delete_keys", """
SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')""")
def a14_delete_keys(spark, sf_dir):
    t = Tables(spark, sf_dir)
    keys = t.orders.where(F.col("o_orderstatus") == "O").select(F.col("o_custkey").alias("c_custkey"))
    return A.delete_keys(t.customer.select("c_custkey"), keys, ["c_custkey"])


@query("a15_file_inventory")
def a15_file_inventory(spark, sf_dir):
    return A.file_inventory(spark, _customer_csv(spark, sf_dir), "*.csv")


@query("a16_write_predictions", """
SELECT l_orderkey, l_linenumber, l_quantity * p_retailprice AS prediction
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def a16_write_predictions(spark, sf_dir):
    t = Tables(spark, sf_dir)
    p = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).withColumn(
        "prediction", F.col("l_quantity") * F.col("p_retailprice"))
    path = A.scratch_dir(spark, "pred")
    A.write_predictions(p, path, ["l_orderkey", "l_linenumber"])
    return spark.read.parquet(path)


@query("a17_model_persistence")
def a17_model_persistence(spark, sf_dir):
    """Fit a preprocessing pipeline, save it, load it back, transform."""
    from ..operators.prep import preprocess_pipeline
    c = Tables(spark, sf_dir).customer.select("c_nationkey", "c_acctbal", "c_mktsegment")
    m = preprocess_pipeline("classification", "c_mktsegment", cluster=False).fit(c)
    path = A.scratch_dir(spark, "model")
    A.save_model(m, path)
    return A.load_pipeline(path).transform(c)


_LOG_SQL = """
SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(user_id AS VARCHAR) AS project_id,
       event_type || ' ' || CAST(value AS VARCHAR) AS message, strftime(ts, '%Y-%m-%d') AS date,
       strftime(ts, '%H:%M:%S') AS time, CAST(event_id AS VARCHAR) AS exec_id,
       CASE WHEN event_type = 'error' THEN 'ValueError' END AS tb_exception_type,
       CASE WHEN event_type = 'error' THEN 'events' END AS tb_filename,
       CASE WHEN event_type = 'error' THEN event_id END AS tb_line_no
FROM events"""


def _event_log(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    return e.select(F.col("user_id").cast("string").alias("user_id"), F.col("user_id").cast("string").alias("project_id"),
                   F.concat_ws(" ", "event_type", F.col("value").cast("string")).alias("message"),
                   F.date_format("ts", "yyyy-MM-dd").alias("date"), F.date_format("ts", "HH:mm:ss").alias("time"),
                   F.col("event_id").cast("string").alias("exec_id"),
                   F.when(F.col("event_type") == "error",
                          F.struct(F.lit("ValueError").alias("exception_type"), F.lit("events").alias("filename"),
                                   F.col("event_id").alias("line_no"))).alias("traceback"))


def _flat_log(rec):
    """The nested traceback struct, flattened for comparison."""
    return rec.select("user_id", "project_id", "message", "date", "time", "exec_id",
                      F.col("traceback.exception_type").alias("tb_exception_type"),
                      F.col("traceback.filename").alias("tb_filename"),
                      F.col("traceback.line_no").alias("tb_line_no"))


@query("a18_log_records", _LOG_SQL)
def a18_log_records(spark, sf_dir):
    return _flat_log(A.log_records(_event_log(spark, sf_dir)))


@query("a18_log_append", _LOG_SQL)
def a18_log_append(spark, sf_dir):
    """Errors and all other events appended to one log by two calls, read back."""
    path = A.scratch_dir(spark, "log")
    log = _event_log(spark, sf_dir)
    for part in (F.col("traceback").isNull(), F.col("traceback").isNotNull()):
        A.log_records(log.where(part), path)
    return _flat_log(spark.read.schema(A.LOG_SCHEMA).parquet(path))


# ---------------------------------------------------------------- B
SPEC = B.SchemaSpec(sample_file_name="events_01012024_000000.csv", date_len=8, time_len=6, n_columns=6,
                    columns={"event_id": "integer", "ts": "timestamp", "user_id": "integer",
                             "event_type": "string", "value": "float", "props": "string"})
REGEX = r"events_.*\.csv"

# Upload names derived from events: events_<ddMMyyyy>_<HHmmss>.csv, damaged
# by event_id % 7: 1 -> date stamp one digit short, 2 -> other prefix,
# 3 -> an extra name part.
FILES_SQL = """
SELECT event_id,
  CASE event_id % 7
    WHEN 1 THEN 'events_' || substr(strftime(ts, '%d%m%Y'), 2) || '_' || strftime(ts, '%H%M%S') || '.csv'
    WHEN 2 THEN 'shop_' || strftime(ts, '%d%m%Y') || '_' || strftime(ts, '%H%M%S') || '.csv'
    WHEN 3 THEN 'events_a_' || strftime(ts, '%d%m%Y') || '_' || strftime(ts, '%H%M%S') || '.csv'
    ELSE 'events_' || strftime(ts, '%d%m%Y') || '_' || strftime(ts, '%H%M%S') || '.csv' END AS file
FROM events"""


def upload_names(spark, sf_dir):
    e = Tables(spark, sf_dir).events
    d, t = F.date_format("ts", "ddMMyyyy"), F.date_format("ts", "HHmmss")
    k = F.col("event_id") % 7
    f = (F.when(k == 1, F.concat(F.lit("events_"), F.substring(d, 2, 7), F.lit("_"), t, F.lit(".csv")))
         .when(k == 2, F.concat(F.lit("shop_"), d, F.lit("_"), t, F.lit(".csv")))
         .when(k == 3, F.concat(F.lit("events_a_"), d, F.lit("_"), t, F.lit(".csv")))
         .otherwise(F.concat(F.lit("events_"), d, F.lit("_"), t, F.lit(".csv"))))
    return e.select("event_id", f.alias("file"))


_STATUS_SQL = f"""
WITH f AS ({FILES_SQL}),
p AS (SELECT event_id, file, string_split(split_part(file, '.', 1), '_') AS parts FROM f)
SELECT event_id, file,
  CASE WHEN NOT regexp_matches(file, '^(?:events_.*\\.csv)') THEN 'bad'
       WHEN len(parts) <> 3 THEN 'bad'
       WHEN length(parts[2]) <> 8 OR length(parts[3]) <> 6 THEN 'bad' ELSE 'good' END AS status,
  CASE WHEN NOT regexp_matches(file, '^(?:events_.*\\.csv)') THEN 'regex'
       WHEN len(parts) <> 3 THEN 'name'
       WHEN length(parts[2]) <> 8 OR length(parts[3]) <> 6 THEN 'datestamp' END AS reason
FROM p"""


@query("b2_validate_filenames", _STATUS_SQL)
def b2_validate_filenames(spark, sf_dir):
    """B2 regex, B3 name structure, B4 stamp lengths in one projection."""
    return B.validate_filenames(upload_names(spark, sf_dir), SPEC, REGEX)


@query("b8_route_counts", f"""
SELECT status, reason, CAST(count(*) AS BIGINT) AS files FROM ({_STATUS_SQL}) GROUP BY 1, 2""")
def b8_route_counts(spark, sf_dir):
    st = B.validate_filenames(upload_names(spark, sf_dir), SPEC, REGEX)
    good, bad = B.route(st)
    B.require_good(good)
    return good.unionByName(bad).groupBy("status", "reason").agg(F.count(F.lit(1)).alias("files"))


@query("b1_parse_schema_spec", """
SELECT CAST(event_id AS BIGINT) AS event_id, ts, CAST(user_id AS BIGINT) AS user_id, event_type,
       CAST(value AS DOUBLE) AS value, props FROM events""")
def b1_parse_schema_spec(spark, sf_dir):
    doc = ("{'SampleFileName': 'events_01012024_000000.csv', 'LengthOfDateStampInFile': 8, "
           "'LengthOfTimeStampInFile': 6, 'NumberofColumns': 6, 'ColName': {'event_id': 'INTEGER', "
           "'ts': 'timestamp', 'user_id': 'Integer', 'event_type': 'String', 'value': 'Float', 'props': 'string'}}")
    spec = B.SchemaSpec.from_json(doc)
    st = spec.struct_type()
    # the parsed schema reads the events table's own columns
    e = Tables(spark, sf_dir).events
    return e.select(*[F.col(f.name).cast(f.dataType) for f in st.fields]).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def _priority_csv_dirs(spark, sf_dir):
    """Orders written as CSV, one folder per priority; two priorities lose a
    column (one drops o_totalprice, one renames it)."""
    o = Tables(spark, sf_dir).orders.select(*ORDERS_COLS)
    root = A.scratch_dir(spark, "uploads")
    pr = [r[0] for r in o.select("o_orderpriority").distinct().collect()]   # bounded: 5 priorities
    for p in pr:
        part = o.where(F.col("o_orderpriority") == p)
        if p == "4-NOT SPECIFIED":
            part = part.drop("o_totalprice")
        elif p == "5-LOW":
            part = part.withColumnRenamed("o_totalprice", "price")
        folder = p.split("-")[0]
        part.write.mode("overwrite").option("header", True).csv(f"{root}/p{folder}")
    return root


@query("b5_validate_columns", """
SELECT DISTINCT 'p' || split_part(o_orderpriority, '-', 1) AS folder,
  CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'bad' ELSE 'good' END AS status,
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'columns'
       WHEN o_orderpriority = '5-LOW' THEN 'column_names' END AS reason
FROM orders""")
def b5_validate_columns(spark, sf_dir):
    """B5 column count and B6 column names from each written file's header
    line; one status per upload folder."""
    root = _priority_csv_dirs(spark, sf_dir)
    spec = B.SchemaSpec(None, 8, 6, len(ORDERS_COLS), {c: "string" for c in ORDERS_COLS})
    st = B.validate_columns(B.file_headers(spark, root), spec)
    st = st.withColumn("folder", F.element_at(F.split("path", "/"), -2))
    return st.groupBy("folder").agg(F.max("status").alias("status"), F.max("reason").alias("reason"))


@query("b7_fill_null_literal", f"""
SELECT CAST(event_id AS VARCHAR) AS event_id, coalesce(CAST(user_id AS VARCHAR), 'NULL') AS user_id,
       coalesce(event_type, 'NULL') AS event_type FROM ({DIRTY_EVENTS_SQL})""")
def b7_fill_null_literal(spark, sf_dir):
    d = dirty_events(spark, sf_dir).select("event_id", "user_id", "event_type")
    return B.fill_null_literal(d)


@query("b10_load_with_quarantine", """
SELECT CASE WHEN event_type = 'error' THEN 'bad' ELSE 'good' END AS part, CAST(count(*) AS BIGINT) AS rows
FROM events GROUP BY 1""")
def b10_load_with_quarantine(spark, sf_dir):
    """Events written as CSV where error events carry the text 'n/a' as value:
    the schema-enforced read keeps them aside as corrupt records."""
    e = Tables(spark, sf_dir).events
    txt = e.select(F.col("event_id").cast("string").alias("event_id"),
                   F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                   F.col("user_id").cast("string").alias("user_id"), "event_type",
                   F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.col("value").cast("string")).alias("value"),
                   F.regexp_replace("props", ",", ";").alias("props"))
    path = A.scratch_dir(spark, "quarantine")
    txt.write.mode("overwrite").option("header", True).csv(path)
    good, bad = B.load_with_quarantine(spark, path, SPEC)
    # freed with the session's caches; both frames read it lazily
    return good.select(F.lit("good").alias("part")).unionByName(bad.select(F.lit("bad").alias("part"))) \
        .groupBy("part").agg(F.count(F.lit(1)).alias("rows"))


@query("b11_ingest_stream", """
WITH e AS (SELECT *, coalesce(event_type, 'view') AS t FROM events)
SELECT 'good rows' AS part, t AS what, CAST(count(*) AS BIGINT) AS n, CAST(sum(event_id) AS BIGINT) AS ids
FROM e WHERE t = 'view' OR (t = 'purchase' AND NOT coalesce(value > 100, false)) GROUP BY t
UNION ALL
SELECT 'bad rows', 'purchase', CAST(count(*) AS BIGINT), NULL FROM e WHERE t = 'purchase' AND value > 100
HAVING count(*) > 0
UNION ALL
SELECT DISTINCT 'bad files', CASE t WHEN 'error' THEN 'name' WHEN 'signup' THEN 'column_names' ELSE 'columns' END,
       NULL::BIGINT, NULL::BIGINT FROM e WHERE t IN ('error', 'signup', 'click')
UNION ALL SELECT 'empty files', 'columns', 1, NULL""")
def b11_ingest_stream(spark, sf_dir):
    """Two upload drops and three available-now runs of the file stream, the
    last one without new files.  Views arrive in good files, purchases in files
    of another column order in which amounts above 100 are the text 'n/a', errors
    under bad names, signups with a renamed column, clicks without one, and one
    file is empty."""
    from ..streaming.ingest_stream import ingest_stream
    root = A.scratch_dir(spark, "stream")
    src, good, bad, ck = f"{root}/in", f"{root}/good", f"{root}/bad", f"{root}/ck"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(src).getFileSystem(conf)
    fs.mkdirs(at(src))
    kind = F.coalesce("event_type", F.lit("view"))
    e = Tables(spark, sf_dir).events
    txt = e.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in SPEC.columns],
                   kind.alias("_kind"), F.col("value").alias("_value"))

    def drop(what, name, *cols):
        tmp = f"{root}/stage_{what}"
        (txt.where(F.col("_kind") == what).select(*cols).write.mode("overwrite").option("header", True).csv(tmp))
        for i, r in enumerate(A.file_inventory(spark, tmp, "*.csv").orderBy("path").collect()):   # one a task
            fs.rename(at(r.path), at(f"{src}/{name.format(i)}"))

    def run():
        ingest_stream(spark, src, SPEC, REGEX, good, bad, ck, glob="*.csv").awaitTermination()

    cols = list(SPEC.columns)
    drop("view", "events_01012024_{:06d}.csv", *cols)
    drop("error", "events_a_01012024_{:06d}.csv", *cols)
    run()
    drop("purchase", "events_02012024_{:06d}.csv", *[
        F.when(F.col("_value") > 100, F.lit("n/a")).otherwise(F.col(c)).alias(c) if c == "value" else c
        for c in reversed(cols)])
    drop("signup", "events_03012024_{:06d}.csv", *[F.col(c).alias("amount" if c == "value" else c) for c in cols])
    drop("click", "events_04012024_{:06d}.csv", *[c for c in cols if c != "value"])
    fs.create(at(f"{src}/events_05012024_000000.csv")).close()
    run()
    run()
    g = spark.read.schema(SPEC.struct_type().add("_file", "string")).parquet(good)
    rows = (g.groupBy(F.coalesce("event_type", F.lit("view")).alias("what"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")).withColumn("part", F.lit("good rows")))
    wrong = (spark.read.schema("_file string, _corrupt_record string").parquet(f"{bad}/rows")
             .groupBy(F.lit("bad rows").alias("part"), F.lit("purchase").alias("what"))
             .agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("long").alias("ids")))
    files = spark.read.option("basePath", f"{bad}/files").parquet(f"{bad}/files").select("reason", "length").distinct()
    empty = F.col("length") == 0
    listed = files.select(F.when(empty, "empty files").otherwise("bad files").alias("part"),
                          F.col("reason").alias("what"), F.when(empty, 1).cast("long").alias("n"),
                          F.lit(None).cast("long").alias("ids")).distinct()
    cols = ["part", "what", "n", "ids"]
    return rows.select(*cols).unionByName(wrong.select(*cols)).unionByName(listed)


@query("a5_export_csv", fx_sql("SELECT o_orderkey, o_custkey, o_totalprice FROM orders", ["o_totalprice"]))
def a5_export_csv(spark, sf_dir):
    """Full-table CSV export (multi-part) read back with its header."""
    o = Tables(spark, sf_dir).orders.select("o_orderkey", "o_custkey", "o_totalprice")
    path = A.export_csv(o, A.scratch_dir(spark, "export"))
    st = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                       T.StructField("o_totalprice", T.DoubleType())])
    return fx_df(A.load_csv(spark, path, st))
