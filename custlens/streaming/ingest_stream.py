"""Incremental ingest (B11): new upload files are discovered by the file
stream source (its checkpoint hands every file to one epoch), and each
micro-batch runs the whole validation of B2-B10 on its files: name, stamps,
header names and column count from each file's own header line, then every row
against the declared types.

Everything an epoch writes goes to a folder of its own that a retry overwrites:
``<good>/epoch=<id>`` for rows, ``<bad>/files/epoch=<id>`` for rejected files and
``<bad>/rows/epoch=<id>`` for malformed rows.  So a batch that failed half-way and
runs again leaves each row once.  File contents are never part of the stream
itself; a batch holds at most ``max_files`` file names on the driver.  Files
without a byte, which the file source does not hand out, are listed from the
file system and rejected by the first epoch that sees them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import ingest as B

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"
RAISE, SKIP = "raise", "skip"


def ingest_files(files: DataFrame, spec: B.SchemaSpec, regex: str, good_path: str, bad_path: str, epoch: int,
                 no_good: str = SKIP) -> None:
    """Validate, route and write the files (path, uri, file, length) of one
    epoch.  ``no_good="raise"`` stops where no file of the epoch passes."""
    spark = files.sparkSession
    listed = [tuple(r) for r in files.select("path", "uri", "file", "length").collect()]     # at most max_files
    checked = [r.asDict() for r in B.check_files(spark.createDataFrame(listed, B.FILE), spec, regex).collect()]
    kind = "path string, file string, length long, status string, reason string, header array<string>, missing array<string>"
    status = spark.createDataFrame([tuple(r[c.split(" ")[0]] for c in kind.split(", ")) for r in checked], kind)
    good, bad = B.route(status)
    B.write_quarantine(bad, f"{bad_path}/files/epoch={epoch}", "overwrite")
    if no_good == RAISE:
        B.require_good(good)
    # files whose columns come in another order are read by their own header
    orders: dict[tuple, list] = {}
    for r in checked:
        if r["status"] == "good":
            orders.setdefault(tuple(r["header"]), []).append(r["path"])
    if not orders:
        return
    rows = None
    for names, paths in orders.items():
        part = B.read_rows(spark, paths, spec, list(names))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.persist()               # the corrupt column needs a materialised scan
    try:
        (rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
         .write.mode("overwrite").parquet(f"{good_path}/epoch={epoch}"))
        (rows.where(F.col("_corrupt_record").isNotNull()).select("_file", "_corrupt_record")
         .write.mode("overwrite").parquet(f"{bad_path}/rows/epoch={epoch}"))
    finally:
        rows.unpersist()


def rejected_before(spark: SparkSession, bad_path: str, epoch: int) -> set[str]:
    """Empty files that an earlier epoch rejected."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(f"{bad_path}/files")
    if not top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top):
        return set()
    kind = "path string, file string, length long, status string, header array<string>, missing array<string>, epoch long"
    seen = spark.read.schema(kind).option("basePath", f"{bad_path}/files").parquet(f"{bad_path}/files")
    return {r[0] for r in seen.where((F.col("length") == 0) & (F.col("epoch") < epoch)).select("path").collect()}


def ingest_stream(spark: SparkSession, src_dir: str, spec: B.SchemaSpec, regex: str, good_path: str,
                  bad_path: str, checkpoint: str, available_now: bool = True, max_files: int = 1000,
                  no_good: str = SKIP, glob: str = "*"):
    """Start the stream; returns the ``StreamingQuery``."""
    # names and lengths only: the content column is pruned, so nothing is read here
    found = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob)
             .option("maxFilesPerTrigger", max_files).load(src_dir)
             .select("path", F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_name").alias("file"),
                     "length"))

    def handle(batch: DataFrame, epoch: int):
        empty = B.empty_files(spark, src_dir, glob)
        if empty:
            before = rejected_before(spark, bad_path, epoch)
            empty = [f for f in empty if f[0] not in before]
        files = batch.unionByName(spark.createDataFrame(empty, B.FILE)) if empty else batch
        ingest_files(files, spec, regex, good_path, bad_path, epoch, no_good)

    w = found.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def predict_stream(model, src_dir: str, schema, out_path: str, checkpoint: str, key: list[str],
                   spark: SparkSession, available_now: bool = True):
    """J12 on a stream: the fitted pipeline's transform is narrow, so the
    same model scores each new file as it arrives."""
    raw = spark.readStream.schema(schema).parquet(src_dir)
    pred = model.predict(raw).select(*key, "prediction")
    w = pred.writeStream.format("parquet").option("path", out_path).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
