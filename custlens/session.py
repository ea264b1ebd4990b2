"""Session helpers: a tuned local/cluster session and lineage cutting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every session of this library relies on.  AQE lets Spark re-plan
# joins at runtime from real shuffle sizes (broadcast only when a side is
# measured small), coalesce tiny partitions and split skewed join partitions.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "custlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    # local mode runs everything in the driver JVM; 1 GiB default is too small
    conf.setdefault("spark.driver.memory", os.environ.get("CUSTLENS_DRIVER_MEMORY", "4g"))
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``; only in local mode (tests, laptops) may it be unset,
    and a private scratch folder is picked.  Elsewhere that raises: executors
    would each write to their own disk."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="custlens-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (written to the shared checkpoint dir, so it
    survives executor loss) used between iterations of driver-side loops to
    keep the plan from growing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or ensure_checkpoint_dir(spark)).rstrip("/")


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet into the shared folder and read back: its
    rows are computed a single time, survive lost executors and take no memory.
    ``drop_staged`` removes what a session has staged."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/custlens-stage-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_staged(spark: SparkSession) -> None:
    """Remove this application's staged tables; frames that read them end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(
        f"{shared_folder(spark)}/custlens-stage-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bytes of input files per partition of ``spread``.
SPREAD_BYTES = 4 << 20


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` dealt by ``cols`` into partitions whose number grows with its input
    files, where the default number would make them larger than
    ``SPREAD_BYTES``: what one task of a grouping holds stays bounded."""
    spark = df.sparkSession
    conf, total = spark._jsc.hadoopConfiguration(), 0
    for name in df.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        total += path.getFileSystem(conf).getFileStatus(path).getLen()
    parts = -(-total // SPREAD_BYTES)
    return df.repartition(parts, *cols) if parts > spark.sparkContext.defaultParallelism else df


def default_parallelism(spark: SparkSession) -> int:
    try:
        return int(spark.conf.get("spark.sql.shuffle.partitions"))
    except Exception:  # pragma: no cover
        return os.cpu_count() or 8
