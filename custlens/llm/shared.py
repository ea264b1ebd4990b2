"""Shared helpers: written intermediate tables and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: the one ``spark.checkpoint.dir``
    names (set by the session helper only where it is unset)."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return (configured or ensure_checkpoint_dir(spark)).rstrip("/")


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back:
    the rows are computed a single time and survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._llm_path = path
    return back


def drop_table(df: DataFrame) -> None:
    """Remove a table of ``write_table`` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._llm_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def meet(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of two sides that grow with the corpus: sorted on both, never broadcast.
    Spark sizes a side by its files and a guess of 4 to 20 bytes a list or
    string, so what is exploded, or repeated and compressed well, looks small
    enough to be sent through the driver."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def drawn(mark, size: int, n: int):
    """Whether a row with 64-bit hash ``mark`` is among about ``size`` of ``n``."""
    if n <= size:
        return F.lit(True)
    return mark <= F.lit(min(int(size / n * 2.0 ** 64) - 2 ** 63, 2 ** 63 - 1))


def bounded_sample(df: DataFrame, n: int, size: int, *cols: str) -> DataFrame:
    """About ``size`` (never more) of the ``n`` rows, drawn by a hash of ``cols``."""
    mark = F.xxhash64(*cols)
    return df.where(drawn(mark, int(1.2 * size), n)).orderBy(mark, *cols).limit(size)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id per vertex that has an edge: (id, component).

    Alternating large-star and small-star rounds; each is a min per vertex and
    a join back, so no neighbour list is ever gathered, and each round's edge
    table is written to the shared folder.  Raises if not settled after
    ``max_rounds`` (rounds needed grow with the logarithm of the vertices)."""
    e = (edges.where(F.col(a) != F.col(b))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = write_table(e, "edges")
    seen = None
    for _ in range(max_rounds):
        mark = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        seen = mark
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (meet(both, low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (meet(large, low, "u")
                 .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                           F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
                 .select("x.u", "x.v").where("u > v").distinct())
        e, old = write_table(small, "edges"), e
        drop_table(old)
    raise RuntimeError(f"components not settled after {max_rounds} rounds")


#: Runs of white space between words, and the words themselves.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def bind(expr, body):
    """``body`` of ``expr``, which is evaluated once per row however often the
    body names it (a lambda variable, not a repeated expression)."""
    return F.element_at(F.transform(F.array(expr), body), 1)


def running(sizes, zero=None):
    """Running sums of an array column, each element included: every pass adds
    what lies 1, 2, 4, ... places before, so n elements take n log n steps."""
    none = F.lit(0) if zero is None else zero
    steps = F.filter(F.array(*[F.lit(1 << b) for b in range(31)]), lambda s: s < F.size(sizes))
    return F.aggregate(steps, sizes, lambda acc, s: F.transform(
        acc, lambda v, i: v + F.coalesce(F.get(acc, i - s), none)))
