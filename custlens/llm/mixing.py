"""Mixing sources to target weights by entropy balancing.

Document rates r stay as close to 1 in relative entropy as the token
constraints sum(r * size) = target of the source allow.  The convex dual has
one multiplier per source; its solution tilts rates exponentially,
r = min(max_rate, exp(multiplier * size / mean size)).  Each Newton iteration
is one distributed sum of gradient and curvature over the table of (source,
size, documents), safeguarded by a bracket per source.  Rates are rounded
into copies by a hash of the document against a threshold per source, found
from two histograms; what is then missing, less than one document, is filled
in a few more rounds among documents that still fit.

Sums are of integers (rates in millionths), so they do not depend on the
order of rows, and reruns agree.

Defined cases: a null or empty text has size 0 and takes 0 words (rate 1);
null is a source of its own, last in order; a target at or above
``max_rate`` times the source copies every document ``max_rate`` times;
repeated rows are decided alike; an empty table gives an empty result; extra
columns are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .shared import WORD, drop_table, write_table

UNIT = 1_000_000
#: Sources held by the driver and broadcast (one small row each); more raise.
MAX_SOURCES = 100_000


def cyclic_weights(n: int) -> list[float]:
    """1, 2, 3, repeating, over sources in order."""
    return [float(1 + i % 3) for i in range(n)]


def capped_targets(sizes: list[int], weights: list[float], cap: float) -> list[float]:
    """Share the sum of sizes by weight; what exceeds ``cap`` times a source's
    size is shared among the others by weight, until none is above."""
    targets = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(sum(sizes))
    while free:
        w = sum(weights[i] for i in free)
        over = {i for i in free if w and left * weights[i] / w > cap * sizes[i]}
        if not over:
            for i in free:
                targets[i] = left * weights[i] / w if w else 0.0
            break
        for i in over:
            targets[i] = cap * float(sizes[i])
            left -= targets[i]
        free -= over
    return targets


def _newton(hist: DataFrame, target: list[float], size: list[int], mean: list[float], cap: int,
            rounds: int, tolerance: float) -> list[float]:
    """Multiplier per source (inf: all at the cap)."""
    spark = hist.sparkSession
    lam = [0.0] * len(target)
    low, high = [-math.inf] * len(target), [math.inf] * len(target)
    todo = set()
    for s, t in enumerate(target):
        if t >= cap * size[s] * (1 - 1e-12):
            lam[s] = math.inf
        elif size[s]:
            todo.add(s)
    for _ in range(rounds):
        if not todo:
            return lam
        now = F.broadcast(spark.createDataFrame([(s, lam[s] / mean[s]) for s in sorted(todo)], "s int, k double"))
        rate = F.least(F.lit(float(cap)), F.exp(F.col("k") * F.col("size")))
        rq = F.round(rate * UNIT).cast("decimal(12,0)")
        mass = (F.col("n") * F.col("size")).cast("decimal(22,0)")
        rows = (hist.join(now, "s").groupBy("s")
                .agg(F.sum(mass * rq).alias("g"),
                     F.sum(F.when(rate < cap, mass * F.col("size").cast("decimal(12,0)") * rq)).alias("h")).collect())
        for r in rows:
            s, gap = r["s"], float(r["g"]) / UNIT - target[r["s"]]
            slope = float(r["h"] or 0) / UNIT / mean[s]
            if abs(gap) <= max(tolerance * target[s], 0.5):
                todo.discard(s)
                continue
            if gap > 0:
                high[s] = lam[s]
            else:
                low[s] = lam[s]
            step = lam[s] - gap / slope if slope > 0 else math.nan
            if not low[s] < step < high[s]:
                if math.isinf(low[s]) or math.isinf(high[s]):
                    step = 2 * lam[s] - math.copysign(1.0, gap)
                else:
                    step = (low[s] + high[s]) / 2
            if high[s] - low[s] < 1e-12 * max(1.0, abs(lam[s])):
                todo.discard(s)
            lam[s] = float(f"{step:.12e}")
    if todo:
        raise RuntimeError(f"{len(todo)} sources not balanced after {rounds} rounds")
    return lam


def _thresholds(v: DataFrame, need: dict[int, float]) -> dict[int, int]:
    """Per source the value below which documents take one copy more without
    exceeding the need: two cumulative histograms, coarse then fine, of the
    eligible documents.  A source all of whose documents fit is left out."""
    spark = v.sparkSession
    goal = F.broadcast(spark.createDataFrame(sorted(need.items()), "s int, need double"))
    width = 1000

    def cut(df, key, rest):
        w = Window.partitionBy("s").orderBy(key)
        summed = (df.groupBy("s", key).agg(F.sum(F.col("size").cast("decimal(38,0)")).alias("m"))
                  .withColumn("upto", F.sum("m").over(w)).join(goal if rest is None else rest, "s"))
        return summed.withColumn("before", F.col("upto") - F.col("m"))

    coarse = cut(v.withColumn("b", F.floor(F.col("v") / width)), "b", None)
    at = (coarse.where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("upto")))
          .select("s", F.col("b"), (F.col("need") - F.col("before")).alias("need")).collect())
    if not at:
        return {}
    inside = F.broadcast(spark.createDataFrame([(r["s"], r["b"], float(r["need"])) for r in at],
                                               "s int, b long, need double"))
    fine = cut(v.withColumn("b", F.floor(F.col("v") / width)).join(inside.select("s", "b"), ["s", "b"]), "v",
               inside.select("s", "need"))
    got = (fine.where((F.col("before") <= F.col("need")) & (F.col("need") < F.col("upto")))
           .select("s", F.col("v").alias("t")).collect())
    return {r["s"]: r["t"] for r in got}


def sizes(docs: DataFrame, text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with ``mix_id``, ``mix_source`` and ``mix_size`` (words)."""
    n = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"mix_id": F.col(id_col), "mix_source": F.col(source_col), "mix_size": n})


def rounded(sized: DataFrame, plan: DataFrame, max_rate: int = 3) -> DataFrame:
    """``sized`` with the plan's columns, ``rate``, ``base`` copies and ``v``,
    whose comparison with a threshold decides about one copy more."""
    rate = F.when(F.col("mix_size") == 0, 1.0).when(F.col("k").isNull(), float(max_rate)).otherwise(
        F.least(F.lit(float(max_rate)), F.exp(F.col("k") * F.col("mix_size"))))
    rq = F.round(F.col("rate") * UNIT).cast("long")
    return (sized.join(F.broadcast(plan), F.col("mix_source").eqNullSafe(F.col("key"))).drop("key")
            .withColumn("rate", rate).withColumn("base", F.floor(rq / UNIT).cast("int"))
            .withColumn("v", F.pmod(F.xxhash64("mix_id", "mix_size"), F.lit(UNIT)) - F.pmod(rq, F.lit(UNIT))))


def _cut():
    """Taken once more by one of the plan's cuts."""
    return F.exists("cuts", lambda c: (F.col("mix_size") <= c["fits"]) & (F.col("v") < c["t"]))


def _more(max_rate: int):
    return (F.col("base") < max_rate) & (F.col("mix_size") > 0)


def solve(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
          weights: Callable[[int], list[float]] = cyclic_weights, max_rate: int = 3, rounds: int = 80,
          tolerance: float = 1e-4, fill_rounds: int = 6) -> tuple[DataFrame, DataFrame]:
    """(ids, sources and sizes as a table; the plan, a row per source)."""
    spark = docs.sparkSession
    sized = write_table(sizes(docs, text_col, source_col, id_col).select("mix_id", "mix_source", "mix_size"), "sized")
    hist = write_table(sized.groupBy("mix_source", "mix_size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    per = (hist.groupBy("mix_source").agg(F.sum(F.col("mix_size") * F.col("n")).alias("size"), F.sum("n").alias("n"))
           .limit(MAX_SOURCES + 1).collect())
    if len(per) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per.sort(key=lambda r: (r[0] is None, str(r[0] or "").encode("utf-8")))
    size = [int(r["size"]) for r in per]
    target = capped_targets(size, weights(len(per)), float(max_rate))
    mean = [max(1.0, z / r["n"]) for z, r in zip(size, per)]
    schema = T.StructType([T.StructField("key", sized.schema["mix_source"].dataType), T.StructField("s", T.IntegerType()),
                           T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
                           T.StructField("k", T.DoubleType()),
                           T.StructField("cuts", T.ArrayType(T.StructType([
                               T.StructField("fits", T.LongType()), T.StructField("t", T.LongType())])))])
    keys = [(r[0], s, size[s], target[s], None, []) for s, r in enumerate(per)]
    numbered = hist.join(F.broadcast(spark.createDataFrame(keys, schema)), F.col("mix_source").eqNullSafe(F.col("key")))
    lam = _newton(numbered.select("s", F.col("mix_size").alias("size"), "n"), target, size, mean, max_rate,
                  rounds, tolerance) if per else []
    keys = [(*r[:4], None if math.isinf(x) else x / mean[s], []) for s, (r, x) in enumerate(zip(keys, lam))]
    doc = rounded(sized, spark.createDataFrame(keys, schema), max_rate)
    fixed = {r["s"]: int(r["m"]) for r in doc.groupBy("s").agg(
        F.sum((F.col("base") * F.col("mix_size")).cast("decimal(38,0)")).alias("m")).collect()}
    need = {s: t - fixed.get(s, 0) for s, t in enumerate(target)}
    cuts: list[list] = [[] for _ in per]
    for _ in range(fill_rounds):
        need = {s: x for s, x in need.items() if x > max(1.0, 1e-3 * target[s])}
        if not need:
            break
        goal = F.broadcast(spark.createDataFrame([(s, int(x)) for s, x in need.items()], "g int, fits long"))
        left = (rounded(sized, spark.createDataFrame([(*r[:5], c) for r, c in zip(keys, cuts)], schema), max_rate)
                .where(_more(max_rate) & ~_cut()).join(goal, F.col("s") == F.col("g"))
                .where(F.col("mix_size") <= F.col("fits")).select("s", F.col("mix_size").alias("size"), "v"))
        found = _thresholds(left, need)
        rows = [(s, int(x), int(found.get(s, UNIT))) for s, x in need.items()]
        now = F.broadcast(spark.createDataFrame(rows, "g int, fits long, t long"))
        got = {r["s"]: int(r["m"]) for r in left.join(now, (F.col("s") == F.col("g")) & (F.col("v") < F.col("t")))
               .groupBy("s").agg(F.sum(F.col("size").cast("decimal(38,0)")).alias("m")).collect()}
        for s, fits, t in rows:
            cuts[s].append((fits, t))
        need = {s: x - got[s] for s, x in need.items() if s in got}
    keys = [(*r[:5], c) for r, c in zip(keys, cuts)]
    drop_table(hist)
    return sized, spark.createDataFrame(keys, schema)


def take(sized: DataFrame, plan: DataFrame, max_rate: int = 3) -> DataFrame:
    """``sized`` (of ``sizes``) with source_size, target, rate and copies: a
    projection with the plan broadcast, so texts stay where they are."""
    more = F.when(_more(max_rate) & _cut(), 1).otherwise(0)
    return rounded(sized, plan, max_rate).withColumn("copies", (F.col("base") + more).cast("int")).drop(
        "s", "k", "cuts", "base", "v")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        max_rate: int = 3, **solving) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, rate, copies,
    taken.  ``weights`` gives the weights of n sources in code-point order."""
    sized, plan = solve(docs, id_col, text_col, source_col, max_rate=max_rate, **solving)
    return take(sized, plan, max_rate).select(
        F.col("mix_id").alias("doc_id"), F.col("mix_source").alias("source"), F.col("mix_size").alias("size"),
        "source_size", "target", "rate", "copies", (F.col("copies") * F.col("mix_size")).alias("taken"))
