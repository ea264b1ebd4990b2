"""Customer segmentation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import regex_label, score_label, segment_from_code
from ..session import stage_table
from .clean import round_numeric
from .kmeans import many_kmeans, nearest_center
from .ranking import (ValueLookup, average_rank_table, bucket_expr, grouped_quantiles, grouped_ranked,
                      ranked_histogram)


# E1
def average_rank(df: DataFrame, col: str, ascending: bool = True, out: str | None = None,
                 return_max: bool = False):
    """Rank with ties given their mean position (1-based); NULL stays NULL.
    The per-value rank table is joined back on the value (AQE broadcasts it
    when small and splits skewed values otherwise)."""
    out = out or f"{col}_rank"
    h = ranked_histogram(df, col)
    ranks = average_rank_table(h, ascending)
    max_rank = h.max_average_rank(ascending) if return_max else None
    joined = df.join(ranks.withColumnRenamed("value", "__v").withColumnRenamed("rank", out),
                     F.col(col) == F.col("__v"), "left").drop("__v")
    return (joined, max_rank) if return_max else joined


# E2-E4
def rfm_score(df: DataFrame, r: str = "recency", f: str = "frequency", m: str = "monetary",
              weights=(0.15, 0.28, 0.57), scale: float = 0.05, compat: bool = False,
              keep_ranks: bool = False) -> DataFrame:
    """Weighted rank score ``scale*(wr*R + wf*F + wm*M)`` of normalised ranks
    (recency ranked descending, others ascending; ``rank/max(rank)*100``),
    float columns rounded to 2 decimals, then labelled.  ``compat=True``
    normalises the monetary term with the frequency rank, as the original
    segment report did.

    The three columns are ranked together, as groups of one histogram; the
    table is staged, so what made it runs once."""
    df = stage_table(df, "scored")
    long = df.select(*[F.col(c).cast("double").alias(c) for c in (r, f, m)]).unpivot([], [r, f, m], "column", "v")
    ranks = grouped_ranked(long, ["column"], "v")
    down = F.col("column") == r
    rank = F.when(down, F.col("n") - F.col("below") - (F.col("cnt") - 1) / 2.0) \
        .otherwise(F.col("below") + (F.col("cnt") + 1) / 2.0)
    # the largest rank is that of the largest value, of the smallest where ranked descending
    ends = ranks.groupBy("column").agg(
        F.max("n").alias("n"), F.min_by("cnt", "value").alias("lo"), F.max_by("cnt", "value").alias("hi"))
    top = ends.select(F.map_from_entries(F.collect_list(F.struct(
        "column", (F.col("n") - (F.when(down, F.col("lo")).otherwise(F.col("hi")) - 1) / 2.0).alias("top"))))).scalar()
    out = df
    for c, name in ((r, "R_rank"), (f, "F_rank"), (m, "M_rank")):
        mine = ranks.where(F.col("column") == c).select(F.col("value").alias("__v"), rank.alias(name))
        out = out.join(mine, F.col(c).cast("double") == F.col("__v"), "left").drop("__v")
    share = lambda name, c: F.col(name) / F.element_at(top, F.lit(c)) * 100
    mn = share("F_rank" if compat else "M_rank", m)
    score = (F.lit(weights[0]) * share("R_rank", r) + F.lit(weights[1]) * share("F_rank", f)
             + F.lit(weights[2]) * mn) * F.lit(scale)
    out = out.withColumn("RFM_Score", score)
    out = round_numeric(out, 2)
    out = out.withColumn("score_label", score_label("RFM_Score"))
    return out if keep_ranks else out.drop("R_rank", "F_rank", "M_rank")


# E5
def qcut_edges(df: DataFrame, col: str, q: int = 5, duplicates: str = "raise") -> list[float]:
    row = grouped_quantiles(df, [], col, [i / q for i in range(q + 1)], [f"e{i}" for i in range(q + 1)]).first()
    edges = [float(e) for e in row]
    uniq = sorted(set(edges))
    if len(uniq) < len(edges):
        if duplicates == "raise":
            raise ValueError(f"qcut: bin edges must be unique for {col}: {edges}")
        edges = uniq
    return edges


def qcut(df: DataFrame, col: str, q: int = 5, out: str | None = None, first_label: int = 1,
         duplicates: str = "raise", edges: list[float] | None = None) -> DataFrame:
    """Equal-frequency bins with exact linear-interpolated edges, right-closed,
    lowest edge included (values outside the edges -> NULL)."""
    out = out or f"{col}_q"
    edges = edges or qcut_edges(df, col, q, duplicates)
    c = F.col(col)
    inner = edges[1:-1]
    label = (bucket_expr(c, inner) if inner else F.lit(0)) + F.lit(first_label)
    inside = (c >= F.lit(edges[0])) & (c <= F.lit(edges[-1]))
    return df.withColumn(out, F.when(inside, label.cast("int")))


# E6
def composite_code(*cols: str) -> Column:
    return F.concat(*[F.col(c).cast("string") for c in cols])


# E7 is functions.labels.regex_label; E10's map is functions.labels.segment_from_code
__all__ = ["regex_label", "segment_from_code", "score_label"]


# E8
@dataclass
class Medoids:
    """Medoids in order, rounds used, and whether they settled."""

    values: list[float]
    rounds: int
    converged: bool


def _next_medoids(lookup: ValueLookup, medoids: list[float]) -> list[float]:
    """New medoids of one round: clusters are value ranges, so a prefix sum at
    each bound gives their first positions and sizes, and a cluster's lower
    weighted median is the value at a position."""
    bounds = [(a + b) / 2.0 for a, b in zip(medoids, medoids[1:])]
    marks = [0, *lookup.rows_up_to(bounds), lookup.n]
    return sorted(set(lookup.values_at([a + (b - a - 1) // 2 for a, b in zip(marks, marks[1:]) if b > a])))


def kmedoids_1d(df: DataFrame, col: str, k: int = 5, max_iter: int = 1000, out: str | None = None,
                with_info: bool = False):
    """1-D k-medoids (alternating): assign each value to the nearest medoid
    (ties to the lower), then move each medoid to its cluster's lower weighted
    median — in one dimension the member minimising the summed distance.

    Works on the value histogram: a round is k - 1 prefix sums and k order
    statistics, exact lookups that take a job only where they leave the ranges
    of values seen before.  It runs until the medoids stay, at most ``max_iter``
    rounds.  Initialisation is deterministic (medoids at the ``(i+.5)/k`` order
    statistics).  Returns ``(df_with_labels, medoids)``, with ``with_info`` the
    medoids as a ``Medoids`` that says whether they settled."""
    out = out or f"{col}_cluster"
    lookup = ValueLookup(df, col)
    info = Medoids([], 0, True)
    if lookup.n == 0:
        return df.withColumn(out, F.lit(None).cast("int")), info if with_info else []
    medoids = sorted(set(lookup.values_at([int((lookup.n - 1) * (i + 0.5) / k) for i in range(k)])))
    info.converged = False
    for info.rounds in range(1, max_iter + 1):
        new = _next_medoids(lookup, medoids)
        info.converged, medoids = new == medoids, new
        if info.converged:
            break
    info.values = medoids
    bounds = [(a + b) / 2.0 for a, b in zip(medoids, medoids[1:])]
    c = F.col(col)
    lab = bucket_expr(c, bounds) if bounds else F.lit(0)
    return df.withColumn(out, F.when(c.isNotNull(), lab.cast("int"))), info if with_info else medoids


# E9
def order_clusters(df: DataFrame, cluster: str, target: str, ascending: bool = True,
                   out: str | None = None) -> DataFrame:
    """Relabel clusters 0..k-1 by the rank of their mean ``target``.  The k
    means are a bounded aggregate; the relabel is a literal map lookup."""
    out = out or cluster
    means = df.groupBy(cluster).agg(F.avg(target).alias("m")).collect()
    means = [r for r in means if r[cluster] is not None]
    means.sort(key=lambda r: ((r["m"] if ascending else -r["m"]) if r["m"] is not None else float("inf"),
                              r[cluster]))
    pairs = [x for i, r in enumerate(means) for x in (F.lit(r[cluster]), F.lit(i))]
    if not pairs:
        return df.withColumn(out, F.lit(None).cast("int"))
    return df.withColumn(out, F.element_at(F.create_map(*pairs), F.col(cluster)).cast("int"))


# E10
def ml_segment(df: DataFrame, r: str = "recency", f: str = "frequency", m: str = "monetary",
               k: int = 5, max_iter: int = 1000, out: str = "ml_label", keep_code: bool = False) -> DataFrame:
    """Cluster recency, frequency and monetary separately (1-D k-medoids, the
    three fits run as concurrent Spark jobs), order the clusters by mean
    (recency descending: 0 = stalest), join the three digits and map the
    first two to a segment name.  1-D clusters are contiguous value ranges,
    so ordering by mean is ordering by medoid: no extra pass is needed."""
    from concurrent.futures import ThreadPoolExecutor
    df = stage_table(df, "segmented")
    specs = ((r, False, "r"), (f, True, "f"), (m, True, "m"))
    with ThreadPoolExecutor(max_workers=3) as ex:
        fits = list(ex.map(lambda sp: kmedoids_1d(df, sp[0], k=k, max_iter=max_iter)[1], specs))
    x = df
    for (col, asc, tag), medoids in zip(specs, fits):
        bounds = [(a + b) / 2.0 for a, b in zip(medoids, medoids[1:])]
        idx = bucket_expr(F.col(col), bounds) if bounds else F.lit(0)
        lab = idx if asc else F.lit(len(medoids) - 1) - idx
        x = x.withColumn(f"__ml_{tag}", F.when(F.col(col).isNotNull(), lab.cast("int")))
    code = composite_code("__ml_r", "__ml_f", "__ml_m")
    x = x.withColumn("ml_code", code).withColumn(out, segment_from_code("ml_code"))
    x = x.drop("__ml_r", "__ml_f", "__ml_m")
    return x if keep_code else x.drop("ml_code")


# E11-E13
def _features(df: DataFrame, cols: list[str], scale: str = "minmax") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    from .prep import minmax_exprs
    x = df
    if scale == "minmax":
        x = x.withColumns(minmax_exprs(df, cols))
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(x)


def rfm_kmeans(df: DataFrame, cols: list[str], k: int = 5, seed: int = 42, max_iter: int = 500,
               n_init: int = 50, out: str = "cluster"):
    """Min-max scale then k-means; ``n_init`` starts advanced together, lowest
    cost kept.  Returns ``(labelled_df, Clustering)``; rows with a null column
    get no cluster."""
    from .prep import minmax_exprs
    df = stage_table(df, "rfm")
    x = df.withColumns(minmax_exprs(df, cols))
    best = many_kmeans(x.select(*cols), cols, [k], n_init, max_iter, seed)[k]
    return x.withColumn(out, nearest_center(cols, best.centers)), best


def elbow(df: DataFrame, cols: list[str], ks=range(1, 11), seed: int = 42, max_iter: int = 300,
          n_init: int = 50) -> DataFrame:
    """Within-cluster sum of squares per k, the lowest of ``n_init`` starts; all
    starts of all k are advanced in the same passes."""
    from .prep import minmax_exprs
    x = stage_table(df.select(*cols), "elbow")
    got = many_kmeans(x.withColumns(minmax_exprs(x, cols)), cols, ks, n_init, max_iter, seed)
    return df.sparkSession.createDataFrame([(k, c.cost, c.converged) for k, c in got.items()],
                                           "k int, wcss double, converged boolean")


def silhouette(df: DataFrame, cols: list[str], ks=range(2, 11), seed: int = 42,
               max_iter: int = 100) -> DataFrame:
    """Mean silhouette per k (Spark's evaluator, squared Euclidean).  Rows of
    more than two partitions a core are staged first, so that a round is few
    tasks; the fits of all k run as concurrent Spark jobs."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    feats = dealt = _features(df, cols).persist()
    if dealt.rdd.getNumPartitions() > 2 * df.sparkSession.sparkContext.defaultParallelism:
        feats = _features(stage_table(dealt.select(*cols), "silhouette"), cols, "none").select("features").persist()
        dealt.unpersist()
    ev = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")

    def run(k):
        model = KMeans(k=k, seed=seed, maxIter=max_iter).fit(feats)
        return int(k), float(ev.evaluate(model.transform(feats)))
    with ThreadPoolExecutor(max_workers=4) as ex:
        rows = list(ex.map(run, ks))
    feats.unpersist()
    return df.sparkSession.createDataFrame(rows, "k int, silhouette double")


# E14
def cluster_profile(df: DataFrame, label: str, cols: list[str]) -> DataFrame:
    return df.groupBy(label).agg(*[F.avg(c).alias(f"avg_{c}") for c in cols],
                                 F.count(F.lit(1)).alias("size"))
