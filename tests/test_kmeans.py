"""k-means with many starts against plain numpy."""

import numpy as np
import pytest

from custlens.operators import segment as S
from custlens.operators.kmeans import many_kmeans, nearest_center


def blobs(rng, per=300):
    at = np.array([[0, 0], [10, 0], [0, 10], [10, 10], [5, 30]], float)
    return np.vstack([c + rng.normal(0, 0.7, (per, 2)) for c in at])


def test_fixed_points_and_costs(spark):
    x = blobs(np.random.default_rng(0))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x] + [(None, 1.0)], "a double, b double").repartition(7)
    got = many_kmeans(df, ["a", "b"], [1, 3, 5], n_init=12)
    assert got[1].cost == pytest.approx(np.square(x - x.mean(axis=0)).sum())
    for k, c in got.items():
        near = np.square(x[:, None] - c.centers[None]).sum(axis=2)
        own = near.argmin(axis=1)
        assert c.converged and c.cost == min(c.costs) == pytest.approx(near.min(axis=1).sum())
        assert np.allclose(c.centers, [x[own == j].mean(axis=0) for j in range(k)], atol=1e-7)
    assert got[5].cost < got[3].cost < got[1].cost and got[5].cost < 1500 * 2 * 0.7 ** 2 * 1.2
    labels = df.select(nearest_center(["a", "b"], got[5].centers).alias("c")).collect()
    assert sum(r["c"] is None for r in labels) == 1 and {r["c"] for r in labels} == {0, 1, 2, 3, 4, None}


def test_starts_are_repeatable_and_more_are_no_worse(spark):
    x = blobs(np.random.default_rng(1), 60)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "a double, b double")
    one, many, again = (many_kmeans(df.coalesce(1), ["a", "b"], [4], n_init=n)[4] for n in (1, 20, 20))
    assert many.cost <= one.cost and np.array_equal(many.centers, again.centers)
    rows = S.elbow(df, ["a", "b"], range(1, 11), n_init=10).collect()
    assert [r["k"] for r in rows] == list(range(1, 11)) and all(r["converged"] for r in rows)
    assert all(b["wcss"] < a["wcss"] for a, b in zip(rows, rows[1:]))


def test_more_clusters_than_points(spark):
    df = spark.createDataFrame([(1.0, 1.0)] * 3 + [(2.0, 2.0)], "a double, b double")
    got = many_kmeans(df, ["a", "b"], [4], n_init=3)[4]
    assert got.cost == 0.0 and got.converged
    with pytest.raises(ValueError):
        many_kmeans(df.where("a > 9"), ["a", "b"], [2])


@pytest.mark.parametrize("same", [False, True])
def test_runs_of_rows_give_the_sums_of_single_rows(spark, monkeypatch, same):
    """Many tiles and cells, also where two thirds of the rows are one point; whole runs are taken."""
    from custlens.operators import kmeans as K
    x = np.random.default_rng(3).uniform(size=(6000, 3))
    x[:4000 if same else 0] = 0.25
    monkeypatch.setattr(K, "TILE", 512)
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], "c0 double, c1 double, c2 double").repartition(3)
    laid = K._laid_out(df, len(x), x[:2000])
    back = np.array([tuple(r) for r in laid.collect()])
    assert sorted(map(tuple, back)) == sorted(map(tuple, x))
    runs = [x[i::1500][:k] + 0.001 for i in range(3) for k in (1, 2, 4)]
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in back.T], ["c0", "c1", "c2"])
    got = np.array(next(iter(K._assign(runs)([batch])))["v"].to_pylist())
    for c in runs:
        gap = np.square(x[:, None] - c[None]).sum(axis=2)
        own = gap.argmin(axis=1)
        seen = [[(own == j).sum(), gap[own == j, j].sum(), *x[own == j].sum(axis=0)] for j in range(len(c))]
        assert np.allclose(got[:len(c)], seen, atol=1e-8)
        got = got[len(c):]


def test_silhouette_rounds_are_few_tasks(spark):
    """Fits read two partitions a core at most, not one per shuffle partition."""
    from pyspark.ml.clustering import KMeans
    seen, fit = [], KMeans._fit
    df = spark.createDataFrame([tuple(map(float, r)) for r in blobs(np.random.default_rng(2), 40)], "a double, b double")
    try:
        KMeans._fit = lambda self, x: seen.append((x.rdd.getNumPartitions(), x.count())) or fit(self, x)
        rows = S.silhouette(df.repartition(64, "a"), ["a", "b"], [5]).collect()
    finally:
        KMeans._fit = fit
    assert [r["k"] for r in rows] == [5] and rows[0]["silhouette"] > 0.7
    assert seen[0][0] <= 2 * spark.sparkContext.defaultParallelism and seen[0][1] == 200
