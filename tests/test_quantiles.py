"""Exact quantile machinery against numpy."""

import numpy as np

from custlens.operators.ranking import grouped_grid_quantiles, grouped_quantiles


def test_grid_quantiles_match_numpy(spark):
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 300):
        vals = [float(v) for v in rng.integers(0, 30, n)]
        grp = ["a" if i % 3 else "b" for i in range(n)]
        df = spark.createDataFrame(list(zip(grp, vals)), "g string, v double")
        for k in (2, 5, 101):
            got = {(r["g"], r["i"]): r["q"] for r in grouped_grid_quantiles(df, ["g"], "v", k).collect()}
            for g in set(grp):
                xs = [v for gg, v in zip(grp, vals) if gg == g]
                want = np.quantile(xs, [i / (k - 1) for i in range(k)])
                for i, w in enumerate(want):
                    assert abs(got[(g, i)] - w) < 1e-9


def test_grouped_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    vals = [float(v) for v in rng.normal(size=257)]
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    r = grouped_quantiles(df, [], "v", [0.1, 0.5, 0.93], ["a", "b", "c"]).first()
    want = np.quantile(vals, [0.1, 0.5, 0.93])
    assert np.allclose([r["a"], r["b"], r["c"]], want, atol=1e-12)
