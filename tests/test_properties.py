"""Property tests (hypothesis) on small generated inputs."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custlens.operators import segment as S
from custlens.sources import ingest as B

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(st.lists(st.integers(min_value=-50, max_value=50), min_size=1, max_size=40))
def test_average_ranks_sum(spark, values):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")
    ranks = [r["r"] for r in S.average_rank(df, "v", True, "r").collect()]
    n = len(values)
    assert math.isclose(sum(ranks), n * (n + 1) / 2)
    down = {r["i"]: r["r"] for r in S.average_rank(df, "v", False, "r").collect()}
    up = {r["i"]: r["r"] for r in S.average_rank(df, "v", True, "r").collect()}
    for i in up:
        assert math.isclose(up[i] + down[i], n + 1)


@SETTINGS
@given(st.lists(st.floats(min_value=-1e3, max_value=1e3, allow_nan=False), min_size=10, max_size=60, unique=True))
def test_qcut_monotone(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    rows = sorted((r["v"], r["q"]) for r in S.qcut(df, "v", 4, out="q").collect())
    labels = [q for _, q in rows]
    assert labels == sorted(labels) and labels[0] == 1 and labels[-1] == 4


@SETTINGS
@given(st.lists(st.integers(min_value=0, max_value=200), min_size=3, max_size=50), st.integers(1, 4))
def test_kmedoids_assignment_and_median(spark, values, k):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    lab, med = S.kmedoids_1d(df, "v", k=k)
    rows = lab.collect()
    for r in rows:
        d = [abs(r["v"] - m) for m in med]
        assert d[r["v_cluster"]] == min(d)


@SETTINGS
@given(st.lists(st.text(alphabet="abcdefghij_0123456789.", min_size=1, max_size=25), min_size=1, max_size=20))
def test_validation_partitions_input(spark, names):
    spec = B.SchemaSpec(None, 8, 6, 1, {"a": "string"})
    df = spark.createDataFrame([(n,) for n in names], "file string")
    stt = B.validate_filenames(df, spec, r"a.*\.csv")
    good, bad = B.route(stt)
    assert good.count() + bad.count() == len(names)
    assert good.where(F.col("reason").isNotNull()).count() == 0
    assert bad.where(F.col("reason").isNull()).count() == 0
