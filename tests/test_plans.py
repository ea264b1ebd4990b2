"""Scale guards on physical plans: no single-partition window over data
rows, no cartesian products, filters and column pruning reach the scan."""

import re

import pytest

import __spark_entry__ as E
from tests.conftest import SMALL

# every query except the model searches / learner comparisons (slow to build)
HEAVY = ("j11", "j12", "j3_", "l_", "f10", "e11", "e12", "e13", "a17", "b11", "j13")
GUARDED = sorted(n for n in E.queries() if not n.startswith(HEAVY))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", GUARDED)
def test_no_cartesian_or_nested_loop(spark, name):
    p = _plan(E.queries()[name](spark, SMALL))
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


RANKED = ["e1_average_rank", "e3_rfm_score", "e5_qcut", "g4_clv_summary_stats", "g10_describe_numeric",
          "g19_box_stats_by_group", "h2_spearman_rho", "j1_stratified_split", "j4_fold_column", "i4_zscore"]


def unpartitioned(plan):
    """Window specifications whose first expression is an ordering."""
    return [w for w in re.findall(r"windowspecdefinition\(([^,)]*)", plan) if re.search(r" (ASC|DESC)\b", w)
            or w.startswith("specifiedwindowframe")]


@pytest.mark.parametrize("name", RANKED)
def test_windows_are_partitioned(spark, name):
    assert not unpartitioned(E.queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString())


def test_the_window_guard_can_fail(spark):
    w = spark.range(5).selectExpr("sum(id) OVER (ORDER BY id) AS s", "sum(id) OVER (PARTITION BY id ORDER BY id) AS t")
    assert len(unpartitioned(w._jdf.queryExecution().optimizedPlan().toString())) == 1


def test_ranking_reads_its_input_once(spark):
    """The input is read when the value counts are staged; the plan left reads
    it once more for the moments only."""
    df = E.queries()["g10_describe_numeric"](spark, SMALL)
    assert _plan(df).split("== Initial Plan ==")[0].count("lineitem.parquet") == 1


def test_pushdown_and_pruning(spark):
    from custlens.operators.clean import outlier_filter
    from custlens.sources.tables import Tables
    c = Tables(spark, SMALL).customer
    df = outlier_filter(c, "c_acctbal", upper=9000).select("c_custkey")
    p = _plan(df)
    assert "PushedFilters: [IsNotNull(c_acctbal), LessThanOrEqual(c_acctbal,9000.0)]" in p
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double>" in p
