"""Distributed order statistics without a global single-partition window.

Everything rank- or quantile-shaped in the library (average ranks, exact
quantiles, qcut edges, medians, 1-D medoids) is built on one structure, the
*ranked value histogram*: one row per distinct value with its multiplicity
``cnt`` and ``below``, the number of non-null rows with a strictly smaller
value.  It is computed as

1. ``groupBy(value).count()`` — partial aggregation collapses hot values
   before the shuffle, so one value holding a third of all rows is one row;
2. one statistics job over it gives the number of distinct values and
   splitters that cut the value range into ranges of about ``RANGE_VALUES``
   distinct values, never fewer than two;
3. per-range totals (one number per range) give each range's offset;
4. a window *partitioned by range* gives the running count inside a range.

No step holds more than one range of distinct values in a task, and the plan
is the same whatever the size.  The value counts are staged once as a table in
the shared folder (the input is read a single time), nothing stays cached.
"""

from __future__ import annotations

import bisect
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import default_parallelism, stage_table


def _not_missing(df: DataFrame, col: str) -> Column:
    c = F.col(col)
    dt = df.schema[col].dataType
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def bucket_expr(value: Column, edges: list) -> Column:
    """Number of ``edges`` strictly below ``value`` as a balanced CASE tree
    (``log2(len(edges))`` comparisons per row, all inside codegen)."""

    def build(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value > F.lit(edges[mid]), build(mid + 1, hi)).otherwise(build(lo, mid))

    return build(0, len(edges))


@dataclass
class RankedHistogram:
    """``df`` has columns ``value, cnt, below``; ``n`` is the number of
    non-null rows, ``n_distinct`` the number of distinct values, ``min_cnt`` /
    ``max_cnt`` the multiplicities of the smallest / largest value."""

    df: DataFrame
    n: int
    n_distinct: int
    min_cnt: int = 0
    max_cnt: int = 0

    def persist(self) -> "RankedHistogram":
        self.df.persist()
        return self

    def unpersist(self) -> None:
        self.df.unpersist()

    def max_average_rank(self, ascending: bool = True) -> float:
        """Largest average rank (of the largest value, or of the smallest when
        ranking descending) without another pass."""
        c = self.max_cnt if ascending else self.min_cnt
        return self.n - (c - 1) / 2.0

    # -- order statistics -------------------------------------------------
    def values_at(self, positions: list[int]) -> dict[int, object]:
        """Value at each 0-based sorted position (bounded list)."""
        uniq = sorted(set(int(p) for p in positions))
        if not uniq:
            return {}
        conds = [(F.col("below") <= p) & (F.col("below") + F.col("cnt") > p) for p in uniq]
        rows = (self.df.where(reduce(lambda a, b: a | b, conds))
                .select("value", "below", "cnt").collect())
        rows.sort(key=lambda r: r["below"])
        starts = [r["below"] for r in rows]
        out = {}
        for p in uniq:
            i = bisect.bisect_right(starts, p) - 1
            out[p] = rows[i]["value"]
        return out

    def quantiles(self, probs: list[float], method: str = "linear") -> list:
        """Exact quantiles.  ``linear`` interpolates between order statistics
        at ``(n-1)p`` (numpy/pandas default, DuckDB ``quantile_cont``);
        ``lower`` returns the order statistic at ``floor((n-1)p)``
        (``percentile_disc``-like lower value)."""
        if self.n == 0:
            return [None for _ in probs]
        pos = []
        for p in probs:
            h = (self.n - 1) * float(p)
            pos += [math.floor(h), math.ceil(h)]
        vals = self.values_at(pos)
        out = []
        for p in probs:
            h = (self.n - 1) * float(p)
            lo, hi = math.floor(h), math.ceil(h)
            vlo, vhi = vals[lo], vals[hi]
            if method == "lower" or lo == hi:
                out.append(vlo)
            else:
                out.append(float(vlo) + (h - lo) * (float(vhi) - float(vlo)))
        return out


#: Distinct values a range should hold, and least number of splitters asked for.
RANGE_VALUES, SPLITTERS = 65_536, 256


def _splitters(hist: DataFrame, accuracy: int):
    """(statistics row, splitters): the number of ranges follows the number of
    distinct values."""
    most = max(SPLITTERS, default_parallelism(hist.sparkSession))
    fracs = [i / most for i in range(1, most)]
    st = hist.agg(F.count(F.lit(1)).alias("d"), F.sum("cnt").alias("n"),
                  F.min_by("cnt", "value").alias("cmin"), F.max_by("cnt", "value").alias("cmax"),
                  F.percentile_approx("value", fracs, accuracy).alias("e")).first()
    ranges = min(most, max(2, -(-int(st["d"] or 0) // RANGE_VALUES)))
    found = st["e"] or []
    picked = [found[-(-i * len(found) // ranges) - 1] for i in range(1, ranges)] if found else []
    return st, sorted(set(v for v in picked if v is not None))


def _running(hist: DataFrame, edges: list) -> DataFrame:
    """``value, cnt, below`` over all rows: the running count inside a range
    plus the range's offset, an array of one number per range."""
    ranged = hist.withColumn("range", bucket_expr(F.col("value"), edges))
    totals = ranged.groupBy("range").agg(F.sum("cnt").alias("t"))
    listed = totals.agg(F.collect_list(F.struct("range", "t")).alias("all"))
    offsets = listed.select(F.transform(
        F.sequence(F.lit(0), F.lit(len(edges))),
        lambda b: F.aggregate(F.filter("all", lambda x: x["range"] < b), F.lit(0).cast("long"),
                              lambda s, x: s + x["t"]))).scalar()
    w = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("cnt").over(w), F.lit(0))
    return ranged.withColumn("below", (inside + F.element_at(offsets, F.col("range") + 1)).cast("long")).drop("range")


def ranked_histogram(df: DataFrame, col: str, accuracy: int = 10000) -> RankedHistogram:
    """Ranked histogram of one column; one statistics job."""
    hist = (df.where(_not_missing(df, col)).groupBy(F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("cnt")))
    hist = stage_table(hist, "values")
    st, edges = _splitters(hist, accuracy)
    return RankedHistogram(_running(hist, edges), int(st["n"] or 0), int(st["d"] or 0), int(st["cmin"] or 0),
                           int(st["cmax"] or 0))


class ValueLookup:
    """Exact lookups in a value histogram for loops on the driver: values at a
    position, rows up to a value.  The driver keeps the splitters with their
    exact row counts and the few ranges that were asked for last; ranges that
    are missing come in one job, and a loop whose lookups stay in ranges it has
    seen needs none."""

    #: Values of a range, most splitters, and most ranges kept.
    RANGE, MOST, KEPT = 4096, 4096, 64

    def __init__(self, df: DataFrame, col: str):
        self.hist = stage_table(
            df.where(_not_missing(df, col)).groupBy(F.col(col).cast("double").alias("value"))
            .agg(F.count(F.lit(1)).alias("cnt")), "values")
        fracs = [i / self.MOST for i in range(1, self.MOST)]
        st = self.hist.agg(F.count(F.lit(1)).alias("d"), F.percentile_approx("value", fracs, 20_000).alias("e")).first()
        ranges = min(self.MOST, max(1, -(-int(st["d"]) // self.RANGE)))
        found = st["e"] or []
        self.edges = sorted(set(found[-(-i * len(found) // ranges) - 1] for i in range(1, ranges)))
        got = (self.hist.groupBy(bucket_expr(F.col("value"), self.edges).alias("r")).agg(F.sum("cnt").alias("t"))
               .collect())                                                            # one row a range
        totals = dict((r["r"], r["t"]) for r in got)
        self.start = [0]
        for r in range(len(self.edges) + 1):
            self.start.append(self.start[-1] + totals.get(r, 0))
        self.n = self.start[-1]
        self.ranges: dict[int, tuple] = {}

    def _load(self, wanted) -> None:
        missing = sorted(set(wanted) - set(self.ranges))
        if missing:
            v = F.col("value")
            parts = []
            for r in missing:
                here = [v > F.lit(self.edges[r - 1])] if r else []
                here += [v <= F.lit(self.edges[r])] if r < len(self.edges) else []
                parts.append(reduce(lambda a, b: a & b, here, F.lit(True)))
            rows = self.hist.where(reduce(lambda a, b: a | b, parts)).toArrow()
            value, cnt = (rows.column(c).to_numpy() for c in ("value", "cnt"))
            order = np.argsort(value)
            value, cnt = value[order], cnt[order]
            at = np.searchsorted(self.edges, value, "left")
            for r in missing:
                mine = at == r
                self.ranges[r] = (value[mine], self.start[r] + np.cumsum(cnt[mine]))
        for r in set(wanted):                                      # the last used are kept
            self.ranges[r] = self.ranges.pop(r)
        while len(self.ranges) > max(self.KEPT, len(set(wanted))):
            self.ranges.pop(next(iter(self.ranges)))

    def rows_up_to(self, values: list[float]) -> list[int]:
        """Rows with a value of at most each of ``values``."""
        at = [bisect.bisect_left(self.edges, v) for v in values]
        self._load(at)
        out = []
        for r, v in zip(at, values):
            value, end = self.ranges[r]
            i = int(np.searchsorted(value, v, "right"))
            out.append(int(end[i - 1]) if i else self.start[r])
        return out

    def values_at(self, positions: list[int]) -> list[float]:
        """Value at each 0-based sorted position."""
        at = [bisect.bisect_right(self.start, p) - 1 for p in positions]
        self._load(at)
        return [float(self.ranges[r][0][np.searchsorted(self.ranges[r][1], p, "right")]) for r, p in zip(at, positions)]


def average_rank_table(h: RankedHistogram, ascending: bool = True) -> DataFrame:
    """``value -> rank`` with ties given the mean of their positions (1-based)."""
    if ascending:
        r = F.col("below") + (F.col("cnt") + F.lit(1)) / F.lit(2.0)
    else:
        r = F.lit(h.n) - F.col("below") - (F.col("cnt") - F.lit(1)) / F.lit(2.0)
    return h.df.select("value", r.alias("rank"))


def grouped_ranked(df: DataFrame, groups: list[str], col: str, accuracy: int = 10000) -> DataFrame:
    """Ranked histogram per group: ``groups..., value, cnt, below, n`` where
    ``below`` counts the group's rows with a smaller value and ``n`` is the
    group's non-null row count.  Windows are partitioned by ``(groups, range)``,
    and offsets come from a window over one row per group and range, so neither
    a hot group nor a hot value lands whole in one task."""
    hist = (df.where(_not_missing(df, col)).groupBy(*[F.col(g) for g in groups], F.col(col).alias("value"))
            .agg(F.count(F.lit(1)).alias("cnt")))
    hist = stage_table(hist, "values")
    st, edges = _splitters(hist, accuracy)
    if not groups:
        return _running(hist, edges).withColumn("n", F.lit(int(st["n"] or 0)).cast("long"))
    key = groups + ["range"]
    ranged = hist.withColumn("range", bucket_expr(F.col("value"), edges))
    wg = Window.partitionBy(*groups)
    totals = (ranged.groupBy(*key).agg(F.sum("cnt").alias("__t"))
              .withColumn("__off", F.coalesce(F.sum("__t").over(
                  wg.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
              .withColumn("n", F.sum("__t").over(wg.rowsBetween(Window.unboundedPreceding,
                                                                 Window.unboundedFollowing)))
              .drop("__t"))
    # null-safe: a null group is a group
    names = {k: f"__{k}" for k in key}
    totals = totals.select(*[F.col(k).alias(names[k]) for k in key], "__off", "n")
    w = Window.partitionBy(*key).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranged.withColumn("__in", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(names[k])) for k in key])
    return (ranked.join(totals, same)
            .select(*groups, "value", "cnt",
                    (F.col("__off") + F.col("__in")).cast("long").alias("below"),
                    F.col("n").cast("long").alias("n")))


def grouped_quantiles(df: DataFrame, groups: list[str], col: str, probs: list[float],
                      names: list[str] | None = None, method: str = "linear") -> DataFrame:
    """Exact per-group quantiles as a DataFrame (nothing collected):
    ``groups..., <name per prob>``.  ``linear`` matches numpy/pandas and
    DuckDB ``quantile_cont``; ``lower`` the lower order statistic."""
    names = names or [f"q{int(round(p * 100))}" for p in probs]
    r = grouped_ranked(df, groups, col)
    aggs = []
    for p, nm in zip(probs, names):
        h = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.floor(h), F.ceil(h)
        at = lambda pos: F.max(F.when((F.col("below") <= pos) & (F.col("below") + F.col("cnt") > pos),
                                      F.col("value").cast("double")))
        aggs += [at(lo).alias(f"__lo_{nm}"), at(hi).alias(f"__hi_{nm}"),
                 F.first(h - lo).alias(f"__fr_{nm}")]
    g = r.groupBy(*groups).agg(*aggs) if groups else r.agg(*aggs)
    outs = []
    for nm in names:
        lo, hi, fr = F.col(f"__lo_{nm}"), F.col(f"__hi_{nm}"), F.col(f"__fr_{nm}")
        outs.append((lo if method == "lower" else lo + fr * (hi - lo)).alias(nm))
    return g.select(*groups, *outs)


def grouped_grid_quantiles(df: DataFrame, groups: list[str], col: str, k: int) -> DataFrame:
    """Exact linear-interpolated quantiles at the evenly spaced probabilities
    ``i / (k - 1)``, ``i = 0..k-1``, per group, in long form
    ``groups..., i, q``.  Each ranked-histogram row works out (integer
    arithmetic) which grid positions it holds and emits only those, so the
    work is O(rows + k) per group — no k-wide aggregate expressions."""
    r = grouped_ranked(df, groups, col)
    lo = F.col("below")
    hi = F.col("below") + F.col("cnt") - 1
    m = F.greatest(F.col("n") - 1, F.lit(1))
    km1 = F.lit(k - 1)

    # positions floor((n-1) i/(k-1)) in [lo, hi]  <=>  i in [ceil(lo(k-1)/m), ceil((hi+1)(k-1)/m) - 1]
    one = F.col("n") == 1   # a single value holds every grid position
    a_lo = F.when(one, F.lit(0)).otherwise(F.floor((lo * km1 + m - 1) / m)).cast("long")
    a_hi = F.when(one, F.lit(k - 1)).otherwise(F.floor(((hi + 1) * km1 + m - 1) / m) - 1).cast("long")
    # positions ceil((n-1) i/(k-1)) in [lo, hi]  <=>  i in [floor((lo-1)(k-1)/m) + 1, floor(hi(k-1)/m)]
    b_lo = F.when(one, F.lit(0)).otherwise(F.floor(((lo - 1) * km1) / m) + 1).cast("long")
    b_hi = F.when(one, F.lit(k - 1)).otherwise(F.floor((hi * km1) / m)).cast("long")
    clamp = lambda c: F.least(F.greatest(c, F.lit(0)), F.lit(k - 1))
    v = F.col("value").cast("double")
    lows = F.when(a_lo <= a_hi, F.transform(F.sequence(clamp(a_lo), clamp(a_hi)),
                                             lambda i: F.struct(i.alias("i"), F.lit(0).alias("side"), v.alias("v"))))
    highs = F.when(b_lo <= b_hi, F.transform(F.sequence(clamp(b_lo), clamp(b_hi)),
                                              lambda i: F.struct(i.alias("i"), F.lit(1).alias("side"), v.alias("v"))))
    both = F.concat(F.coalesce(lows, F.array().cast("array<struct<i:bigint,side:int,v:double>>")),
                    F.coalesce(highs, F.array().cast("array<struct<i:bigint,side:int,v:double>>")))
    ex = r.select(*groups, "n", F.explode(both).alias("e")).select(*groups, "n", "e.i", "e.side", "e.v")
    g = ex.groupBy(*groups, "i").agg(F.first("n").alias("n"),
                                     F.max(F.when(F.col("side") == 0, F.col("v"))).alias("vlo"),
                                     F.max(F.when(F.col("side") == 1, F.col("v"))).alias("vhi"))
    h = (F.col("n") - 1) * F.col("i") / F.lit(float(k - 1))
    fr = h - F.floor(h)
    q = F.when(F.col("n") == 1, F.col("vlo")).otherwise(F.col("vlo") + fr * (F.coalesce("vhi", "vlo") - F.col("vlo")))
    return g.select(*groups, F.col("i").cast("int").alias("i"), q.alias("q"))
