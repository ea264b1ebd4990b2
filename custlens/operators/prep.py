"""Preprocessing estimators (I1-I12): pyspark.ml Estimator/Model pairs whose
fit statistics are single aggregation passes (a few scalars per column come
back) and whose transforms are narrow projections, so a fitted pipeline also
runs on a streaming DataFrame.  Every step leaves the target column alone.

Order of the default pipeline: validate -> zero variance -> impute ->
dummies -> scale -> collinearity -> cluster -> target."""

from __future__ import annotations

import math

import numpy as np

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.special import norm_ppf
from .clean import categorical_columns, datetime_columns, numeric_columns
from .ranking import bucket_expr, grouped_grid_quantiles, grouped_quantiles

NUMERIC_STRATEGIES = ("mean", "median", "most_frequent", "zero", "constant")
CATEGORICAL_STRATEGIES = ("most_frequent", "constant")
SCALERS = ("zscore", "minmax", "yeo-johnson", "quantile")


def minmax_exprs(df: DataFrame, cols: list[str]) -> dict:
    """(x-min)/(max-min); a constant column maps to 0."""
    r = df.agg(*[F.min(c).alias(f"mn_{c}") for c in cols], *[F.max(c).alias(f"mx_{c}") for c in cols]).first()
    out = {}
    for c in cols:
        mn, mx = r[f"mn_{c}"], r[f"mx_{c}"]
        if mn is None or mx is None or mx == mn:
            out[c] = F.when(F.col(c).isNotNull(), F.lit(0.0))
        else:
            out[c] = (F.col(c).cast("double") - F.lit(float(mn))) / F.lit(float(mx) - float(mn))
    return out


class _HasTarget(Params):
    target = Param(Params._dummy(), "target", "target column left untouched", TypeConverters.toString)
    passthrough = Param(Params._dummy(), "passthrough", "columns carried along untouched (row keys)",
                        TypeConverters.toListString)

    def _skip(self) -> set:
        t = self.getOrDefault(self.target) if self.isDefined(self.target) else None
        keep = self.getOrDefault(self.passthrough) if self.isDefined(self.passthrough) else []
        return set(keep) | ({t} if t else set())

    def _features(self, df: DataFrame, kind: str = "numeric") -> list[str]:
        cols = numeric_columns(df) if kind == "numeric" else categorical_columns(df)
        skip = self._skip()
        return [c for c in cols if c not in skip]

    def _with_passthrough(self, passthrough):
        if passthrough:
            self._set(passthrough=list(passthrough))
        return self


class _Fitted(Params):
    state = Param(Params._dummy(), "state", "fitted statistics (JSON-serialisable)")

    def _state(self) -> dict:
        return self.getOrDefault(self.state)


def _model_class(name: str, apply):
    """Build a persistable Model class whose transform is ``apply(self, df)``."""

    class _M(Model, _HasTarget, _Fitted, DefaultParamsReadable, DefaultParamsWritable):
        def __init__(self, state: dict | None = None, target: str | None = None):
            super().__init__()
            self._setDefault(state={})
            if state is not None:
                self._set(state=state)
            if target is not None:
                self._set(target=target)

        def _transform(self, df: DataFrame) -> DataFrame:
            return apply(self, df)

    _M.__name__ = name
    _M.__qualname__ = name
    return _M


# ---------------------------------------------------------------- C8 + I0
def _validation_apply(self, df):
    st = self._state()
    cols = st["columns"]
    t = self.getOrDefault(self.target) if self.isDefined(self.target) else None
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise TypeError(f"test data does not have column(s) {missing}")
    extra = st.get("passthrough", [])
    keep = cols + [c for c in extra + ([t] if t else []) if c in df.columns and c not in cols]
    out = df.select(*keep)
    floats = [c for c in st["floats"] if c in keep]
    return out.withColumns({c: F.when(F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf"))), F.lit(None))
                            .otherwise(F.col(c)) for c in floats})


ValidationModel = _model_class("ValidationModel", _validation_apply)


class Validation(Estimator, _HasTarget, DefaultParamsReadable, DefaultParamsWritable):
    """Remembers the training columns (datetime columns and duplicate names
    dropped); at transform time requires them, drops extras and turns
    NaN/inf into NULL."""

    @keyword_only
    def __init__(self, target: str | None = None):
        super().__init__()
        if target is not None:
            self._set(target=target)

    def _fit(self, df: DataFrame):
        t = self.getOrDefault(self.target) if self.isDefined(self.target) else None
        dt = set(datetime_columns(df))
        skip = self._skip()
        seen, cols = set(), []
        for c in df.columns:
            if c in seen or c in dt or c in skip:
                continue
            seen.add(c)
            cols.append(c)
        floats = [f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")]
        keep = self.getOrDefault(self.passthrough) if self.isDefined(self.passthrough) else []
        return ValidationModel({"columns": cols, "floats": floats, "passthrough": list(keep)}, t)


# ---------------------------------------------------------------- C9
def _drop_apply(self, df):
    return df.drop(*[c for c in self._state()["drop"] if c in df.columns])


ZeroVarianceModel = _model_class("ZeroVarianceModel", _drop_apply)


class ZeroVariance(Estimator, _HasTarget, DefaultParamsReadable, DefaultParamsWritable):
    """Drops numeric features whose sample standard deviation is exactly 0."""

    @keyword_only
    def __init__(self, target: str | None = None):
        super().__init__()
        if target is not None:
            self._set(target=target)

    def _fit(self, df):
        cols = self._features(df)
        drop = []
        if cols:
            r = df.agg(*[F.stddev_samp(F.col(c).cast("double")).alias(c) for c in cols]).first()
            drop = [c for c in cols if r[c] is not None and r[c] == 0.0]
        return ZeroVarianceModel({"drop": drop}, self.getOrDefault(self.target) if self.isDefined(self.target) else None)


# ---------------------------------------------------------------- I1 / I2
def _impute_apply(self, df):
    fills, widen = self._state()["fills"], self._state().get("widen", [])
    out = {}
    for c, v in fills.items():
        if c in df.columns and v is not None:
            # a mean or median of integers need not be one
            kind = "double" if c in widen else df.schema[c].dataType
            out[c] = F.coalesce(F.col(c).cast(kind), F.lit(v).cast(kind))
    return df.withColumns(out) if out else df


ImputationModel = _model_class("ImputationModel", _impute_apply)


def column_modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent value per column (smallest on ties), one grouped pass."""
    if not cols:
        return {}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], cols, "column", "v") \
             .where(F.col("v").isNotNull())
    per = long.groupBy("column", "v").agg(F.count(F.lit(1)).alias("c"))
    rows = per.groupBy("column").agg(F.min_by("v", F.struct(-F.col("c"), F.col("v"))).alias("top")).collect()
    return {r["column"]: r["top"] for r in rows}


class Imputation(Estimator, _HasTarget, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric NULLs -> mean (default) / exact median / mode / 0 / constant;
    string NULLs -> mode (smallest on ties) or a constant (``others``)."""

    num_strategy = Param(Params._dummy(), "num_strategy", "numeric strategy", TypeConverters.toString)
    cat_strategy = Param(Params._dummy(), "cat_strategy", "categorical strategy", TypeConverters.toString)
    num_fill = Param(Params._dummy(), "num_fill", "numeric constant", TypeConverters.toFloat)
    cat_fill = Param(Params._dummy(), "cat_fill", "categorical constant", TypeConverters.toString)

    @keyword_only
    def __init__(self, target: str | None = None, num_strategy: str = "mean", cat_strategy: str = "most_frequent",
                 num_fill: float = 0.0, cat_fill: str = "others"):
        super().__init__()
        if num_strategy not in NUMERIC_STRATEGIES:
            raise ValueError(f"numeric imputation strategy {num_strategy!r} not in {NUMERIC_STRATEGIES}")
        if cat_strategy not in CATEGORICAL_STRATEGIES:
            raise ValueError(f"categorical imputation strategy {cat_strategy!r} not in {CATEGORICAL_STRATEGIES}")
        self._set(num_strategy=num_strategy, cat_strategy=cat_strategy, num_fill=num_fill, cat_fill=cat_fill)
        if target is not None:
            self._set(target=target)

    def _fit(self, df):
        num, cat = self._features(df, "numeric"), self._features(df, "categorical")
        ns, cs = self.getOrDefault(self.num_strategy), self.getOrDefault(self.cat_strategy)
        fills = {}
        if num:
            if ns == "mean":
                r = df.agg(*[F.avg(c).alias(c) for c in num]).first()
                fills.update({c: r[c] for c in num})
            elif ns == "median":
                long = df.select(*[F.col(c).cast("double").alias(c) for c in num]).unpivot([], num, "column", "v")
                q = grouped_quantiles(long, ["column"], "v", [0.5], ["med"]).collect()
                fills.update({r["column"]: r["med"] for r in q})
            elif ns == "most_frequent":
                modes = column_modes(df, num)
                fills.update({c: (float(modes[c]) if modes.get(c) is not None else None) for c in num})
            elif ns == "zero":
                fills.update({c: 0.0 for c in num})
            else:
                fills.update({c: float(self.getOrDefault(self.num_fill)) for c in num})
        if cat:
            if cs == "most_frequent":
                fills.update(column_modes(df, cat))
            else:
                fills.update({c: self.getOrDefault(self.cat_fill) for c in cat})
        t = self.getOrDefault(self.target) if self.isDefined(self.target) else None
        return ImputationModel({"fills": fills, "widen": num if ns in ("mean", "median") else []}, t)


# ---------------------------------------------------------------- I3 / C10
def _dummies_apply(self, df):
    st = self._state()
    out = df.drop(*[c for c in st["drop"] if c in df.columns])
    new = {}
    for c, values in st["levels"].items():
        for v in values:
            new[f"{c}_{v}"] = F.when(F.col(c) == F.lit(v), F.lit(1.0)).otherwise(F.lit(0.0)).cast("float")
    out = out.withColumns(new) if new else out
    return out.drop(*[c for c in st["levels"] if c in out.columns])


CatDummiesModel = _model_class("CatDummiesModel", _dummies_apply)


class CatDummies(Estimator, _HasTarget, DefaultParamsReadable, DefaultParamsWritable):
    """One-hot encoding into named float columns ``<col>_<value>``; values
    unseen at fit time encode as all zeros.  String columns with as many
    distinct values as rows (identifiers) are dropped.  ``max_levels`` guards
    against encoding a high-cardinality column by mistake (raises)."""

    max_levels = Param(Params._dummy(), "max_levels", "max distinct values per column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, target: str | None = None, max_levels: int = 1000):
        super().__init__()
        self._set(max_levels=max_levels)
        if target is not None:
            self._set(target=target)

    def _fit(self, df):
        cat = self._features(df, "categorical")
        t = self.getOrDefault(self.target) if self.isDefined(self.target) else None
        if not cat:
            return CatDummiesModel({"levels": {}, "drop": []}, t)
        from .clean import unique_valued_columns
        drop = unique_valued_columns(df, cat)
        keep = [c for c in cat if c not in drop]
        cap = self.getOrDefault(self.max_levels)
        if keep:   # sketch-based guard; the exact level lists below are then bounded
            est = df.agg(*[F.approx_count_distinct(c, 0.01).alias(c) for c in keep]).first()
            too_many = [c for c in keep if est[c] > cap * 1.05]
            if too_many:
                raise ValueError(f"columns {too_many} have more than {cap} levels; raise max_levels to encode them")
        levels = {c: [] for c in keep}
        if keep:
            long = df.select(*keep).unpivot([], keep, "column", "v").where(F.col("v").isNotNull()).distinct()
            for row in long.collect():   # bounded: at most max_levels per column
                levels[row["column"]].append(row["v"])
        levels = {c: sorted(v) for c, v in levels.items()}
        return CatDummiesModel({"levels": levels, "drop": drop}, t)


# ---------------------------------------------------------------- I4-I7
def _scale_apply(self, df):
    st = self._state()
    method = st["method"]
    out = {}
    for c, p in st["params"].items():
        if c not in df.columns:
            continue
        x = F.col(c).cast("double")
        if method == "zscore":
            out[c] = F.lit(0.0) * x if not p["s"] else (x - F.lit(p["m"])) / F.lit(p["s"])
        elif method == "minmax":
            rng = p["mx"] - p["mn"] if p["mx"] is not None and p["mn"] is not None else 0.0
            out[c] = F.lit(0.0) * x if not rng else (x - F.lit(p["mn"])) / F.lit(rng)
        elif method == "yeo-johnson":
            y = yeo_johnson_expr(x, p["lmbda"])
            out[c] = F.lit(0.0) * x if not p["s"] else (y - F.lit(p["m"])) / F.lit(p["s"])
        else:  # quantile -> normal
            out[c] = quantile_normal_expr(x, p["q"], p["probs"])
    return df.withColumns(out) if out else df


ScaleModel = _model_class("ScaleModel", _scale_apply)


def yeo_johnson_expr(x, lmbda: float):
    pos = x >= 0
    if abs(lmbda) < 1e-12:
        yp = F.log1p(x)
    else:
        yp = (F.pow(x + 1, F.lit(lmbda)) - 1) / F.lit(lmbda)
    if abs(lmbda - 2) < 1e-12:
        yn = -F.log1p(-x)
    else:
        yn = -(F.pow(-x + 1, F.lit(2 - lmbda)) - 1) / F.lit(2 - lmbda)
    return F.when(pos, yp).otherwise(yn)


def _power(k: np.ndarray, u: np.ndarray, shift: float):
    """``h = (e^(ku) - 1) / k`` and its derivative by k, both times ``e^-shift``;
    near k u = 0 by their series."""
    t = k * u
    small = np.abs(t) < 1e-3
    kk = np.where(k == 0, 1.0, k)
    low = np.exp(-shift)
    up = np.exp(t - shift)
    h = np.where(small, u * (1 + t / 2 * (1 + t / 3 * (1 + t / 4))) * low, (up - low) / kk)
    d = np.where(small, u * u * (0.5 + t / 3 * (1 + 3 * t / 8 * (1 + 4 * t / 15))) * low, (u * up - h) / kk)
    return h, d


def _yj_sums(cols: int, lambdas: np.ndarray, centre: np.ndarray, top: np.ndarray):
    """Per column and candidate: n, and sums of y, y', y^2, y y' about a pilot
    value; y is scaled by the largest power, so no candidate overflows."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros((cols, lambdas.shape[1], 5))
        for batch in batches:
            for c in range(cols):
                x = batch.column(c).drop_null().to_numpy(zero_copy_only=False)
                x = np.append(x[np.isfinite(x)], centre[c])
                u, neg = np.log1p(np.abs(x)), x < 0
                for j, lam in enumerate(lambdas[c]):
                    shift = max(lam * top[c, 0], (2 - lam) * top[c, 1], 0.0)
                    k = np.where(neg, 2 - lam, lam)
                    h, d = _power(k, u, shift)
                    y = np.where(neg, -h, h)
                    y, d = y[:-1] - y[-1], d[:-1] - d[-1]
                    total[c, j] += len(y), y.sum(), d.sum(), y @ y, y @ d
        c, j = np.indices(lambdas.shape)
        yield pa.RecordBatch.from_arrays([pa.array(c.ravel()), pa.array(j.ravel())] + [
            pa.array(total[..., i].ravel()) for i in range(5)], ["c", "j", "n", "y", "d", "yy", "yd"])
    return run


def yeo_johnson_lambdas(df: DataFrame, cols: list[str], points: int = 12, tol: float = 1e-9,
                        reach: float = 1024.0) -> dict[str, float]:
    """Maximum-likelihood lambda per column: the root of the derivative of the
    profile log-likelihood, ``J - n/2 var'/var``.  Every round is one job that
    evaluates ``points`` candidates of every column; brackets grow until the
    derivative changes its sign from plus to minus, then shrink around that
    change.  There is no grid and no clamp; a column without spread, or whose
    likelihood has no inner maximum within ``reach``, gets 1."""
    d = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)])
    d = d.select(*[F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) for c in d.columns])
    aggs = []
    for c in d.columns:
        x = F.col(c)
        aggs += [F.count(x), F.avg(x), F.min(x), F.max(x), F.sum(F.signum(x) * F.log1p(F.abs(x)))]
    r = d.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first()
    st = [r[i * 5:i * 5 + 5] for i in range(len(cols))]
    live = [i for i, (n, _, lo, hi, _) in enumerate(st) if n and lo < hi]
    out = {c: 1.0 for c in cols}
    if not live:
        return out
    d = d.select(*[f"c{i}" for i in live])
    centre = np.array([st[i][1] for i in live])
    top = np.array([[math.log1p(max(st[i][3], 0.0)), math.log1p(max(-st[i][2], 0.0))] for i in live])
    jac = np.array([st[i][4] / st[i][0] for i in live])
    low, high = np.full(len(live), -2.0), np.full(len(live), 4.0)
    found, lost = np.zeros(len(live), bool), np.zeros(len(live), bool)
    while True:
        open_ = ~lost & (~found | (high - low > tol * np.maximum(1.0, np.abs(low))))
        if not open_.any():
            break
        grid = np.linspace(low, high, points, axis=1)
        sums = np.zeros(grid.shape + (5,))
        got = (d.mapInArrow(_yj_sums(len(live), grid, centre, top),
                            "c long, j long, n double, y double, d double, yy double, yd double")
               .groupBy("c", "j").agg(*[F.sum(x).alias(x) for x in ("n", "y", "d", "yy", "yd")]).collect())
        for g in got:
            sums[g["c"], g["j"]] = g["n"], g["y"], g["d"], g["yy"], g["yd"]
        n, y, dy, yy, yd = np.moveaxis(sums, 2, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            slope = jac[:, None] - (yd / n - y / n * dy / n) / (yy / n - (y / n) ** 2)
        for i in np.flatnonzero(open_):
            down = np.flatnonzero((slope[i, :-1] >= 0) & (slope[i, 1:] < 0))
            if len(down):
                found[i] = True
                low[i], high[i] = grid[i, down[0]], grid[i, down[0] + 1]
                if high[i] <= np.nextafter(low[i], np.inf):
                    lost[i] = True
            elif found[i]:
                lost[i] = True                     # rounding hides the change: the bracket is as small as it gets
            elif high[i] - low[i] > 2 * reach:
                lost[i] = True
            else:                                  # towards the side on which the likelihood rises
                width = high[i] - low[i]
                low[i], high[i] = (high[i] - width / points, high[i] + 2 * width) if slope[i, -1] >= 0 else \
                    (low[i] - 2 * width, low[i] + width / points)
    for k, i in enumerate(live):
        if found[k]:
            out[cols[i]] = float((low[k] + high[k]) / 2)
    return out


def quantile_normal_expr(x, q: list[float], probs: list[float]):
    """Piecewise-linear map through the fitted quantiles to [0, 1], clipped,
    then the normal quantile function."""
    from ..functions.special import let
    if not q:
        return F.lit(None).cast("double")
    qa = F.array(*[F.lit(float(v)) for v in q])
    pa = F.array(*[F.lit(float(v)) for v in probs])

    def at(xv):
        def seg(i):  # i = number of quantile points strictly below x
            lo_i = F.greatest(i, F.lit(1))
            hi_i = F.least(i + 1, F.lit(len(q)))
            ql, qh = F.element_at(qa, lo_i), F.element_at(qa, hi_i)
            pl, ph = F.element_at(pa, lo_i), F.element_at(pa, hi_i)
            return F.when(qh == ql, ph).otherwise(pl + (xv - ql) * (ph - pl) / (qh - ql))
        p = F.when(xv <= F.lit(q[0]), F.lit(probs[0])).when(xv >= F.lit(q[-1]), F.lit(probs[-1])) \
             .otherwise(let(bucket_expr(xv, q), seg))
        eps = 1e-7
        return norm_ppf(F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps)))
    return let(x, at)


class ScaleTransformer(Estimator, _HasTarget, DefaultParamsReadable, DefaultParamsWritable):
    """Numeric feature scaling: ``zscore`` (population std, zero std -> 0),
    ``minmax`` (constant -> 0), ``yeo-johnson`` (maximum-likelihood lambda per
    column, all columns' brackets moved in one job a round, then standardised) or ``quantile`` (up to ``n_quantiles`` exact quantiles,
    mapped to a standard normal)."""

    method = Param(Params._dummy(), "method", "scaling method", TypeConverters.toString)
    n_quantiles = Param(Params._dummy(), "n_quantiles", "quantiles for 'quantile'", TypeConverters.toInt)

    @keyword_only
    def __init__(self, target: str | None = None, method: str = "zscore", n_quantiles: int = 1000):
        super().__init__()
        if method not in SCALERS:
            raise ValueError(f"scaler {method!r} not in {SCALERS}")
        self._set(method=method, n_quantiles=n_quantiles)
        if target is not None:
            self._set(target=target)

    def _fit(self, df):
        cols = self._features(df)
        method = self.getOrDefault(self.method)
        t = self.getOrDefault(self.target) if self.isDefined(self.target) else None
        params = {}
        if cols and method == "zscore":
            r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
            params = {c: {"m": r[f"m_{c}"], "s": r[f"s_{c}"]} for c in cols}
        elif cols and method == "minmax":
            r = df.agg(*[F.min(c).alias(f"a_{c}") for c in cols], *[F.max(c).alias(f"b_{c}") for c in cols]).first()
            params = {c: {"mn": _f(r[f"a_{c}"]), "mx": _f(r[f"b_{c}"])} for c in cols}
        elif cols and method == "yeo-johnson":
            lm = yeo_johnson_lambdas(df, cols)
            r3 = df.agg(*[F.avg(yeo_johnson_expr(F.col(c).cast("double"), lm[c])).alias(f"m_{c}") for c in cols],
                        *[F.stddev_pop(yeo_johnson_expr(F.col(c).cast("double"), lm[c])).alias(f"s_{c}") for c in cols]).first()
            params = {c: {"lmbda": lm[c], "m": r3[f"m_{c}"], "s": r3[f"s_{c}"]} for c in cols}
        elif cols:
            n = df.count()
            k = max(2, min(self.getOrDefault(self.n_quantiles), n))
            probs = [i / (k - 1) for i in range(k)]
            long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "v")
            qs: dict = {c: [None] * k for c in cols}
            for r in grouped_grid_quantiles(long, ["column"], "v", k).collect():   # k values per column
                qs[r["column"]][r["i"]] = r["q"]
            for c, q in qs.items():
                if all(v is not None for v in q):
                    params[c] = {"q": q, "probs": probs}
        return ScaleModel({"method": method, "params": params}, t)


def _f(v):
    return None if v is None else float(v)


# ---------------------------------------------------------------- I8
PerfectCollinearityModel = _model_class("PerfectCollinearityModel", _drop_apply)


class PerfectCollinearity(Estimator, _HasTarget, DefaultParamsReadable, DefaultParamsWritable):
    """Drops one column of every numeric pair whose |corr| rounds to 1.00
    (the earlier column in schema order); a no-op with two or fewer columns."""

    @keyword_only
    def __init__(self, target: str | None = None):
        super().__init__()
        if target is not None:
            self._set(target=target)

    def _fit(self, df):
        from .reports import correlation_matrix
        cols = self._features(df)
        t = self.getOrDefault(self.target) if self.isDefined(self.target) else None
        if len(cols) <= 2:
            return PerfectCollinearityModel({"drop": []}, t)
        order = {c: i for i, c in enumerate(cols)}
        rows = correlation_matrix(df, cols).where(F.col("a") != F.col("b")).collect()  # k^2 numbers
        drop = []
        for r in sorted(rows, key=lambda r: (order[r["a"]], order[r["b"]])):
            if r["corr"] is None or order[r["a"]] > order[r["b"]]:
                continue
            if round(abs(r["corr"]), 2) == 1.0 and r["a"] not in drop and r["b"] not in drop:
                drop.append(r["a"])
        return PerfectCollinearityModel({"drop": drop}, t)


# ---------------------------------------------------------------- E15
def _cluster_apply(self, df):
    from pyspark.ml.clustering import KMeansModel
    from pyspark.ml.feature import VectorAssembler
    st = self._state()
    if not st.get("centers"):
        return df
    cols = st["cols"]
    centers = st["centers"]
    # nearest centre as a column expression (k small): no model object needed
    best = None
    for i, cen in enumerate(centers):
        d = sum(((F.col(c).cast("double") - F.lit(v)) ** 2 for c, v in zip(cols, cen)), F.lit(0.0))
        best = F.struct(d.alias("d"), F.lit(i).alias("i")) if best is None else \
            F.least(best, F.struct(d.alias("d"), F.lit(i).alias("i")))
    del KMeansModel, VectorAssembler
    return df.withColumn("cluster_label", best["i"])


ClusterDataModel = _model_class("ClusterDataModel", _cluster_apply)


class ClusterData(Estimator, _HasTarget, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``cluster_label`` from k-means over the numeric features."""

    k = Param(Params._dummy(), "k", "clusters", TypeConverters.toInt)
    seed = Param(Params._dummy(), "seed", "seed", TypeConverters.toInt)

    @keyword_only
    def __init__(self, target: str | None = None, k: int = 5, seed: int = 42):
        super().__init__()
        self._set(k=k, seed=seed)
        if target is not None:
            self._set(target=target)

    def _fit(self, df):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler
        cols = self._features(df)
        t = self.getOrDefault(self.target) if self.isDefined(self.target) else None
        if not cols:
            return ClusterDataModel({"cols": [], "centers": []}, t)
        feats = VectorAssembler(inputCols=cols, outputCol="__f", handleInvalid="skip").transform(df)
        km = KMeans(k=self.getOrDefault(self.k), seed=self.getOrDefault(self.seed), featuresCol="__f").fit(feats)
        centers = [[float(v) for v in c] for c in km.clusterCenters()]
        return ClusterDataModel({"cols": cols, "centers": centers}, t)


# ---------------------------------------------------------------- I9-I11
def _target_apply(self, df):
    st = self._state()
    t = self.getOrDefault(self.target)
    if t not in df.columns:
        return df
    out = df.where(F.col(t).isNotNull())
    if st["ml_type"] == "classification":
        labels = st["labels"]
        m = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(v), F.lit(float(i)))])
        out = out.withColumn(t, F.element_at(m, F.col(t).cast("string")))
    return out


TargetTreatModel = _model_class("TargetTreatModel", _target_apply)


class TargetTreat(Estimator, _HasTarget, DefaultParamsReadable, DefaultParamsWritable):
    """Drops rows without a target; for classification encodes the sorted
    distinct labels as 0..k-1 (the list is kept for the inverse map)."""

    ml_type = Param(Params._dummy(), "ml_type", "classification or regression", TypeConverters.toString)

    @keyword_only
    def __init__(self, target: str | None = None, ml_type: str = "classification"):
        super().__init__()
        self._set(ml_type=ml_type)
        if target is not None:
            self._set(target=target)

    def _fit(self, df):
        t = self.getOrDefault(self.target)
        mt = self.getOrDefault(self.ml_type)
        labels = []
        if mt == "classification":
            labels = sorted(r[0] for r in df.select(F.col(t).cast("string")).where(F.col(t).isNotNull())
                            .distinct().collect())   # class labels: bounded
        return TargetTreatModel({"ml_type": mt, "labels": labels}, t)


def inverse_label(df: DataFrame, labels: list[str], col: str = "prediction", out: str | None = None) -> DataFrame:
    """Class index -> original label (applied once)."""
    m = F.create_map(*[x for i, v in enumerate(labels) for x in (F.lit(float(i)), F.lit(v))])
    return df.withColumn(out or col, F.element_at(m, F.col(col).cast("double")))


# ---------------------------------------------------------------- I12
PIPELINE_OPTIONS = ("numeric_imputation_strategy", "categorical_imputation_strategy", "scaler",
                    "cluster", "collinearity", "zero_variance", "n_clusters", "passthrough")


def preprocess_pipeline(ml_type: str, target: str, **options) -> Pipeline:
    """Default preprocessing pipeline; unknown options raise ``ValueError``.
    The numeric imputation option is honoured."""
    unknown = [k for k in options if k not in PIPELINE_OPTIONS]
    if unknown:
        raise ValueError(f"unknown preprocessing option(s) {unknown}; allowed {PIPELINE_OPTIONS}")
    if ml_type not in ("classification", "regression"):
        raise ValueError("ml_type must be classification or regression")
    scaler = options.get("scaler", "minmax" if ml_type == "classification" else "zscore")
    stages = [Validation(target=target)]
    if options.get("zero_variance", True):
        stages.append(ZeroVariance(target=target))
    stages.append(Imputation(target=target, num_strategy=options.get("numeric_imputation_strategy", "mean"),
                             cat_strategy=options.get("categorical_imputation_strategy", "most_frequent")))
    stages.append(CatDummies(target=target))
    stages.append(ScaleTransformer(target=target, method=scaler))
    if options.get("collinearity", True):
        stages.append(PerfectCollinearity(target=target))
    if options.get("cluster", True):
        stages.append(ClusterData(target=target, k=options.get("n_clusters", 5)))
    stages.append(TargetTreat(target=target, ml_type=ml_type))
    keep = options.get("passthrough") or []
    for st in stages:
        st._with_passthrough(keep)
    return Pipeline(stages=stages)
