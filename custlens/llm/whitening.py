"""Embedding whitening by a weighted multiplicity covariance.

Entries become integers, ``x = floor(64 * c) + 1000000``, and identical
x-vectors are grouped: a group enters the fit once, weighted by its count
(``weights="counts"``, the fit list is all vectors) or by one
(``weights="one"``, the fit list is the distinct x-vectors).  Sums are exact
integers.  The covariance is a weighted product of centred blocks, one matrix
per task, added row by row; its eigenvectors are the components.  Each distinct
x-vector is whitened once and joined back to its rows.

Groups of more than 1 / HOT_SHARE of the rows are fewer than HOT_SHARE, so
they alone are broadcast; all others meet their rows by a shuffle.  The driver
holds the covariance, dimensions squared, and nothing that grows with the rows.

Defined cases: vectors that are null, or hold null or non-finite entries, are
dropped; vectors of different length are spaces of their own, each with its own
fit, and empty vectors have no component; repeated rows and tied vectors count
each; an x beyond +-2^53 is held at that bound; a component without variance
(eigenvalue below 1e-12 of the largest) has a null ``whitened`` and does not
enter ``identity_error``, which is null if no component has variance;
``deviation`` is null where it needs more than 38 digits; an empty table gives
an empty result; a null id is kept; extra columns are not touched.  Texts do
not occur.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import write_table

#: Groups of more rows than n / HOT_SHARE are broadcast: fewer than HOT_SHARE.
HOT_SHARE = 1000
#: Components with a smaller share of the largest eigenvalue have no variance.
RANK = 1e-12
BOUND = float(2 ** 53)


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that remain."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = F.transform(v, lambda c: F.floor(F.greatest(F.least(c.cast("double") * 64.0, F.lit(BOUND)), F.lit(-BOUND)))
                    .cast("long") + F.lit(1_000_000))
    return vectors.where(fine).select(F.col(id_col).alias("vec_id"), x.alias("x"))


def _matrix(column, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _sums(groups: DataFrame, d: int, n: int, top: int) -> list[int]:
    """Exact weighted sums per dimension."""
    wide = n * top >= 2 ** 62
    kind = "decimal(38,0)" if wide else "long"
    x = lambda j: F.col("x")[j].cast("decimal(19,0)") * F.col("w").cast("decimal(18,0)") if wide \
        else F.col("x")[j] * F.col("w")
    return [int(s) for s in groups.agg(*[F.sum(x(j)).cast(kind).alias(f"s{j}") for j in range(d)]).first()]


def _centred(x: np.ndarray, base: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """x - S / n, where S = base * n + rest: integers are subtracted first."""
    return (x - base) - rest / n


def _gram(rows: DataFrame, d: int, centre, weight: str, column: str) -> np.ndarray:
    """Weighted sum of outer products of ``centre(block)``: one matrix per
    task, its rows added by Spark."""
    def run(batches):
        import pyarrow as pa
        total = np.zeros((d, d))
        for batch in batches:
            if batch.num_rows:
                y = centre(_matrix(batch.column(1), d))
                total += (y * batch.column(0).to_numpy()[:, None].astype(float)).T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(list(total), pa.list_(pa.float64()))],
                                         ["i", "v"])
    parts = rows.select(weight, column).mapInArrow(run, "i long, v array<double>")
    out = np.zeros((d, d))
    for r in parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(d)]).alias("v")).collect():
        out[r["i"]] = r["v"]                                                # d rows
    return out


def _deviation(x: np.ndarray, base: np.ndarray, rest: np.ndarray, n: int) -> list:
    """Exact sum over dimensions of (n * x - S)^2."""
    y = x - base
    if x.shape[1] * (float(np.abs(y).max(initial=0)) * n + n) ** 2 < 2.0 ** 62:
        return ((y * n - rest) ** 2).sum(axis=1).tolist()
    y = y.astype(object) * n - rest.astype(object)
    out = (y * y).sum(axis=1).tolist()
    return [s if s < 10 ** 38 else None for s in out]


def _whiten(groups: DataFrame, d: int, n: int, base, rest, scale: np.ndarray, live: int) -> DataFrame:
    """One whitened vector per distinct x-vector."""
    def run(batches):
        import decimal

        import pyarrow as pa
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0), d)
            z = _centred(x, base, rest, n) @ scale
            dev = [None if s is None else decimal.Decimal(s) for s in _deviation(x, base, rest, n)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(dev, pa.decimal128(38, 0)),
                 pa.array(list(z), pa.list_(pa.float64()))], ["x", "m", "w", "deviation", "z"])
    return groups.select("x", "m", "w").mapInArrow(
        run, "x array<bigint>, m long, w long, deviation decimal(38,0), z array<double>")


def fit(groups: DataFrame, d: int, n: int, top: int):
    """(base, rest, eigenvalues, unit eigenvectors as columns) of one length;
    the weighted sums are ``base * n + rest``."""
    base, rest = zip(*(divmod(s, n) for s in _sums(groups, d, n, top)))
    base, rest = np.array(base, np.int64), np.array(rest, np.int64)
    cov = _gram(groups, d, lambda x: _centred(x, base, rest, n), "w", "x") / n
    e, u = np.linalg.eigh((cov + cov.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(d)] < 0, -1.0, 1.0)
    return base, rest, np.maximum(e, 0.0), u


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 32,
           weights: str = "counts") -> DataFrame:
    """Per remaining row and component: vec_id, component, n (fit weight),
    deviation decimal(38,0), whitened, explained, identity_error."""
    if weights not in ("counts", "one"):
        raise ValueError("weights are 'counts' or 'one'")
    rows = integers(vectors, id_col, vector_col)
    groups = rows.groupBy("x").agg(F.count(F.lit(1)).alias("m"))
    groups = write_table(groups.withColumn("w", F.col("m") if weights == "counts" else F.lit(1).cast("long")),
                         "groups")
    out = None
    lengths = groups.groupBy(F.size("x").alias("d")).agg(
        F.sum("w").alias("n"), F.sum("m").alias("rows"),
        F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))).alias("top"))
    for r in lengths.orderBy("d").collect():                # as many as there are lengths of a vector
        d, n = r["d"], r["n"]
        if not d:
            continue
        mine = groups.where(F.size("x") == d)
        base, rest, e, u = fit(mine, d, n, r["top"])
        k = min(components, d)
        live = int((e[:k] > RANK * e[0]).sum())
        white = write_table(_whiten(mine, d, n, base, rest, u[:, :live] / np.sqrt(e[:live]), live), "white")
        error = None
        if live:
            mean = np.array(white.agg(*[F.sum(F.col("z")[j] * F.col("w")) for j in range(live)]).first()) / n
            error = float(np.abs(_gram(white, live, lambda z: z - mean, "w", "z") / n - np.eye(live)).max())
        trace = float(e.sum())
        share = [float(v) / trace if trace > 0 else None for v in e[:k]]
        values = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.struct(
            j.cast("int").alias("component"), F.get(F.col("z"), j - 1).alias("whitened"),
            F.get(F.array(*[F.lit(s).cast("double") for s in share]), j - 1).alias("explained")))
        # rows meet their x-vector: the few large groups by broadcast, the others by a shuffle
        white = white.select("x", "m", "deviation", "z")
        hot = white.where(F.col("m") * HOT_SHARE > r["rows"])
        of_length = rows.where(F.size("x") == d)
        met = of_length.join(F.broadcast(hot), "x", "left")
        ready = met.where(F.col("m").isNotNull()).select("vec_id", "deviation", "z")
        other = (met.where(F.col("m").isNull()).select("vec_id", "x")
                 .join(white.where(F.col("m") * HOT_SHARE <= r["rows"]), "x").select("vec_id", "deviation", "z"))
        part = (ready.unionByName(other).select("vec_id", "deviation", F.explode(values).alias("c"))
                .select("vec_id", "c.component", F.lit(n).cast("long").alias("n"), "deviation", "c.whitened",
                        "c.explained", F.lit(error).cast("double").alias("identity_error")))
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.where("false").select(
            "vec_id", F.lit(0).alias("component"), F.lit(0).cast("long").alias("n"),
            F.lit(0).cast("decimal(38,0)").alias("deviation"), F.lit(0.0).alias("whitened"),
            F.lit(0.0).alias("explained"), F.lit(0.0).alias("identity_error"))
    return out
