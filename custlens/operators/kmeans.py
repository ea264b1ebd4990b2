"""k-means with many starts, all advanced in one pass over the data.

Starts are k-means++ draws on a bounded hash sample of the rows.  The rows
are staged once with neighbouring rows close to each other.  A round is one job:
every task assigns its rows to the centres of all starts that still move, runs
of close rows as a whole where one centre is nearest to all of them, and hands
on sums per start and cluster; the next centres come from ``groupBy(start,
cluster)``.  A start is done when its centres stay.  The driver
holds centres and sums (starts x clusters x columns), never rows."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage_table
from .kdtree import Cells, tree_order

#: Rows of the sample that starts are drawn from.
SAMPLE_ROWS = 4096
#: Rows handled at once inside a task, least rows of a run, runs measured at once.
TILE, RUN_ROWS, NODES = 65536, 32, 512
#: Rows of a staged partition.
PART_ROWS = 1 << 18


@dataclass
class Clustering:
    """Best of the starts for one k: centres, within-cluster sum of squares,
    rounds of the longest start, whether all starts settled, and every start's cost."""

    k: int
    centers: np.ndarray
    cost: float
    rounds: int
    converged: bool
    costs: list[float]


def _plus_plus(x: np.ndarray, k: int, rng) -> np.ndarray:
    centers = [x[rng.integers(len(x))]]
    near = np.square(x - centers[0]).sum(axis=1)
    while len(centers) < k:
        total = near.sum()
        at = rng.choice(len(x), p=near / total) if total > 0 else rng.integers(len(x))
        centers.append(x[at])
        near = np.minimum(near, np.square(x - x[at]).sum(axis=1))
    return np.array(centers)


def _run_rows(n: int) -> int:
    """Rows of a run: longer ones, by the fourth root, as rows lie closer."""
    return int(RUN_ROWS * max(1.0, n / 500_000) ** 0.25)


def _in_order(cells: Cells, run_rows: int):
    """Rows of a partition in the order of a tree, so that neighbouring rows lie close."""
    def run(batches):
        import pyarrow as pa
        for x in _tiles(batches, cells.low.shape[1]):
            x = x[tree_order(x, run_rows)[0]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in x.T], [f"c{i}" for i in range(x.shape[1])])
    return run


def _tiles(batches, d: int):
    """The first ``d`` columns as matrices of about ``TILE`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[:d]]))
        n += len(held[-1])
        if n >= TILE:
            yield np.vstack(held)
            held, n = [], 0
    if n:
        yield np.vstack(held)


def _laid_out(x: DataFrame, n: int, sample: np.ndarray) -> DataFrame:
    """The rows staged so that neighbouring rows lie close: dealt by the cells of a
    tree (a cell of many rows over several partitions), in tree order inside."""
    cells = Cells(sample, min(len(sample), -(-n // TILE)))
    schema = x.schema
    if len(cells) > 1:
        def deal(batches):
            import pyarrow as pa
            for batch in batches:
                rows = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells.of(rows), pa.int64())],
                                                 [*batch.schema.names, "cell"])
        dealt = x.mapInArrow(deal, ", ".join([f"{c} double" for c in x.columns] + ["cell long"]))
        parts = max(x.sparkSession.sparkContext.defaultParallelism, -(-n // PART_ROWS))
        x = (dealt.withColumn("salt", F.xxhash64(*x.columns, F.monotonically_increasing_id()))
             .repartitionByRange(parts, "cell", "salt").sortWithinPartitions("cell", "salt").drop("salt"))
    return stage_table(x.mapInArrow(_in_order(cells, _run_rows(n)), schema), "kmeans")


def _assign(runs: list[np.ndarray], run_rows: int = RUN_ROWS):
    """Sums per start and cluster: rows, squared distance, columns.

    A run of neighbouring rows whose ball lies on one centre's side of all the
    others goes to it as a whole; only rows of other runs are measured."""
    first = np.concatenate([[0], np.cumsum([len(c) for c in runs])])
    alike: dict[int, list[int]] = {}
    for i, c in enumerate(runs):
        alike.setdefault(len(c), []).append(i)

    def measure(x, c, total):
        near_gap = np.square(c).sum(axis=1)[None, :] - 2.0 * x @ c.T
        near = near_gap.argmin(axis=1)
        cost = np.maximum(near_gap[np.arange(len(x)), near] + np.square(x).sum(axis=1), 0.0)
        for j, w in enumerate([None, cost, *x.T]):
            total[:, j] += np.bincount(near, w, len(c))

    def run(batches):
        import pyarrow as pa
        d = runs[0].shape[1]
        total = np.zeros((first[-1], d + 2))
        for x in _tiles(batches, d):
            at = np.arange(0, len(x), run_rows)
            size = np.diff(np.append(at, len(x)))
            mid = np.add.reduceat(x, at) / size[:, None]
            off = np.square(x - np.repeat(mid, size, axis=0)).sum(axis=1)
            inside, radius = np.add.reduceat(off, at), np.sqrt(np.maximum.reduceat(off, at))
            for k, group in alike.items():
                c = np.stack([runs[i] for i in group])
                norm = np.square(c).sum(axis=2)
                apart = np.sqrt(np.square(c[:, :, None] - c[:, None]).sum(axis=3))
                for lo in range(0, len(at), NODES):
                    part = slice(lo, lo + NODES)
                    m, s = mid[part], np.arange(len(group))
                    gap = norm[None] - 2.0 * (m @ c.reshape(-1, d).T).reshape(len(m), len(group), k)
                    own = gap.argmin(axis=2)
                    least = np.take_along_axis(gap, own[:, :, None], 2)
                    slack = 2.0 * radius[part, None, None] * apart[s[None, :], own]
                    scale = 1e-12 * (norm.max() + np.square(m).sum(axis=1))
                    sure = (gap - least > slack * (1 + 1e-9) + scale[:, None, None]).sum(axis=2) == k - 1
                    node, start = np.nonzero(sure)
                    where = first[group][start] + own[node, start]
                    far = np.square(m[node] - c[start, own[node, start]]).sum(axis=1)
                    rows = size[part][node]
                    for j, w in enumerate([rows, rows * far + inside[part][node], *(rows[:, None] * m[node]).T]):
                        total[:, j] += np.bincount(where, w, len(total))
                    for i, g in enumerate(group):
                        rest = np.nonzero(~sure[:, i])[0] + lo
                        if len(rest):
                            rows = (at[rest][:, None] + np.arange(run_rows)).ravel()
                            measure(x[rows[rows < len(x)]], runs[g], total[first[g]:first[g + 1]])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(list(total), pa.list_(pa.float64()))],
                                         ["c", "v"])
    return run


def many_kmeans(df: DataFrame, cols: list[str], ks, n_init: int = 50, max_iter: int = 300, seed: int = 42,
                tol: float = 1e-9) -> dict[int, Clustering]:
    """Best clustering per k out of ``n_init`` starts; rows with a null are left out."""
    ks = [int(k) for k in ks]
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).na.drop()
    mark = F.xxhash64(*x.columns, F.monotonically_increasing_id())
    n = x.count()
    if not n:
        raise ValueError("k-means needs rows")
    share = min(1.0, 1.2 * SAMPLE_ROWS / n)
    sample = x.where(mark <= F.lit(min(int(share * 2.0 ** 64) - 2 ** 63, 2 ** 63 - 1))).limit(SAMPLE_ROWS)
    sample = np.array(sorted(tuple(r) for r in sample.collect()), float).reshape(-1, len(cols))
    if not len(sample):
        sample = np.array([tuple(x.first())], float)
    runs = [(k, _plus_plus(sample, k, np.random.default_rng([seed, k, i]))) for k in ks for i in range(n_init)]
    centers = [c for _, c in runs]
    cost, rounds, moving = np.full(len(runs), np.inf), np.zeros(len(runs), int), list(range(len(runs)))
    d = len(cols)
    x = _laid_out(x, n, sample)
    sums = [F.sum(F.col("v")[j]).alias(f"s{j}") for j in range(d + 2)]
    for r in range(1, max_iter + 1):
        if not moving:
            break
        now = [centers[i] for i in moving]
        got = x.mapInArrow(_assign(now, _run_rows(n)), "c long, v array<double>").groupBy("c").agg(F.array(*sums).alias("v")).collect()
        total = np.zeros((sum(map(len, now)), d + 2))
        for g in got:
            total[g["c"]] = g["v"]
        at, still = 0, []
        for i in moving:
            t = total[at:at + len(centers[i])]
            at += len(t)
            new = np.where(t[:, :1] > 0, t[:, 2:] / np.maximum(t[:, :1], 1.0), centers[i])   # an empty cluster stays
            cost[i], rounds[i] = t[:, 1].sum(), r
            if np.abs(new - centers[i]).max() > tol:
                still.append(i)
            centers[i] = new
        moving = still
    out = {}
    for k in ks:
        mine = [i for i, (kk, _) in enumerate(runs) if kk == k]
        best = min(mine, key=lambda i: (cost[i], i))
        order = np.lexsort(centers[best].T[::-1])
        out[k] = Clustering(k, centers[best][order], float(cost[best]), int(rounds[mine].max()),
                            not set(mine) & set(moving), [float(cost[i]) for i in mine])
    return out


def nearest_center(cols: list[str], centers: np.ndarray) -> Column:
    """Number of the nearest centre (ties to the smaller number); NULL where a column is."""
    gaps = [sum(((F.col(f"`{c}`").cast("double") - F.lit(float(v))) ** 2 for c, v in zip(cols, row)), F.lit(0.0))
            for row in centers]
    arr = F.array(*gaps)
    return F.when(gaps[0].isNotNull(), F.array_position(arr, F.array_min(arr)) - 1).cast("int")
