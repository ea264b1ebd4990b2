"""Nearest neighbours by vantage-point trees, one per shard.

Distances are angles, a metric on directions; the largest cosine is the
smallest angle.  Pivots fitted on a bounded sample deal every vector into the
cell of its nearest pivot; a cell is cut by a hash into shards of bounded size,
and every shard holds a vantage-point tree over all of its vectors.  The tree
is stored as rows in tree order: a node is a run of positions, its first row
the vantage point, the nearer half of the others by angle comes next, the
farther half last, and the vantage row keeps the least and greatest angle of
both halves.

A query first walks down to one leaf of its own shard's tree, which gives the
angle ``tau`` of its k-th neighbour so far, and searches that tree.  Then it
goes to the shards of each cell that the triangle inequality allows, from the
cell's covering annulus or from the two pivots' angles, and in each tree to
the halves that it allows:

    skip if relax * (least angle that the triangle inequality leaves) > tau

``relax`` of one gives the exact neighbours; more skips more and may miss some.
Queries meet a shard in blocks of bounded size.  What is found is scored again
on the original vectors, component by component in double precision, so that
equal vectors tie exactly.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite
components take no part, neither as query nor as candidate; only vectors of a
query's own length are its candidates; repeated rows are candidates of their
own, also of each other; ties go to the smaller id, a null id last, and a row
without an id is a candidate but never a query of op13; an empty table gives an
empty result; extra columns are not touched.  Texts do not occur.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_sample, write_table

#: Vectors of the sample that pivots are drawn from, and most pivots of a length.
FIT_VECTORS, PIVOTS = 4096, 256
#: Mean vectors of a shard, queries of a block, and most vectors of a leaf.
SHARD_ROWS, QUERY_ROWS, LEAF_ROWS = 2048, 2048, 48
#: Slack on angles and cosines, far above their rounding.
SLACK, TIE = 1e-7, 1e-12


def _list_matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(flat)
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 1))


def unit(x: np.ndarray) -> np.ndarray:
    """Directions, also of vectors whose squares leave the range of doubles."""
    x = x / np.exp2(np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.sqrt(np.square(x).sum(axis=1, keepdims=True))


def angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1.0, 1.0))


def grow(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(order of the rows, four angles per position): the tree of unit rows."""
    order = np.arange(len(x))
    bounds = np.full((len(x), 4), np.nan)
    todo = [(0, len(x))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf_rows:
            continue
        # the vantage point is the row farthest from the run's first
        far = a + int((x[order[a:b]] @ x[order[a]]).argmin())
        order[[a, far]] = order[[far, a]]
        gap = angle(x[order[a + 1:b]] @ x[order[a]])
        by = np.argsort(gap, kind="stable")
        order[a + 1:b], gap = order[a + 1:b][by], gap[by]
        m = a + 1 + (b - a - 1) // 2
        bounds[a] = gap[0], gap[m - a - 2], gap[m - a - 1], gap[-1]
        todo += [(a + 1, m), (m, b)]
    return order, bounds


def _dots(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise dot products, always added in the order of the components."""
    out = np.zeros(len(p))
    for j in range(p.shape[1]):
        out += p[:, j] * q[:, j]
    return out


class _Best:
    """The k best (score, id, row) of every query of a block."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, k: int, tau: np.ndarray):
        self.q, self.own, self.k = queries, own, k
        n = len(queries)
        self.score = np.full((n, k), -np.inf)
        self.vec = np.zeros((n, k), np.int64)
        self.none = np.ones((n, k), bool)            # the candidate has no id
        self.rid = np.full((n, k), -1, np.int64)
        self.given = tau                             # angle known before this shard

    def tau(self, at) -> np.ndarray:
        last = self.score[at, -1]
        return np.minimum(self.given[at], np.where(np.isfinite(last), angle(last), np.inf))

    def look(self, at: np.ndarray, x, vec, none, rid) -> None:
        """Compare queries ``at`` with some rows."""
        sims = self.q[at] @ x.T
        # what may be among the k best, ties included
        floor = np.maximum(self.score[at, -1], np.where(np.isfinite(self.given[at]),
                                                        np.cos(np.minimum(self.given[at] + SLACK, math.pi)), -np.inf))
        hit = (sims >= floor[:, None] - TIE) & (rid[None, :] != self.own[at][:, None])
        p, c = np.nonzero(hit)
        if not len(p):
            return
        who = at[p]
        score = _dots(self.q[who], x[c])
        some, back = np.unique(who, return_inverse=True)
        k = self.k
        who = np.concatenate([back, np.repeat(np.arange(len(some)), k)])
        score = np.concatenate([score, self.score[some].ravel()])
        v, z, r = (np.concatenate([new[c], old[some].ravel()]) for new, old in
                   ((vec, self.vec), (none, self.none), (rid, self.rid)))
        by = np.lexsort((r, v, z, -score, who))
        first = np.searchsorted(who[by], np.arange(len(some)))
        keep = by[first[:, None] + np.arange(k)]     # every query has k entries of its own before
        self.score[some], self.vec[some], self.none[some], self.rid[some] = score[keep], v[keep], z[keep], r[keep]


def _least(gap, lo, hi):
    """Least angle to a point whose angle from the vantage point is in [lo, hi]."""
    return np.maximum(gap - hi, lo - gap)


def walk(best: _Best, x, bounds, vec, none, rid, relax: float, seed: bool, leaf_rows: int = LEAF_ROWS) -> int:
    """Search one tree for a block of queries; returns compared pairs.  With
    ``seed`` each query first goes down to a single leaf."""
    seen = 0
    if seed:
        todo = [(0, len(x), np.arange(len(best.q)))]
        while todo:
            a, b, at = todo.pop()
            if not len(at):
                continue
            if b - a <= leaf_rows:
                best.look(at, x[a:b], vec[a:b], none[a:b], rid[a:b])
                seen += len(at) * (b - a)
                continue
            m = a + 1 + (b - a - 1) // 2
            gap = angle(best.q[at] @ x[a])
            near = gap <= (bounds[a, 1] + bounds[a, 2]) / 2
            todo += [(a + 1, m, at[near]), (m, b, at[~near])]
        # the leaf's rows come again below: start anew, with the angle as what is known
        best.given = best.tau(np.arange(len(best.q)))
        best.score[:], best.rid[:], best.none[:] = -np.inf, -1, True
    todo = [(0, len(x), np.arange(len(best.q)), None)]
    while todo:
        a, b, at, least = todo.pop()
        if least is not None:
            at = at[relax * least <= best.tau(at) + SLACK]
        if not len(at):
            continue
        if b - a <= leaf_rows:
            best.look(at, x[a:b], vec[a:b], none[a:b], rid[a:b])
            seen += len(at) * (b - a)
            continue
        best.look(at, x[a:a + 1], vec[a:a + 1], none[a:a + 1], rid[a:a + 1])
        seen += len(at)
        m = a + 1 + (b - a - 1) // 2
        gap = angle(best.q[at] @ x[a])
        todo += [(m, b, at, _least(gap, bounds[a, 2], bounds[a, 3])),
                 (a + 1, m, at, _least(gap, bounds[a, 0], bounds[a, 1]))]
    return seen


def _deal(pivots: dict[int, tuple[int, np.ndarray]]):
    """Cell of the nearest pivot, and the angle to it."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            lists = batch.column(2)
            size = np.diff(lists.offsets.to_numpy())
            cell, gap = np.empty(len(size), np.int64), np.zeros(len(size))
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                if int(d) in pivots:
                    first, c = pivots[int(d)]
                    sims = unit(_list_matrix(lists.take(pa.array(at)))) @ c.T
                    near = sims.argmax(axis=1)
                    cell[at], gap[at] = first + near, angle(sims[np.arange(len(at)), near])
                else:                                   # a length that the sample lacks: one cell, any angle
                    cell[at], gap[at] = -int(d), np.nan
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(cell), pa.array(gap)],
                                             ["rid", "vec_id", "v", "cell", "gap"])
    return run


def _plant(leaf_rows: int):
    """One shard's tree as rows in tree order."""
    def run(key, table):
        import pyarrow as pa
        x = unit(_list_matrix(table.column("v")))
        order, bounds = grow(x, leaf_rows)
        table = table.select(["rid", "vec_id", "v", "cell", "shard"]).take(pa.array(order))
        inner = ~np.isnan(bounds[:, 0])
        angles = pa.array([list(b) if i else None for b, i in zip(bounds, inner)], pa.list_(pa.float64()))
        return table.append_column("pos", pa.array(np.arange(len(x)))).append_column("bounds", angles)
    return run


class Index:
    """Trees of all shards as a written table, and the cells they belong to."""

    def __init__(self, nodes: DataFrame, cells: list, pivots: dict, kind: str, leaf_rows: int):
        self.nodes, self.cells, self.pivots, self.kind, self.leaf_rows = nodes, cells, pivots, kind, leaf_rows


def index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD_ROWS,
          pivots: int = PIVOTS, fit_vectors: int = FIT_VECTORS, leaf_rows: int = LEAF_ROWS) -> Index:
    """Index every vector that takes part."""
    v = F.col(vector_col)
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) \
        & F.exists(v, lambda c: c != 0)
    rows = write_table(vectors.where(fine).select(F.monotonically_increasing_id().alias("rid"),
                                                  F.col(id_col).cast("long").alias("vec_id"), v.alias("v")), "vectors")
    kind = dict(rows.dtypes)["v"]
    n = rows.count()
    sample: dict[int, list] = {}
    for r in bounded_sample(rows, n, fit_vectors, "rid").select("v").collect():
        sample.setdefault(len(r[0]), []).append(r[0])
    most = max(1, min(pivots, n // max(1, shard_rows)))
    fitted, first = {}, 0
    for d, some in sorted(sample.items()):
        x = unit(np.array(some, np.float64))
        # pivots spread out: each is the sampled vector farthest from those before
        chosen, near = [0], x @ x[0]
        while len(chosen) < min(most, len(x)) and near.min() < 1 - TIE:
            chosen.append(int(near.argmin()))
            near = np.maximum(near, x @ x[chosen[-1]])
        fitted[d] = (first, x[chosen])
        first += len(chosen)
    dealt = write_table(rows.mapInArrow(_deal(fitted), f"rid long, vec_id long, v {kind}, cell long, gap double"),
                        "dealt")
    spark = vectors.sparkSession
    sized = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.min("gap").alias("lo"),
                                      F.max("gap").alias("hi")).collect()      # pivots, and lengths not sampled
    cells = [(r["cell"], -(-r["rows"] // shard_rows), r["lo"], r["hi"]) for r in sized]
    cuts = spark.createDataFrame([(c, p) for c, p, _, _ in cells], "cell long, pieces long")
    shard = F.struct("cell", F.pmod(F.xxhash64("rid"), F.col("pieces")).alias("piece"))
    nodes = (dealt.join(F.broadcast(cuts), "cell").select("rid", "vec_id", "v", "cell", shard.alias("shard"))
             .groupBy("shard").applyInArrow(_plant(leaf_rows), f"rid long, vec_id long, v {kind}, cell long, shard struct"
                                            "<cell:bigint,piece:bigint>, pos long, bounds array<double>"))
    return Index(write_table(nodes, "trees"), cells, fitted, kind, leaf_rows)


def _visit(cells: list, pivots: dict, relax: float):
    """(query, cell) pairs that the triangle inequality allows."""
    cell = np.array([c[0] for c in cells], np.int64)
    lo, hi = (np.array([c[i] for c in cells], np.float64) for i in (2, 3))

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            tau = batch.column(2).to_numpy()
            rows, to = [], []
            for d in np.unique(size):
                at = np.flatnonzero(size == d)
                if int(d) not in pivots:
                    rows.append(at)
                    to.append(np.full(len(at), -int(d)))
                    continue
                first, c = pivots[int(d)]
                mine = np.flatnonzero((cell >= first) & (cell < first + len(c)))
                gap = angle(unit(_list_matrix(lists.take(pa.array(at)))) @ c.T)
                own = gap.min(axis=1, keepdims=True)
                gap = gap[:, cell[mine] - first]
                least = np.maximum(_least(gap, lo[mine], hi[mine]), (gap - own) / 2)
                p, q = np.nonzero(relax * least <= tau[at][:, None] + SLACK)
                rows.append(at[p])
                to.append(cell[mine[q]])
            at = np.concatenate(rows) if rows else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(np.concatenate(to) if to else np.empty(0, np.int64))],
                ["rid", "cell"])
    return run


def _ask(k: int, relax: float, seed: bool, leaf_rows: int):
    """One shard and one block of queries."""
    def run(key, nodes, queries):
        import pyarrow as pa
        names = ["qid", "score", "vec_id", "rid"]
        if not nodes.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.float64())] + [pa.array([], pa.int64())] * 2, names)
        nodes = nodes.take(pa.array(np.argsort(nodes.column("pos").to_numpy())))
        ids = nodes.column("vec_id").combine_chunks()
        none = ids.is_null().to_numpy(zero_copy_only=False)
        vec, rid = ids.fill_null(0).to_numpy(), nodes.column("rid").to_numpy()
        bounds = np.array([b or [np.nan] * 4 for b in nodes.column("bounds").to_pylist()])
        qid = queries.column("rid").to_numpy()
        best = _Best(unit(_list_matrix(queries.column("v"))), qid, k, queries.column("tau").to_numpy().copy())
        walk(best, unit(_list_matrix(nodes.column("v"))), bounds, vec, none, rid, relax, seed, leaf_rows)
        q, j = np.nonzero(best.rid >= 0)
        return pa.table([pa.array(qid[q]), pa.array(best.score[q, j]), pa.array(best.vec[q, j], mask=best.none[q, j]),
                         pa.array(best.rid[q, j])], names)
    return run


def search(idx: Index, queries: DataFrame, k: int = 5, relax: float = 1.0,
           query_rows: int = QUERY_ROWS) -> DataFrame:
    """k nearest candidates of indexed rows ``queries`` (columns of
    ``idx.nodes``): query_id, rank, vec_id, score."""
    spark = queries.sparkSession
    asked = write_table(queries.select("rid", "vec_id", "v", "shard"), "asked")
    n = asked.count()
    blocks = max(1, -(-n // query_rows))
    block = F.pmod(F.xxhash64("rid"), F.lit(blocks))
    schema = "qid long, score double, vec_id long, rid long"

    def ask(pairs: DataFrame, seed: bool) -> DataFrame:
        """pairs: rid, v, tau, shard"""
        pairs = pairs.withColumn("block", block)
        # fresh columns: both sides of the cogroup come from one table
        fresh = lambda df, *names: df.select(*[F.col(c).alias(c) for c in names])
        wanted = fresh(pairs, "shard", "block").distinct()
        trees = fresh(idx.nodes.join(wanted, "shard"), "shard", "block", "pos", "bounds", "rid", "vec_id", "v")
        pairs = fresh(pairs, "shard", "block", "rid", "v", "tau")
        return write_table(trees.groupBy("shard", "block").cogroup(pairs.groupBy("shard", "block")).applyInArrow(
            _ask(k, relax, seed, idx.leaf_rows), schema), "found")

    home = ask(asked.select("rid", "v", F.lit(float("inf")).alias("tau"), "shard"), True)
    # the k-th angle of the own shard; infinite where it holds fewer
    known = home.groupBy("qid").agg(F.count(F.lit(1)).alias("m"), F.min("score").alias("low")).select(
        F.col("qid").alias("rid"), F.when(F.col("m") >= k, F.acos(F.greatest(F.least("low", F.lit(1.0)), F.lit(-1.0))))
        .alias("known"))
    armed = write_table(asked.join(known, "rid", "left").select(
        "rid", "v", F.coalesce("known", F.lit(float("inf"))).alias("tau"), "shard"), "armed")
    cuts = spark.createDataFrame([(c, p) for c, p, _, _ in idx.cells], "cell long, pieces long")
    to = (armed.select("rid", "v", "tau").mapInArrow(_visit(idx.cells, idx.pivots, relax), "rid long, cell long")
          .join(F.broadcast(cuts), "cell")
          .select("rid", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1),
                                               lambda p: F.struct(F.col("cell").alias("cell"), p.alias("piece"))))
                  .alias("to")))
    rest = (to.join(armed, "rid").where(F.col("to") != F.col("shard"))
            .select("rid", "v", "tau", F.col("to").alias("shard")))
    found = home.unionByName(ask(rest, False))
    near = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "rid")
    named = asked.select(F.col("rid").alias("qid"), F.col("vec_id").alias("query_id"))
    return (found.withColumn("rank", F.row_number().over(near)).where(F.col("rank") <= k)
            .join(named, "qid").select("query_id", "rank", "vec_id", "score"))
