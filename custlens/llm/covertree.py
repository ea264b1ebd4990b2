"""Embedding near-duplicates by dual traversal of a cover tree.

Distances are angles, a metric on directions.  The tree's levels are nets of
halving radii, each inside a node of the level above; a node knows its covering
radius, the angle to its farthest vector.  A tree fitted on a bounded sample
routes every vector down its levels to a block: a node with few enough rows, or
some small siblings together, so blocks lie apart as far as the data do (copies
that no radius parts are cut by a hash).  Inside its block every vector goes on
down nested nets until radii are at most half the threshold angle, so any two
vectors of a leaf link.  Nodes of all levels are kept as a table.

Two blocks meet where their covering radii allow it, in one task that walks
pairs of nodes from the two roots down.  A pair is dropped with all below it when

    angle(centres) > threshold + radius + radius

and a pair of leaves is taken whole, without looking at vectors, when

    angle(centres) + radius + radius <= threshold.

Leaf pairs between the two are compared vector by vector in double precision,
so the result is exact.  A dense group, copies of one vector say, costs a leaf
per block instead of its pairs; only counts and one edge per leaf pair leave
the comparison.

Defined cases: vectors that are null, zero, or hold null or non-finite
components link with nothing, nor do vectors of different length; repeated
rows are vectors of their own and link; a null id is allowed and never names
a component with other ids; an empty table gives an empty result; extra columns
are not touched.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bounded_sample, connected_components, write_table

#: Vectors of the sample that the top net is fitted on.
FIT_VECTORS = 4096
#: Least vectors of a block, and most blocks (blocks grow beyond).
BLOCK_ROWS, MAX_BLOCKS = 8192, 50_000
#: Children of a router node that a finer level may have instead, and the finest such radius.
FAN, FINEST = 64, 1e-3
#: Components of more than 1 / HOT_SHARE of the leaves are broadcast: fewer than HOT_SHARE.
HOT_SHARE = 1000
#: Slack on angles, far above the rounding of arccos near 1.
SLACK = 1e-6


def _unit(rows) -> np.ndarray:
    """Directions; components are scaled first, so that no square over- or underflows."""
    x = np.asarray(rows, dtype=np.float64)
    x = x / np.exp2(np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angle(c: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(c, -1.0, 1.0))


def _matrix(column) -> tuple[np.ndarray, np.ndarray]:
    """(2-D double array, its row numbers) of an Arrow list column whose lists
    have one length."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    n = len(flat)
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(n, -1) if n else \
        np.empty((0, 1))


def _net(x: np.ndarray, radius: float, chunk: int = 256) -> np.ndarray:
    """Greedy net: centre number per row, every row within ``radius`` of its
    centre's row."""
    part = np.full(len(x), -1, np.int64)
    bound, made = math.cos(radius), 0
    left = np.arange(len(x))
    while len(left):
        some = left[:chunk]
        sims = x[some] @ x[left].T
        for k, row in enumerate(some):
            if part[row] < 0:
                hit = left[(sims[k] >= bound) & (part[left] < 0)]
                part[hit] = made
                part[row] = made
                made += 1
        left = left[part[left] < 0]
    return part


def _tree(x: np.ndarray, radius: float) -> tuple[np.ndarray, list[tuple]]:
    """(order of the rows, nodes) of a cover tree: nested nets of halving radii
    down to leaves whose covering radius about their mean direction is at most
    ``radius``.  A node is (start, end, parent, is leaf, centre, reach) over the
    ordered rows; parents come before their children, the root first."""
    order = np.arange(len(x))
    nodes: list[tuple] = []
    todo = [(0, len(x), -1, math.pi / 2)]
    while todo:
        a, b, parent, r = todo.pop()
        rows = order[a:b]
        centre, reach = _spread(x[rows])
        leaf = b - a == 1 or reach <= radius - SLACK
        nodes.append((a, b, parent, leaf, centre, reach))
        if leaf:
            continue
        me = len(nodes) - 1
        part = _net(x[rows], r)
        while part.max() == 0:                       # one net cell: the next level parts it
            r /= 2
            part = _net(x[rows], r)
        by = np.argsort(part, kind="stable")
        order[a:b] = rows[by]
        cuts = [0, *(np.flatnonzero(np.diff(part[by])) + 1).tolist(), b - a]
        todo += [(a + p, a + q, me, r / 2) for p, q in zip(cuts, cuts[1:])]
    return order, nodes


def _spread(x: np.ndarray) -> tuple[np.ndarray, float]:
    """(centre as 32-bit floats, covering radius about it)."""
    c = x[0] if len(x) == 1 else x.mean(axis=0)
    c = c if np.linalg.norm(c) > 1e-9 else x[0]
    c = c.astype(np.float32)
    u = _unit(c[None])[0]
    return c, float(_angle(x @ u).max()) if len(x) > 1 or not np.array_equal(u, x[0]) else 0.0


def _router(x: np.ndarray, rows_each: float, block_rows: int, first: int):
    """Cover tree of sampled unit rows, cut where a node stands for few enough
    rows: nested (centres, children), a child being a node or a block number.
    Small siblings share blocks.  Returns (root, next free block number)."""
    def node(rows, r):
        nonlocal first
        if len(rows) * rows_each <= block_rows or r < SLACK:
            first += 1
            return first - 1
        # levels that hardly branch are passed over: coarse borders would cut through dense groups
        part = _net(x[rows], r)
        while r > FINEST and part.max() < FAN:
            finer = _net(x[rows], r / 2)
            if finer.max() >= FAN:
                break
            part, r = finer, r / 2
        if part.max() == 0:
            return node(rows, r / 2)
        centres = x[[rows[int(np.argmax(part == k))] for k in range(part.max() + 1)]]
        # as vectors will be routed: to the nearest centre
        part = (x[rows] @ centres.T).argmax(axis=1)
        groups = [rows[part == k] for k in range(len(centres))]
        children, filled, block = [], block_rows + 1.0, -1
        for g in groups:
            if len(g) * rows_each > block_rows:
                children.append(node(g, r / 2))
                continue
            if filled + len(g) * rows_each > block_rows:
                block, filled, first = first, 0.0, first + 1
            filled += len(g) * rows_each
            children.append(block)
        return centres, children
    return node(np.arange(len(x)), math.pi / 2), first


def _fit(vectors: DataFrame, n: int, fit_vectors: int, block_rows: int) -> tuple[dict, int]:
    """Router per length, and the number of blocks they name."""
    rows = [r[0] for r in bounded_sample(vectors, n, fit_vectors, "vec_id", "v").select("v").collect()]
    by_len: dict[int, list] = {}
    for r in rows:
        by_len.setdefault(len(r), []).append(r)
    routers, first = {}, 0
    for size, some in sorted(by_len.items()):
        routers[size], first = _router(_unit(some), n / max(1, len(rows)), block_rows, first)
    return routers, first


def _assign(routers: dict, blocks: int):
    """Route vectors down the sampled tree of their length to the nearest
    centre of every level; lengths that the sample lacks are blocks of their own."""
    def down(x, rows, at, out):
        if isinstance(at, int):
            out[rows] = at
            return
        centres, children = at
        near = (x[rows] @ centres.T).argmax(axis=1)
        for k in np.unique(near):
            down(x, rows[near == k], children[k], out)

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            cell = np.empty(len(size), np.int64)
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                if int(n) in routers:
                    x = _unit(_matrix(lists.take(pa.array(at))))
                    found = np.empty(len(at), np.int64)
                    down(x, np.arange(len(at)), routers[int(n)], found)
                    cell[at] = found
                else:
                    cell[at] = blocks + n
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(cell)], ["vec_id", "v", "cell"])
    return run


NODE = "block long, leaf long, node int, parent int, centre array<float>, reach double, k long"


def _grow(radius: float, kind: str):
    """One block: its vectors in tree order, and the nodes of its tree.  Rows
    with a ``rid`` are vectors, rows with a ``node`` are nodes; a leaf has a
    number in both."""
    def run(key, table):
        import pyarrow as pa
        block = key[0].as_py()
        ids = table.column("vec_id")
        x = _unit(_matrix(table.column("v")))
        first = np.lexsort(np.hstack([x[:, :1], np.array(ids.fill_null(-1).to_pylist(), np.float64)[:, None]]).T)
        order, nodes = _tree(x[first], radius)
        order = first[order]
        n, m, at = len(x), len(nodes), block << 32
        leaf, number = np.empty(n, np.int64), np.full(m, -1, np.int64)
        for i, (a, b, _, is_leaf, _, _) in enumerate(nodes):
            if is_leaf:
                leaf[a:b] = number[i] = at + i
        none = lambda k, t: pa.nulls(k, t)
        lists = table.column("v").type
        points = pa.table({"rid": pa.array(at + np.arange(n)), "vec_id": ids.take(pa.array(order)),
                           "v": table.column("v").take(pa.array(order)), "block": pa.array(np.full(n, block)),
                           "leaf": pa.array(leaf), "node": none(n, pa.int32()), "parent": none(n, pa.int32()),
                           "centre": none(n, pa.list_(pa.float32())), "reach": none(n, pa.float64()),
                           "k": none(n, pa.int64())})
        tree = pa.table({"rid": none(m, pa.int64()), "vec_id": none(m, pa.int64()), "v": none(m, lists),
                         "block": pa.array(np.full(m, block)), "leaf": pa.array(number, mask=number < 0),
                         "node": pa.array(np.arange(m, dtype=np.int32)),
                         "parent": pa.array(np.array([t[2] for t in nodes], np.int32)),
                         "centre": pa.array([t[4] for t in nodes], pa.list_(pa.float32())),
                         "reach": pa.array([t[5] for t in nodes]), "k": pa.array([t[1] - t[0] for t in nodes])})
        return pa.concat_tables([points, tree])
    return run


def _partners(nodes: list, threshold: float):
    """Block pairs (i, j), i <= j, that covering radii do not rule out."""
    ids = np.array([n[0] for n in nodes], np.int64)
    reach = np.array([n[2] for n in nodes])
    size = np.array([len(n[1]) for n in nodes])
    centre = {s: _unit([n[1] for n in nodes if len(n[1]) == s]) for s in set(size.tolist())}

    def run(batches):
        import pyarrow as pa
        for batch in batches:
            a, b = [], []
            for i in batch.column(0).to_pylist():
                me = int(np.flatnonzero(ids == i)[0])
                same = np.flatnonzero(size == size[me])
                c = centre[size[me]]
                gap = _angle(c @ c[int(np.flatnonzero(same == me)[0])])
                for j in ids[same[(gap <= threshold + reach[me] + reach[same] + SLACK) & (ids[same] >= i)]]:
                    a.append(i)
                    b.append(int(j))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["i", "j"])
    return run


class _Nodes:
    """A block's nodes, by number."""

    def __init__(self, table):
        order = np.argsort(table.column("node").to_numpy())
        self.x = _unit(_matrix(table.column("centre")))[order]
        self.reach = table.column("reach").to_numpy()[order]
        leaf = table.column("leaf").fill_null(-1).to_numpy()[order]
        self.leaf, self.is_leaf = leaf, leaf >= 0
        parent = table.column("parent").to_numpy()[order]
        by = np.argsort(parent, kind="stable")
        at = np.searchsorted(parent[by], np.arange(len(parent) + 1))
        self.children = lambda i: by[at[i]:at[i + 1]]


def _walk(left: _Nodes, right: _Nodes, within: bool, cosine: float, threshold: float, tile: int = 1024):
    """Pairs of leaves that covering radii leave, as (left, right, taken whole);
    ``within`` one block, each pair once.  Also counts the node pairs looked at."""
    out, seen = [], 0
    todo = [(0, 0)]
    while todo:
        p, q = todo.pop()
        same = within and p == q
        if same and left.is_leaf[p]:
            continue                                            # all of a leaf links
        a = np.array([p]) if left.is_leaf[p] else left.children(p)
        b = np.array([q]) if right.is_leaf[q] else right.children(q)
        far = threshold + left.reach[a].max() + right.reach[b].max() + SLACK
        bound = math.cos(far) if far < math.pi else -2.0
        for at in range(0, len(a), tile):
            some = a[at:at + tile]
            sims = left.x[some] @ right.x[b].T
            seen += sims.size
            i, j = np.nonzero(sims >= min(bound, cosine))
            s, i, j = sims[i, j], some[i], b[j]
            reach = left.reach[i] + right.reach[j]
            gap = _angle(s)
            keep = gap <= threshold + reach + SLACK
            if same:
                keep &= i <= j
            i, j, s, reach, gap = (v[keep] for v in (i, j, s, reach, gap))
            ends = left.is_leaf[i] & right.is_leaf[j]
            exact = reach == 0
            link = np.where(exact, s >= cosine, gap + reach <= threshold - SLACK)
            use = ends & (link | ~exact)
            if within:
                use &= left.leaf[i] != right.leaf[j]
            out.append((left.leaf[i[use]], right.leaf[j[use]], link[use]))
            todo += list(zip(i[~ends].tolist(), j[~ends].tolist()))
    cat = lambda k, kind: np.concatenate([o[k] for o in out]) if out else np.empty(0, kind)
    return cat(0, np.int64), cat(1, np.int64), cat(2, bool), seen


def _meet(cosine: float, threshold: float):
    """Leaf pairs of two blocks: taken whole, or to be looked at."""
    def run(key, left, right):
        import pyarrow as pa
        within = key[0].as_py() == key[1].as_py()
        a, b, sure, _ = _walk(_Nodes(left), _Nodes(right), within, cosine, threshold)
        if within:
            a, b = np.minimum(a, b), np.maximum(a, b)
        return pa.table({"a": pa.array(a), "b": pa.array(b), "sure": pa.array(sure)})
    return run


def _look(cosine: float, tile: int = 2048):
    """Links per vector between two leaves."""
    def run(key, left, right):
        import pyarrow as pa
        xa, xb = _unit(_matrix(left.column("v"))), _unit(_matrix(right.column("v")))
        na, nb = np.zeros(len(xa), np.int64), np.zeros(len(xb), np.int64)
        for at in range(0, len(xa), tile):
            hit = xa[at:at + tile] @ xb.T >= cosine
            na[at:at + tile] = hit.sum(axis=1)
            nb += hit.sum(axis=0)
        rid = np.concatenate([left.column("rid").to_numpy(), right.column("rid").to_numpy()])
        n = np.concatenate([na, nb])
        keep = n > 0
        m = int(keep.sum())
        return pa.table({"a": pa.array([key[0].as_py()] * m, pa.int64()), "b": pa.array([key[1].as_py()] * m, pa.int64()),
                         "rid": pa.array(rid[keep]), "n": pa.array(n[keep])})
    return run


def grow(good: DataFrame, threshold: float, block_rows: int = BLOCK_ROWS,
         fit_vectors: int = FIT_VECTORS) -> tuple[DataFrame, DataFrame]:
    """(points, nodes) of the trees of all blocks, as written tables."""
    kind = dict(good.dtypes)["v"]
    n = good.count()
    per = max(block_rows, n // MAX_BLOCKS)
    routers, known = _fit(good, n, fit_vectors, per)
    dealt = write_table(good.mapInArrow(_assign(routers, known), f"vec_id long, v {kind}, cell long"), "cells")
    first, cut = 0, []
    for r in dealt.groupBy("cell").count().orderBy("cell").collect():      # as many as blocks and lengths
        # the sample's estimate may be off; what is far beyond a block is cut by a hash
        blocks = -(-r["count"] // per) if r["count"] > 2 * per else 1
        cut.append((r["cell"], first, blocks))
        first += blocks
    cells = F.broadcast(good.sparkSession.createDataFrame(cut, "cell long, first long, blocks long"))
    block = F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks"))
    grown = write_table(dealt.join(cells, "cell").select("vec_id", "v", block.alias("block")).groupBy("block")
                        .applyInArrow(_grow(threshold / 2, kind), f"rid long, vec_id long, v {kind}, {NODE}"), "points")
    return grown.where("rid is not null").select("rid", "vec_id", "v", "block", "leaf"), \
        grown.where("node is not null").select("block", "leaf", "node", "parent", "centre", "reach", "k")


def block_pairs(nodes: DataFrame, threshold: float) -> DataFrame:
    """Pairs (i, j), i <= j, of blocks whose roots' covering radii leave a link possible."""
    roots = nodes.where("parent = -1").select("block", "centre", "reach")
    tops = [tuple(r) for r in roots.orderBy("block").collect()]            # about rows / block_rows
    return roots.select("block").repartition(max(1, min(len(tops), 200)), "block") \
        .mapInArrow(_partners(tops, threshold), "i long, j long")


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95,
                 block_rows: int = BLOCK_ROWS, fit_vectors: int = FIT_VECTORS) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    threshold = math.acos(cosine)
    v = F.col("v")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v")).withColumn(
        "ok", F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False)))
    points, nodes = grow(rows.where("ok").select("vec_id", "v"), threshold, block_rows, fit_vectors)
    pairs = write_table(block_pairs(nodes, threshold), "blocks")
    fresh = lambda *names: [F.col(c).alias(c) for c in names]  # noqa: E731  both sides of a cogroup come from one table
    side = lambda x: pairs.join(nodes, F.col(x) == F.col("block")).select(
        *fresh("i", "j", "leaf", "node", "parent", "centre", "reach"))
    met = write_table(side("i").groupBy("i", "j").cogroup(side("j").groupBy("i", "j"))
                      .applyInArrow(_meet(cosine, threshold), "a long, b long, sure boolean"), "met")
    leaves = nodes.where("leaf is not null").select("leaf", "k")

    sure, unsure = met.where("sure"), met.where("not sure")
    of_leaf = points.select(F.col("leaf").alias("x"), "rid", "v")
    one = lambda x: unsure.join(of_leaf, F.col(x) == F.col("x")).select(*fresh("a", "b", "rid", "v"))
    looked = write_table(one("a").groupBy("a", "b").cogroup(one("b").groupBy("a", "b"))
                         .applyInArrow(_look(cosine), "a long, b long, rid long, n long"), "looked")

    parts = connected_components(sure.select("a", "b").union(looked.select("a", "b")))
    whole = (sure.select(F.col("a").alias("leaf"), F.col("b").alias("o"))
             .union(sure.select("b", "a")).join(leaves.select(F.col("leaf").alias("o"), F.col("k").alias("m")), "o")
             .groupBy("leaf").agg(F.sum("m").alias("m")))
    single = looked.groupBy("rid").agg(F.sum("n").alias("n"))
    # components are named once per leaf: a component of a third of all rows is no key of rows
    named = write_table(points.groupBy("leaf").agg(F.min("vec_id").alias("low")).join(
        parts, F.col("leaf") == F.col("id"), "left").select("leaf", "low", F.coalesce("component", "leaf").alias("p")),
        "named")
    least = write_table(named.groupBy("p").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("size")),
                        "least")
    hot = F.broadcast(least.where(F.col("size") * HOT_SHARE > named.count()).select(
        "p", F.col("component_id").alias("hot_id"), F.lit(True).alias("is_hot")))           # fewer than HOT_SHARE
    split = named.join(hot, "p", "left")
    of_leaf = split.where("is_hot").select("leaf", F.col("hot_id").alias("component_id")).unionByName(
        split.where("is_hot is null").join(least.where(F.col("size") * HOT_SHARE <= named.count()), "p")
        .select("leaf", "component_id"))
    per_leaf = (of_leaf.join(leaves, "leaf").join(whole, "leaf", "left")
                .select("leaf", "component_id", "k", (F.col("k") - 1 + F.coalesce("m", F.lit(0))).alias("links")))
    # rows meet their leaf: leaves of a large share of the rows by broadcast, the others by a shuffle
    per_leaf = write_table(per_leaf, "leaves")
    ids, n = points.select("rid", "vec_id", "leaf"), points.count()
    large = F.col("k") * HOT_SHARE > F.lit(n)
    met = ids.join(F.broadcast(per_leaf.where(large).drop("k")), "leaf", "left")
    ready = met.where("links is not null")
    other = met.where("links is null").select("rid", "vec_id", "leaf").join(per_leaf.where(~large).drop("k"), "leaf")
    linked = (ready.unionByName(other).join(single, "rid", "left")
              .select("vec_id", (F.col("links") + F.coalesce("n", F.lit(0))).alias("n_links"), "component_id"))
    alone = rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                        F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
