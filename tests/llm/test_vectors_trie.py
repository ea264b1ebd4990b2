"""Whitening, prefix trie and vantage-point search against brute force on the
benchmark's small tables and hand-made rows."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from custlens.llm import prefixtrie, queries, vptree, whitening
from custlens.llm.shared import bounded_sample

MID = "/root/testdata/sf0.01"
INF = float("inf")


# ------------------------------------------------------------------ whitening
def check_whitening(rows, got, d, components=32):
    """``rows``: (id, vector) that remain; ``got``: the operator's rows."""
    x = np.floor(64 * np.array([v for _, v in rows], np.float64)).astype(np.int64) + 1_000_000
    n = len(x)
    total = [sum(int(v) for v in x[:, j]) for j in range(d)]
    y = x - np.array(total) / n
    cov = y.T @ y / n
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    k = min(components, d)
    assert len(got) == n * k and all(r["n"] == n for r in got)
    dev = collections.Counter((i, sum((n * int(a) - s) ** 2 for a, s in zip(v, total))) for (i, _), v in zip(rows, x))
    assert dev == collections.Counter((r["vec_id"], int(r["deviation"])) for r in got if r["component"] == 1)
    by = collections.defaultdict(list)
    for r in got:
        assert math.isclose(r["explained"], e[r["component"] - 1] / np.trace(cov), rel_tol=1e-6, abs_tol=1e-15)
        by[r["component"]].append((str(r["vec_id"]), r["whitened"]))
    live = [c for c in by if e[c - 1] > whitening.RANK * e[0]]
    for c in live:
        mine = sorted(by[c])
        want = sorted(zip([str(i) for i, _ in rows], (y @ u[:, c - 1] / math.sqrt(e[c - 1])).tolist()))
        flip = sorted((a, -b) for a, b in want)
        assert any(np.allclose([b for _, b in mine], [b for _, b in w], atol=1e-7) for w in (want, flip))
    assert all(w is None for c in by if c not in live for _, w in by[c])
    assert max(r["identity_error"] for r in got) <= 1e-9


def test_whitening_query(spark):
    got = [r.asDict() for r in queries.QUERIES["op11_embedding_whitening"](spark, MID).collect()]
    src = spark.read.parquet(f"{MID}/embeddings.parquet")
    check_whitening([(r["vec_id"], r["embedding"]) for r in src.collect()], got, 64)


def test_whitening_groups_and_odd_rows(spark):
    """A third of the rows is one vector; ties, nulls, several lengths, no rows."""
    rng = random.Random(5)
    rows = [(i, [1.5, -2.25, 0.125]) for i in range(700)] + [
        (700 + i, [rng.random(), rng.random(), rng.random()]) for i in range(1400)]
    odd = [(None, None), (3, [None, 1.0, 1.0]), (4, [INF, 1.0, 2.0]), (5, [float("nan"), 0.0, 1.0]), (6, [])]
    src = spark.createDataFrame([(i, v, 1, "m") for i, v in rows + odd], "vec_id long, embedding array<double>, x int, m string")
    got = [r.asDict() for r in whitening.whiten(src).collect()]
    check_whitening(rows, got, 3)
    once = {r["vec_id"]: r for r in whitening.whiten(src, weights="one").collect() if r["component"] == 1}
    assert once[0]["n"] == len({tuple(math.floor(64 * c) for c in v) for _, v in rows})
    assert whitening.whiten(src.limit(0)).count() == 0
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [9.0]), (4, [1e300, 0.0])],
                                "vec_id long, embedding array<double>")
    got = sorted((r["vec_id"], r["component"], r["n"], r["whitened"] is None) for r in whitening.whiten(two).collect())
    assert [g[:3] for g in got] == [(1, 1, 3), (1, 2, 3), (2, 1, 3), (2, 2, 3), (3, 1, 1), (4, 1, 3), (4, 2, 3)]
    assert got[4][3] and not got[0][3]


# ------------------------------------------------------------------ prefix trie
def brute_trie(rows):
    conv = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            mark = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            conv[c].append(((t is not None, t or 0, mark), role, text))
    turns = {c: [(r, x) for _, r, x in sorted(v)] for c, v in conv.items()}
    full = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        full[c] = tuple(turns.get(c - int(math.fmod(c, 5)), [])[:h]) + tuple(turns[c][h:])
    nodes, kids, ends = (collections.defaultdict(list) for _ in range(3))
    for c, p in full.items():
        ends[p].append(c)
        for d in range(len(p) + 1):
            nodes[p[:d]].append(c)
    for p in nodes:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) if kids[p] else 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(kids[p]), leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
                  for p, m in nodes.items())


def test_trie_query(spark):
    src = spark.read.parquet(f"{MID}/conversations.parquet").select("conv_id", "turn", "role", "text")
    got = sorted(tuple(r) for r in queries.QUERIES["op12_prefix_trie"](spark, MID).collect())
    assert got == brute_trie([tuple(r) for r in src.collect()])


def odd_conversations():
    rng = random.Random(1)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(1, 2, 3, 4, 5, 6, 7, 10, 11, 12, 13, 14, 15, 20, 21, None, -3), pick(0, 1, 2, 3, None),
             pick("user", "assistant", None), pick("a", "b", "é", None, "x" * 3000)) for _ in range(120)]
    rows += [(c, t, "user", f"same{t}") for c in range(100, 700) for t in range(3 + (c % 7 == 0))]   # one hot path
    return rows + [(5000 + c, t, "user", str(t)) for c in range(2) for t in range(700 + 100 * c)]    # deep ones


@pytest.mark.parametrize("cells", [1_000_000, 3000, 60])
def test_trie_of_many_blocks(spark, cells):
    """Small blocks cut the hot path and the deep ones, and need several levels."""
    rows = odd_conversations()
    src = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .selectExpr("*", "1 AS path", "'x' AS bytes")
    got = sorted(tuple(r) for r in prefixtrie.trie(prefixtrie.rebuilt(src), cells=cells).collect())
    assert got == brute_trie(rows)


def test_trie_of_nothing(spark):
    src = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefixtrie.trie(prefixtrie.rebuilt(src)).count() == 0
    src = spark.createDataFrame([(None, 1, "user", "x")], src.schema)
    assert prefixtrie.trie(prefixtrie.rebuilt(src)).count() == 0


# ------------------------------------------------------------------ vantage-point search
def brute_near(rows, step=50, k=5):
    """query id -> [(score, id)] of each query row, in order."""
    out = []
    for q, (i, v) in enumerate(rows):
        if i is None or i % step:
            continue
        v = np.array(v, np.float64) / max(map(abs, v))
        near = []
        for c, (j, w) in enumerate(rows):
            if c != q and len(w) == len(v):
                w = np.array(w, np.float64) / max(map(abs, w))
                near.append((float(v @ w / math.sqrt((v @ v) * (w @ w))), j))
        near.sort(key=lambda x: (-round(x[0], 12), x[1] is None, x[1]))
        out.append((i, near[:k]))
    return out


def check_near(want, got):
    by = collections.defaultdict(list)
    for r in got:
        by[r["query_id"]].append(r)
    assert len(got) == sum(len(n) for _, n in want)
    for q, near in want:
        mine = sorted(by[q], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(near) + 1))
        assert [r["vec_id"] for r in mine] == [j for _, j in near]
        assert all(math.isclose(r["score"], s, abs_tol=1e-12) for r, (s, _) in zip(mine, near))


def test_search_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{MID}/embeddings.parquet").collect()]
    check_near(brute_near(rows), [r.asDict() for r in queries.QUERIES["op13_vantage_point_search"](spark, MID).collect()])


def test_search_of_many_shards(spark):
    """Copies that tie, lengths, extreme and useless vectors; exact through all shards and blocks."""
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(500)]
    rows += [(500 + i, [0.6, 0.8, 0.0]) for i in range(200)] + [(800, [0.6 * 2.0 ** 660, 0.8 * 2.0 ** 660, 0.0]), (850, [0.6 / 2.0 ** 660, 0.8 / 2.0 ** 660, 0.0])]
    rows += [(None, [1.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0]), (900, [1.0, 1.0]), (901, [1.0, 0.5]), (1000, [2.0])]
    bad = [(950, None), (1050, []), (1100, [0.0, 0.0, 0.0]), (1150, [None, 1.0, 1.0]), (1200, [INF, 1.0, 1.0])]
    src = spark.createDataFrame([(i, v, 1) for i, v in rows + bad], "vec_id long, embedding array<double>, shard int")
    trees = vptree.index(src, shard_rows=60, pivots=5, leaf_rows=7)
    assert trees.nodes.count() == len(rows) and trees.nodes.select("shard").distinct().count() > 8
    got = [r.asDict() for r in vptree.search(trees, trees.nodes.where("vec_id % 50 = 0"), query_rows=6).collect()]
    check_near(brute_near(rows), got)
    empty = vptree.index(src.limit(0))
    assert vptree.search(empty, empty.nodes).count() == 0


def test_pruning_and_relaxation():
    """On clustered directions most pairs are never compared; a larger factor
    compares fewer, a factor of one misses none."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 16))
    x = vptree.unit(np.repeat(centres, 100, axis=0) + 0.05 * rng.normal(size=(4000, 16)))
    ids, q = np.arange(4000), x[::40]
    want = np.argsort(-(q @ x.T) + 9 * (ids[None, :] == ids[::40, None]), axis=1)[:, :5]
    order, bounds = vptree.grow(x)
    assert sorted(order) == list(range(4000))
    seen, recall = [], []
    for relax in (1.0, 3.0):
        best = vptree._Best(q, ids[::40], 5, np.full(len(q), np.inf))
        seen.append(vptree.walk(best, x[order], bounds, ids[order], np.zeros(4000, bool), ids[order], relax, True))
        recall.append(np.mean([len(set(a) & set(b)) / 5 for a, b in zip(best.rid, want)]))
    assert recall[0] == 1.0 and recall[1] >= 0.9
    assert seen[1] <= seen[0] < 0.2 * len(q) * len(x)


def test_bounded_sample(spark):
    df = spark.range(10_000).selectExpr("id", "'x' AS t")
    got = bounded_sample(df, 10_000, 100, "id").count()
    assert 60 <= got <= 100
    assert bounded_sample(df, 10 ** 15, 100, "id").count() == 0 and bounded_sample(df.limit(5), 5, 100, "id").count() == 5
