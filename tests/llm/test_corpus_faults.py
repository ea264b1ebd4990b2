"""Corpus operators on inputs that once lost rows, texts or rules."""

import collections
import random

import numpy as np

from custlens.llm import covertree, htmltext, minhash, quality, secrets, urls
from custlens.llm.shared import drawn

SAID = ("the a this some old new small city river house report market school winter people water letter year road music "
        "field garden was is had found").split()


def sentences(rng, low=30, high=70):
    return " ".join(rng.choice(SAID) for _ in range(rng.randint(low, high))).capitalize() + "."


def test_articles_in_containers_without_a_name(spark):
    """A site that lists no article container keeps its paragraphs, all of them and nothing else."""
    rng = random.Random(3)
    want, rows = {}, []
    for i in range(60):
        body = [sentences(rng) for _ in range(8)]
        want[i] = " ".join(body)
        rows.append((i, f"http://x/{i}", "<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/b'>Blog</a></li>"
                     "</ul></nav><div id='content'>" + "".join(f"<p>{p}</p>" for p in body)
                     + "</div><footer><p>Copyright 2020 Site</p></footer></body></html>"))
    got = {r["page_id"]: r["text"] for r in htmltext.extract(
        spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want


def test_formulas_and_drawings_stay(spark):
    page = "<article><p>Let <math><mi>x</mi></math> be <svg><text>drawn</text></svg> here.</p><script>no</script></article>"
    got = htmltext.extract(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert got["text"] == "Let x be drawn here."


def test_prose_without_spaces_is_kept(spark):
    zh = "\n".join(f"这是一个没有空格的中文句子用来测试质量规则是否保留正常的文章内容第{i}行因为它们不应该被删除" for i in range(14))
    run = "\n".join(f"{'x' * 40}{i}" for i in range(14))
    got = {r["doc_id"]: r["kept"] for r in quality.measures(
        spark.createDataFrame([(1, zh), (2, run)], "doc_id long, text string")).collect()}
    assert got == {1: True, 2: False}


def test_samples_of_any_table_size(spark):
    """Shares far below a millionth still draw, and rows without ids are drawn by their text."""
    df = spark.range(200_000).selectExpr("CAST(NULL AS long) AS doc_id", "CAST(id AS string) AS text")
    from pyspark.sql import functions as F
    mark = F.xxhash64("doc_id", "text")
    assert 20 < df.where(drawn(mark, 50, 200_000)).count() < 90
    assert df.where(drawn(mark, 20_000, 10 ** 11)).count() <= 5          # share 2e-7: about none of these, not all
    assert spark.range(1).select(drawn(F.lit(-2 ** 63), 1, 10 ** 12)).first()[0]
    words = spark.range(3000).selectExpr("CAST(NULL AS long) AS doc_id",
                                         "concat('token=', sha2(CAST(id AS string), 256), ' readable_identifier anotherReadableName') AS text")
    assert secrets.fit(words, fit_docs=30) is not None


def test_rules_of_four_tokens(spark):
    """Only the four tokens together tell: no shorter rule is confident."""
    rng = random.Random(1)
    rows = []
    for i in range(1600):
        on = [bool(i >> k & 1) for k in range(4)]
        path = "/".join(t for t, o in zip("abcd", on) if o)
        rows.append((f"http://h{rng.randint(0, 9)}.net/{path}/{i}", all(on)))
    labelled = spark.createDataFrame(rows, "url string, bad boolean")
    rules = urls.mine(labelled).collect()
    assert [sorted(r["items"]) for r in rules] == [["p:a", "p:b", "p:c", "p:d"]]
    assert rules[0]["confidence"] == 1.0 and rules[0]["support"] == 100


def test_vectors_of_extreme_length(spark):
    rows = [(1, [1e200, 0.0]), (2, [1e200, 1e190]), (3, [1e-200, 0.0]), (4, [1.0, 0.0]), (5, [0.0, 1e-300])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in covertree.near_vectors(
        spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5)}


def test_one_id_on_many_texts(spark):
    """Two thousand texts share an id; near pairs among them link, and each set is made once."""
    rng = random.Random(2)
    texts = [" ".join(rng.choice(SAID) + str(rng.randint(0, 99)) for _ in range(40)) for _ in range(1000)]
    rows = [(7, t) for t in texts] + [(7, t + " end") for t in texts]
    got = collections.Counter(tuple(r) for r in minhash.near_duplicates(
        spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert sum(got.values()) == 2000 and all(k[0] == 7 and k[2] == 7 for k in got)
    kept = minhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).count()
    assert kept == 1000


def test_covering_radii_prune_blocks_of_planted_clusters(spark):
    """Forty clusters apart: blocks are clusters, and almost no two blocks meet."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(40, 24))
    x = np.repeat(centres, 100, axis=0) + 0.05 * rng.normal(size=(4000, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
    threshold = float(np.arccos(0.95))
    points, nodes = covertree.grow(df, threshold, block_rows=120)
    blocks = nodes.where("parent = -1").count()
    pairs = covertree.block_pairs(nodes, threshold).count()
    assert points.count() == 4000 and blocks >= 30
    assert pairs <= blocks + 0.1 * blocks * (blocks - 1) / 2, (pairs, blocks)
    # levels: every node but the root lies in its parent, radii at most halve the threshold at the leaves
    rows = nodes.toPandas()
    at = {(r.block, r.node): r for r in rows.itertuples()}
    for r in rows.itertuples():
        if r.parent >= 0:
            assert at[r.block, r.parent].k >= r.k and r.leaf != at[r.block, r.parent].leaf
        if r.leaf == r.leaf:
            assert r.reach <= threshold / 2
    assert rows[rows.leaf.notna()].k.sum() == 4000


def test_walk_looks_at_few_node_pairs():
    """Inside one block the walk from the root drops clusters whole."""
    rng = np.random.default_rng(1)
    x = np.repeat(rng.normal(size=(50, 24)), 60, axis=0)
    x = covertree._unit(x + 0.4 * rng.normal(size=x.shape))
    threshold = float(np.arccos(0.95))
    order, nodes = covertree._tree(x, threshold / 2)
    import pyarrow as pa
    table = pa.table({"node": pa.array(range(len(nodes)), pa.int32()), "parent": pa.array([t[2] for t in nodes], pa.int32()),
                      "leaf": pa.array([i if t[3] else None for i, t in enumerate(nodes)], pa.int64()),
                      "reach": pa.array([t[5] for t in nodes]), "centre": pa.array([t[4] for t in nodes], pa.list_(pa.float32()))})
    tree = covertree._Nodes(table)
    a, b, sure, seen = covertree._walk(tree, tree, True, 0.95, threshold)
    leaves = int(tree.is_leaf.sum())
    assert leaves > 1000 and seen < 0.25 * leaves * leaves
    x = x[order]
    spans = {i: t[:2] for i, t in enumerate(nodes) if t[3]}
    met = {(min(p, q), max(p, q)) for p, q in zip(a.tolist(), b.tolist())}
    of = np.empty(len(x), int)
    for i, (s, e) in spans.items():
        of[s:e] = i
    p, q = np.nonzero(np.triu(x @ x.T >= 0.95, 1))
    assert all(of[i] == of[j] or (min(of[i], of[j]), max(of[i], of[j])) in met for i, j in zip(p, q))


def test_spans_of_many_hits_take_linear_time(spark):
    """Four times the text takes at most about five times as long."""
    import time
    from pyspark.sql import functions as F
    from custlens.llm.secrets import base_spans, show

    def took(n):
        df = spark.createDataFrame([(n,)], "n long").select(F.expr(
            "array_join(transform(sequence(1, n), i -> concat('token=abcdefgh', i)), ' plain ')").alias("t")).cache()
        df.count()
        t = time.time()
        got = df.select(F.sha2(show(base_spans(F.col("t"))), 256), F.size(base_spans(F.col("t")))).first()
        assert got[1] == n
        return time.time() - t
    took(2000)
    small, large = took(8_000), took(32_000)
    assert large < 6 * small + 1.0, (small, large)


def test_running_sums(spark):
    from pyspark.sql import functions as F
    from custlens.llm.shared import running
    rows = [[], [5], [1, 2, 3], list(range(1000))]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "x array<int>").select(running(F.col("x"))).collect()]
    assert got == [np.cumsum(r).tolist() for r in rows]
