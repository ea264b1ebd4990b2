"""The corpus operators bound to the benchmark tables, one query each."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from . import (chat, covertree, htmltext, minhash, mixing, packing, prefixtrie, quality, secrets, sharding, urls, vptree,
               whitening)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
#: Pruning of op13's trees; one is exact search.
RELAX = 1.0


def _query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql.strip()
        return f
    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op1_best_fit_packing")
def op1(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@_query("op2_source_mixing")
def op2(spark, sf_dir):
    return mixing.mix(_table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


@_query("op3_secret_scan")
def op3(spark, sf_dir):
    found = secrets.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", n("assign").alias("n_assign"), n("access").alias("n_access"), n("hex").alias("n_hex"),
        F.sha2(secrets.show(F.col("base_spans")), 256).alias("base_sha256"),
        secrets.show(F.col("spans")).alias("spans"), n("markov").alias("n_markov"))


@_query("op4_quality_rules")
def op4(spark, sf_dir):
    return quality.measures(_table(spark, sf_dir, "documents"))


@_query("op5_sharding")
def op5(spark, sf_dir):
    tree = sharding.even_tree(2, 3, 4)
    return sharding.shard(_table(spark, sf_dir, "documents"), tree, sharding.with_branch(tree, 24))


def _as_events(rows):
    """Every row as a message of its own in a log: a streamed draft that an edit
    (a regeneration, for the assistant) takes back, then the text in streamed
    pieces.  Rows without a turn come first."""
    n = F.coalesce(F.length("text"), F.lit(0))
    cut = (n / 3).cast("int")
    piece = lambda at, size: F.substring(F.coalesce("text", F.lit("")), at, size)
    first = piece(F.lit(1), cut)
    again = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")
    log = F.array(*[F.struct(F.lit(i).alias("i"), event.alias("event"), text.alias("text")) for i, (event, text) in enumerate([
        (F.lit("delta"), F.concat(F.lit("draft "), first)), (again, first), (F.lit("delta"), piece(cut + 1, cut)),
        (F.lit("delta"), piece(2 * cut + 1, n))])])
    # ids of equal rows differ; their order does not matter
    message = F.concat_ws(":", F.hex(F.xxhash64("role", "text")), F.monotonically_increasing_id())
    turn = F.coalesce("turn", F.lit(-2 ** 58))
    named = rows.select("conv_id", turn.alias("turn"), message.alias("message"), "role", "text")
    return named.select("conv_id", "turn", "message", "role", F.explode(log).alias("e")).select(
        "conv_id", (F.col("turn") * 8 + F.col("e.i")).alias("seq"), "e.event", "message", "role", "e.text")


@_query("op6_chat_formatting")
def op6(spark, sf_dir):
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(1).select(F.explode(F.array(
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(0).cast("long").alias("turn"),
                 F.lit("user").alias("role"), F.lit(said).alias("text")),
        F.struct(F.lit(-7).cast("long").alias("conv_id"), F.lit(1).cast("long").alias("turn"),
                 F.lit("assistant").alias("role"), F.lit(said).alias("text")))).alias("x")).select("x.*")
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.render(chat.conversations(_as_events(rows)))
    back = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                      F.array_join(chat.read_loss(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    digest = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(digest, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
                       F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))


@_query("op7_url_filter")
def op7(spark, sf_dir):
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    labels = _table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1))
                                                    .alias("bad"))
    # the number in a page's path is the document it shows
    doc = F.regexp_extract(urls.host_path(F.col("url"))[1], r"/([0-9]{1,18})(?:[^0-9]|$)", 1)
    labelled = (pages.select("url", F.when(doc != "", doc).cast("long").alias("doc_id"))
                .join(labels, "doc_id").groupBy("url").agg(F.max("bad").alias("bad")))
    return urls.judge(pages, labelled)


@_query("op8_minhash_dedup")
def op8(spark, sf_dir):
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


@_query("op9_html_text")
def op9(spark, sf_dir):
    return htmltext.extract(_table(spark, sf_dir, "pages"))


@_query("op10_cover_tree_dedup")
def op10(spark, sf_dir):
    return covertree.near_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@_query("op11_embedding_whitening")
def op11(spark, sf_dir):
    out = whitening.whiten(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return out.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@_query("op12_prefix_trie")
def op12(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return prefixtrie.trie(prefixtrie.rebuilt(rows))


@_query("op13_vantage_point_search")
def op13(spark, sf_dir):
    trees = vptree.index(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return vptree.search(trees, trees.nodes.where("vec_id % 50 = 0"), 5, RELAX)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
