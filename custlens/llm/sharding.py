"""Sharding by a hierarchical weighted hash tree (regions, racks, shards).

A document descends the tree; at every node each child draws ln(u) / weight
with u hashed from the document's key and the child's name, and the largest
draw wins.  Draws do not depend on the other children, so a change of weight
moves documents only into or out of the subtree where it happens.  A shard
added as a branch of its own therefore takes documents only into itself
(law ``key``: key and tree decide, no counts).

Slots number a shard's documents from 0: rows are numbered within (shard,
hash bucket) and offset by the counts of the buckets before, so no task holds
a whole shard.

Defined cases: a null text counts as empty; a null key draws by the text's
checksum; repeated rows get slots of their own in the same shard; an empty
table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import write_table

#: A tree is {name: (weight, subtree or shard number)}.
Tree = dict


def even_tree(regions: int, racks: int, shards: int) -> Tree:
    """Equal shards, numbered along the tree."""
    n = iter(range(regions * racks * shards))
    return {f"r{r}": (float(racks * shards), {
        f"r{r}k{k}": (float(shards), {f"s{i}": (1.0, i) for i in (next(n) for _ in range(shards))})
        for k in range(racks)}) for r in range(regions)}


def with_branch(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """One more shard, as a region and rack of its own."""
    return tree | {f"r+{shard}": (weight, {f"k+{shard}": (weight, {f"s{shard}": (weight, shard)})})}


def place(key: Column, tree: Tree) -> Column:
    """Shard number of a key."""
    def draw(name, weight):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(name), key), 11).cast("double") + 0.5) / float(1 << 53)
        return F.log(u) / weight
    kids = [(name, w, sub) for name, (w, sub) in tree.items() if w > 0]
    if not kids:
        raise ValueError("a tree node needs a child of positive weight")
    below = [sub if isinstance(sub, int) else None for _, _, sub in kids]
    if len(kids) == 1:
        return F.lit(below[0]).cast("int") if below[0] is not None else place(key, kids[0][2])
    best = F.array_max(F.array(*[F.struct(draw(n, w).alias("d"), F.lit(i).alias("i"))
                                 for i, (n, w, _) in enumerate(kids)]))["i"]
    if all(b is not None for b in below):
        return F.element_at(F.array(*[F.lit(b).cast("int") for b in below]), best + 1)

    def descend(i):
        out = None
        for j, (_, _, sub) in enumerate(kids):
            to = F.lit(sub).cast("int") if isinstance(sub, int) else place(key, sub)
            out = F.when(i == j, to) if out is None else out.when(i == j, to)
        return out
    from .shared import bind
    return bind(best, descend)


def shard(docs: DataFrame, tree: Tree, grown: Tree | None = None, id_col: str = "doc_id", text_col: str = "text",
          rows_per_bucket: int = 5_000) -> DataFrame:
    """Per document: doc_id, size (UTF-8 bytes plus 8), text_crc32, law,
    shard, slot, grown_shard (its shard in ``grown``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("~"), F.col("text_crc32").cast("string")))
    placed = write_table(
        base.withColumn("shard", place(key, tree))
        .withColumn("grown_shard", place(key, grown) if grown else F.lit(None).cast("int"))
        .withColumn("mix", F.xxhash64(key, F.lit("slot"))), "placed")
    buckets = max(1, -(-placed.count() // (rows_per_bucket * _leaves(tree))))
    rows = placed.withColumn("bucket", F.pmod("mix", F.lit(buckets)).cast("int")).drop("mix")
    at = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = (rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
              .select("shard", "bucket", F.coalesce(F.sum("n").over(at), F.lit(0)).alias("before")))
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32")
    return (rows.withColumn("k", F.row_number().over(inside) - 1).join(before, ["shard", "bucket"])
            .select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
                    (F.col("k") + F.col("before")).alias("slot"), "grown_shard"))


def _leaves(tree: Tree) -> int:
    return sum(1 if isinstance(sub, int) else _leaves(sub) for _, sub in tree.values())
