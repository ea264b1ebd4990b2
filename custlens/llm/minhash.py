"""MinHash near-duplicate groups by a signature-coordinate inverted join.

1. Each text becomes its set of distinct 5-word shingles (64-bit hashes) and a
   MinHash signature.  Texts with equal sets are one class, compared once.
2. Classes are posted under their (coordinate, value) pairs.  Two classes are
   candidates when at least ``matches`` of the ``coordinates`` agree, so values
   that only one class has are dropped, and of the rest, rarest first, a class
   needs posting only under its first coordinates - matches + 1 (prefix).
   Values that many texts share through a common passage come last and are
   mostly never posted.
3. Lists of at most ``short_list`` classes are joined with themselves.  Longer
   lists are linked by stars first: members against those of up to ``hubs``
   drawn members that agree best; members of one component then are skipped,
   and so are members that have too many shingles to themselves for any link;
   only pairs across components remain.  A pair survives if it is the first
   list both share, set sizes allow the threshold and enough coordinates agree.
4. Candidates are confirmed on their full sets; components follow from the
   links.  What is left across components is compared in blocks of a list,
   each pair of blocks a task of bounded size, and only links leave it.

A pair at similarity 0.75 misses step 2 with probability 2e-6 (32 coordinates,
12 matches), a closer one far less.

Defined cases: a null text, or one without words, has an empty set and links
with nothing; fewer than five words are one shingle; long texts are taken
whole; repeated rows are one class; of rows with one id each is returned; rows
without an id link like others, and of a component without any id the rows of
its smallest ``text_key`` are kept; an empty table gives an empty result; extra
columns are not touched.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, connected_components, meet, write_table

#: Distinct words a Python worker remembers the hash of.
CACHE_WORDS = 500_000


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash
        h = xxhash.xxh64_intdigest(word)
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h
        return h


def shingle_set(text: str | None, known: dict, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; words split on ASCII white space, A-Z
    lower-cased."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out + h[k:len(h) - n + 1 + k] * np.uint64(2 * k + 1))
    return np.unique(out)


_FACTORS = np.random.default_rng(8).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _signature(s: np.ndarray, coordinates: int) -> np.ndarray:
    """Smallest of each coordinate's multiplicative hash, 31 bits of it."""
    low = np.full(coordinates, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 2048):
        np.minimum(low, (s[at:at + 2048, None] * _FACTORS[:coordinates]).min(axis=0), out=low)
    return (low >> np.uint64(16) & np.uint64(0x7FFFFFFF)).astype(np.int32)


def _sign(coordinates: int, width: int):
    def run(batches):
        import pyarrow as pa
        known = _WordHash()
        for batch in batches:
            n, key, sig = [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py(), known, width)
                n.append(len(s))
                key.append(_key(s))
                sig.append(_signature(s, coordinates) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(key, pa.binary()),
                 pa.array(sig, pa.list_(pa.int32()))], ["doc_id", "text_key", "n_shingles", "set_key", "sig"])
    return run


def _key(s: np.ndarray) -> bytes | None:
    import xxhash
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _sets(width: int):
    """Sets of (class, expected key, text); an id may name other texts too."""
    def run(batches):
        import pyarrow as pa
        known = _WordHash()
        for batch in batches:
            c, sets = [], []
            for at, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                s = shingle_set(text.as_py(), known, width)
                if _key(s) == key:
                    c.append(at)
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                                             ["c", "s"])
    return run


def _agree(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def _sized(percent: int) -> Column:
    """Set sizes allow the threshold."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets reach the threshold, compared in full."""
    left = meet(pairs, sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
    return (meet(left, sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
            .where(_reached(percent)).select("a", "b"))


def _reached(percent: int) -> Column:
    both = F.size(F.array_intersect("sa", "sb"))
    return 100 * both >= percent * (F.size("sa") + F.size("sb") - both)


def _across(percent: int, matches: int, tile: int = 256):
    """Links between components among two blocks of a list (or one with
    itself): signatures first, then full sets of the pairs that first meet here."""
    def run(key, table):
        import pyarrow as pa
        at, i, j = (k.as_py() for k in key)
        mine = table.column("mine").to_numpy()
        c, p = table.column("c").to_numpy(), table.column("p").to_numpy()
        grid = lambda name: np.array(table.column(name).to_pylist())
        sig = grid("sig")
        posted = np.zeros(sig.shape, bool)          # coordinates before this one that a member is posted under
        for r, lists in enumerate(table.column("lists").to_pylist()):
            posted[r, [x >> 32 for x in lists if x < at]] = True
        sets = [np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in table.column("s").combine_chunks()] \
            if len(c) else []
        n = np.array([len(x) for x in sets])
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        out_a, out_b = [], []
        for k in range(0, len(left), tile):
            rows = left[k:k + tile]
            low, high = np.minimum(n[rows][:, None], n[right]), np.maximum(n[rows][:, None], n[right])
            near = (p[rows][:, None] != p[right]) & (100 * low >= percent * high)
            if i == j:
                near &= rows[:, None] < right
            u, v = np.nonzero(near)
            u, v = rows[u], right[v]
            for z in range(0, len(u), 200_000):
                x, y = u[z:z + 200_000], v[z:z + 200_000]
                equal = sig[x] == sig[y]
                good = (equal.sum(axis=1) >= matches) & ~(equal & posted[x] & posted[y]).any(axis=1)
                for q, r in zip(x[good], y[good]):
                    both = len(np.intersect1d(sets[q], sets[r], assume_unique=True))
                    if 100 * both >= percent * (n[q] + n[r] - both):
                        out_a.append(min(c[q], c[r]))
                        out_b.append(max(c[q], c[r]))
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64())})
    return run


def text_key(text: Column) -> Column:
    """128 bits of a text, as hexadecimal digits."""
    return F.md5(text.cast("binary"))


def _components(docs: DataFrame, id_col: str, text_col: str, percent: int, coordinates: int, matches: int, width: int,
                short_list: int, hubs: int, spokes_each: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, n_shingles, set_key) per row, and (set_key, component
    number p) of all sets that are not empty."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                      text_key(F.col(text_col)).alias("text_key"))
    signed = write_table(src.mapInArrow(_sign(coordinates, width),
                                        "doc_id long, text_key string, n_shingles long, set_key binary, sig array<int>"), "signed")
    # one class per set, numbered by the set's hash; its smallest document stands for it
    classes = write_table(signed.where("set_key is not null").groupBy("set_key").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key", "n_shingles", "sig")).alias("x"))
        .select("set_key", F.xxhash64("set_key").alias("c"), F.col("x.doc_id").alias("doc_id"),
                F.col("x.text_key").alias("text_key"),
                F.col("x.n_shingles").alias("n"), F.col("x.sig").alias("sig")), "classes")

    # (coordinate, value) as one number
    values = classes.select("c", "n", F.explode(F.transform("sig", lambda v, i: F.shiftleft(i.cast("long"), 32) + v))
                            .alias("at"))
    common = values.groupBy("at").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = meet(values, common, "at").groupBy("c", "n").agg(
        F.array_sort(F.collect_list(F.struct("df", "at"))).alias("t")).where(F.size("t") >= matches)
    # values of its own are the rarest: they fill the prefix first
    prefix = F.slice("t", 1, F.size("t") - matches + 1)
    posted = write_table(
        meet(shared.select("c", "n", prefix.alias("t")), classes.select("c", "sig"), "c")
        .select("c", "n", "sig", F.explode("t").alias("x"), F.transform("t", lambda x: x["at"]).alias("lists"))
        .select("x.at", "x.df", "c", "n", "sig", "lists"), "posted")

    def side(rows, x, *more):
        return rows.select("at", F.col("c").alias(x), F.col("n").alias("n" + x), F.col("sig").alias("g" + x),
                           F.col("lists").alias("l" + x), *more)

    near = _sized(percent) & (_agree(F.col("ga"), F.col("gb")) >= matches)
    first = F.array_min(F.array_intersect("la", "lb")) == F.col("at")      # a pair meets in one list

    brief = posted.where(F.col("df") <= short_list)
    a, b = side(brief, "a"), side(brief, "b").withColumnRenamed("at", "at_b")
    pairs = meet(a, b, (F.col("at") == F.col("at_b")) & (F.col("a") < F.col("b")) & _sized(percent) & first & near) \
        .select("a", "b")

    long_rows = posted.where(F.col("df") > short_list)
    # hubs: up to ``hubs`` members of a list, the smallest hash of each residue
    mix = F.xxhash64("c", F.lit("hub"))
    picked = (long_rows.groupBy("at", F.pmod(mix, F.lit(hubs)).alias("slot"))
              .agg(F.min_by(F.struct("c", "n", "sig"), mix).alias("h")).groupBy("at")
              .agg(F.collect_list("h").alias("hubs")))
    # a member looks at the hubs of its longest, middle and shortest long list
    ranked = F.array_sort(F.collect_list(F.struct("df", "at")))
    looks = (long_rows.groupBy("c", "n").agg(ranked.alias("t"))
             .select("c", "n", F.explode(F.array_distinct(F.transform(F.array(
                 F.lit(0), F.floor((F.size("t") - 1) / 2).cast("int"), F.size("t") - 1),
                 lambda i: F.get("t", i)["at"]))).alias("at")))
    agreed = F.filter(F.transform("hubs", lambda h: F.struct(
        F.when((h["c"] != F.col("c")) & (100 * F.least(h["n"], F.col("n")) >= percent * F.greatest(h["n"], F.col("n"))),
               _agree(h["sig"], F.col("sig"))).otherwise(0).alias("k"), h["c"].alias("h"))), lambda x: x["k"] >= matches)
    spokes = (meet(looks, classes.select("c", "sig"), "c").join(picked, "at")
              .select("c", F.explode(F.slice(F.sort_array(agreed, asc=False), 1, spokes_each)).alias("x"))
              .select(F.least("c", "x.h").alias("a"), F.greatest("c", "x.h").alias("b")))
    pairs = pairs.union(spokes)
    pairs = write_table(pairs.distinct(), "pairs")

    # sets of the classes in candidate pairs and in long lists, made once
    needed = meet(pairs.select(F.col("a").alias("c")).union(pairs.select("b")).union(long_rows.select("c")).distinct(),
                  classes.select("c", "set_key", "doc_id", "text_key"), "c")
    with_text = meet(needed, src, ["doc_id", "text_key"]).select("c", "set_key", "text")
    # a class without any id finds its text by the text's key
    nameless = src.where("doc_id is null").dropDuplicates(["text_key"]).select("text_key", "text")
    with_text = with_text.union(meet(needed.where("doc_id is null"), nameless, "text_key").select("c", "set_key", "text"))
    sets = write_table(with_text
                       .mapInArrow(_sets(width), "c long, s array<long>"), "sets")
    if sets.count() > needed.count():      # repeated rows
        sets = write_table(sets.dropDuplicates(["c"]), "sets")
    links = write_table(_confirm(pairs, sets, percent), "links")
    parts = connected_components(links)

    # a member with more than its share of shingles that no other member has links with none
    for _ in range(2):
        members = long_rows.select("c").distinct()
        own = (meet(sets, members, "c").select("c", F.size("s").alias("n"), F.explode("s").alias("x"))
               .groupBy("x").agg(F.count(F.lit(1)).alias("k"), F.min("c").alias("c"), F.min("n").alias("n"))
               .where("k = 1").groupBy("c", "n").agg(F.count(F.lit(1)).alias("own"))
               .where(100 * F.col("own") > (100 - percent) * F.col("n")))
        long_rows = write_table(long_rows.join(own.select("c"), "c", "left_anti"), "open")

    # what long lists still hold across components: members outside a list's largest component against all
    rest = (meet(long_rows, parts, F.col("c") == F.col("id"), "left")
            .withColumn("p", F.coalesce("component", "c")).drop("id", "component"))
    largest = (rest.groupBy("at", "p").agg(F.count(F.lit(1)).alias("k")).groupBy("at")
               .agg(F.max_by("p", F.struct("k", "p")).alias("most"), F.count(F.lit(1)).alias("parts"))
               .where("parts > 1").select("at", "most"))
    rest = meet(rest.join(largest, "at"), sets, "c")
    # a list's members in hashed blocks; each pair of blocks is one bounded comparison
    cut = F.ceil(F.col("size") / block).cast("int")
    cells = (rest.join(posted.groupBy("at").agg(F.count(F.lit(1)).alias("size")), "at")
             .withColumn("mine", F.pmod(F.xxhash64("c"), cut).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), cut - 1)))
             .select("at", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "c", "p",
                     "sig", "lists", "s"))
    across = write_table(cells.groupBy("at", "i", "j").applyInArrow(_across(percent, matches), "a long, b long")
                         .distinct(), "across")
    if not across.isEmpty():
        parts = connected_components(links.union(across))

    of_set = meet(classes, parts, F.col("c") == F.col("id"), "left").select("set_key", F.coalesce("component", "c").alias("p"))
    return signed.select("doc_id", "text_key", "n_shingles", "set_key"), of_set


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
                    coordinates: int = 32, matches: int = 12, width: int = 5, short_list: int = 24,
                    hubs: int = 64, spokes_each: int = 4,
                    block: int = 1000) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept."""
    signed, of_set = _components(docs, id_col, text_col, percent, coordinates, matches, width, short_list, hubs,
                                 spokes_each, block)
    ids = signed.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("doc_id"), F.min("text_key").alias("low_key"))
    smallest = meet(of_set, ids, "set_key").groupBy("p").agg(
        F.min("doc_id").alias("component_id"), F.min("low_key").alias("low_key"))
    named = meet(of_set, smallest, "p").select("set_key", "component_id", "low_key")
    first = F.col("component_id").isNotNull() | F.col("text_key").eqNullSafe(F.col("low_key"))
    out = ["doc_id", "n_shingles", "component_id",
           (F.col("doc_id").eqNullSafe(F.col("component_id")) & first).alias("kept")]
    empty = signed.where("set_key is null").withColumns({"component_id": F.col("doc_id"), "low_key": F.col("text_key")})
    return meet(signed, named, "set_key").select(*out).union(empty.select(*out))


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 75,
              coordinates: int = 32, matches: int = 12, width: int = 5, short_list: int = 24, hubs: int = 64,
              spokes_each: int = 4, block: int = 1000) -> DataFrame:
    """One row of ``docs`` per component and all rows with an empty set.

    A component's row is the one with the smallest id, null last, then the
    smallest ``text_key``, then the smallest other columns; rows are told apart
    by id and text, so neither a repeated id nor a missing one takes other
    texts with it."""
    signed, of_set = _components(docs, id_col, text_col, percent, coordinates, matches, width, short_list, hubs,
                                 spokes_each, block)
    # rows of one id and text are counted: they are told apart only where the chosen one repeats
    rows = signed.where("set_key is not null").groupBy("set_key", "doc_id", "text_key").agg(
        F.count(F.lit(1)).alias("times"))
    first = write_table(meet(rows, of_set, "set_key").groupBy("p").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "times")).alias("x"))
        .select(F.col("x.doc_id").alias("first_id"), F.col("x.text_key").alias("first_key"), "x.times"), "first")
    text = F.coalesce(F.col(text_col), F.lit(""))
    blank = ~text.rlike(WORD)
    chosen = meet(docs.where(~blank), first, F.col(id_col).cast("long").eqNullSafe(F.col("first_id"))
                  & (text_key(F.col(text_col)) == F.col("first_key")))
    once = chosen.where("times = 1").select(*docs.columns)
    if not first.where("times > 1").isEmpty():
        once = once.union(chosen.where("times > 1").groupBy("first_id", "first_key").agg(
            F.min(F.struct(*docs.columns)).alias("x")).select(*[F.col("x")[c].alias(c) for c in docs.columns]))
    return once.union(docs.where(blank))
