"""URL filters: host and path rules, and association rules mined from labels.

Association-rule filtering.  A URL is a set of tokens (words of the host, its
suffixes, words of the path, query keys).  Spark's FP-growth mines
token combinations of labelled URLs together with the label ``bad``; the rules
with ``bad`` as consequent are pruned by support, confidence and by shorter
rules that already say as much.  URLs meet rules through an inverted index: a
rule is posted under its rarest token only, and the hit is then checked for
the rule's other tokens.

The fixed rules judge first: a rule fits its host and all subdomains when the
path starts with its path; the longest wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path,
no rule, and is allowed; no labels, or none that say ``bad``, give no mined
rules and so ``allow``; repeated rows are judged alike; long URLs are read
whole; an empty table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bind, drawn, write_table

BAD = "!bad"
#: Rules of the list: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"),
         ("allow", "org", "/fr/"))
#: Bound on the labelled URLs that rules are mined from.
FIT_URLS = 200_000


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path: after the first ``://`` up to ``/``,
    ``?``, ``#`` or the end; then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    # the rest may hold line ends, which the classes take too
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null."""
    best = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        hit = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        best = F.when(fits, hit) if best is None else best.when(fits, hit)
    return best


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL, each marked with the part it is from; runs of
    digits count as one token."""
    host, path = host_path(url)
    mark = lambda arr, m: F.transform(F.filter(arr, lambda x: x != ""), lambda x: F.concat(F.lit(m), x))
    labels = bind(F.split(host, r"\.", -1), lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda i: F.concat(
        F.lit("d:"), F.array_join(F.slice(x, -i, i), "."))))
    words = mark(F.split(host, r"[.\-_]", -1), "w:")
    steps = mark(F.split(F.regexp_replace(path, "[0-9]+", "0"), r"[/.\-_]", -1), "p:")
    query = mark(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit(r"[?&]([^=&#?]+)="), F.lit(1)), "q:")
    return F.array_distinct(F.concat(labels, words, steps, query))


def mine(labelled: DataFrame, url_col: str = "url", bad_col: str = "bad", min_share: float = 1e-4,
         min_urls: int = 20, min_confidence: float = 0.8, fit_urls: int = FIT_URLS) -> DataFrame:
    """Rules (rule_id, items, anchor, support, confidence): URLs that hold all
    ``items`` are bad.  ``anchor`` is the rarest item.  A rule needs ``min_share``
    of the labelled URLs that are read, and ``min_urls`` of them; its length is
    bounded by confidence alone: it must beat every rule on fewer of its items."""
    spark = labelled.sparkSession
    rows = write_table(labelled.where(F.col(url_col).isNotNull()).select(
        tokens(F.col(url_col)).alias("t"), F.col(bad_col).cast("boolean").alias("bad"),
        F.xxhash64(url_col).alias("h")), "labelled")
    n, bad = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("bad"), 1).otherwise(0))).first()
    none = "rule_id long, items array<string>, anchor string, support long, confidence double"
    if n > fit_urls:
        rows = rows.where(drawn(F.col("h"), fit_urls, n))
        n, bad = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("bad"), 1).otherwise(0))).first()
    if not n or not bad:
        return spark.createDataFrame([], none)
    min_support = max(min_urls, math.ceil(min_share * n))
    # what bad URLs hold often enough is all a rule can be made of
    bad_rows = rows.where("bad")
    often = (bad_rows.select(F.explode("t").alias("x")).groupBy("x").count()
             .where(F.col("count") >= min_support))
    total = (rows.select(F.explode("t").alias("x"), "h").groupBy("x")
             .agg(F.count(F.lit(1)).alias("df"), F.sum(F.col("h").cast("decimal(38,0)")).alias("where")))
    # tokens of the same URLs are one item, and a token of every URL narrows no other
    one = (often.join(total, "x").where((F.col("df") < n) | F.lit(bad >= min_confidence * n))
           .groupBy("df", "where").agg(F.min("x").alias("x")))
    items = [r["x"] for r in one.orderBy("x").select("x").collect()]
    if not items:
        return spark.createDataFrame([], none)
    baskets = rows.select(F.concat(
        F.array_intersect("t", F.split(F.lit("\n".join(items)), "\n")),
        F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items"))
    fp = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support / max(1, n)),
                  numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions")))
    # rules come from the sets that hold the label, which is all that is asked for
    sets = write_table(fp.fit(baskets).freqItemsets.select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    with_bad = (sets.where(F.array_contains("items", BAD) & (F.size("items") > 1))
                .select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("support")))
    found = (with_bad.join(sets, "items").withColumn("confidence", F.col("support") / F.col("freq"))
             .where(F.col("confidence") >= min_confidence).select("items", "confidence", "support").collect())
    best: dict[tuple, tuple] = {}
    for r in sorted(found, key=lambda r: (len(r["items"]), r["items"])):
        key = tuple(r["items"])
        inside = [v[0] for k, v in best.items() if set(k) < set(key)]
        if not inside or r["confidence"] > max(inside) + 1e-9:      # a shorter rule says as much
            best[key] = (r["confidence"], r["support"])
    df = {r["x"]: r["df"] for r in total.where(F.col("x").isin(*sorted({i for k in best for i in k}))).collect()} \
        if best else {}
    return spark.createDataFrame(
        [(k, list(key), min(key, key=lambda x: (df.get(x, math.inf), x)), int(s), float(c))
         for k, (key, (c, s)) in enumerate(sorted(best.items()))], none)


def matches(urls: DataFrame, rules: DataFrame, id_col: str, token_col: str) -> DataFrame:
    """Ids of URLs that some mined rule says are bad, once each."""
    posted = urls.select(id_col, token_col, F.explode(token_col).alias("anchor"))
    hit = posted.join(rules.select("anchor", "items"), "anchor").where(
        F.size(F.array_except("items", token_col)) == 0)
    return hit.select(id_col).distinct()


def judge(pages: DataFrame, labelled: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES,
          **mining) -> DataFrame:
    """Per page: id, host, path, rule, verdict, and by whom."""
    mined = mine(labelled, **mining)
    host, path = host_path(F.col(url_col))
    # distinct URLs are judged once, and keyed by the URL: ids may repeat
    rows = pages.select(F.col(id_col), F.col(url_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", listed(F.col("host"), F.col("path"), rules))
    open_urls = (rows.where(F.col("fit").isNull() & (F.col("host") != "")).select(F.col(url_col).alias("u")).distinct()
                 .withColumn("t", tokens(F.col("u"))))
    bad = matches(open_urls, mined, "u", "t").withColumn("mined", F.lit(True))
    return (rows.join(bad, F.col(url_col) == F.col("u"), "left")
            .select(id_col, "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce(F.col("fit.verdict"), F.when(F.col("mined"), "block"), F.lit("allow")).alias("verdict"),
                    F.when(F.col("fit").isNotNull(), "list").when(F.col("mined"), "mined").alias("decided_by")))
