"""Quality rules as a short-circuit cascade.

Each rule says which texts it rejects.  On a bounded sample every rule's time
and rejections are measured; rules then run in the order of rejections per
cost, as branches of one CASE expression, so a rule only sees the texts all
earlier ones let through.  The order changes the cost, never the verdict:
a text is kept when no rule rejects it.

Defined cases: a null text has no words (and fails the length rule); empty
and very long texts are counted whole; repeated rows are judged alike; an
empty table keeps the given rule order and gives an empty result; columns of
the input are returned as they are, and the added ones must not clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, bind, drop_table, write_table

#: Rows of the sample on which costs and selectivities are estimated.
SAMPLE_ROWS = 2_000
SYMBOLS = "#*$%&|<>"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE, -1), "")


def word_chars(text: Column) -> Column:
    """Code points outside white space."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[^" + SYMBOLS + "]+", "")).cast("long")


def lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def dup_lines(text: Column) -> Column:
    return bind(lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def repeated_words(ws: Column, width: int = 5) -> Column:
    """Words covered by windows of ``width`` words that occur twice or more in
    the text.  Windows are compared by 64-bit hash; texts without an equal
    pair (the most) stop after a set of hashes, others sort theirs."""
    def covered(h):
        by_hash = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
        twice = bind(by_hash, lambda s: F.filter(s, lambda x, i: F.coalesce(
            F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))))
        at = F.array_sort(F.transform(twice, lambda x: x["p"]))
        return bind(at, lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(width), F.coalesce(F.get(p, i + 1) - x, F.lit(width)))),
            F.lit(0), lambda acc, x: acc + x))

    def windows(h):
        n = F.size(h)
        return F.when(n < width, F.lit(0)).otherwise(bind(
            F.transform(F.sequence(F.lit(0), n - width),
                        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)])),
            lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(covered(g))))
    return bind(F.transform(ws, lambda w: F.xxhash64(w)), windows).cast("long")


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Column], Column]      # of the text column


#: The two rules every text must pass.
BASE_RULES = (
    Rule("few_words", lambda t: F.size(words(t)) < 10),
    Rule("repeated_windows", lambda t: bind(words(t), lambda w: 100 * repeated_words(w) > 20 * F.size(w))),
)
#: Scripts written without spaces, where a word of white space is no word: not measured by length.
UNSPACED = (r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTibetan}"
            r"\u3000-\u303F\uFF00-\uFFEF]")
#: Further rules; limits leave prose of every length and language alone.
MORE_RULES = (
    Rule("symbols", lambda t: 100 * symbol_count(t) > 5 * word_chars(t)),
    Rule("duplicate_lines", lambda t: bind(lines(t), lambda x:
         2 * (F.size(x) - F.size(F.array_distinct(x))) > F.size(x))),
    Rule("word_length", lambda t: bind(F.size(words(t)), lambda n:
         (n > 0) & (((word_chars(t) > 20 * n) & (word_chars(F.regexp_replace(t, UNSPACED, "")) > 20 * n))
                    | (2 * word_chars(t) < 3 * n)))),
    Rule("stutter", lambda t: bind(words(t), lambda w: 10 * F.size(F.filter(
        w, lambda x, i: F.coalesce(F.get(w, i - 1) == x, F.lit(False)))) > 3 * F.size(w))),
)


def estimate(docs: DataFrame, rules: tuple[Rule, ...], text_col: str = "text",
             sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on a sample, best rejection per cost
    first; ties keep the given order."""
    texts = docs.select(F.col(text_col).alias("text"))
    share = min(1.0, sample_rows / max(1, texts.count()))
    sample = write_table(texts.sample(False, share, 4), "sample")

    def timed(col):
        began = time.perf_counter()
        n, hits = sample.agg(F.count(F.lit(1)), F.sum(F.when(col, 1).otherwise(0))).first()
        return time.perf_counter() - began, (hits or 0) / max(n, 1)

    timed(F.length("text") < 0)
    idle = timed(F.length("text") < 0)[0]
    found = []
    for r in rules:
        took, share = timed(r.rejects(F.col("text")))
        found.append((r, max(took - idle, 1e-3), share))
    drop_table(sample)
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(text: Column, ordered: list[Rule]) -> Column:
    """Name of the first rule that rejects, else null."""
    out = None
    for r in ordered:
        out = F.when(r.rejects(text), r.name) if out is None else out.when(r.rejects(text), r.name)
    return out if out is not None else F.lit(None).cast("string")


def judge(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES,
          sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``rejected_by`` (null: kept)."""
    order = [r for r, _, _ in estimate(docs, rules, text_col, sample_rows)]
    return docs.withColumn("rejected_by", cascade(F.col(text_col), order))


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             rules: tuple[Rule, ...] = MORE_RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The counts of every text, its base verdict, and ``kept``: the cascade
    runs on texts that the base rules let through."""
    order = [r for r, _, _ in estimate(docs, rules, text_col, sample_rows)]
    t = F.col("text")
    counted = docs.select(
        F.col(id_col).alias("doc_id"), t if text_col == "text" else F.col(text_col).alias("text"),
        bind(words(F.col(text_col)), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words"))).alias("w"),
        word_chars(F.col(text_col)).alias("word_chars"), symbol_count(F.col(text_col)).alias("n_symbols"),
        dup_lines(F.col(text_col)).alias("n_dup_lines"))
    n, rep = F.col("w.n_words"), F.col("w.n_repeat_words")
    failed = (n < 10) | (100 * rep > 20 * n)
    return counted.select("doc_id", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
                          rep.alias("n_repeat_words"), failed.alias("base_failed"),
                          F.when(failed, F.lit(False)).otherwise(cascade(t, order).isNull()).alias("kept"))
