"""Secret scans: fixed patterns, and character Markov models.

Two first-order Markov models over characters, one of random strings and one
of ordinary identifiers, are counted from labelled samples: values that the
patterns find, and the other long words of the same texts.  A token, or what
pattern spans leave of it, is a secret when its log-likelihood ratio passes
``threshold`` nats in total and ``per_char`` nats a character.

Spans are in code points, end exclusive.  A pattern's position follows from
the lengths of the pieces between its matches, so everything stays in column
expressions.

Defined cases: a null text is an empty one without spans; a sample without
positives gives no model and so no added spans; long texts are scanned whole;
repeated rows get equal spans; an empty table gives an empty result; extra
columns are not touched.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bind, drawn, drop_table, running, write_table

#: Kinds of the fixed patterns, in order: pattern and whether a match counts.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
     lambda hit, pat: F.length(F.regexp_extract(hit, pat, 2)) >= 8),
    ("access", "AKIA[A-Z0-9]+", lambda hit, pat: F.length(hit) >= 16),
    # every run of 32 or more is one maximal run, so the count is in the pattern
    ("hex", "[0-9a-f]{32,}", None),
)
#: Characters of tokens; any token of 16 or more is scored, or each part of it beside pattern spans.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_=-"
TOKEN = "[A-Za-z0-9+/_=-]{16,}"
NAME = "[A-Za-z0-9+/_=-]{6,}"
#: Bound on the documents whose tokens the models are fitted on.
FIT_DOCS = 20_000
EMPTY = "array<struct<start:int,k:int,end:int,kind:string>>"


def _spans(text: Column, kind: str, k: int, pattern: str, counts, parts=None) -> Column:
    """Spans of one pattern: struct(start, k, end, kind), in order; ``parts``
    gives those that a hit and its span are replaced by."""
    def walk(hits):
        gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
        lens = F.transform(hits, lambda x: F.length(x))

        def at(g, n):
            ends = running(F.transform(n, lambda x, i: x + F.get(g, i)))
            return bind(ends, lambda e: F.transform(e, lambda x, i: F.struct(
                (x - F.get(n, i)).alias("start"), F.lit(k).alias("k"), x.alias("end"), F.lit(kind).alias("kind"))))
        found = bind(gaps, lambda g: bind(lens, lambda n: at(g, n)))
        if parts is not None:
            return bind(found, lambda s: F.flatten(F.transform(s, lambda x, i: parts(F.get(hits, i), x))))
        if counts is None:
            return found
        return bind(found, lambda s: F.filter(s, lambda x, i: counts(F.get(hits, i), pattern)))
    none = F.array().cast(EMPTY)
    return F.when(text.rlike(pattern), bind(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walk)).otherwise(none)


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns by start, then kind as listed."""
    return F.array_sort(F.concat(*[_spans(text, kind, k, pat, ok) for k, (kind, pat, ok) in enumerate(PATTERNS)]))


def fit(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", fit_docs: int = FIT_DOCS,
        smoothing: float = 0.5) -> list[float] | None:
    """Log-likelihood ratios per pair of characters (row-major over ALPHABET,
    a first row for the token's first character), random over ordinary."""
    n = docs.count()
    t = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.where(drawn(F.xxhash64(id_col, text_col), fit_docs, n)).select(t.alias("t"))
    t = F.col("t")
    secret = F.concat(*[
        F.when(t.rlike(pat), F.regexp_extract_all(t, F.lit(pat), F.lit(2 if kind == "assign" else 0)))
        .otherwise(F.array().cast("array<string>")) for kind, pat, _ in PATTERNS])
    secret = F.filter(secret, lambda x: F.length(x) >= 8)
    other = t
    for _, pat, _ in PATTERNS:
        other = F.when(other.rlike(pat), F.regexp_replace(other, pat, " ")).otherwise(other)
    names = F.regexp_extract_all(other, F.lit(NAME), F.lit(0))
    tokens = (some.select(F.explode(F.concat(
        F.transform(F.array_distinct(secret), lambda x: F.struct(x.alias("x"), F.lit(1).alias("y"))),
        F.transform(F.array_distinct(names), lambda x: F.struct(x.alias("x"), F.lit(0).alias("y"))))).alias("e"))
        .select("e.x", "e.y").distinct().where(F.col("x").rlike("^[A-Za-z0-9+/_=-]+$")))
    tokens = write_table(tokens, "tokens")
    model = _ratios(tokens, smoothing)
    if model is not None:
        # unlabelled secrets among the ordinary tokens: long ones that look random leave the sample
        odd = (F.col("y") == 0) & (F.length("x") >= 16)
        model = _ratios(tokens.where(~F.when(odd, score(F.col("x"), model) > 0).otherwise(False)), smoothing)
    drop_table(tokens)
    return model


def _ratios(tokens: DataFrame, smoothing: float) -> list[float] | None:
    pairs = tokens.select("y", F.explode(F.transform(
        F.sequence(F.lit(1), F.length("x")), lambda i: F.struct(
            F.when(i == 1, "").otherwise(F.substring(F.col("x"), i - 1, F.lit(1))).alias("a"),
            F.substring(F.col("x"), i, F.lit(1)).alias("b")))).alias("p"))
    size = len(ALPHABET)
    count = [[[0] * size for _ in range(size + 1)] for _ in range(2)]
    for r in pairs.groupBy("y", "p.a", "p.b").count().collect():      # at most 2 * 68 * 67 rows
        count[r["y"]][ALPHABET.index(r["a"]) + 1 if r["a"] else 0][ALPHABET.index(r["b"])] = r["count"]
    if not sum(map(sum, count[1])) or not sum(map(sum, count[0])):
        return None
    out = []
    for a in range(size + 1):
        rows = [count[y][a] for y in (1, 0)]
        total = [sum(x) + smoothing * size for x in rows]
        out += [math.log((rows[0][b] + smoothing) / total[0]) - math.log((rows[1][b] + smoothing) / total[1])
                for b in range(size)]
    return out


def score(token: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of a token, random against ordinary."""
    size = len(ALPHABET)
    table = F.split(F.lit(",".join(f"{x:.6f}" for x in model)), ",").cast("array<double>")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    return F.aggregate(
        F.sequence(F.lit(1), F.length(token)), F.struct(F.lit(0).alias("a"), F.lit(0.0).alias("s")),
        lambda acc, i: bind(place(i), lambda b: F.struct(
            b.alias("a"), (acc["s"] + F.get(table, acc["a"] * size + b - 1)).alias("s"))),
        lambda acc: acc["s"])


def scan(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", fit_docs: int = FIT_DOCS,
         threshold: float = 15.0, per_char: float = 0.5) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans`` (base ones and those the
    models add, none of which overlaps a base span)."""
    model = fit(docs, text_col, id_col, fit_docs)
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = docs.withColumn("base_spans", base_spans(text))
    if model is None:
        return out.withColumn("spans", F.col("base_spans"))

    base = F.col("base_spans")

    def secret(hit):
        return bind(score(hit, model), lambda s: (s > threshold) & (s > per_char * F.length(hit)))

    def parts(hit, token):
        return F.filter(_beside(token, base), lambda x: secret(
            F.substring(hit, x["start"] - token["start"] + 1, x["end"] - x["start"])))
    new = _spans(text, "markov", len(PATTERNS), TOKEN, None, parts)
    return out.withColumn("spans", F.array_sort(F.concat(base, new)))


def _beside(token: Column, base: Column) -> Column:
    """Parts of a token's span that no base span (sorted by start) covers."""
    part = lambda start, end: F.array(F.struct(
        start.alias("start"), token["k"].alias("k"), end.alias("end"), token["kind"].alias("kind")))
    cut = F.filter(base, lambda b: (b["start"] < token["end"]) & (token["start"] < b["end"]))
    return F.aggregate(
        cut, F.struct(token["start"].alias("pos"), F.array().cast(EMPTY).alias("out")),
        lambda acc, b: F.struct(
            F.greatest(acc["pos"], b["end"]).alias("pos"),
            F.when(b["start"] > acc["pos"], F.concat(acc["out"], part(acc["pos"], b["start"])))
            .otherwise(acc["out"]).alias("out")),
        lambda acc: F.when(acc["pos"] < token["end"], F.concat(acc["out"], part(acc["pos"], token["end"])))
        .otherwise(acc["out"]))


def show(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span (overlaps together) replaced by ``mark``."""
    keep = F.aggregate(
        spans, F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out")),
        lambda acc, x: F.struct(
            F.greatest(acc["pos"], x["end"]).alias("pos"),
            F.when(x["start"] < acc["pos"], acc["out"]).otherwise(F.concat(acc["out"], F.array(
                F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"]), F.lit(mark)))).alias("out")),
        lambda acc: F.concat(acc["out"], F.array(F.substring(text, acc["pos"] + 1, F.length(text)))))
    return F.when(F.size(spans) > 0, F.array_join(keep, "")).otherwise(text)
