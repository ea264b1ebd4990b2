"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events.  Events of one message are folded first
(so a hot conversation spreads over its messages), messages are then put in
the order of their first event, cut back by regenerations and rendered.

Events, by sequence number:

* ``message`` a whole message (several under one id stay messages of their own);
* ``delta`` streamed text, appended to the message;
* ``edit`` the message's text from here on;
* ``regenerate`` the message starts anew with this text, and messages that
  began between its first event and this one are dropped.

Template: every turn is ``<s>[role]text</s>``; in roles and texts the four
characters ``\\ < [ ]`` are written ``\\b \\l \\k \\j``, so no control string
of this template (or of the usual ``[INST]`` and ``</s>`` ones) can occur in
them, and unescaping restores them exactly.  The loss mask covers the escaped
text of assistant turns, as byte offsets into the UTF-8 of the output.

Defined cases: a null text or role is an empty one; equal sequence numbers
order by message id, then role, then text; repeated rows are repeated turns
(``message``); rows of a null conversation are one conversation; an unknown
event raises; an empty table gives an empty result; extra columns are not
touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import bind, running

ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\k"), ("]", "\\j"))
OPEN, MIDDLE, CLOSE = "<s>[", "]", "</s>"


def escape(x: Column) -> Column:
    for plain, coded in ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(coded))
    return x


def unescape(x: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        x = F.replace(x, F.lit(coded), F.lit(plain))
    return x


def fold_messages(events: DataFrame) -> DataFrame:
    """(conv_id, message) -> first sequence number, role, texts (one, or one
    per ``message`` event) and where a regeneration restarted it."""
    e = F.struct("seq", "event", F.coalesce("role", F.lit("")).alias("role"),
                 F.coalesce("text", F.lit("")).alias("text"))
    known = F.when(F.col("event").isin("message", "delta", "edit", "regenerate"), F.col("event")).otherwise(
        F.raise_error(F.concat(F.lit("unknown chat event "), F.coalesce("event", F.lit("null")))))
    got = (events.withColumn("event", known).groupBy("conv_id", "message")
           .agg(F.array_sort(F.collect_list(e)).alias("log")))
    starts = F.transform(F.col("log"), lambda x, i: F.when(x["event"] != "delta", i).otherwise(0))
    live = F.slice(F.col("log"), F.array_max(starts) + 1, F.size("log"))
    stream = F.array(F.array_join(F.transform(live, lambda x: x["text"]), ""))
    whole = F.forall("log", lambda x: x["event"] == "message")
    return got.select(
        "conv_id", "message", F.col("log")[0]["seq"].alias("seq"), F.col("log")[0]["role"].alias("role"),
        F.when(whole, F.transform("log", lambda x: x["text"])).otherwise(stream).alias("texts"),
        F.array_max(F.transform(F.filter("log", lambda x: x["event"] == "regenerate"),
                                lambda x: x["seq"])).alias("restart"))


def conversations(events: DataFrame) -> DataFrame:
    """conv_id -> turns, the final messages in order: array of (role, text)."""
    m = fold_messages(events).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("seq", "message", "role", "texts", "restart"))).alias("all"))
    cuts = F.filter("all", lambda x: x["restart"].isNotNull())
    kept = bind(cuts, lambda c: F.when(F.size(c) == 0, F.col("all")).otherwise(F.filter(
        F.col("all"), lambda x: ~F.exists(c, lambda y: (y["message"] != x["message"]) & (y["seq"] < x["seq"])
                                          & (x["seq"] < y["restart"])))))
    return m.select("conv_id", F.flatten(F.transform(kept, lambda x: F.transform(
        x["texts"], lambda t: F.struct(x["role"].alias("role"), t.alias("text"))))).alias("turns"))


def render(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id -> formatted, loss_mask (array of byte start and length)."""
    coded = F.transform("turns", lambda x: F.struct(
        F.concat(F.lit(OPEN), escape(x["role"]), F.lit(MIDDLE)).alias("head"), escape(x["text"]).alias("body"),
        x["role"].isin(*trained).alias("train")))
    bytes_of = lambda x: F.octet_length(x["head"]) + F.octet_length(x["body"]) + len(CLOSE)

    out = turns.select("conv_id", coded.alias("coded"))
    # where each turn starts: its end less its size
    starts = bind(F.transform("coded", lambda x: bytes_of(x)),
                  lambda n: F.transform(running(n), lambda x, i: x - F.get(n, i)))
    mask = bind(starts, lambda s: F.filter(F.transform("coded", lambda x, i: F.when(x["train"], F.struct(
        (F.get(s, i) + F.octet_length(x["head"])).alias("start"), F.octet_length(x["body"]).alias("length")))),
        lambda x: x.isNotNull()))
    return out.select("conv_id", F.array_join(F.transform("coded", lambda x: F.concat(
        x["head"], x["body"], F.lit(CLOSE))), "").alias("formatted"), mask.alias("loss_mask"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) turns of a formatted conversation."""
    parts = F.filter(F.split(formatted, CLOSE, -1), lambda x: x != "")
    return F.transform(parts, lambda x: bind(F.instr(x, MIDDLE), lambda m: F.struct(
        unescape(F.substring(x, F.lit(len(OPEN) + 1), m - len(OPEN) - 1)).alias("role"),
        unescape(F.substring(x, m + 1, F.length(x))).alias("text"))))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    return bind(F.encode(formatted, "utf-8"), lambda b: F.transform(mask, lambda m: unescape(
        F.decode(F.substring(b, m["start"] + 1, m["length"]), "utf-8"))))
