"""Best-fit packing of tokenised documents into fixed-capacity sequences.

Hierarchical residual packing.  Each input partition tokenises its documents
and packs their pieces best-fit, largest first.  Bins that are nearly full are
final.  The underfull rest goes on as items: groups of ``fan_in`` neighbouring
partitions are packed again, then groups of groups, until one group is left.
Every underfull bin is handed on.  A group of more than ``hand_on`` bins is
dealt by hash into siblings, each a task with bins of all its children, so no
task's input grows with the corpus; the last group is dealt anew and packed
again until a round merges nothing.  (In a packed sibling any two bins hold
more than the capacity together, so at most one is half full or less: what is
left to merge is less than one bin a sibling.)  Pieces never move: rounds carry
(bin, fill) only, and the shifts found are joined back.

Defined cases: a null text is an empty one and yields the end id alone; only
a document longer than the capacity is cut; a repeated row is packed again;
an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import meet, write_table

#: Words (white-space separated) and pieces whose ids one Python worker keeps.
CACHE_WORDS = 400_000
CACHE_PIECES = 300_000


class WordTokenizer:
    """Token ids of whole texts; each distinct word is encoded about once per
    worker.  Words and pieces are kept in two generations (a full younger one
    replaces the older), so memory is bounded and frequent words stay.

    Needs a pre-tokenizer that neither joins across ASCII white space nor
    keeps it; a probe text asserts that.  Words that are a run of Latin
    letters and a run of closing punctuation are split here when probes show
    that the tokenizer splits, lower-cases and spells them that way; all
    other words go through the tokenizer's own steps."""

    _made: dict[str, "WordTokenizer"] = {}
    _simple = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.words, self.old_words = {}, {}
        self.pieces, self.old_pieces = {}, {}
        split = self._split
        letters = [c for c in map(chr, range(256)) if self._simple.fullmatch(c)]
        spelt = {ord(c.lower()): split(c)[0] for c in letters}
        ends = [x + y for x in ".,;:!?" for y in [""] + list(".,;:!?")]
        self.spelt = spelt if all(
            split(f"a{c}{c}b{e}") == [f"a{c}{c}b".lower().translate(spelt), e] for c in letters for e in ends
        ) else None
        probe = "One two,\tthree\n\u00e9 four's <x>  5 Stra\u00dfe. A"
        if self.tok.encode(probe, add_special_tokens=False).ids != list(np.frombuffer(self.ids(probe), "<u4")):
            raise ValueError(f"{path} joins tokens across white space")

    @classmethod
    def of(cls, path: str) -> "WordTokenizer":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _split(self, word: str) -> list[str]:
        return [p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(word))]

    def _piece(self, p: str) -> bytes:
        got = self.pieces.get(p)
        if got is None:
            got = self.old_pieces.get(p)
            if got is None:
                got = array("I", [t.id for t in self.tok.model.tokenize(p)]).tobytes()
            if len(self.pieces) >= CACHE_PIECES:
                self.pieces, self.old_pieces = {}, self.pieces
            self.pieces[p] = got
        return got

    def _word(self, w: bytes) -> bytes:
        got = self.old_words.get(w)
        if got is None:
            s = w.decode("utf-8")
            m = self.spelt and self._simple.fullmatch(s)
            if m:
                got = self._piece(m[1].lower().translate(self.spelt))
                if m[2]:
                    got += self._piece(m[2])
            elif "<" in s:                # may hold an added token, matched before any splitting
                got = array("I", self.tok.encode(s, add_special_tokens=False).ids).tobytes()
            else:
                got = b"".join(map(self._piece, self._split(s)))
        self.words[w] = got
        return got

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        words = (text or "").encode("utf-8").split()
        if len(self.words) >= CACHE_WORDS:
            self.words, self.old_words = {}, self.words
        get, word = self.words.get, self._word
        return b"".join([get(w) or word(w) for w in words])


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best-fit decreasing: (bin, offset) per item and the fill per bin.  Bins
    are kept by free space; a bit mask finds the tightest one that fits."""
    bins = np.empty(len(lengths), np.int64)
    offsets = np.empty(len(lengths), np.int64)
    fill: list[int] = []
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for i in np.argsort(-lengths, kind="stable"):
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            free = n + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                mask &= ~(1 << free)
        else:
            b, free = len(fill), capacity
            fill.append(0)
        bins[i], offsets[i] = b, fill[b]
        fill[b] += n
        free -= n
        if free:
            by_free[free].append(b)
            mask |= 1 << free
    return bins, offsets, fill


def _local_round(path: str, id_col: str, text_col: str, capacity: int, end_id: int, block: int, with_ids: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        tok, part, made = WordTokenizer.of(path), TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def packed():
            nonlocal made
            cols = list(zip(*rows))
            length = np.array(cols[3], np.int64)
            b, off, fill = best_fit(length, capacity)
            used = np.array(fill, np.int64)[b]
            data = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()),
                    pa.array(length), pa.array(cols[4], pa.int64()), pa.array((part << 33) + made + b),
                    pa.array(off), pa.array(used)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "used"]
            if with_ids:
                data.append(pa.array([np.frombuffer(x, "<u4").astype(np.int64) for x in cols[5]],
                                     pa.list_(pa.int64())))
                names.append("ids")
            made += len(fill)
            rows.clear()
            return pa.RecordBatch.from_arrays(data, names)

        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for doc, text in zip(ids.to_pylist(), texts):
                raw = tok.ids(text.as_py()) + end
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    x = raw[at:at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(x) // 4, zlib.crc32(x), x if with_ids else None))
                if len(rows) >= block:
                    yield packed()
        if rows:
            yield packed()
    return run


def _merge_round(capacity: int, full: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items = pdf.drop_duplicates("root")[["root", "used"]].sort_values(["used", "root"], ascending=[False, True])
        b, off, fill = best_fit(items["used"].to_numpy(np.int64), capacity)
        first = np.full(len(fill), -1, np.int64)
        roots = items["root"].to_numpy(np.int64)
        first[b[::-1]] = roots[::-1]                     # a merged bin goes by its first item
        used = np.array(fill, np.int64)
        done = used >= full
        where = pd.DataFrame({"root": roots, "new": first[b], "by": off, "total": used[b], "end": done[b]})
        out = pdf.merge(where, on="root")
        return pd.DataFrame({"grp": out["grp"], "bin": out["bin"], "root": out["new"],
                             "shift": out["shift"] + out["by"], "used": out["total"], "done": out["end"]})
    return run


def _dealt(items: DataFrame, hand_on: int, turn: int) -> tuple[DataFrame, bool]:
    """``items`` with ``part``, the sibling of a group that a root's bins go to,
    and whether any group has siblings."""
    sizes = items.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / hand_on).alias("siblings")).where("siblings > 1")
    if sizes.isEmpty():
        return items.withColumn("part", F.lit(0).cast("long")), False
    return (items.join(sizes, "grp", "left")
            .withColumn("part", F.coalesce(F.pmod(F.xxhash64("root", F.lit(turn)), "siblings"), F.lit(0).cast("long")))
            .drop("siblings")), True


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = 4096, end_id: int = 1, nearly_full: float = 0.995, fan_in: int = 8,
         block: int = 200_000, hand_on: int = 100_000, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, sequence_length (and ids if asked for).

    ``nearly_full``: share of the capacity at which a bin is final.
    ``block``: pieces packed together in a partition; ``hand_on``: bins handed
    to one task of a later round.  Both bound a task's memory."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, used long"
              + (", ids array<long>" if with_ids else ""))
    pieces = write_table(src.mapInArrow(_local_round(tokenizer_path, id_col, text_col, capacity, end_id, block,
                                                     with_ids), schema), "pieces")
    full = int(capacity * nearly_full)
    items = (pieces.where((F.col("offset") == 0) & (F.col("used") < full))
             .select(F.shiftright("bin", 33).alias("grp"), "bin", F.col("bin").alias("root"),
                     F.lit(0).cast("long").alias("shift"), "used", F.lit(False).alias("done")))
    moved, top, turn = None, (items.agg(F.max("grp")).first()[0] or 0), 0
    roots = lambda rows: rows.where(F.col("bin") == F.col("root")).count()  # noqa: E731  # a root keeps its own row
    while True:
        last, turn = top < fan_in, turn + 1
        items, siblings = _dealt(items.withColumn("grp", F.floor(F.col("grp") / fan_in)), hand_on, turn)
        after = write_table(items.groupBy("grp", "part").applyInPandas(
            _merge_round(capacity, full),
            "grp long, bin long, root long, shift long, used long, done boolean"), "bins")
        settled = last and not (siblings and roots(after) < roots(items))
        ended = after if settled else after.where("done")
        moved = ended if moved is None else moved.unionByName(ended)
        if settled:
            break
        items, top = after.where("not done"), top // fan_in
    moved = moved.select("bin", "root", "shift", F.col("used").alias("total"))
    return (meet(pieces, moved, "bin", "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    F.coalesce("root", "bin").alias("sequence_id"),
                    (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
                    F.coalesce("total", "used").alias("sequence_length"),
                    *(["ids"] if with_ids else [])))
