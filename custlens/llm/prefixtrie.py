"""Prefix trie of conversations from padded turn-id matrices.

A conversation is a path of turns; a turn is known by 128 bits of the SHA-256
of its role and text, so texts are read once and never shuffled.  Paths are
range-sharded in the order of (path, conv_id).  A shard goes through numpy in
blocks of bounded cells: the turns of a block get dense numbers, its paths
become the rows of a zero-padded matrix, ``lexsort`` orders them, the mask
"differs from the row above", accumulated by OR along the columns, marks where
nodes start, and ``reduceat`` over those starts aggregates every depth, from
the deepest up.

A node that holds a block's first or last row may go on in a neighbouring
block.  Such boundary nodes lie on two paths per block; they leave the block
with what their closed part adds up to (members, smallest member, closed
children, leaves and saved tokens) as two rows of a next, far smaller table,
which goes the same way until one block is left.  A child of a boundary node
gets its parent's name by a join on the digest of the path; parents of more
than 1 / HOT_SHARE of all nodes are fewer than HOT_SHARE and alone broadcast.
The member list of a node is hashed where it is closed; pieces of a list that
spans blocks are streamed through the hash in order.

Defined cases: a null role or text is an empty one; equal turn numbers order
by the turn's digest; repeated rows are repeated turns; rows without a conv_id
belong to no conversation; a conversation may be turnless and is then a member
of the root only; very long texts only cost their digest; an empty table gives
an empty result; extra columns are not touched.  A conversation itself must fit
a row (16 bytes a turn) and its path one task.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import write_table

#: Turns (cells) of a matrix; a block grows only for a single longer path.
CELLS = 1_000_000
#: Nodes of more than this share of all nodes' children have their children named by broadcast.
HOT_SHARE = 1000
WIDTH = 16
EMPTY = hashlib.sha256(b"").hexdigest()
BIG = np.iinfo(np.int64).max

NODE = ["conv_id", "depth", "parent_conv_id", "parent_key", "key", "n_convs", "n_children", "n_leaves",
        "saved_tokens", "ends_sha256"]
OPEN = ["path", "bytes", "members", "least", "kids", "leaves", "saved"]
SCHEMA = ("kind string, conv_id long, depth long, parent_conv_id long, parent_key binary, key binary, n_convs long, "
          "n_children long, n_leaves long, saved_tokens long, ends_sha256 string, piece string, path binary, "
          + ", ".join(f"{c} array<bigint>" for c in OPEN[1:]))


def rebuilt(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text", group: int = 5, most: int = 9) -> DataFrame:
    """conv_id, path, bytes: conversation c starts with the first
    ``crc32(c) % most`` turns of conversation ``c - c % group`` and goes on with
    its own turns after as many."""
    role, text = F.coalesce(role_col, F.lit("")), F.coalesce(text_col, F.lit(""))
    c = F.col(conv_col).cast("long")
    mark = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).substr(1, 2 * WIDTH)
    turns = rows.where(c.isNotNull()).select(
        c.alias("conv_id"), (c - c % group).alias("base"),
        F.struct(F.col(turn_col).alias("turn"), mark.alias("id"),
                 F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    own = (turns.repartition("base").groupBy("base", "conv_id")
           .agg(F.sort_array(F.collect_list("t")).alias("own")))
    head = own.where(F.col("conv_id") == F.col("base")).select("base", F.slice("own", 1, most - 1).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    whole = own.join(head, "base", "left").select(
        "conv_id", F.concat(F.slice(F.coalesce("head", F.slice("own", 1, 0)), F.lit(1), h.cast("int")),
                            F.slice("own", h.cast("int") + 1, F.size("own"))).alias("turns"))
    return whole.select("conv_id", F.unhex(F.array_join("turns.id", "")).alias("path"),
                        F.col("turns.bytes").alias("bytes"))


def _numbers(paths: list) -> np.ndarray:
    """Dense turn numbers from 1, in the order of the digests, of all turns of
    a block one after the other."""
    every = b"".join(paths)
    if not every:
        return np.empty(0, np.int32)
    flat = np.frombuffer(every, ">u8").reshape(-1, 2)
    hi, lo = flat[:, 0].astype(np.uint64), flat[:, 1].astype(np.uint64)
    order = np.lexsort((lo, hi))
    new = np.ones(len(order), bool)
    new[1:] = (hi[order][1:] != hi[order][:-1]) | (lo[order][1:] != lo[order][:-1])
    out = np.empty(len(order), np.int32)
    out[order] = np.cumsum(new)
    return out


def _prefix_keys(path: bytes) -> list[bytes]:
    """Digest of every prefix of a path, the empty one first."""
    h = hashlib.sha256()
    keys = [h.digest()]
    for at in range(0, len(path), WIDTH):
        h.update(path[at:at + WIDTH])
        keys.append(h.copy().digest())
    return keys


class _Block:
    """One block of consecutive paths: its closed nodes, boundary paths and
    list pieces.  ``conv`` is given at the first level, ``parts`` (five flat
    arrays with one entry per node of a path) at the later ones."""

    def __init__(self, paths, sizes, conv=None, parts=None, final=False):
        n = len(paths)
        lens = np.array([len(p) // WIDTH for p in paths])
        w = int(lens.max(initial=0))
        number = _numbers(paths)
        matrix = np.zeros((n, w), np.int32)
        matrix[np.arange(w)[None, :] < lens[:, None]] = number
        keys = [conv] if conv is not None else []
        by = np.lexsort(keys + [matrix[:, j] for j in range(w - 1, -1, -1)]) if w or keys else np.arange(n)
        matrix, lens = matrix[by], lens[by]
        self.paths, self.lens, self.final, self.n = [paths[i] for i in by], lens, final, n
        self.sizes = [sizes[i] for i in by]
        self.conv = conv[by] if conv is not None else None
        # one entry per node of a path: where row i, depth d lies
        at = np.zeros(n + 1, np.int64)
        old = np.zeros(n + 1, np.int64)
        np.cumsum(np.array([len(p) // WIDTH + 1 for p in paths]), out=old[1:])
        np.cumsum(lens + 1, out=at[1:])
        self.at = at
        if parts is None:
            total = int(at[-1])
            zero = np.zeros(total, np.int64)
            self.parts = [np.ones(total, np.int64), np.repeat(self.conv, lens + 1), zero, zero, zero]
        else:
            pick = np.concatenate([np.arange(old[i], old[i + 1]) for i in by]) if n else np.empty(0, np.int64)
            self.parts = [p[pick] for p in parts]
        change = np.ones((n, w), bool)
        change[1:] = matrix[1:] != matrix[:-1]
        self.change = np.logical_or.accumulate(change, axis=1)
        # rows whose whole path differs from the row above
        self.fresh = np.ones(n, bool)
        self.fresh[1:] = (self.change[1:, -1] if w else False) | (lens[1:] != lens[:-1])
        self.bytes = np.concatenate([np.asarray(s, np.int64) for s in self.sizes]) if n else np.empty(0, np.int64)
        self.byte_at = np.concatenate([[0], np.cumsum(lens)])
        self.matrix = matrix
        self.prefix: dict[int, list] = {}

    def key(self, row: int, depth: int) -> bytes:
        if row not in self.prefix:
            self.prefix[row] = _prefix_keys(self.paths[row])
        return self.prefix[row][depth]

    def _part(self, which: int, depth: int, none: int) -> np.ndarray:
        out = np.full(self.n, none, np.int64)
        rows = np.flatnonzero(self.lens >= depth)
        out[rows] = self.parts[which][self.at[rows] + depth]
        return out

    def ends(self, named: dict) -> list:
        """Hash the members that end at a node, per distinct path; lists of
        boundary nodes become pieces.  Fills ``named``: first row -> hash."""
        pieces = []
        names = [str(c) for c in self.conv.tolist()]
        first = np.flatnonzero(self.fresh)
        # the last start of a node per depth; the root starts once
        last = np.append(0, self.n - 1 - self.change[::-1].argmax(axis=0)) if self.change.size else np.zeros(1, int)
        for a, b in zip(first.tolist(), [*first[1:].tolist(), self.n]):
            text = ",".join(names[a:b])
            if a == 0 or last[self.lens[a]] <= a:          # a boundary node
                pieces.append((self.key(a, int(self.lens[a])), int(self.conv[a]), text))
            else:
                named[a] = hashlib.sha256(text.encode()).hexdigest()
        return pieces

    def run(self):
        """(columns of closed nodes, boundary rows, list pieces)."""
        named: dict[int, str] = {}
        pieces = self.ends(named) if self.conv is not None else []
        columns: dict[str, list] = {c: [] for c in NODE}
        first_path = [np.zeros(int(self.lens[0]) + 1, np.int64) for _ in range(5)]
        last_path = [np.zeros(int(self.lens[-1]) + 1, np.int64) for _ in range(5)]
        for p in (first_path, last_path):
            p[1][:] = BIG
        below = None                       # starts, closed, least, leaves and saved of the depth below
        for d in range(self.matrix.shape[1], -1, -1):
            start = np.flatnonzero(self.change[:, d - 1]) if d else np.zeros(1, np.int64)
            real = self.lens[start] >= d
            end = np.append(start[1:], self.n)
            add = lambda x: np.add.reduceat(x, start)[real]
            members = add(self._part(0, d, 0))
            least = np.minimum.reduceat(self._part(1, d, BIG), start)[real]
            kids, leaves, saved = (self._part(i, d, 0) for i in (2, 3, 4))
            if below is not None:
                s, shut, _, low_leaves, low_saved = below
                kids[s] += shut
                leaves[s] += np.where(shut, low_leaves, 0)
                saved[s] += np.where(shut, low_saved, 0)
            kids, leaves, saved = add(kids), add(leaves), add(saved)
            s, e = start[real], end[real]
            closed = np.full(len(s), True) if self.final else (s > 0) & (e < self.n)
            size = self.bytes[self.byte_at[s] + d - 1] if d else np.zeros(len(s), np.int64)
            all_leaves = leaves + (kids == 0)
            all_saved = saved + (members - 1) * size
            if below is not None:
                self._finish(columns, d + 1, below, pending, s, closed, least)
            # boundary nodes: on the first row's path, else on the last row's
            for where, path in ((np.flatnonzero(~closed & (s == 0)), first_path),
                                (np.flatnonzero(~closed & (s > 0)), last_path)):
                for i in where:
                    for col, x in zip(path, (members, least, kids, leaves, saved)):
                        col[d] = x[i]
            pending = (members, kids, all_leaves, all_saved, self._hashes(s, d, named))
            below = (s, closed, least, all_leaves, all_saved)
        self._finish(columns, 0, below, pending, None, None, None)
        boundary = []
        if not self.final:
            boundary.append((self.paths[0], self.sizes[0], first_path))
            if self.n > 1 and last_path[0].any():
                boundary.append((self.paths[-1], self.sizes[-1], last_path))
        return columns, boundary, pieces

    def _hashes(self, s, d, named):
        return [named.get(i, EMPTY) if self.lens[i] == d else EMPTY for i in s.tolist()] \
            if self.conv is not None else [None] * len(s)

    def _finish(self, columns, d, nodes, pending, up_start, up_closed, up_least):
        """Write the closed nodes of depth d, with their parents of d - 1."""
        s, closed, least, _, _ = nodes
        keep = np.flatnonzero(closed)
        if not len(keep):
            return
        members, kids, leaves, saved, hashes = pending
        m = len(keep)
        if up_start is None:
            parent, parent_key = [None] * m, [None] * m
        else:
            up = np.searchsorted(up_start, s[keep], "right") - 1
            known = up_closed[up]
            parent = [int(x) if k else None for x, k in zip(up_least[up].tolist(), known.tolist())]
            parent_key = [None if k else self.key(0 if up_start[i] == 0 else self.n - 1, d - 1)
                          for i, k in zip(up.tolist(), known.tolist())]
        columns["conv_id"] += least[keep].tolist()
        columns["depth"] += [d] * m
        columns["parent_conv_id"] += parent
        columns["parent_key"] += parent_key
        # later levels: nodes that were open, known to children and lists by their key
        columns["key"] += [None] * m if self.conv is not None else [self.key(i, d) for i in s[keep].tolist()]
        columns["n_convs"] += members[keep].tolist()
        columns["n_children"] += kids[keep].tolist()
        columns["n_leaves"] += leaves[keep].tolist()
        columns["saved_tokens"] += saved[keep].tolist()
        columns["ends_sha256"] += [hashes[i] for i in keep.tolist()]


def _level(first: bool, final: bool, cells: int):
    """Sorted rows of one shard -> closed nodes, boundary rows, list pieces."""
    def block(rows):
        paths, sizes = [r["path"] for r in rows], [r["bytes"] for r in rows]
        if first:
            return _Block(paths, sizes, conv=np.array([r["conv_id"] for r in rows], np.int64), final=False)
        parts = [np.array([x for r in rows for x in r[c]], np.int64) for c in OPEN[2:]]
        return _Block(paths, sizes, parts=parts, final=final)

    def table(columns, boundary, pieces):
        import pyarrow as pa
        n, b, p = len(columns["conv_id"]), len(boundary), len(pieces)
        names = [x.strip().split(" ")[0] for x in SCHEMA.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
        of = {x.strip().split(" ")[0]: kinds[x.strip().split(" ")[1]] for x in SCHEMA.split(", ")}
        out = {c: [None] * (n + b + p) for c in names}
        out["kind"] = ["node"] * n + ["open"] * b + ["piece"] * p
        for c in NODE:
            out[c][:n] = columns[c]
        for i, (path, size, parts) in enumerate(boundary, n):
            out["path"][i], out["bytes"][i] = path, size
            for c, x in zip(OPEN[2:], parts):
                out[c][i] = x
        for i, (key, least, text) in enumerate(pieces, n + b):
            out["key"][i], out["conv_id"][i], out["piece"][i] = key, least, text
        return pa.RecordBatch.from_arrays([pa.array(out[c], of[c]) for c in names], names)

    def run(batches):
        held, width = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                w = max(width, len(r["path"]) // WIDTH + 1)
                if held and not final and w * (len(held) + 1) > cells:
                    yield table(*block(held).run())
                    held, w = [], len(r["path"]) // WIDTH + 1
                held.append(r)
                width = w
        if held:
            yield table(*block(held).run())
    return run


def _hash_lists():
    """Pieces of member lists, sorted by key and first member, through one hash a key."""
    def run(batches):
        import pyarrow as pa
        key, h = None, None
        for batch in batches:
            keys, hashes = [], []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if k != key:
                    if key is not None:
                        keys.append(key)
                        hashes.append(h.hexdigest())
                    key, h = k, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(hashes, pa.string())],
                                             ["key", "ends"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([h.hexdigest()], pa.string())],
                                             ["key", "ends"])
    return run


def trie(paths: DataFrame, cells: int = CELLS) -> DataFrame:
    """Nodes of the trie of ``paths`` (conv_id, path, bytes): conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = paths.sparkSession
    paths = write_table(paths, "paths")
    level = paths
    order, first, limit, nodes, pieces = ["path", "conv_id"], True, cells, None, None
    before = None
    while True:
        n, turns = level.agg(F.count(F.lit(1)), F.sum(F.size("bytes") + 1)).first()
        final = not first and turns <= limit
        if final:
            dealt = level.coalesce(1).sortWithinPartitions(*order)         # at most ``limit`` cells
        else:
            shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int((turns or 0) // cells)) if first \
                else max(1, int(turns // limit))
            dealt = level.repartitionByRange(shards, *order).sortWithinPartitions(*order)
        done = write_table(dealt.mapInArrow(_level(first, final, limit), SCHEMA), "trie")
        some = done.where("kind = 'node'").select(*NODE)
        nodes = some if nodes is None else nodes.unionByName(some)
        if first:
            pieces = done.where("kind = 'piece'").select("key", "conv_id", "piece")
        if final or not n:
            break
        level = done.where("kind = 'open'").select(*OPEN)
        order, first = ["path"], False
        # paths as long as a block leave as many boundary rows as they came: let blocks grow
        if before is not None and turns > before // 2:
            limit *= 2
        before = turns
    lists = pieces.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(
        _hash_lists(), "key binary, ends string")
    opened = (nodes.where("key is not null").join(lists, "key", "left")
              .withColumn("ends_sha256", F.coalesce("ends", F.lit(EMPTY))).drop("ends"))
    every = write_table(nodes.where("key is null").unionByName(opened), "nodes")
    # parents that were open when their child was closed
    parents = every.where("key is not null").select(F.col("key").alias("parent_key"), F.col("conv_id").alias("p"),
                                                    "n_children")
    total = every.count()
    big = F.col("n_children") * HOT_SHARE > F.lit(total)
    known, asked = every.where("parent_key is null"), every.where("parent_key is not null")
    met = asked.join(F.broadcast(parents.where(big).select("parent_key", "p")), "parent_key", "left")
    ready = met.where("p is not null").withColumn("parent_conv_id", F.col("p")).drop("p")
    other = (met.where("p is null").drop("p").join(parents.where(~big).select("parent_key", "p"), "parent_key")
             .withColumn("parent_conv_id", F.col("p")).drop("p"))
    return known.unionByName(ready).unionByName(other).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
