"""Prefix trie of conversations: which beginnings are shared, by how many, and what computing a shared turn once would save.

Every turn becomes a record of fixed size (a digest of role and text, a count of words) before anything is shuffled. A conversation is a
chain of prefix digests. Tasks take whole conversations until a shard is full. A shard enumerates its distinct prefix digests, gives
them slots 0..n-1 by a minimal perfect hash, checks each slot against the digest that it holds, scatters counts into flat arrays by slot,
and adds them up through an array of parent slots, deepest level first. What shards share, the root for one, is one row a shard, and
is merged by a grouped sum; so a beginning that a third of all conversations have costs no task more than another.

The second pass needs what only merged counts tell (members, children). Each node's leaf and saving go to the shard that holds the node's
smallest member, as that shard has all its ancestors too, and are added up there along the same arrays.

Rows of a conversation follow by turn (null first), rows of one turn by the digest of role and text; null role or text is empty; rows
without a conv_id belong to no conversation; repeated rows are turns. Texts of any length are hashed where they lie. One conversation
is one chain, so one task holds its records: some 100 bytes a turn. An empty table gives no rows. Other columns are left alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, hot_join, sparing, written

#: Records of a shard, but for its last conversation.
SHARD_RECORDS = 1 << 17
#: Characters of identifiers that travel as one row to where a node's list is hashed.
PIECE = 1 << 14

ROOT = bytes(16)
PAIR = np.dtype([("a", "<u8"), ("b", "<u8")])
PARTS = "kind int, shard long, digest binary, parent binary, depth long, words long, n long, conv_id long"


class Slots:
    """A minimal perfect hash of distinct digests. On each level the digests left are dealt to as many bits; who is alone on a bit owns
    it, the others go on. A digest's slot is the rank of its bit. `digests[slot]` is kept, so a slot is never given to a stranger."""

    GAMMA, LEVELS = 1.5, 40

    def __init__(self, digests: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (bits, rank of each bit)
        self.digests = np.zeros(len(digests), PAIR)
        left, given = digests, 0
        while len(left):
            if len(self.levels) == self.LEVELS:
                raise ValueError("digests are not distinct")
            size = max(8, int(len(left) * self.GAMMA))
            at = self._place(left, len(self.levels), size)
            bits = np.bincount(at, minlength=size) == 1
            rank = given + np.cumsum(bits) - 1
            self.levels.append((bits, rank))
            alone = bits[at]
            self.digests[rank[at[alone]]] = left[alone]
            given += int(alone.sum())
            left = left[~alone]

    @staticmethod
    def _place(digests: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (digests["a"] + np.uint64(2 * level + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ (digests["b"] * np.uint64(2 * level + 3))
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(29)
        return (x % np.uint64(size)).astype(np.int64)

    def __call__(self, digests: np.ndarray) -> np.ndarray:
        """Slots; -1 for a digest that has none."""
        out, left = np.full(len(digests), -1), np.arange(len(digests))
        for level, (bits, rank) in enumerate(self.levels):
            at = self._place(digests[left], level, len(bits))
            out[left[bits[at]]] = rank[at[bits[at]]]
            left = left[~bits[at]]
        known = out >= 0
        out[known] = np.where(self.digests[out[known]] == digests[known], out[known], -1)
        return out


class NodeTable:
    """The nodes of one shard as flat arrays by slot."""

    def __init__(self, digests: np.ndarray, parents: np.ndarray, depth: np.ndarray):
        self.slots = Slots(np.unique(digests))
        self.n = len(self.slots.digests)
        self.at = self.slots(digests)
        if (self.at < 0).any():
            raise ValueError("a digest has no slot")
        self.depth, self.parent = np.zeros(self.n, np.int64), np.full(self.n, -1)
        self.depth[self.at] = depth
        below = np.flatnonzero(depth > 0)
        self.parent[self.at[below]] = self.slots(parents[below])
        order = np.argsort(-self.depth, kind="stable")
        self.levels = np.split(order, np.flatnonzero(np.diff(self.depth[order])) + 1)[:-1]  # without the root

    def add_up(self, values: np.ndarray) -> np.ndarray:
        """Sums over subtrees."""
        for level in self.levels:
            np.add.at(values, self.parent[level], values[level])
        return values

    def least(self, values: np.ndarray) -> np.ndarray:
        """Minima over subtrees."""
        for level in self.levels:
            np.minimum.at(values, self.parent[level], values[level])
        return values


def _pairs(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), PAIR)


def records(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, turn, digest, words: what the trie needs of each turn."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(r).cast("string"), F.lit(":"), r, t), 256))
    return conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), digest.alias("digest"), F.regexp_count(t, F.lit(WORD)).cast("long").alias("words")
    )


def with_borrowed_heads(turns: DataFrame, head: Column, base: Column, most: int) -> DataFrame:
    """conv_id, at, digest, words of rebuilt conversations, and a row without a digest for each conversation.

    Each conversation starts with the first `head` turns (`most` at most) of conversation `base` (both columns over conv_id), and goes on with
    its own after its first `head`. turns: as records() gives them. A conversation is the base of a bounded number of others."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    numbered, _ = written(turns.withColumn("k", F.row_number().over(w)), "trie-turns")
    ids = numbered.where("k = 1").select("conv_id", head.alias("head"), base.alias("base"))
    lent = numbered.where(F.col("k") <= most).select(F.col("conv_id").alias("base"), "k", "digest", "words")
    place = lambda own: F.struct(F.lit(own).alias("own"), F.col("k").alias("k"))
    borrowed = ids.where("head > 0").join(lent, "base").where("k <= head").select("conv_id", place(1).alias("at"), "digest", "words")
    own = numbered.where(F.col("k") > head).select("conv_id", place(2).alias("at"), "digest", "words")
    mark = ids.select("conv_id", F.struct(F.lit(0).alias("own"), F.lit(0).alias("k")).alias("at"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    return mark.unionByName(borrowed).unionByName(own)


def _chains(batches):
    """Rows conv_id, digest (null: no turn), words, by conversation and in order -> rows of PARTS: kind 0 a node of a shard with the members
    and the least member that the shard has, kind 1 the node where a conversation ends."""
    task, made = TaskContext.get().partitionId() << 32, 0
    digests, parents, depths, words, convs, ends = [], [], [], [], [], []  # of the shard; ends: record numbers

    def flush():
        nonlocal made, digests, parents, depths, words, convs, ends
        keys = _pairs(digests)
        table = NodeTable(keys, _pairs(parents), np.array(depths))
        conv, end = np.array(convs), np.array(ends)
        n, least, said = np.zeros(table.n, np.int64), np.full(table.n, np.iinfo(np.int64).max), np.zeros(table.n, np.int64)
        np.add.at(n, table.at[end], 1)
        np.minimum.at(least, table.at[end], conv[end])
        said[table.at] = words
        table.add_up(n), table.least(least)
        node = table.slots.digests
        above = np.where(table.parent < 0, np.arange(table.n), table.parent)  # the root's is the root
        k, size = table.n, table.n + len(end)
        cols = [
            np.repeat([0, 1], [k, len(end)]).astype(np.int32), np.full(size, task + made), [*_bytes(node), *_bytes(keys[end])], [*_bytes(node[above]), *[ROOT] * len(end)],
            np.append(table.depth, np.array(depths)[end]), np.append(said, np.zeros(len(end), np.int64)), np.append(n, np.ones(len(end), np.int64)), np.append(least, conv[end]),
        ]
        made, digests, parents, depths, words, convs, ends = made + 1, [], [], [], [], [], []
        for at in range(0, size, 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c[at : at + 10_000], t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["kind", "shard", "digest", "parent", "depth", "words", "n", "conv_id"],
            )

    now, last, depth = None, ROOT, 0
    for batch in batches:
        for conv, turn, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if conv != now:
                if now is not None:
                    ends.append(len(digests) - 1)
                    if len(digests) >= SHARD_RECORDS:
                        yield from flush()
                now, last, depth = conv, ROOT, 0
                digests.append(ROOT), parents.append(ROOT), depths.append(0), words.append(0), convs.append(conv)
            if turn is not None:
                parents.append(last)
                last, depth = hashlib.blake2b(last + turn, digest_size=16).digest(), depth + 1
                digests.append(last), depths.append(depth), words.append(said), convs.append(conv)
    if now is not None:
        ends.append(len(digests) - 1)
        yield from flush()


def _bytes(pairs: np.ndarray) -> list[bytes]:
    raw = pairs.tobytes()
    return [raw[k : k + 16] for k in range(0, len(raw), 16)]


def _subtrees(shard: pa.Table) -> pa.Table:
    """Rows digest, parent, depth, leaf, saved of one shard -> sums of leaf and saved over the shard's part of each subtree."""
    pairs = [_pairs(shard.column(c).to_pylist()) for c in ("digest", "parent")]
    table = NodeTable(*pairs, shard.column("depth").to_numpy())
    out = []
    for c in ("leaf", "saved"):
        value = np.zeros(table.n, np.int64)
        value[table.at] = shard.column(c).to_numpy()
        out.append(table.add_up(value))
    some = (out[0] > 0) | (out[1] > 0)
    return pa.table({"digest": pa.array(_bytes(table.slots.digests[some]), pa.binary()), "n_leaves": out[0][some], "saved": out[1][some]})


def _pieces(batches):
    """Rows digest, conv_id in order -> (digest, first, piece, sha): the hash of each list that lies whole in this task, and pieces of those
    that may go on in the task before or after: its first one and its last one."""
    now, ids, size, whole = None, [], 0, False
    out: list[tuple] = []

    def cut():
        nonlocal ids, size
        out.append((now, int(ids[0]), ",".join(ids), None))
        ids, size = [], 0

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.string(), pa.string()))], names=["digest", "first", "piece", "sha"])

    for batch in batches:
        for digest, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest != now:
                if now is not None:
                    if whole:
                        out.append((now, None, None, hashlib.sha256(",".join(ids).encode()).hexdigest()))
                        ids, size = [], 0
                    elif ids:
                        cut()
                whole = now is not None  # but for the task's first list, until it gets too long
                now = digest
            ids.append(str(conv))
            size += len(ids[-1]) + 1
            if size >= PIECE:
                whole = False
                cut()
        if len(out) >= 500:
            yield batch_of(out)
            out = []
    if ids:
        cut()
    yield batch_of(out)


def _hashed(batches):
    """Rows digest, piece in order -> digest, sha of the joined pieces."""
    now, running, out = None, None, []
    for batch in batches:
        for digest, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if digest != now:
                if now is not None:
                    out.append((now, running.hexdigest()))
                now, running = digest, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
    if now is not None:
        out.append((now, running.hexdigest()))
    yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.string())], names=["digest", "sha"])


def ends(parts: DataFrame) -> DataFrame:
    """digest, sha: SHA-256 of the ascending identifiers of the conversations that end at a node, comma-joined. parts: digest, conv_id.
    Lists are built where a range of (node, identifier) lies; one that spans ranges is hashed over pieces, which are few."""
    ranged = parts.repartitionByRange("digest", "conv_id").sortWithinPartitions("digest", "conv_id")
    pieces, _ = written(ranged.mapInArrow(sparing(_pieces), "digest binary, first long, piece string, sha string"), "trie-ends")
    rest = pieces.where("sha is null").repartition("digest").sortWithinPartitions("digest", "first").select("digest", "piece")
    return pieces.where("sha is not null").select("digest", "sha").unionByName(rest.mapInArrow(sparing(_hashed), "digest binary, sha string"))


def trie(turns: DataFrame) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    turns: conv_id, at (their order), digest (null: no turn, only names a conversation), words."""
    dealt = turns.repartition("conv_id").sortWithinPartitions("conv_id", "at").select("conv_id", "digest", "words")
    parts, _ = written(dealt.mapInArrow(sparing(_chains), PARTS), "trie-parts")
    shards = parts.where("kind = 0")
    # parent, depth and words follow from the digest
    merged = shards.groupBy("digest", "parent", "depth", "words").agg(F.min("conv_id").alias("conv_id"), F.min_by("shard", "conv_id").alias("home"), F.sum("n").alias("n_convs"))
    merged, _ = written(merged, "trie-merged")
    children = merged.where("depth > 0").groupBy(F.col("parent").alias("digest")).agg(F.count("*").alias("n_children"))
    nodes = merged.join(children, "digest", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("long"))
    nodes, _ = written(nodes, "trie-nodes")

    own = nodes.select("digest", F.col("home").alias("shard"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    valued = shards.select("shard", "digest", "parent", "depth").join(own, ["shard", "digest"], "left").na.fill(0, ["leaf", "saved"])
    sums = valued.groupBy("shard").applyInArrow(_subtrees, "digest binary, n_leaves long, saved long").groupBy("digest").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    above = nodes.where("n_children > 0").select(F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n"))
    below = nodes.where("depth > 0").select("digest", "parent")
    named = hot_join(below, above, ["parent"]).select("digest", "parent_conv_id")  # a parent may have most nodes as children
    out = nodes.join(sums, "digest", "left").join(named, "digest", "left").join(ends(parts.where("kind = 1").select("digest", "conv_id")), "digest", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).alias("saved_tokens"), F.coalesce("sha", F.lit(none)).alias("ends_sha256")
    )


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of a table of turns as it is."""
    return trie(records(conversations, conv_id, turn, role, text).withColumn("at", F.struct("turn", "digest")).select("conv_id", "at", "digest", "words"))
