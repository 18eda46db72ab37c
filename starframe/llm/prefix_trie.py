"""Conversation prefix trie (13): every distinct beginning of conversations is a node, with counts of its subtree.

Only fixed-size rows travel: a turn is the digest of its role and text and the bytes of its text.  A node is named by two 64-bit words,
the exclusive or of hashes of (place, turn) over its turns, so names of all beginnings of a conversation are a running total.  Long
conversations are cut into segments of SEGMENT turns, which are dealt to shards; totals of earlier segments come as one row each.

A shard lists its distinct nodes and gives each a slot by a minimal perfect hash (levels of bit tables, as in BBHash): keys that are
alone in their place of a level get the next slots, the others go on to the next level.  Slots are verified: the table holds the
names, depths, turns and parents, and every row must agree with its slot.  Counts are scattered into flat arrays by slot.

1. Each shard counts its conversations at each node; counts and least members of a node are then added over all shards.
2. A node's weights (is it a leaf, what it saves) are added at one place only: in the segment of its least member.  That member's path
   holds all ancestors, so each shard adds weights up through its array of parent slots, deepest first, and the sums of a node are then
   added over all shards.  What later segments of a conversation hold is added at the last node of a segment.

So no node, however many conversations begin with it, needs more than one row from each shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from starframe.llm import _rolling as R
from starframe.llm._shared import cut

#: Turns in a segment; turns in a shard (a task takes some 200 bytes for each).
SEGMENT, SHARD = 4096, 500_000
#: Conversations whose ids are joined to one piece, before pieces of a node are hashed in order.
PIECE = 4096

_U = np.uint64
_TURN = "conv_id long, turn long, t1 long, t2 long, bytes long"


def digests(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, t1, t2, bytes) for turns (conv_id, turn, role, text); null roles and texts are empty."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    half = lambda k: F.expr(f"CAST(CAST(conv(substring(d, {k}, 8), 16, 10) AS BIGINT) AS BIGINT)")
    word = lambda k: half(k).bitwiseXOR(F.shiftleft(half(k + 8), 32))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), hashed.alias("d"), F.octet_length(text).cast("long").alias("bytes"))
    return rows.where("conv_id is not null").select("conv_id", "turn", word(1).alias("t1"), word(17).alias("t2"), "bytes")


def _numbered(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition's number and the number of the row within its conversation and partition; rows come sorted."""
    from pyspark import TaskContext

    part, last, n = TaskContext.get().partitionId(), None, 0
    for table in tables:
        c = table.column("conv_id").to_numpy()
        if not len(c):
            continue
        new = np.append(c[0] != last, c[1:] != c[:-1])
        begin = np.where(new, np.arange(len(c)), -1)
        begin = np.maximum.accumulate(begin)
        number = np.where(begin >= 0, np.arange(len(c)) - begin, np.arange(len(c)) + n)
        last, n = c[-1], int(number[-1]) + 1
        yield pa.RecordBatch.from_arrays([*table.columns, pa.array(np.full(len(c), part, np.int32)), pa.array(number)], names=[*table.schema.names, "part", "number"])


def ordered(rows: DataFrame) -> DataFrame:
    """Adds ``pos``, the place within the conversation from 0 on: by turn (nulls first); ties by digest.

    Rows are sorted over all conversations, so a long one is spread over several tasks; each task's share of it is then counted.
    """
    keys = ["conv_id", F.col("turn").asc_nulls_first(), "t1", "t2"]
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    numbered = cut(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).mapInArrow(_numbered, f"{_TURN}, part int, number long"))
    counts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("conv_id").orderBy("part")) - F.col("n")).where("before > 0").drop("n")
    placed = numbered.join(before, ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("number") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "bytes")


class Slots:
    """A minimal perfect hash of distinct 64-bit keys: every key has a slot of its own below their number."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = len(keys)
        base = 0
        while len(keys):
            m = max(2, 2 * len(keys))
            place = self._place(keys, len(self.levels), m)
            held = np.bincount(place, minlength=m)
            alone = held == 1
            self.levels.append((alone, base + np.cumsum(alone) - 1))
            keys = keys[~alone[place]]
            base += int(alone.sum())

    @staticmethod
    def _place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (R.mix(keys + _U(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64))) % _U(m)).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; a key that is not in the table may get any slot, or -1."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (alone, slot) in enumerate(self.levels):
            place = self._place(keys[left], level, len(alone))
            hit = alone[place]
            out[left[hit]] = slot[place[hit]]
            left = left[~hit]
        return out


class Table:
    """The distinct nodes of a shard, by slot: names, depth, bytes of the last text, parent slot (-1: none here)."""

    def __init__(self, rows: pa.Table, segment: int):
        rows = rows.sort_by([("conv_id", "ascending"), ("depth", "ascending")])
        col = lambda c: rows[c].to_numpy()
        self.conv, self.depth = col("conv_id"), col("depth")
        n = len(self.conv)
        # Names: a running exclusive or within each segment, from the total before it on.
        first = np.append(True, (self.conv[1:] != self.conv[:-1]) | (self.depth[1:] // segment != self.depth[:-1] // segment)) if n else np.zeros(0, bool)
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        names, parents = [], []
        for lane in ("1", "2"):
            own, before = col(f"h{lane}").view(_U), col(f"b{lane}").view(_U)
            total = np.bitwise_xor.accumulate(own) if n else own
            run = total ^ total[start] ^ own[start] ^ before[start]
            names.append(run)
            parents.append(run ^ own)
        key = R.mix(names[0]) ^ names[1]
        self.distinct, at = np.unique(key, return_index=True)
        self.slots = Slots(self.distinct)
        self.slot = self.slots.of(key)
        where = np.empty(len(at), np.int64)
        where[self.slots.of(self.distinct)] = at
        self.a, self.b, self.level, self.bytes = names[0][where], names[1][where], self.depth[where], col("bytes")[where]
        self.pa, self.pb = parents[0][where], parents[1][where]
        same = lambda table, rows: bool((table[self.slot] == rows).all())
        if not (same(self.a, names[0]) and same(self.b, names[1]) and same(self.level, self.depth) and same(self.pa, parents[0]) and same(self.pb, parents[1]) and same(self.bytes, col("bytes"))):
            raise ValueError("two beginnings of conversations share a digest")
        # The parent is the row before, but for the first of a segment.
        self.parent = np.full(len(at), -1, np.int64)
        inner = np.flatnonzero(~first)
        self.parent[self.slot[inner]] = self.slot[inner - 1]

    def look_up(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        slot = self.slots.of(R.mix(a) ^ b)
        if (slot < 0).any() or (self.a[slot] != a).any() or (self.b[slot] != b).any():
            raise ValueError("a node is not in the shard that holds its least member")
        return slot

    def upward(self, values: np.ndarray) -> np.ndarray:
        """Sums of values over the subtrees, through the parent slots, deepest nodes first."""
        order = np.argsort(-self.level, kind="stable")
        edges = np.append(np.flatnonzero(np.diff(self.level[order])) + 1, len(order))
        begin = 0
        for end in edges.tolist():
            own = order[begin:end]
            own = own[self.parent[own] >= 0]
            np.add.at(values, self.parent[own], values[own])
            begin = end
        return values


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _counted(segment: int):
    def count(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        t = Table(rows, segment)
        n = np.bincount(t.slot, minlength=len(t.a))
        least = np.full(len(t.a), np.iinfo(np.int64).max)
        np.minimum.at(least, t.slot, t.conv)
        columns = [_signed(t.a), _signed(t.b), _signed(t.pa), _signed(t.pb), pa.array(t.level), pa.array(t.bytes), pa.array(n.astype(np.int64)), pa.array(least)]
        return pa.table(columns, names=["a", "b", "pa", "pb", "depth", "bytes", "n", "least"])

    return count


def _summed(segment: int):
    def add(key: tuple[pa.Scalar, ...], rows: pa.Table, weights: pa.Table) -> pa.Table:
        t = Table(rows, segment)
        slot = t.look_up(weights["a"].to_numpy().view(_U), weights["b"].to_numpy().view(_U))
        out = []
        for c in ("leaves", "saved"):
            values = np.zeros(len(t.a), np.int64)
            np.add.at(values, slot, weights[c].to_numpy())
            out.append(pa.array(t.upward(values)))
        return pa.table([_signed(t.a), _signed(t.b), *out], names=["a", "b", "leaves", "saved"])

    return add


def _joined_hashes(tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each node, joined by commas; rows come sorted by node and piece.  One state is held."""
    name, state, done = None, None, []
    for table in tables:
        for a, b, ids in zip(table.column("a").to_pylist(), table.column("b").to_pylist(), table.column("ids").to_pylist(), strict=True):
            if (a, b) != name:
                if state is not None:
                    done.append((*name, state.hexdigest()))
                name, state = (a, b), hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["a", "b", "ends_sha256"])
        done = []
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((*name, state.hexdigest()), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["a", "b", "ends_sha256"])


def _ends(last: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) for (a, b, conv_id): pieces of PIECE consecutive ids first, so a node with many conversations is few rows."""
    pieces = last.groupBy("a", "b", F.floor(F.col("conv_id") / PIECE).alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    pieces = cut(pieces)
    many = pieces.groupBy("a", "b").agg(F.count("*").alias("pieces"))
    pieces = pieces.join(many, ["a", "b"])
    one = pieces.where("pieces = 1").select("a", "b", F.sha2("ids", 256).alias("ends_sha256"))
    rest = pieces.where("pieces > 1").select("a", "b", "piece", "ids").repartition("a", "b").sortWithinPartitions("a", "b", "piece")
    return one.unionByName(rest.mapInArrow(_joined_hashes, "a long, b long, ends_sha256 string"))


def trie(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """The nodes of conversations given by rows (conv_id, pos, t1, t2, bytes), pos from 0 on without gaps.

    ``conversations`` (conv_id) may name some that have no turns: they are members of the root.  See ``prefix_trie`` for the result.
    """
    lane = lambda k: F.xxhash64(F.lit(k), F.col("pos"), F.col("t1"), F.col("t2"))
    turns = rows.select("conv_id", (F.col("pos") + 1).alias("depth"), lane(1).alias("h1"), lane(2).alias("h2"), "bytes")
    none = F.lit(0).cast("long")
    ids = rows.select("conv_id") if conversations is None else rows.select("conv_id").unionByName(conversations.select("conv_id"))
    roots = ids.where("conv_id is not null").distinct().select("conv_id", none.alias("depth"), none.alias("h1"), none.alias("h2"), none.alias("bytes"))
    turns = cut(turns.unionByName(roots).withColumn("segment", F.expr(f"depth DIV {SEGMENT}")))
    totals = turns.groupBy("conv_id", "segment").agg(F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.max("depth").alias("to"), F.count("*").alias("n"))
    # Running totals; a conversation has one row for each SEGMENT turns here.
    upto = Window.partitionBy("conv_id").orderBy("segment")
    totals = cut(totals.select("conv_id", "segment", F.bit_xor("b1").over(upto).alias("e1"), F.bit_xor("b2").over(upto).alias("e2"), "b1", "b2", "to", "n", F.max("segment").over(Window.partitionBy("conv_id")).alias("last")))
    n = totals.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-n // SHARD))
    shard = lambda c, s: F.pmod(F.xxhash64(c, s), F.lit(shards)).cast("int")
    before = totals.where("last > 0").select("conv_id", "segment", F.col("e1").bitwiseXOR(F.col("b1")).alias("b1"), F.col("e2").bitwiseXOR(F.col("b2")).alias("b2"))
    dealt = turns.join(before, ["conv_id", "segment"], "left").withColumns({"b1": F.coalesce("b1", none), "b2": F.coalesce("b2", none), "shard": shard("conv_id", "segment")}).drop("segment")
    dealt = cut(dealt)
    counted = dealt.groupBy("shard").applyInArrow(_counted(SEGMENT), "a long, b long, pa long, pb long, depth long, bytes long, n long, least long")
    nodes = cut(counted.groupBy("a", "b").agg(*(F.first(c).alias(c) for c in ("pa", "pb", "depth", "bytes")), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id")))
    children = nodes.where("depth > 0").groupBy(F.col("pa").alias("a"), F.col("pb").alias("b")).agg(F.count("*").alias("n_children"))
    nodes = cut(nodes.join(children, ["a", "b"], "left").withColumn("n_children", F.coalesce("n_children", none)))
    owned = nodes.select("a", "b", "conv_id", F.expr(f"depth DIV {SEGMENT}").alias("segment"), (F.col("n_children") == 0).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    # What the later segments of a conversation hold of its own nodes counts at the last node of each earlier one.
    later = totals.where("last > 0").select("conv_id", "segment", F.col("e1").alias("a"), F.col("e2").alias("b"))
    held = owned.groupBy("conv_id", "segment").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    after = Window.partitionBy("conv_id").orderBy(F.col("segment").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = later.join(held, ["conv_id", "segment"], "left").select("a", "b", "conv_id", "segment", F.sum("leaves").over(after).alias("leaves"), F.sum("saved").over(after).alias("saved")).where("leaves is not null")
    weights = owned.unionByName(later).select(shard("conv_id", "segment").alias("shard"), "a", "b", "leaves", "saved")
    summed = dealt.groupBy("shard").cogroup(weights.groupBy("shard")).applyInArrow(_summed(SEGMENT), "a long, b long, leaves long, saved long")
    sums = summed.groupBy("a", "b").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    ends = _ends(totals.where("segment = last").select(F.col("e1").alias("a"), F.col("e2").alias("b"), "conv_id"))
    over = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(over, ["pa", "pb"], "left").join(sums, ["a", "b"]).join(ends, ["a", "b"], "left")
    parent = F.when(F.col("depth") > 0, F.col("parent_conv_id")).alias("parent_conv_id")
    return out.select("conv_id", "depth", parent, "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, turn, role, text): one for each distinct beginning, and the root of no turns.

    conv_id (least member), depth (turns), parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless nodes
    of the subtree, its top included), saved_tokens (over the subtree, (n_convs - 1) times the bytes of a node's last text), ends_sha256
    (of the ids of the conversations that end here, in order, joined by commas).  Turns are ordered, nulls first; ties by digest, so
    equal turns of one place are interchangeable.  Null roles and texts are empty.  Rows without conv_id belong to no conversation.
    Repeated rows are turns of their own; other columns are ignored; an empty table gives no nodes.
    """
    return trie(ordered(digests(turns)))
