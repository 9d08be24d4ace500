"""The trie of all conversation prefixes, with totals of every subtree.

A prefix's digest is the xor of a hash of each of its turns and the turn's place, so it is a running
value that chunks of one conversation can compute apart. Nodes whose members have few turns below
them are cut off as units of bounded size; the others, the crown, are few and near the root. Units
are dealt to shards. A shard gives each of its distinct digests a slot by a minimal perfect hash,
checks every slot against the digest it holds, scatters counts into flat arrays and adds them up
through the array of parent slots, depth by depth. The crown's totals are sums over the conversations
that stand for the nodes below it, combined before they are shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import fold, map_groups
from kindred.session import broadcast_if_fits, cut_lineage

_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_COLUMNS = [c.split()[0] for c in _NODE.split(", ")]
_EMPTY = hashlib.sha256(b"").hexdigest()
_ROW_BYTES = 48


@dataclass(frozen=True)
class Trie:
    """Parameters: conversations in blocks of ``block`` ids share up to ``shared - 1`` turns of the block's first one."""

    block: int = 100
    shared: int = 6
    unit_turns: int = 1024
    shard_turns: int = 32_768
    chunk_turns: int = 4096
    joined_ids: int = 512


class PerfectHash:
    """A minimal perfect hash of distinct pairs of 64-bit words: levels of bit arrays, slots by rank.

    A key takes the first level where it meets no other key; its slot is the number of taken
    places before it. ``slots`` gives -1 for a key that is not one of them: a slot holds the key it
    was given to, and every look-up compares.
    """

    def __init__(self, keys: np.ndarray) -> None:
        left, self.levels, taken = keys, [], 0
        held = []
        while len(left):
            size = 2 * len(left) + 1
            place = self._place(left, len(self.levels), size)
            alone = np.bincount(place, minlength=size)[place] == 1
            rank = np.full(size, -1, np.int64)
            spots = np.sort(place[alone])
            rank[spots] = taken + np.arange(len(spots))
            held.append(left[alone][np.argsort(place[alone])])
            taken += len(spots)
            self.levels.append(rank)
            left = left[~alone]
        self.keys = np.concatenate(held) if held else np.empty((0, 2), np.uint64)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        h = (keys[:, 0] + np.uint64(2 * level + 1) * keys[:, 1]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h = (h + np.uint64(level + 1)) * np.uint64(0xD6E8FEB86659FD93)
        return ((h ^ (h >> np.uint64(32))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, rank in enumerate(self.levels):
            found = rank[self._place(keys[open_], level, len(rank))]
            own = (found >= 0) & (self.keys[found] == keys[open_]).all(axis=1)
            out[open_[own]] = found[own]
            open_ = open_[~own]
            if not len(open_):
                break
        return out


def running(df: DataFrame, keys: list[str], order: str, chunk: str, values: dict[str, Column], kind) -> DataFrame:
    """Running ``kind`` (an aggregate that combines with itself) of ``values`` along ``order``; chunks of a key are separate tasks."""
    inside = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    ends = df.groupBy(*keys, chunk).agg(*[kind(v).alias(f"_{n}") for n, v in values.items()])
    carried = ends.select(*keys, chunk, *[kind(f"_{n}").over(before).alias(f"_{n}") for n in values])
    own = df.select(*df.columns, *[kind(v).over(inside).alias(f"own_{n}") for n, v in values.items()])
    both = {n: kind_of_two(kind, F.col(f"own_{n}"), F.coalesce(f"_{n}", F.lit(0).cast("long"))) for n in values}
    return own.join(carried, [*keys, chunk]).select(*df.columns, *[v.alias(n) for n, v in both.items()])


def kind_of_two(kind, a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b) if kind is F.bit_xor else a + b


def turns_in_order(conversations: DataFrame, plan: Trie) -> DataFrame:
    """``c, pos, t1, t2, chars``: every turn's place in its conversation, hashes and code points.

    Turns are ordered by ``turn``, null first; ties by the turn's hashes. A conversation is cut into
    chunks along ``turn`` where it is long, so that no task orders one that holds much of the table.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"),
        F.xxhash64(F.lit(1), role, F.lit(2), text).alias("t1"), F.xxhash64(text, F.lit(3), role).alias("t2"),
        F.length(text).cast("long").alias("chars"),
    )
    part = F.coalesce(F.floor(F.col("turn") / plan.chunk_turns).cast("long"), F.lit(-(1 << 62)))
    chunked = turns.withColumn("part", part)
    inside = Window.partitionBy("c", "part").orderBy(F.col("turn").asc_nulls_first(), "t1", "t2")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = chunked.groupBy("c", "part").agg(F.count("*").alias("n"))
    offsets = sizes.select("c", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = chunked.withColumn("own", F.row_number().over(inside)).join(offsets, ["c", "part"])
    return placed.select("c", (F.col("own") + F.col("offset")).cast("long").alias("pos"), "t1", "t2", "chars")


def rebuilt(conversations: DataFrame, plan: Trie) -> DataFrame:
    """``c, depth, d1, d2, p1, p2, chars, total``: every prefix of every rebuilt conversation, the empty one as well.

    ``d`` and ``p`` are the digests of the prefix and of its parent, ``chars`` the code points of its
    last text, ``total`` the turns of the conversation.
    """
    turns = cut_lineage(turns_in_order(conversations, plan))
    convs = turns.groupBy("c").agg(F.count("*").alias("n")).withColumn("h", fold("c", plan.shared))
    base = F.col("c") - F.col("c") % plan.block
    heads = turns.where(F.col("pos") < plan.shared).withColumnRenamed("c", "base")
    bases = convs.select(F.col("c").alias("base"), F.col("n").alias("n_base"))
    known = cut_lineage(
        convs.withColumn("base", base).join(bases, "base", "left").select(
            "c", "base", "h", F.least("h", F.coalesce("n_base", F.lit(0))).cast("long").alias("borrowed"), "n"
        ).withColumn("total", F.col("borrowed") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    )
    first = known.join(heads, "base").where(F.col("pos") <= F.col("h")).select("c", F.col("pos").alias("depth"), "t1", "t2", "chars", "total")
    own = turns.join(known, "c").where(F.col("pos") > F.col("h"))
    own = own.select("c", (F.col("pos") - F.col("h") + F.col("borrowed")).alias("depth"), "t1", "t2", "chars", "total")
    path = first.unionByName(own).withColumn("chunk", F.floor(F.col("depth") / plan.chunk_turns))
    x1, x2 = F.xxhash64("depth", "t1", "t2"), F.xxhash64("t2", "depth", "t1")
    summed = running(path, ["c"], "depth", "chunk", {"d1": x1, "d2": x2}, F.bit_xor)
    prefixes = summed.select(
        "c", "depth", "d1", "d2", F.col("d1").bitwiseXOR(x1).alias("p1"), F.col("d2").bitwiseXOR(x2).alias("p2"), "chars", "total"
    )
    zero = F.lit(0).cast("long")
    roots = known.select("c", *[zero.alias(x) for x in ("depth", "d1", "d2", "p1", "p2", "chars")], "total")
    return prefixes.unionByName(roots)


def shard_nodes(group: pa.Table) -> dict[str, list]:
    """All nodes of the units of one shard, with their subtrees' totals.

    Rows are prefixes of conversations; a unit's top has its parent outside the shard.
    """
    col = {n: group.column(n).to_numpy() for n in ("c", "depth", "d1", "d2", "p1", "p2", "chars", "total")}
    digests = np.stack([col["d1"], col["d2"]], axis=1).view(np.uint64)
    table = PerfectHash(np.unique(digests, axis=0))
    n = len(table.keys)
    at = table.slots(digests)
    if (at < 0).any():
        raise ValueError("a prefix without a slot")
    n_convs = np.bincount(at, minlength=n)
    conv = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(conv, at, col["c"])
    depth, chars = np.zeros(n, np.int64), np.zeros(n, np.int64)
    depth[at], chars[at] = col["depth"], col["chars"]
    parent_digest = np.zeros((n, 2), np.uint64)
    parent_digest[at] = np.stack([col["p1"], col["p2"]], axis=1).view(np.uint64)
    parent = table.slots(parent_digest)
    inside = (parent >= 0) & (depth > 0)
    n_children = np.bincount(parent[inside], minlength=n)
    leaves = (n_children == 0).astype(np.int64)
    saved = (n_convs - 1) * chars
    order = np.argsort(depth, kind="stable")
    edges = np.flatnonzero(np.diff(depth[order])) + 1
    for level in reversed(np.split(order, edges)):
        level = level[inside[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    ends = [_EMPTY] * n
    last = np.flatnonzero(col["depth"] == col["total"])
    last = last[np.lexsort((col["c"][last], at[last]))]
    for of_node in np.split(last, np.flatnonzero(np.diff(at[last])) + 1) if len(last) else []:
        ends[at[of_node[0]]] = hashlib.sha256(",".join(map(str, col["c"][of_node].tolist())).encode()).hexdigest()
    parents = [int(conv[p]) if ok else None for p, ok in zip(parent, inside)]
    signed = table.keys.view(np.int64), parent_digest.view(np.int64)
    return {
        "conv_id": conv, "depth": depth, "parent_conv_id": parents, "n_convs": n_convs, "n_children": n_children, "n_leaves": leaves,
        "saved_tokens": saved, "ends_sha256": ends, "p1": signed[1][:, 0], "p2": signed[1][:, 1],
    }


def end_digests(ends: DataFrame, plan: Trie) -> DataFrame:
    """``d1, d2, ends_sha256``: the hash of each node's sorted ids, whatever their number.

    Ranges of ids are joined to strings of bounded length first; only these pass, in order and one
    at a time, through the node's hash, which can't be computed otherwise than in order.
    """

    def join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("first", pa.int64()), ("ids", pa.string())])
        for batch in batches:
            d1, d2, c = (batch.column(i).to_pylist() for i in range(3))
            rows, start = [], 0
            for i in range(1, len(c) + 1):
                if i == len(c) or (d1[i], d2[i]) != (d1[start], d2[start]) or i - start == plan.joined_ids:
                    rows.append((d1[start], d2[start], c[start], ",".join(map(str, c[start:i]))))
                    start = i
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * 4, schema)], schema=schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("d1", pa.int64()), ("d2", pa.int64()), ("ends_sha256", pa.string())])
        node, state, done = None, None, []
        for batch in batches:
            for a, b, ids in zip(*(batch.column(n).to_pylist() for n in ("d1", "d2", "ids")), strict=True):
                if (a, b) != node:
                    if state is not None:
                        done.append((*node, state.hexdigest()))
                    node, state = (a, b), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)
                done = []
        if state is not None:
            done.append((*node, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), schema)], schema=schema)

    ids = ends.select("d1", "d2", "c").repartitionByRange("d1", "d2", "c").sortWithinPartitions("d1", "d2", "c")
    joined = ids.mapInArrow(join_ids, "d1 long, d2 long, first long, ids string")
    return joined.repartition("d1", "d2").sortWithinPartitions("d1", "d2", "first").mapInArrow(digest, "d1 long, d2 long, ends_sha256 string")


def trie(conversations: DataFrame, plan: Trie = Trie()) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    Null roles and texts count as empty. Rows without a conversation id belong to no conversation and
    are passed over. Turns with one number are ordered by a hash of role and text; repeated rows are
    turns of their own. Other columns are ignored; no rows give no node, not even a root.
    """
    paths = cut_lineage(rebuilt(conversations, plan))
    key = ["depth", "d1", "d2"]
    below = F.col("total") - F.col("depth") + 1
    nodes = paths.groupBy(*key).agg(
        F.count("*").alias("n_convs"), F.min("c").alias("conv_id"), F.first("chars").alias("chars"), F.first("p1").alias("p1"),
        F.first("p2").alias("p2"), F.sum(below).alias("turns"),
    )
    crown = cut_lineage(nodes.where(F.col("turns") > plan.unit_turns))
    shown = broadcast_if_fits(crown.select(*key, "conv_id"), _ROW_BYTES)
    # The crown is closed upwards: along a conversation its nodes come first.
    in_crown = cut_lineage(paths.join(shown, key))
    tops = in_crown.groupBy("c").agg(F.max("depth").alias("top"))
    split = paths.join(tops, "c", "left").withColumn("top", F.coalesce("top", F.lit(-1)))
    outside = split.where(F.col("depth") > F.col("top"))
    heads = outside.where(F.col("depth") == F.col("top") + 1).select("c", F.col("d1").alias("u1"), F.col("d2").alias("u2"))
    shards = max(1, math.ceil(paths.count() / plan.shard_turns))
    dealt = outside.drop("top").join(heads, "c").withColumn("shard", F.pmod(F.xxhash64("u1", "u2"), F.lit(shards)))
    units = cut_lineage(map_groups(dealt.drop("u1", "u2"), ["shard"], shard_nodes, f"{_NODE}, p1 long, p2 long"))
    hung = units.where(F.col("parent_conv_id").isNull())
    rest = units.where(F.col("parent_conv_id").isNotNull()).select(*_COLUMNS)
    parents = crown.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent"))
    parents = broadcast_if_fits(parents, _ROW_BYTES)
    # A unit without a parent in the crown is the whole trie.
    tops_named = hung.drop("parent_conv_id").join(parents, ["depth", "p1", "p2"], "left")
    tops_named = tops_named.withColumnRenamed("parent", "parent_conv_id").select(*_COLUMNS)
    crowned = crown_nodes(crown, in_crown, hung, parents, plan)
    return rest.unionByName(tops_named).unionByName(crowned)


def crown_nodes(crown: DataFrame, in_crown: DataFrame, hung: DataFrame, parents: DataFrame, plan: Trie) -> DataFrame:
    """The crown's nodes: what hangs below a node is added up over the conversations that stand for it.

    A unit's or a crown node's own value is put on its smallest conversation; a running sum from the
    conversation's deepest crown node upwards brings it to all of that conversation's crown nodes.
    """
    key = ["depth", "d1", "d2"]
    kids = hung.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2")).unionByName(
        crown.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("d1"), F.col("p2").alias("d2"))
    )
    children = kids.groupBy(*key).agg(F.count("*").alias("n_children"))
    own = crown.join(children, key, "left").select(
        F.col("conv_id").alias("c"), "depth", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
        F.col("n_children").isNull().cast("long").alias("leaves"),
    )
    units = hung.select(F.col("conv_id").alias("c"), (F.col("depth") - 1).alias("depth"), F.col("saved_tokens").alias("saved"), F.col("n_leaves").alias("leaves"))
    values = own.unionByName(units).groupBy("c", "depth").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    rows = in_crown.select("c", *key).join(values.select("c").distinct(), "c").join(values, ["c", "depth"], "left")
    rows = rows.select("c", *key, F.coalesce("saved", F.lit(0)).alias("s"), F.coalesce("leaves", F.lit(0)).alias("l"))
    rows = rows.withColumns({"up": -F.col("depth"), "chunk": F.floor(-F.col("depth") / plan.chunk_turns)})
    summed = running(rows, ["c"], "up", "chunk", {"saved": F.col("s"), "leaves": F.col("l")}, F.sum)
    totals = summed.groupBy(*key).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves"))
    ends = end_digests(in_crown.where(F.col("depth") == F.col("total")), plan)
    named = crown.join(parents, ["depth", "p1", "p2"], "left").withColumnRenamed("parent", "parent_conv_id")
    full = named.join(totals, key).join(children, key, "left").join(ends, ["d1", "d2"], "left")
    return full.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
