"""Conversation prefix trie by vertical bitmaps.

1. Each turn becomes a 128-bit key of its role and text; each conversation a row with the keys of its turns in order.
2. Conversations are range-sorted by id and cut into shards of at most SHARD conversations.  A shard indexes (position,
   turn) to a bitset of its conversations; depth first, the bitset of a node is intersected with the postings of the next
   position, which yields its children; popcounts give members, and the bits without a next turn its end list.
3. Nodes of all shards are merged by the hash of their prefix: counts add up, the smallest member wins, end lists, which
   are runs of ascending ids as shards are ranges, are digested one after the other.
4. Sums over subtrees add up over shards as well, once each node has one owner, its smallest member: a conversation owns a
   suffix of its path, from the first depth at which no smaller one shares its prefix.  So of a node's members the owners of
   childless nodes count its leaves, and each member saves the bytes of its turns from the node's depth to what it owns.

No depth costs a round, and no task holds more than a shard, however many conversations share a prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, staged

#: Conversations of a shard at most, and turns beyond which it takes no further conversation.
SHARD, SHARD_TURNS = 2048, 65_536
#: Bytes of a turn's key and of a node's.
KEY = 16


def turn_key(role: str, text: str) -> Column:
    """128 bits of a role and a text; null counts as empty."""
    role, text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    return F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))


def numbered(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, pos, key, size) of turns (conv_id, turn, role, text): position from 1, key, UTF-8 bytes of the text.

    Turns are taken by turn number, nulls first, equal ones by role and text; rows without conv_id are in no conversation.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.where("conv_id IS NOT NULL").withColumn("pos", F.row_number().over(order).cast("long"))
    return rows.select("conv_id", "pos", turn_key("role", "text").alias("key"), F.octet_length("text").cast("long").alias("size"))


def mixed(turns: DataFrame, group: int = 5, shared: int = 9) -> DataFrame:
    """Rows (conv_id, pos, key, size) of numbered() turns, rebuilt so that conversations share beginnings.

    Conversation c is the first h turns of conversation c - c % group (all if it has fewer, none if it is absent), then its own
    after its first h; h = crc32(decimal c) % shared.  A conversation without turns has one row whose pos is null.
    """
    first = turns.where(F.col("pos") < shared).select(F.col("conv_id").alias("base_id"), "pos", "key", "size")
    ids = turns.select("conv_id").distinct().withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared)
    own = turns.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).where("pos > h").select("conv_id", "pos", "key", "size")
    lent = ids.withColumn("base_id", F.expr(f"conv_id - conv_id % {group}")).join(first, "base_id").where("pos <= h").select("conv_id", "pos", "key", "size")
    none = ids.select("conv_id", *(F.lit(None).cast(t).alias(c) for c, t in (("pos", "long"), ("key", "binary"), ("size", "long"))))
    return own.union(lent).union(none)


def paths(turns: DataFrame) -> DataFrame:
    """One row (conv_id, keys, sizes) for each conversation of rows (conv_id, pos, key, size), by pos; rows without pos are no turns."""
    turn = F.when(F.col("pos").isNotNull(), F.struct("pos", "key", "size"))
    rows = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return rows.select("conv_id", F.col("t.key").alias("keys"), F.col("t.size").alias("sizes"))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    held, turns = [], 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
            held.append(row)
            turns += len(row[1])
            if len(held) >= SHARD or turns >= SHARD_TURNS:
                yield held
                held, turns = [], 0
    if held:
        yield held


def child(node: bytes, key: bytes) -> bytes:
    return hashlib.blake2b(node + key, digest_size=KEY).digest()


ROOT = bytes(KEY)


def bitmap_nodes(keys: list[list[bytes]]) -> Iterator[tuple[bytes, int, int, int, int]]:
    """(node, its parent's index, depth, bitset of members, bitset of those that end there) of a shard, depth first."""
    postings: dict[tuple[int, bytes], int] = {}
    ended: dict[int, int] = {}
    for i, path in enumerate(keys):
        bit = 1 << i
        for at in enumerate(path):
            postings[at] = postings.get(at, 0) | bit
        ended[len(path)] = ended.get(len(path), 0) | bit
    stack = [(ROOT, -1, 0, (1 << len(keys)) - 1)]
    n = 0
    while stack:
        node, parent, depth, members = stack.pop()
        ends = members & ended.get(depth, 0)
        yield node, parent, depth, members, ends
        rest = members ^ ends
        while rest:
            key = keys[(rest & -rest).bit_length() - 1][depth]
            inside = members & postings[depth, key]
            rest ^= inside
            stack.append((child(node, key), n, depth + 1, inside))
        n += 1


def bits(x: int) -> Iterator[int]:
    while x:
        low = x & -x
        yield low.bit_length() - 1
        x ^= low


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


NODES = pa.schema([("node", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("least", pa.int64()), ("size", pa.int64()), ("first_end", pa.int64()), ("ends", pa.binary())])


@lean
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, keys, sizes), ascending, to the nodes of each shard."""
    for shard in _shards(batches):
        ids = [row[0] for row in shard]
        known, rows = [], []
        for node, parent, depth, members, ends in bitmap_nodes([row[1] for row in shard]):
            known.append(node)
            least = (members & -members).bit_length() - 1
            ended = [ids[i] for i in bits(ends)]
            rows.append((node, known[parent] if depth else None, depth, members.bit_count(), ids[least], shard[least][2][depth - 1] if depth else 0, ended[0] if ended else None, ",".join(map(str, ended)).encode() if ended else None))
        yield _batch(rows, NODES)


SUMS = pa.schema([("node", pa.binary()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64())])


@lean
def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, keys, sizes, first depth owned or null, whether a leaf is owned) to each shard's part of the sums."""
    for shard in _shards(batches):
        upto = []  # bytes up to each depth, and up to what the conversation owns
        owners: dict[int, int] = {}
        leaves = 0
        for i, (_, keys, sizes, owned, leaf) in enumerate(shard):
            sums = [0]
            for s in sizes:
                sums.append(sums[-1] + s)
            first = len(keys) + 1 if owned is None else owned
            upto.append((sums, sums[max(first - 1, 0)]))
            if owned is not None:
                owners[first] = owners.get(first, 0) | 1 << i
            leaves |= bool(leaf) << i
        owned_to = []  # by depth, the conversations that own their path from there on or from before
        for depth in range(max(len(row[1]) for row in shard) + 1):
            owned_to.append((owned_to[-1] if depth else 0) | owners.get(depth, 0))
        nodes = list(bitmap_nodes([row[1] for row in shard]))
        total = [0] * len(nodes)
        for k in range(len(nodes) - 1, -1, -1):
            _, parent, _, _, ends = nodes[k]
            total[k] += sum(upto[i][1] for i in bits(ends))
            if parent >= 0:
                total[parent] += total[k]
        rows = []
        for k, (node, _, depth, members, _) in enumerate(nodes):
            least = (members & -members).bit_length() - 1
            before = upto[least][0][max(depth - 1, 0)]
            saved = total[k] - members.bit_count() * before
            for i in bits(members & owned_to[depth]):  # one at most: it saves nothing from here on
                saved -= upto[i][1] - before
            rows.append((node, (members & leaves).bit_count(), saved))
        yield _batch(rows, SUMS)


@lean
def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (node, ends) of end lists, in order, to (node, ends_sha256)."""
    now, digest, names = None, None, ["node", "ends_sha256"]
    for batch in batches:
        done = []
        for node, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    done.append((now, digest.hexdigest()))
                now, digest = node, hashlib.sha256(ends)
            else:
                digest.update(b"," + ends)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), (pa.binary(), pa.string()), strict=True)], names=names)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], names=names)


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The trie of conversations given as rows (conv_id, pos, key, size), see numbered(); pos is null for one without turns.

    Returns a row for each distinct beginning, from the root on: conv_id (its smallest member), depth, parent_conv_id (of
    its parent, null for the root), n_convs, n_children, n_leaves (childless nodes of its subtree), saved_tokens (over its
    subtree, (members - 1) x bytes of the last text), ends_sha256 (of the ids of members that end there, ascending,
    comma-joined), all of them whole.  No conversations, no rows; repeated rows are repeated turns.
    A conversation's keys and sizes, 24 bytes a turn, have to fit a task; the ids that end at one node pass through one
    task as a stream, as their digest is sequential.
    """
    convs = staged(paths(turns), "trie-paths")
    ranged = convs.repartitionByRange("conv_id").sortWithinPartitions("conv_id")
    parts = staged(ranged.mapInArrow(_count, "node binary, parent binary, depth long, n long, least long, size long, first_end long, ends binary"), "trie-nodes")
    nodes = parts.groupBy("node").agg(F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"))
    children = nodes.groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")).where("node IS NOT NULL")
    nodes = staged(nodes.join(children, "node", "left").na.fill(0, ["n_children"]), "trie-merged")
    owned = nodes.groupBy("conv_id").agg(F.min("depth").alias("first_owned"), F.max(F.col("n_children") == 0).alias("leaf"))
    sums = convs.join(owned, "conv_id", "left").select("conv_id", "keys", "sizes", "first_owned", "leaf")
    sums = sums.mapInArrow(_sum, "node binary, n_leaves long, saved_tokens long").groupBy("node").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    ends = parts.where("first_end IS NOT NULL").select("node", "first_end", "ends").repartition("node").sortWithinPartitions("node", "first_end")
    ends = ends.select("node", "ends").mapInArrow(_digest, "node binary, ends_sha256 string")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    told = nodes.join(sums, "node").join(ends, "node", "left").join(parents, "parent", "left")
    return told.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
