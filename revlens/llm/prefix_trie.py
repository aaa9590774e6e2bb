"""Prefix trie of conversations, built from Z-fast tries.

A conversation is the sequence of its turns (role, text); a node is a distinct
sequence of first turns. Every turn is a 128-bit digest before anything is
shuffled, so texts stay in the scan, and a prefix is the folded digest of its
turns: equal digests are the same node wherever they arise.

1. Every task inserts its conversations, batch by batch, into a compacted Z-fast
   trie (``ZFastTrie``). A compacted node covers the depths of one edge and is
   hashed under the prefix digest at its *handle*, the two-fattest depth of that
   edge (the multiple of the largest power of two in it). The node where a
   conversation leaves the trie is found by fat binary search: probes go to
   two-fattest depths, so a conversation of length L needs about log2 L probes.
2. Edges are expanded to one row per depth, with the conversations counted below
   it, the smallest one and sums of their weights. A prefix shared by a third of
   all conversations is one row per trie; rows are merged by digest.
3. Sums over subtrees need no walk over depths. A node's *owner* is its smallest
   member; the nodes a conversation owns are the end of its path. Conversations
   go through the tries once more, weighted with what they own, so a node's sum
   over members is the sum of its subtree plus what its owner owns above it.

A trie is expanded and emptied once it holds ``TRIE_DEPTHS`` depths; that changes
nothing but the number of rows to merge.

Defined results: null role or text is empty; turns are ordered by turn (null
first), then role, then digest; repeated rows are turns of their own; rows with a
null conv_id name no conversation and are left out; a conversation without turns
is a member of the root alone; an empty table has no nodes, not even a root.
Memory of a task: one trie and 20 bytes a turn of the conversation it reads.
"""

from __future__ import annotations

from functools import partial
from hashlib import blake2b, sha256

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, release, small_side, staged

ROOT = b"\0" * 16
TRIE_DEPTHS = 200_000
# Ids of ending conversations are put together in blocks of so many numbers.
END_BLOCK = 4096


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that is divisible by the largest power of two."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class _Node:
    __slots__ = ("top", "path", "chars", "children", "members", "least", "weight", "leaves")

    def __init__(self, top: int, path: list, chars: list):
        self.top = top  # depth of the parent's end; this edge covers top + 1 .. end
        self.path, self.chars = path, chars
        self.children: dict[bytes, _Node] = {}
        self.members, self.least, self.weight, self.leaves = 0, None, 0, 0

    @property
    def end(self) -> int:
        return self.top + len(self.path)


class ZFastTrie:
    """Compacted trie over sequences given by their prefix digests."""

    def __init__(self):
        self.root = _Node(-1, [ROOT], [0])
        self.handles: dict[bytes, _Node] = {}
        self.depths = 1

    def _hash(self, node: _Node) -> None:
        self.handles[node.path[two_fattest(node.top, node.end) - node.top - 1]] = node

    def _unhash(self, node: _Node) -> None:
        del self.handles[node.path[two_fattest(node.top, node.end) - node.top - 1]]

    def exit_node(self, path: list) -> tuple[_Node, int]:
        """The node on whose edge ``path`` (digests of depths 0..L) leaves the
        trie, and the depth up to which they agree."""
        node, a, b = self.root, 0, len(path) - 1
        while a < b:
            f = two_fattest(a, b)
            met = self.handles.get(path[f])
            if met is None:
                b = f - 1
                continue
            node, a = met, met.end
            if a >= len(path) or path[a] != met.path[-1]:
                break  # it ends or leaves inside this edge
        if node.end < len(path) and path[node.end] == node.path[-1]:
            # The exit may lie on a child's edge, before its handle.
            if node.end + 1 >= len(path) or (child := node.children.get(path[node.end + 1])) is None:
                return node, node.end
            node = child
        lo, hi = node.top + 1, min(node.end, len(path) - 1)
        while lo < hi:  # they agree at node.top + 1
            mid = (lo + hi + 1) // 2
            if path[mid] == node.path[mid - node.top - 1]:
                lo = mid
            else:
                hi = mid - 1
        return node, lo

    def insert(self, path: list, chars: list, conv: int, weight: int = 0, leaf: int = 0) -> None:
        node, depth = self.exit_node(path)
        if depth < node.end:  # split the edge
            self._unhash(node)
            k = depth - node.top
            rest = _Node(depth, node.path[k:], node.chars[k:])
            rest.children, rest.members, rest.least, rest.weight, rest.leaves = (
                node.children, node.members, node.least, node.weight, node.leaves)
            node.path, node.chars = node.path[:k], node.chars[:k]
            node.children = {rest.path[0]: rest}
            node.members, node.least, node.weight, node.leaves = 0, None, 0, 0
            self._hash(node)
            self._hash(rest)
        if depth + 1 < len(path):
            child = _Node(depth, path[depth + 1:], chars[depth + 1:])
            node.children[child.path[0]] = child
            self._hash(child)
            self.depths += len(child.path)
            node = child
        node.members += 1
        node.least = conv if node.least is None else min(node.least, conv)
        node.weight += weight
        node.leaves += leaf

    def expand(self):
        """(digest, parent digest, depth, chars, members, least, weight, leaves)
        of every depth of every edge, counted over the subtree."""
        order, stack = [], [(self.root, b"")]
        while stack:
            node, above = stack.pop()
            order.append((node, above))
            stack += [(c, node.path[-1]) for c in node.children.values()]
        for node, _ in reversed(order):  # children before parents
            for c in node.children.values():
                node.members += c.members
                node.weight += c.weight
                node.leaves += c.leaves
                node.least = c.least if node.least is None else min(node.least, c.least)
        for node, above in order:
            for k, digest in enumerate(node.path):
                yield (digest, above or None, node.top + 1 + k, node.chars[k], node.members, node.least, node.weight, node.leaves)
                above = digest


NODES = "node binary, parent binary, depth long, chars long, members long, least long, weight decimal(38,0), leaves long, ends long"
_COLUMNS = ["node", "parent", "depth", "chars", "members", "least", "weight", "leaves", "ends"]


def _tries(with_ends: bool, batches):
    """Sorted turns to expanded nodes; with ``with_ends`` also one row per
    conversation, whose ``ends`` is its id and ``node`` the node it ends at."""
    trie, rows = ZFastTrie(), []
    conv, path, chars, own = None, [], [], (0, 0)

    def close():
        nonlocal trie
        trie.insert(path, chars, conv, *own)
        if with_ends:
            rows.append((path[-1], None, None, None, None, None, None, None, conv))
        if trie.depths >= TRIE_DEPTHS:
            rows.extend((*x, None) for x in trie.expand())
            trie = ZFastTrie()

    def frames():
        for k in range(0, len(rows), 20_000):
            some = pd.DataFrame(rows[k:k + 20_000], columns=_COLUMNS, dtype=object)
            for c in ("depth", "chars", "members", "least", "leaves", "ends"):
                some[c] = pd.array(some[c], dtype="Int64")
            yield some
        rows.clear()

    for pdf in batches:
        for c, kind, digest, n, weight, leaf in zip(*(pdf[x].tolist() for x in ("conv_id", "kind", "digest", "chars", "weight", "leaf"))):
            if c != conv or conv is None:
                if conv is not None:
                    close()
                conv, path, chars = c, [ROOT], [0]
            if kind == 0:  # the conversation's own row
                own = (int(weight), int(leaf))
            else:
                path.append(blake2b(path[-1] + digest, digest_size=16).digest())
                chars.append(n)
        yield from frames()
    if conv is not None:
        close()
        rows.extend((*x, None) for x in trie.expand())
        yield from frames()
    release()


def _through_tries(turns: DataFrame, with_ends: bool) -> DataFrame:
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["conv_id", "kind", "pos"]
    return (turns.select("conv_id", "kind", "pos", "digest", "chars", "weight", "leaf").repartition(parts, "conv_id")
            .sortWithinPartitions(*order).mapInPandas(partial(_tries, with_ends), NODES))


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, digest, chars) of every turn with a conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars")).where("conv_id is not null")
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return rows.select("conv_id", F.row_number().over(w).cast("long").alias("pos"), "digest", "chars")


def with_shared_openings(turns: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """(conv_id, kind, pos, digest, chars): kind 0 one row per conversation, 1
    the first h turns of conversation ``conv_id - conv_id % group``, 2 its own
    turns after its first h; h is crc32(conv_id as text) % (most + 1)."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = turns.select("conv_id").distinct()
    opening = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") <= most)).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    taken = (convs.select("conv_id", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base"))
             .join(opening, "base").where("pos <= h").select("conv_id", F.lit(1).alias("kind"), "pos", "digest", "chars"))
    own = turns.where(F.col("pos") > h).select("conv_id", F.lit(2).alias("kind"), "pos", "digest", "chars")
    marks = convs.select("conv_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("digest"),
                         F.lit(0).cast("long").alias("chars"))
    return marks.unionByName(taken).unionByName(own)


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from rows (node, conv): ids are joined in blocks of
    numbers, and the blocks of a node stream through one hash in order."""
    parts = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = (ends.groupBy("node", F.floor(F.col("conv") / END_BLOCK).alias("block"))
              .agg(F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("ids")))

    def fold(batches):
        node, h = None, None
        for pdf in batches:
            out = []
            for x, ids in zip(pdf["node"].tolist(), pdf["ids"].tolist()):
                if x != node:
                    if node is not None:
                        out.append((node, h.hexdigest()))
                    node, h = x, sha256()
                else:
                    h.update(b",")
                h.update(ids.encode())
            if out:
                yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, h.hexdigest())], columns=["node", "ends_sha256"])

    return blocks.repartition(parts, "node").sortWithinPartitions("node", "block").select("node", "ids").mapInPandas(
        fold, "node binary, ends_sha256 string")


def build(turns: DataFrame) -> DataFrame:
    """Nodes of the trie of conversations given as rows (conv_id, kind, pos,
    digest, chars), kind 0 being one row per conversation without a turn:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, node and parent (digests)."""
    bound_batches(turns.sparkSession)
    turns = staged(turns, "trie-turns")
    zero = F.lit(0).cast("decimal(38,0)")
    first = staged(_through_tries(turns.withColumn("weight", zero).withColumn("leaf", F.lit(0).cast("long")), True), "trie-parts")
    nodes = staged(first.where("ends is null").groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"),
        F.sum("members").alias("n_convs"), F.min("least").alias("conv_id")), "trie-nodes")
    children = staged(nodes.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    own = (F.col("n_convs") - 1).cast("decimal(20,0)") * F.col("chars")
    nodes = staged(nodes.join(children, "node", "left").select(
        "node", "parent", "depth", "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        own.cast("decimal(38,0)").alias("own")), "trie-owned")
    owned = nodes.groupBy("conv_id").agg(F.sum("own").cast("decimal(38,0)").alias("weight"), F.sum(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    # Only a conversation's own row carries what it owns.
    marks = (turns.where("kind = 0").join(owned, "conv_id", "left")
             .select(*turns.columns, F.coalesce("weight", zero).alias("weight"), F.coalesce("leaf", F.lit(0)).cast("long").alias("leaf")))
    rest = turns.where("kind <> 0").withColumn("weight", zero).withColumn("leaf", F.lit(0).cast("long"))
    sums = (_through_tries(marks.unionByName(rest), False).groupBy("node")
            .agg(F.sum("weight").alias("below"), F.sum("leaves").alias("n_leaves")))
    above = F.sum("own").over(Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1))
    ends = _end_digests(first.where("ends is not null").select("node", F.col("ends").alias("conv")))
    out = staged(nodes.withColumn("above", F.coalesce(above, zero)).join(sums, "node").join(ends, "node", "left"), "trie-sums")
    inner = staged(nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "trie-inner")
    return out.join(small_side(inner, 40), "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("below") - F.col("above")).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), "node", "parent")


def prefix_trie(conversations: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """The trie of conversations rebuilt with shared openings."""
    return build(with_shared_openings(staged(turn_digests(conversations), "trie-digests"), group, most))
