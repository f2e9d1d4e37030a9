"""Prefix trie of conversations: ternary search trees per range shard, merged at the shards' edges.

A conversation is the sequence of its turns; a turn's code is a 128-bit digest of role and text.
Sequences are range-partitioned in lexicographic order of their codes (ties by conversation id), so
a shard holds a contiguous stretch of the trie and equal conversations lie side by side; a large
group of copies is cut by id and spread over shards.  A task reads its range as blocks of at most
``BLOCK_TURNS`` turns.  Inside a block the codes become ids of a sorted local dictionary, and the
distinct sequences are inserted into a ternary search tree, medians first, which keeps the binary
search trees among siblings balanced.  One iterative traversal gathers members, leaves and savings.

Only nodes on a block's first or last sequence can continue in another block.  Everything else is
finished where it is.  For the edge nodes a block emits sums over the finished nodes below them;
those add up over blocks.  What the edge nodes themselves contribute to their ancestors is counted
by the first block that holds them, along its two edge paths, once their own totals are known.

Memory: one block a task, however large its partition; a conversation is one row of 20 bytes a turn.

Defined cases: rows without a conversation id belong to no conversation; null role or text is
empty; turns are ordered by number, null first, equal ones by their code; empty tables give no
node (there is no conversation that the root could stand for); other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nestrank.llm.common import staged

BLOCK_TURNS = 200_000
CODE = 16
ROOT = hashlib.md5(b"").digest()
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

# ``edge``: 0 finished, 1 on the block's first sequence, 2 on its last one below the common part;
# ``parent_edge`` tells the same of the parent. For edge nodes the sums leave out edge nodes.
NODES = (
    "block long, edge int, parent_edge int, node binary, depth int, conv_id long, parent_conv_id long, n_convs long, "
    "words long, n_children long, n_leaves long, saved long, path_saved long, ends string"
)


def turn_codes(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order, as (turn, code, words)."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    coded = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("code"),
            F.regexp_count(text, F.lit("[^ \\t-\\r]+")).alias("words"),
        ).alias("t"),
    )
    return coded.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """Every conversation with its first h turns taken from the group's first conversation.

    The group of c starts at c - c % ``group`` (the remainder has c's sign); h is crc32(c) % ``heads``.  All of that turn list is
    used if it is shorter, none if there is no such conversation.
    """
    first = convs.where(F.col("conv_id") % group == 0).select(
        F.col("conv_id").alias("_first"), F.slice("turns", 1, heads).alias("_head")
    )
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0)))
    head = F.slice(F.coalesce("_head", F.slice("turns", 1, 0)), F.lit(1), h)
    return (
        convs.withColumn("_first", F.col("conv_id") - F.col("conv_id") % group)
        .join(first, "_first", "left")
        .select("conv_id", F.concat(head, own).alias("turns"))
    )


def sequences(convs: DataFrame) -> DataFrame:
    """(seq, words, conv_id) in shards by (seq, conv_id): the codes glued together, and words a turn."""
    glued = convs.select(
        F.unhex(F.array_join(F.transform("turns", lambda t: t["code"]), "")).alias("seq"),
        F.transform("turns", lambda t: t["words"].cast("int")).alias("words"),
        "conv_id",
    )
    # staged, since the range bounds are sampled in a job of their own
    return staged(glued, "op12-sequences").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")


class TernaryTree:
    """Ternary search tree over sequences of small integers; node 0 is the root's empty slot.

    Each node is one turn: ``low`` and ``high`` lead to its siblings, ``down`` to what follows it.
    """

    def __init__(self) -> None:
        self.turn, self.low, self.high, self.down = [-1], [-1], [-1], [-1]

    def _new(self, turn: int) -> int:
        for column, value in ((self.turn, turn), (self.low, -1), (self.high, -1), (self.down, -1)):
            column.append(value)
        return len(self.turn) - 1

    def insert(self, sequence: list[int]) -> list[int]:
        """Nodes of the sequence, the root first."""
        turn, path, at = self.turn, [0], 0
        for wanted in sequence:
            side, here = self.down, at  # where a missing node is hooked
            at = side[here]
            while at >= 0 and turn[at] != wanted:
                side, here = (self.low if wanted < turn[at] else self.high), at
                at = side[here]
            if at < 0:
                at = self._new(wanted)
                side[here] = at
            path.append(at)
        return path

    def children(self, node: int) -> Iterator[int]:
        stack = [self.down[node]]
        while stack:
            at = stack.pop()
            if at >= 0:
                yield at
                stack += (self.low[at], self.high[at])


def median_order(count: int) -> Iterator[int]:
    """0 .. count-1, the middle of every stretch before its halves."""
    waiting = [(0, count)]
    for low, high in waiting:
        if low < high:
            middle = (low + high) // 2
            yield middle
            waiting += ((low, middle), (middle + 1, high))


def _prefix_keys(seq: bytes) -> list[bytes]:
    """Digest of every prefix, the empty one first."""
    state, keys = hashlib.md5(), [ROOT]
    for i in range(0, len(seq), CODE):
        state.update(seq[i:i + CODE])
        keys.append(state.copy().digest())
    return keys


def block_nodes(block: int, rows: list[tuple[bytes, list[int], int]]) -> list[tuple]:
    """Rows of ``NODES`` for one block of sorted (sequence, words, conversation) rows."""
    distinct, convs = [], []
    for seq, words, conv in rows:
        if not distinct or seq != distinct[-1][0]:
            distinct.append((seq, words))
            convs.append([])
        convs[-1].append(conv)
    glued = b"".join(s for s, _ in distinct)
    local = np.unique(np.frombuffer(glued, dtype=f"V{CODE}"), return_inverse=True)[1].tolist() if glued else []
    starts = np.cumsum([0] + [len(s) // CODE for s, _ in distinct]).tolist()
    tree, paths = TernaryTree(), [[] for _ in distinct]
    for i in median_order(len(distinct)):
        paths[i] = tree.insert(local[starts[i]:starts[i + 1]])

    size = len(tree.turn)
    members, words, first = [0] * size, [0] * size, [None] * size
    parent, depth, ends = [-1] * size, [0] * size, [None] * size
    for path, found, (_, counts) in zip(paths, convs, distinct):
        ends[path[-1]] = found
        smallest = min(found)
        for node, below in zip(path, path[1:]):
            parent[below] = node
        for d, node in enumerate(path):
            members[node] += len(found)
            depth[node] = d
            words[node] = counts[d - 1] if d else 0
            if first[node] is None or smallest < first[node]:
                first[node] = smallest

    edge, key = [0] * size, {}
    for kind, i in ((2, len(paths) - 1), (1, 0)):  # the common part belongs to the first path
        for node, digest in zip(paths[i], _prefix_keys(distinct[i][0])):
            edge[node], key[node] = kind, digest

    # parents come before their children here, so the reverse order adds children first
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(tree.children(node))
    children, leaves, saved, path_saved = [0] * size, [0] * size, [0] * size, [0] * size
    for node in reversed(order):
        if edge[node]:
            path_saved[node] += members[node] * words[node]
        else:
            leaves[node] += tree.down[node] < 0
            saved[node] += (members[node] - 1) * words[node]
        up = parent[node]
        if up >= 0:
            children[up] += not edge[node]
            leaves[up] += leaves[node]
            saved[up] += saved[node]
            path_saved[up] += path_saved[node]

    out = []
    for node in order:
        ids = ",".join(map(str, ends[node])) if ends[node] else ""
        up = parent[node]
        out.append((
            block, edge[node], edge[up] if up >= 0 else 0, key.get(node), depth[node], first[node],
            first[up] if up >= 0 else None, members[node], words[node], children[node], leaves[node], saved[node],
            path_saved[node], ids if edge[node] else hashlib.sha256(ids.encode()).hexdigest(),
        ))
    return out


_ARROW = {"binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [part.split() for part in schema.split(", ")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, type=_ARROW[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields]
    )


def _block_batches(batches: Iterator[pa.RecordBatch], block_turns: int) -> Iterator[pa.RecordBatch]:
    shard, number, rows, turns = TaskContext.get().partitionId() << 32, 0, [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("seq", "words", "conv_id"))):
            rows.append(row)
            turns += len(row[1]) + 1
            if turns >= block_turns:
                yield _batch(block_nodes(shard + number, rows), NODES)
                number, rows, turns = number + 1, [], 0
    if rows:
        yield _batch(block_nodes(shard + number, rows), NODES)


EDGE_SUMS = "node binary, depth int, leaves long, saved long"


def _edge_sums(block: pa.Table) -> pa.Table:
    """What a block's own edge nodes add to each edge node of the block: the two paths, bottom up."""
    rows = block.to_pylist()
    rows.sort(key=lambda r: (-r["edge"], -r["depth"]))  # last path first, deepest first
    out, leaves, words, fork = [], 0, 0, {}
    for i, r in enumerate(rows):
        if i and rows[i - 1]["edge"] != r["edge"]:  # the last path ends in a node of the first one
            fork[rows[i - 1]["depth"] - 1] = (leaves, words)
            leaves = words = 0
        more = fork.get(r["depth"], (0, 0)) if r["edge"] == 1 else (0, 0)
        leaves += more[0] + (r["owned"] and r["childless"])
        words += more[1] + (r["words"] if r["owned"] else 0)
        out.append((r["node"], r["depth"], int(leaves), -int(words)))
    return pa.Table.from_batches([_batch(out, EDGE_SUMS)])


ENDS = "node binary, depth int, ends_sha256 string"


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over a node's id lists, which arrive in order; only its state is kept."""
    now, state, any_ids, done = None, None, False, []
    for batch in batches:
        for node, depth, ends in zip(*(batch.column(c).to_pylist() for c in ("node", "depth", "ends"))):
            if (node, depth) != now:
                if now is not None:
                    done.append((*now, state.hexdigest()))
                now, state, any_ids = (node, depth), hashlib.sha256(), False
            if ends:
                state.update(("," + ends if any_ids else ends).encode())
                any_ids = True
        yield _batch(done, ENDS)
        done = []
    if now is not None:
        yield _batch([(*now, state.hexdigest())], ENDS)


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(convs: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Nodes of the trie over ``convs`` (conv_id, turns as ``turn_codes`` gives them)."""
    nodes = staged(sequences(convs).mapInArrow(lambda it: _block_batches(it, block_turns), NODES), "op12-nodes")
    edges = nodes.where("edge > 0")

    # Totals of the edge nodes: one row a (node, block), no more than two paths a block.
    at = ["node", "depth"]
    merged = edges.groupBy(*at).agg(
        F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), F.max("words").alias("words"),
        F.sum("n_children").alias("inner_children"), F.sum("n_leaves").alias("leaves"),
        F.sum(F.col("saved") + F.col("path_saved")).alias("saved"), F.min("block").alias("owner"),
    )
    merged = staged(merged, "op12-merged")
    # The parent of an edge node is an edge node of the same block: found by (block, depth), so that
    # the root's key is spread over blocks.
    above = F.when(F.col("parent_edge") > 0, F.col("parent_edge")).otherwise(F.lit(1))
    places = staged(
        edges.select("block", "edge", *at).join(merged.select(*at, "conv_id"), at), "op12-places"
    )
    parents = places.select(
        "block", F.col("edge").alias("_edge"), (F.col("depth") + 1).alias("depth"),
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv"),
    )
    hooked = staged(
        edges.withColumn("_edge", above).join(parents, ["block", "_edge", "depth"])
        .select(*at, "parent", "parent_conv").distinct(), "op12-hooked"
    )
    fan = hooked.groupBy(F.col("parent").alias("node"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("edge_children")
    )
    whole = staged(
        merged.join(fan, at, "left").withColumn("n_children", F.col("inner_children") + F.coalesce("edge_children", F.lit(0))),
        "op12-whole",
    )
    own = edges.select("block", "edge", *at).join(
        whole.select(*at, "owner", "words", (F.col("n_children") == 0).alias("childless")), at
    ).withColumn("owned", F.col("owner") == F.col("block"))
    sums = own.groupBy("block").applyInArrow(_edge_sums, EDGE_SUMS).groupBy(*at).agg(
        F.sum("leaves").alias("edge_leaves"), F.sum("saved").alias("edge_saved")
    )
    ends = (
        edges.where("ends <> ''").select(*at, "block", "ends").repartition("node", "depth")
        .sortWithinPartitions("node", "depth", "block").mapInArrow(_hash_ends, ENDS)
    )
    edge_rows = (
        whole.join(sums, at).join(hooked.select(*at, "parent_conv"), at, "left").join(ends, at, "left")
        .select(
            "conv_id", F.col("depth").cast("long").alias("depth"), F.col("parent_conv").alias("parent_conv_id"), "n_convs",
            "n_children", (F.col("leaves") + F.col("edge_leaves")).alias("n_leaves"),
            (F.col("saved") + F.col("edge_saved")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
        )
    )
    inner = nodes.where("edge = 0")
    tops = inner.where("parent_edge > 0").join(
        parents.select("block", F.col("_edge").alias("parent_edge"), "depth", "parent_conv"), ["block", "parent_edge", "depth"]
    ).withColumn("parent_conv_id", F.col("parent_conv")).select(*nodes.columns)
    inner = inner.where("parent_edge = 0").union(tops).select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"),
    )
    return edge_rows.select(*RESULT).union(inner.select(*RESULT))


def conversation_trie(turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """Trie of the rebuilt conversations of a table of turns (conv_id, turn, role, text)."""
    return prefix_trie(rebuilt(staged(turn_codes(turns), "op12-turns")), block_turns)
