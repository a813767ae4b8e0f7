"""Prefix trie of conversations from sorted sequences, their LCPs and range minima, without a stack.

A conversation becomes the list of the 128-bit digests of its turns. Equal lists are one sequence with a weight. The distinct
sequences are sorted over the whole table and cut into blocks by ranges. With the common prefix of each sequence and its
predecessor (LCP) in a sparse table, every candidate prefix (sequence, depth) finds the first and the last sequence that share it
by two binary searches of its own: the interval of its members. A prefix is a node where its interval starts, nodes in order of
(start, depth) are in preorder, and what a subtree sums up is a difference of running sums.

A block finishes all nodes but the prefixes of its first and its last sequence, which may go on in other blocks. For those it
gives their parts. These border sequences, two per block, are a small instance of the same problem, solved by the same kernel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.llm.tables import arrow_map, batch_of, only, stored

#: Conversations of one family share their first turns: c belongs to c - c % FAMILY and takes over crc32(c) % MOST_TAKEN turns.
FAMILY, MOST_TAKEN = 5, 9
#: Turns of distinct sequences in a block, and bytes of the identifiers in one piece of a list of copies.
BLOCK_TURNS = 1 << 17
PIECE_BYTES = 1 << 16
DIGEST = 16
NOTHING = hashlib.sha256(b"").hexdigest()

SEQUENCE = "sequence binary, bytes array<long>, members long, least long, ends string"
#: Finished nodes (side is null), and the parts of prefixes of the first (0) and last (1) sequence of a block.
NODE = (
    "block int, side int, depth long, least long, parent_least long, parent_side int, members long, children long, leaves long, "
    "saved long, ends string, bytes long, sequence binary"
)
TOP = "block int, side int, depth long, node boolean, least long, parent_least long, members long, children long, leaves long, saved long, ends string"


def own_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, family, turns``: per conversation its turns in order, as structs with the digest ``h`` in hex and ``bytes``.

    Null turns come first, equal ones in the order of role and of the text's digest; null roles and texts are empty.
    """
    c = F.col("conv_id").cast("long")
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    text_digest = F.md5(F.encode(text, "UTF-8"))
    digest = F.md5(F.encode(F.concat_ws(":", F.octet_length(role).cast("string"), role, text_digest), "UTF-8"))
    turn = F.struct(
        F.col("turn").isNotNull().alias("numbered"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        text_digest.alias("t"),
        digest.alias("h"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    rows = only(conversations, ["conv_id", "turn", "role", "text"]).filter("conv_id IS NOT NULL")
    rows = rows.select(c.alias("conv_id"), (c - c % FAMILY).alias("family"), turn.alias("t"))
    # dealt by family, so that the members of one meet their first without another shuffle
    listed = rows.repartition("family").groupBy("family", "conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    return listed.select("conv_id", "family", F.transform("turns", lambda t: F.struct(t["h"].alias("h"), t["bytes"].alias("bytes"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: the first h turns of the family's first conversation, then the own turns after the first h."""
    own = own_turns(conversations)
    first = own.filter("conv_id = family").select("family", F.slice("turns", 1, MOST_TAKEN - 1).alias("shared"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_TAKEN
    none = F.slice("turns", 1, 0)
    taken = F.slice(F.coalesce("shared", none), 1, h.cast("int"))
    rest = F.slice("turns", h.cast("int") + 1, F.size("turns"))
    return own.join(first, "family", "left").select("conv_id", F.concat(taken, rest).alias("turns"))


def _end_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, conv_id) -> (key, first id, ids joined by commas) in pieces of bounded size."""
    key, first, held, size = None, None, [], 0

    def piece() -> pa.RecordBatch:
        return batch_of(key=pa.array([key], pa.string()), first=pa.array([first], pa.int64()), ids=pa.array([",".join(held)], pa.string()))

    for batch in batches:
        for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if held and (k != key or size > PIECE_BYTES):
                yield piece()
                held, size = [], 0
            if not held:
                key, first = k, c
            held.append(str(c))
            size += len(held[-1]) + 1
    if held:
        yield piece()


def _ends_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (key, first id) -> the SHA-256 over all pieces of a key, taken in one at a time."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        return batch_of(key=pa.array([key], pa.string()), ends=pa.array([state.hexdigest()], pa.string()))

    for batch in batches:
        for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids"), strict=True):
            if k != key:
                if state is not None:
                    yield done()
                key, state = k, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.as_py().encode())
    if state is not None:
        yield done()


def sequences(conversations: DataFrame) -> DataFrame:
    """The columns of SEQUENCE: distinct lists of turns, their weight, least identifier and the hash of their identifiers."""
    turns = rebuilt(conversations)
    flat = F.array_join(F.transform("turns", lambda t: t["h"]), "")
    rows = stored(
        turns.select(
            "conv_id",
            F.md5(F.encode(flat, "UTF-8")).alias("key"),
            F.unhex(flat).alias("sequence"),
            F.transform("turns", lambda t: t["bytes"]).alias("bytes"),
        ),
        "rebuilt",
    )
    groups = rows.groupBy("key").agg(F.count("*").alias("members"), F.min("conv_id").alias("least"))
    groups = stored(groups, "groups")
    several = groups.filter("members > 1").select("key")
    copies = rows.select("key", "conv_id").join(several, "key", "left_semi")
    pieces = copies.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = arrow_map(pieces, _end_pieces, "key string, first long, ids string")
    hashed = arrow_map(
        pieces.repartition("key").sortWithinPartitions("key", "first"), _ends_hashes, "key string, ends string"
    )
    named = groups.join(hashed, "key", "left").select("members", "least", "ends")
    alone = F.sha2(F.col("least").cast("string"), 256)
    return rows.join(named, rows["conv_id"] == named["least"]).select(
        "sequence", "bytes", "members", "least", F.coalesce("ends", alone).alias("ends")
    )


class RangeMinimum:
    """Sparse table: minima of all runs of a power of two of values."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        width = 1
        while 2 * width <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The least value from ``first`` to ``last``, both included."""
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), dtype=self.levels[0].dtype)
        for k in np.unique(level).tolist():
            own = level == k
            out[own] = np.minimum(self.levels[k][first[own]], self.levels[k][last[own] - (1 << k) + 1])
        return out

    def extents(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last place that share ``depth`` with place ``at``; value i is shared by the places i - 1 and i.

        Both are found by a binary search of each candidate, over runs that halve.
        """
        left, right, count = at.copy(), at.copy(), len(self.levels[0])
        for k in range(len(self.levels) - 1, -1, -1):
            run, level = 1 << k, self.levels[k]
            start = left - run + 1
            step = start >= 1
            step[step] = level[start[step]] >= depth[step]
            left[step] -= run
            start = right + 1
            step = start + run <= count
            step[step] = level[start[step]] >= depth[step]
            right[step] += run
        return left, right


class SortedSequences:
    """Sorted distinct lists of digests; candidate prefixes, the nodes among them, and sums over subtrees."""

    def __init__(self, packed: list[bytes]):
        self.lengths = np.array([len(p) // DIGEST for p in packed], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        words = np.frombuffer(b"".join(packed), dtype=np.uint64).reshape(-1, 2)
        self.shared = self._shared(words)
        self.table = RangeMinimum(self.shared)
        # candidates: every prefix of every sequence that its predecessor does not have, in preorder
        fresh = np.where(np.arange(len(packed)) == 0, -1, self.shared)
        counts = self.lengths - fresh
        self.node_starts = np.concatenate([[0], np.cumsum(counts)])
        self.at = np.repeat(np.arange(len(packed)), counts)
        self.depth = np.arange(len(self.at)) - self.node_starts[self.at] + fresh[self.at] + 1
        self.last = self.table.extents(self.at, self.depth)[1]

    def _shared(self, words: np.ndarray) -> np.ndarray:
        """LCP of each sequence with its predecessor; the first has none (-1)."""
        common = np.minimum(self.lengths[1:], self.lengths[:-1])
        ends = np.concatenate([[0], np.cumsum(common)])
        pair = np.repeat(np.arange(len(common)), common)
        place = np.arange(len(pair)) - ends[pair]
        same = (words[self.starts[1:-1][pair] + place] == words[self.starts[:-2][pair] + place]).all(axis=1)
        shared = common.copy()
        np.minimum.at(shared, pair[~same], place[~same])
        return np.concatenate([[-1], shared])

    def node(self, at: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The number of the node of a prefix: that of the first sequence which has it."""
        first = self.table.extents(at, depth)[0]
        fresh = np.where(first == 0, -1, self.shared[first])
        return self.node_starts[first] + depth - fresh - 1

    def parents(self) -> np.ndarray:
        """The number of the parent of every node; the root's is -1."""
        inner = self.depth > 0
        out = np.full(len(self.at), -1, dtype=np.int64)
        out[inner] = self.node(self.at[inner], self.depth[inner] - 1)
        return out

    def subtree(self, values: np.ndarray) -> np.ndarray:
        """Sums of a value of the nodes over the subtree of each."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.node_starts[self.last + 1]] - sums[: len(self.at)]

    def is_end(self) -> np.ndarray:
        return self.depth == self.lengths[self.at]


def _last_bytes(rows: SortedSequences, sizes: list[list[int]]) -> np.ndarray:
    """Bytes of the last text of each node; the root has none."""
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *[np.array(s, dtype=np.int64) for s in sizes]])
    out = np.zeros(len(rows.at), dtype=np.int64)
    inner = rows.depth > 0
    out[inner] = flat[rows.starts[rows.at[inner]] + rows.depth[inner] - 1]
    return out


def _one_block(block: int, columns: dict[str, list]) -> pa.RecordBatch:
    """The nodes of one block of sorted sequences; those on its borders as parts, with their whole sequence at the deepest."""
    rows = SortedSequences(columns["sequence"])
    last = len(rows.lengths) - 1
    weight = np.concatenate([[0], np.cumsum(np.array(columns["members"], dtype=np.int64))])
    members = weight[rows.last + 1] - weight[rows.at]
    least = RangeMinimum(np.array(columns["least"], dtype=np.int64)).least(rows.at, rows.last)
    size = _last_bytes(rows, columns["bytes"])
    parent = rows.parents()
    is_open = (rows.at == 0) | (rows.last == last)
    # a node that the first sequence has belongs to it, also if the last one has it, too
    side = np.where(rows.at == 0, 0, 1)
    has_parent = parent >= 0
    children = np.bincount(parent[has_parent & ~is_open], minlength=len(parent))
    leaf = ~is_open & (np.bincount(parent[has_parent], minlength=len(parent)) == 0)
    leaves = rows.subtree(leaf.astype(np.int64))
    saved = rows.subtree(np.where(is_open, 0, (members - 1) * size))
    open_parent = has_parent & is_open[np.maximum(parent, 0)]
    ends = np.where(rows.is_end(), np.array(columns["ends"], dtype=object)[rows.at], NOTHING)
    deepest = is_open & rows.is_end() & ((rows.at == 0) | (rows.at == last))
    whole = [columns["sequence"][a] if d else None for a, d in zip(rows.at.tolist(), deepest.tolist(), strict=True)]
    none = ~has_parent | open_parent
    return batch_of(
        block=pa.array(np.full(len(parent), block, dtype=np.int32)),
        side=pa.array(side.astype(np.int32), mask=~is_open),
        depth=pa.array(rows.depth),
        least=pa.array(least),
        parent_least=pa.array(least[np.maximum(parent, 0)], mask=none),
        parent_side=pa.array(side[np.maximum(parent, 0)].astype(np.int32), mask=~open_parent),
        members=pa.array(members),
        children=pa.array(children.astype(np.int64)),
        leaves=pa.array(leaves),
        saved=pa.array(saved),
        ends=pa.array(ends.tolist(), pa.string()),
        bytes=pa.array(size),
        sequence=pa.array(whole, pa.binary()),
    )


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partition of sorted sequences is a block, named by the number of the partition."""
    from pyspark import TaskContext

    got = [b for b in batches if b.num_rows]
    if got:
        held = {name: [v for b in got for v in b.column(name).to_pylist()] for name in got[0].schema.names}
        out = _one_block(TaskContext.get().partitionId(), held)
        for at in range(0, out.num_rows, 1 << 14):
            yield out.slice(at, 1 << 14)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of all border prefixes -> the finished nodes, and to which node each part belongs."""
    got = [b for b in batches if b.num_rows]
    if not got:
        return
    table = pa.Table.from_batches(got)
    block, side, depth, part_least, part_members, part_children, part_leaves, part_saved, size = (
        table.column(c).to_numpy() for c in ("block", "side", "depth", "least", "members", "children", "leaves", "saved", "bytes")
    )
    sequence, ends = table.column("sequence").to_pylist(), table.column("ends").to_pylist()
    # one sequence per block and side, at its deepest part; by value they are sorted as the blocks are
    held = sorted((s, int(b), int(x)) for s, b, x in zip(sequence, block, side, strict=True) if s is not None)
    rows = SortedSequences([s for s, _, _ in held])
    place = {(b, x): k for k, (_, b, x) in enumerate(held)}
    at = np.array([place[b, x] for b, x in zip(block.tolist(), side.tolist(), strict=True)], dtype=np.int64)
    node = rows.node(at, depth)
    count = len(rows.at)
    members = _summed(node, part_members, count)
    least = np.full(count, np.iinfo(np.int64).max)
    np.minimum.at(least, node, part_least)
    own_size = np.zeros(count, dtype=np.int64)
    own_size[node] = size
    own_ends = np.full(count, NOTHING, dtype=object)
    for n, e in zip(node.tolist(), ends, strict=True):
        if e != NOTHING:
            own_ends[n] = e
    parent = rows.parents()
    inner = parent >= 0
    children = _summed(node, part_children, count) + np.bincount(parent[inner], minlength=count)
    leaves = _summed(node, part_leaves, count) + rows.subtree((children == 0).astype(np.int64))
    saved = _summed(node, part_saved, count) + rows.subtree((members - 1) * own_size)
    above = least[np.maximum(parent, 0)]
    first = np.zeros(len(node), dtype=bool)
    first[np.unique(node, return_index=True)[1]] = True
    out = batch_of(
        block=pa.array(block.astype(np.int32)),
        side=pa.array(side.astype(np.int32)),
        depth=pa.array(depth),
        node=pa.array(first),
        least=pa.array(least[node]),
        parent_least=pa.array(above[node], mask=parent[node] < 0),
        members=pa.array(members[node]),
        children=pa.array(children[node]),
        leaves=pa.array(leaves[node]),
        saved=pa.array(saved[node]),
        ends=pa.array(own_ends[node].tolist(), pa.string()),
    )
    for first_row in range(0, out.num_rows, 1 << 14):
        yield out.slice(first_row, 1 << 14)


def _summed(node: np.ndarray, values: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros(count, dtype=np.int64)
    np.add.at(out, node, values.astype(np.int64))
    return out


def _result(least: Column, parent: Column) -> list[Column]:
    return [
        least.alias("conv_id"),
        F.col("depth"),
        parent.alias("parent_conv_id"),
        F.col("members").alias("n_convs"),
        F.col("children").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.col("ends").alias("ends_sha256"),
    ]


def prefix_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``: one row per node.

    Null roles and texts are empty; rows without a conversation id belong to none and are left out. Turns come by number, null
    first, and of one number by role and digest of the text, so repeated rows are turns of their own. ``c % 5`` has the sign of
    c, as in SQL. An empty table has no conversation and no node, not even the root. Very long texts count by their digest; a
    conversation's digests (16 bytes a turn) are one row. Other columns are ignored.
    """
    if block_turns < 1:
        raise ValueError("a block has at least one turn")
    found = stored(sequences(conversations), "sequences")
    turns = found.agg(F.sum(F.size("bytes") + 1)).first()[0]
    if not turns:
        return conversations.sparkSession.createDataFrame(
            [], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
        )
    blocks = -(-turns // block_turns)
    dealt = found.repartitionByRange(int(blocks), "sequence").sortWithinPartitions("sequence")
    nodes = stored(arrow_map(dealt, _blocks, NODE), "nodes")
    parts = nodes.filter("side IS NOT NULL").select(
        "block", "side", "depth", "least", "members", "children", "leaves", "saved", "ends", "bytes", "sequence"
    )
    top = stored(arrow_map(parts.repartition(1), _borders, TOP), "borders")
    finished = nodes.filter("side IS NULL")
    whole = finished.filter("parent_side IS NULL").select(*_result(F.col("least"), F.col("parent_least")))
    above = top.select("block", F.col("side").alias("parent_side"), (F.col("depth") + 1).alias("depth"), F.col("least").alias("above"))
    under = finished.filter("parent_side IS NOT NULL").join(above, ["block", "parent_side", "depth"])
    under = under.select(*_result(F.col("least"), F.col("above")))
    return whole.unionByName(under).unionByName(top.filter("node").select(*_result(F.col("least"), F.col("parent_least"))))
