"""Conversation prefix trie: double arrays per shard of the sorted conversations, their shared upper nodes merged by Spark.

A turn is known by a digest of its role and text, so that no text leaves the scan. Conversations are ranged by the digests of
their turns: those with a common beginning are neighbours, and a shard (a stretch of this order with a bounded number of
turns) holds whole subtrees but for the nodes on its first and its last path. In a shard, distinct turns get dense ids in the
order of the nodes, the transitions of each node are packed into BASE and CHECK arrays, and the conversations are walked
through these arrays to count members. Nodes off the two edge paths are complete there. Those on them (the root always) come
with what hangs below them inside the shard; Spark adds up their parts by key, and takes the sums of the subtrees of these
upper nodes by doubling, in as many rounds as the depth has binary digits. A first turn that a third of all conversations
share, or a third of them being copies, only means that some shards have the same upper nodes.

Defined results: turns are ordered by turn (NULL first), those of equal turn by their digest, repeated rows included; NULL
roles and texts are empty; rows without a conversation id belong to no conversation; a conversation without turns ends at the
root; an empty table gives no node; other columns are ignored. What one task holds is a shard, at least one conversation
(40 bytes a turn); the ids that end at one node are hashed in a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censora.session import materialise

# Turns and conversations of a shard; ids in a piece of a node's ends; cells tried for a node's children.
SHARD_TURNS, PIECE_IDS, TRIES = 200_000, 512, 64
_NOTHING = hashlib.sha256(b"").hexdigest()


class DoubleArray:
    """A trie in two arrays: the child of state ``s`` by id ``c`` is ``BASE[s] + c``, if ``CHECK`` there names ``s``.

    It is packed from nodes in level order (node 0 is the root; node i + 1 has ``parents[i]`` and the dense id ``codes[i]``).
    Nodes with several children take cells at random places, or the end, where all of these are free; only children fill the rest.
    """

    def __init__(self, parents: np.ndarray, codes: np.ndarray):
        nodes, ids = len(parents) + 1, int(codes.max(initial=-1)) + 1
        self.cell_of = np.zeros(nodes, np.int64)
        base_of = np.zeros(nodes, np.int64)
        order = np.lexsort((codes, parents))
        many, first, count = np.unique(parents[order], return_index=True, return_counts=True)
        used = np.zeros(nodes + ids + 1, bool)
        used[0], end, pick = True, 1, np.random.default_rng(17)
        for k in np.argsort(-count, kind="stable"):
            if count[k] == 1:
                break
            children = order[first[k] : first[k] + count[k]]
            apart = codes[children] - codes[children[0]]
            if len(used) <= end + apart[-1]:
                used = np.concatenate([used, np.zeros(len(used) + apart[-1], bool)])
            at = np.append(pick.integers(1, end + 1, TRIES), end)
            at = at[at + apart[-1] < len(used)]
            cells = at[np.argmin(used[at[:, None] + apart].any(1))] + apart
            used[cells] = True
            end = max(end, int(cells[-1]) + 1)
            base_of[many[k]] = cells[0] - codes[children[0]]
            self.cell_of[children + 1] = cells
        only = order[first[count == 1]]
        free = np.flatnonzero(~used[:end])[: len(only)]
        cells = np.concatenate([free, end + np.arange(len(only) - len(free))])
        self.cell_of[only + 1] = cells
        base_of[parents[only]] = cells - codes[only]
        self.base = np.zeros(int(self.cell_of.max()) + 1, np.int64)
        self.check = np.full(len(self.base), -1, np.int64)
        self.base[self.cell_of] = base_of
        self.check[self.cell_of[1:]] = self.cell_of[parents]

    def step(self, states: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The states after one more turn each, -1 where there is none."""
        to = self.base[states] + codes
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == states), to, -1)

    def find(self, codes: Iterable[int]) -> int:
        """The state of a path, -1 if the trie lacks it."""
        state = 0
        for code in codes:
            state = int(self.step(np.array([state]), np.array([code]))[0])
            if state < 0:
                break
        return state


def levels(starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Level by level, the distinct prefixes: their parents' numbers, their last ids, and a place in ``codes`` for each."""
    at, ids, number = np.zeros(len(lengths), np.int64), int(codes.max(initial=0)) + 1, 1
    parents, last, places = [], [], []
    alive = np.arange(len(lengths))
    for depth in range(int(lengths.max(initial=0))):
        alive = alive[lengths[alive] > depth]
        place = starts[alive] + depth
        pairs, one, back = np.unique(at[alive] * ids + codes[place], return_index=True, return_inverse=True)
        parents.append(pairs // ids)
        last.append(pairs % ids)
        places.append(place[one])
        at[alive] = number + back
        number += len(pairs)
    return parents, last, places


_SHARD = pa.schema(
    [
        ("kind", pa.string()),
        ("key", pa.string()),
        ("parent_key", pa.string()),
        *((n, pa.int64()) for n in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars")),
        ("ends", pa.string()),
    ]
)
_SHARD_DDL = (
    "kind string, key string, parent_key string, conv_id long, depth long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string"
)


def shard_nodes(convs: np.ndarray, lengths: np.ndarray, keys: pa.Array, chars: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The nodes of a shard of sorted conversations: whole ones (``inner``), parts of upper ones, pieces of the latter's ends."""
    starts = np.cumsum(lengths) - lengths
    turns = keys.dictionary_encode()
    codes = turns.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    parents_by, codes_by, places_by = levels(starts, lengths, codes)
    none = [np.zeros(0, np.int64)]
    parents, last, places = (np.concatenate(a or none) for a in (parents_by, codes_by, places_by))
    # Dense ids in the order of the nodes: most siblings get neighbouring ones.
    seen, first = np.unique(last, return_index=True)
    dense = np.empty(int(codes.max(initial=0)) + 1, np.int64)
    dense[seen[np.argsort(first)]] = np.arange(len(seen))
    codes = dense[codes]
    trie = DoubleArray(parents, dense[last])

    nodes = len(parents) + 1
    members, least, cells = np.zeros(len(trie.base), np.int64), np.full(len(trie.base), np.iinfo(np.int64).max), np.zeros(len(convs), np.int64)
    members[0], least[0] = len(convs), convs.min()
    alive = np.arange(len(convs))
    for depth in range(len(parents_by)):
        alive = alive[lengths[alive] > depth]
        cells[alive] = trie.step(cells[alive], codes[starts[alive] + depth])
        np.add.at(members, cells[alive], 1)
        np.minimum.at(least, cells[alive], convs[alive])
    members, least = members[trie.cell_of], least[trie.cell_of]
    node_at = np.zeros(len(trie.base), np.int64)
    node_at[trie.cell_of] = np.arange(nodes)
    end_at = node_at[cells]

    depth = np.zeros(nodes, np.int64)
    depth[1:] = np.repeat(np.arange(1, len(parents_by) + 1), [len(p) for p in parents_by])
    size = np.zeros(nodes, np.int64)
    size[1:] = chars[places]
    children = np.bincount(parents, minlength=nodes)
    # The first and the last path may go on in other shards.
    upper, key = np.zeros(nodes, bool), {0: _NOTHING}
    upper[0] = True
    for i in {0, len(convs) - 1}:
        path, node = hashlib.sha256(), int(end_at[i])
        line = []
        while node:
            line.append(node)
            node = int(parents[node - 1])
        for node in reversed(line):
            path.update(keys[int(places[node - 1])].as_py().encode())
            upper[node] = True
            key[node] = path.hexdigest()
    leaves, saved = ((children == 0) & ~upper).astype(np.int64), np.where(upper, 0, (members - 1) * size)
    below = nodes
    for at in range(len(parents_by) - 1, -1, -1):
        level = np.arange(below - len(parents_by[at]), below)
        below = int(level[0])
        level = level[~upper[level]]
        np.add.at(leaves, parents[level - 1], leaves[level])
        np.add.at(saved, parents[level - 1], saved[level])
    inside = children - np.bincount(parents[upper[1:]], minlength=nodes)

    ends: dict[int, list[int]] = {}
    for node, conv in zip(end_at.tolist(), convs.tolist()):
        ends.setdefault(node, []).append(conv)
    rows = []
    for node in range(nodes):
        above = int(parents[node - 1]) if node else None
        numbers = (int(least[node]), int(depth[node]), int(least[above]) if node and not upper[above] else None, int(members[node]), int(inside[node]), int(leaves[node]), int(saved[node]), int(size[node]))
        own = ends.get(node, ())
        if upper[node]:
            rows.append(("upper", key[node], key.get(above), *numbers, None))
            for k in range(0, len(own), PIECE_IDS):
                piece = own[k : k + PIECE_IDS]
                rows.append(("piece", key[node], None, piece[0], *[None] * 7, ",".join(map(str, piece))))
        else:
            rows.append(("inner", None, key.get(above), *numbers, hashlib.sha256(",".join(map(str, own)).encode()).hexdigest()))
        if len(rows) >= 10_000:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SHARD)], schema=_SHARD)


def _shards(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]]:
    """Stretches of at most ``SHARD_TURNS`` turns and conversations together, or one conversation."""
    held: list[pa.RecordBatch] = []
    room = SHARD_TURNS

    def joined():
        columns = [pa.concat_arrays([b.column(i) for b in held]) for i in range(3)]
        lengths = np.diff(columns[1].offsets.to_numpy()) if len(columns[1]) else np.zeros(0, np.int64)
        return columns[0].to_numpy(zero_copy_only=False), lengths.astype(np.int64), columns[1].flatten(), columns[2].flatten().to_numpy(zero_copy_only=False)

    for batch in batches:
        cost = np.cumsum(batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(cost, (cost[at - 1] if at else 0) + room, "right"))
            if to <= at and not held:
                to = at + 1
            if to > at:
                held.append(batch.slice(at, to - at))
                room -= int(cost[to - 1] - (cost[at - 1] if at else 0))
                at = to
            if at < batch.num_rows:
                yield joined()
                held, room = [], SHARD_TURNS
    if held:
        yield joined()


def turn_keys(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id`` and ``turns``: digest and code points of the text of each turn, in order. Texts are not shuffled."""
    said = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).where("conv_id IS NOT NULL")
    whole = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    one = F.struct("turn", F.substring(F.sha2(whole.cast("binary"), 256), 1, 32).alias("key"), F.char_length("text").cast("long").alias("chars"))
    ordered = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return ordered.select("conv_id", F.transform("turns", lambda t: F.struct(t["key"].alias("key"), t["chars"].alias("chars"))).alias("turns"))


def _totals(upper: DataFrame) -> DataFrame:
    """Sums of ``leaves`` and ``saved`` over the subtree of each upper node, by doubling the distance that is covered."""
    reached = materialise(upper.select("key", F.col("parent_key").alias("up"), "leaves", "saved"), "trie-sums")
    while not reached.where("up IS NOT NULL").isEmpty():
        moved = reached.where("up IS NOT NULL").groupBy(F.col("up").alias("key")).agg(F.sum("leaves").alias("_leaves"), F.sum("saved").alias("_saved"))
        further = reached.select(F.col("key").alias("up"), F.col("up").alias("_up"))
        added = reached.join(moved, "key", "left").join(further, "up", "left")
        zero = F.lit(0)
        reached = materialise(
            added.select("key", F.col("_up").alias("up"), (F.col("leaves") + F.coalesce("_leaves", zero)).alias("leaves"), (F.col("saved") + F.coalesce("_saved", zero)).alias("saved")),
            "trie-sums",
        )
    return reached.drop("up")


def _ends(pieces: DataFrame) -> DataFrame:
    """``key`` and the hash of all ids that end there, ascending. A node's pieces pass through one task as a stream."""

    def run(batches):
        key, digest, out = None, None, []
        for batch in batches:
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if own != key:
                    if key is not None:
                        out.append((key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if key is not None:
            out.append((key, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)], ["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "ends").mapInArrow(run, "key string, ends_sha256 string")


def nodes(sequences: DataFrame) -> DataFrame:
    """One row per node of the trie of ``sequences`` (``conv_id``, distinct; ``turns`` of ``key`` and ``chars``).

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``
    (code points that members below need not repeat) and ``ends_sha256`` (of the members that end at the node).
    """
    keys, chars = (F.col(f"turns.{c}").alias(c) for c in ("key", "chars"))
    path = F.array_join("turns.key", "").alias("path")
    ordered = sequences.select("conv_id", keys, chars, path).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")

    def run(batches):
        for shard in _shards(batches):
            yield from shard_nodes(*shard)

    found = materialise(ordered.select("conv_id", "key", "chars").mapInArrow(run, _SHARD_DDL), "trie-nodes")
    parts = found.where("kind = 'upper'").groupBy("key")
    added = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    merged = materialise(parts.agg(F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.max("chars").alias("chars"), *added), "trie-upper")
    kids = merged.where("parent_key IS NOT NULL").groupBy(F.col("parent_key").alias("key")).agg(F.count(F.lit(1)).alias("_kids"))
    upper = merged.join(kids, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("_kids", F.lit(0)))
    own_leaf = (F.col("n_children") == 0).cast("long")
    upper = materialise(
        upper.select("*", (F.col("n_leaves") + own_leaf).alias("leaves"), (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved")), "trie-upper"
    )
    names = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("_above"))
    ends = _ends(found.where("kind = 'piece'").select("key", "conv_id", "ends"))
    whole = upper.drop("leaves", "saved").join(_totals(upper), "key").join(ends, "key", "left").join(names, "parent_key", "left")
    shared = whole.select(*_columns(parent=F.col("_above"), leaves=F.col("leaves"), saved=F.col("saved"), ends=F.coalesce("ends_sha256", F.lit(_NOTHING))))
    inner = found.where("kind = 'inner'")
    below = inner.where("parent_key IS NOT NULL").join(names, "parent_key").select(*_columns(parent=F.col("_above")))
    return shared.unionByName(below).unionByName(inner.where("parent_key IS NULL").select(*_columns()))


def _columns(parent: Column | None = None, leaves: Column | None = None, saved: Column | None = None, ends: Column | None = None) -> Sequence[Column]:
    given = {"parent_conv_id": parent, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": F.col("ends") if ends is None else ends}
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return [(F.col(n) if given.get(n) is None else given[n]).alias(n) for n in names]
