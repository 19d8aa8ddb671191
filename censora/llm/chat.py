"""Chat formatting on a prefix tree: shared first turns are written once, with position ids and attention intervals.

Conversations are sorted by the hashes of their turns, so that those with a common beginning are neighbours and the sorted
order is the depth-first order of their prefix tree. Each task walks its part of that order and packs it into sequences of
bounded length: the turns a conversation shares with the one before it (compared in full) are there already, the rest is
appended. A turn is a node: its characters (the tokens here) in the sequence, the position id of its first one, and the
intervals of the sequence that it may attend to beside itself, which are its ancestors. However many conversations share
a beginning, no group is gathered: a common beginning is written once per sequence, and sequences end at a fixed size.

Template: ``<|role|>text</s>`` for each turn; control strings within roles and texts get a backslash behind their first
character, which is taken off again on reading. The loss mask covers the texts of assistant turns, nothing else.

Defined results: turns are ordered by turn, role, text, repeated rows included; NULL roles and texts are empty; a NULL
conversation id is a conversation of its own; an empty table gives no sequence; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censora.session import materialise

# Characters and conversations after which a sequence ends.
SEQUENCE_CHARS, SEQUENCE_LEAVES = 65_536, 1_024
LEARNT = "assistant"

# What stands behind the first character of a control string.
_TAIL = r"(?=\\*(?:\||>|/?s>|/?INST\]))"
_ESCAPE = re.compile(rf"([<\[|]){_TAIL}")
_UNESCAPE = re.compile(rf"([<\[|])\\{_TAIL}")


def escaped(text: str) -> str:
    return _ESCAPE.sub(r"\1\\", text)


def unescaped(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def formatted_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn under the template, and where its text begins and ends."""
    head, body = f"<|{escaped(role)}|>", escaped(text)
    return f"{head}{body}</s>", len(head), len(head) + len(body)


def parsed(formatted: str) -> Iterator[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    at = 0
    while at < len(formatted):
        role_end = formatted.index("|>", at + 2)
        end = formatted.index("</s>", role_end + 2)
        yield unescaped(formatted[at + 2 : role_end]), unescaped(formatted[role_end + 2 : end])
        at = end + 4


class Node(NamedTuple):
    """Its characters ``start`` to ``end``, the position id of the first, its parent, the span under the loss mask, its ancestors' intervals."""

    start: int
    end: int
    position: int
    parent: int
    loss_start: int
    loss_end: int
    attends: list[tuple[int, int]]


class Sequence:
    """A sequence while it grows, in depth-first order."""

    def __init__(self):
        self.text: list[str] = []
        self.size = 0
        self.nodes: list[Node] = []
        self.leaves: list[tuple[int | None, int]] = []
        self.path: list[tuple[tuple[str, str], int]] = []

    def shared(self, turns: list[tuple[str, str]]) -> int:
        """How many first turns are those of the conversation before."""
        n = 0
        for (turn, _), other in zip(self.path, turns):
            if turn != other:
                break
            n += 1
        return n

    def add(self, conversation: int | None, turns: list[tuple[str, str]]) -> None:
        del self.path[self.shared(turns) :]
        for role, text in turns[len(self.path) :]:
            parent = self.path[-1][1] if self.path else -1
            shown, a, b = formatted_turn(role, text)
            attends: list[tuple[int, int]] = []
            position = 0
            if parent >= 0:
                above = self.nodes[parent]
                attends = list(above.attends)
                # Neighbouring intervals are one.
                if attends and attends[-1][1] == above.start:
                    attends[-1] = (attends[-1][0], above.end)
                else:
                    attends.append((above.start, above.end))
                position = above.position + above.end - above.start
            start, learnt = self.size, role == LEARNT
            self.nodes.append(Node(start, start + len(shown), position, parent, start + a if learnt else start, start + b if learnt else start, attends))
            self.text.append(shown)
            self.size += len(shown)
            self.path.append(((role, text), len(self.nodes) - 1))
        self.leaves.append((conversation, self.path[-1][1]))

    def full(self, turns: list[tuple[str, str]]) -> bool:
        """Whether another conversation would make it too long."""
        extra = sum(len(r) + len(t) + 8 for r, t in turns[self.shared(turns) :])
        return bool(self.leaves) and (len(self.leaves) >= SEQUENCE_LEAVES or extra > 0 and self.size + extra > SEQUENCE_CHARS)

    def row(self) -> dict:
        return {
            "text": "".join(self.text),
            "nodes": [n._asdict() | {"attends": [{"start": a, "end": b} for a, b in n.attends]} for n in self.nodes],
            "leaves": [{"conversation": c, "node": n} for c, n in self.leaves],
        }


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_NODE = pa.struct([*((n, pa.int64()) for n in ("start", "end", "position", "parent", "loss_start", "loss_end")), ("attends", pa.list_(_SPAN))])
_PACKED = pa.schema([("text", pa.string()), ("nodes", pa.list_(_NODE)), ("leaves", pa.list_(pa.struct([("conversation", pa.int64()), ("node", pa.int64())])))])
SEQUENCES = (
    "text string, nodes array<struct<start:long,end:long,position:long,parent:long,loss_start:long,loss_end:long,attends:array<struct<start:long,end:long>>>>, "
    "leaves array<struct<conversation:long,node:long>>"
)


def position_ids(sequence) -> np.ndarray:
    """The position id of every character of a sequence."""
    return np.concatenate([np.arange(n["position"], n["position"] + n["end"] - n["start"]) for n in sequence["nodes"]] or [np.zeros(0, np.int64)])


def sequences(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Packed sequences: ``text``, ``nodes`` and ``leaves`` (the last node of each conversation)."""
    said = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    whole = conversations.groupBy(F.col(conv_id).cast("long").alias("conversation")).agg(F.array_sort(F.collect_list(said)).alias("turns"))
    path = F.concat_ws("", F.transform("turns", lambda t: F.lower(F.lpad(F.hex(F.xxhash64(t["role"], t["text"])), 16, "0"))))
    stored = materialise(whole.select("conversation", path.alias("path"), F.transform("turns", lambda t: F.struct(t["role"], t["text"])).alias("turns")), "conversations")
    ordered = stored.repartitionByRange("path", "conversation").sortWithinPartitions("path", "conversation").select("conversation", "turns")

    def run(batches):
        held, out = Sequence(), []
        for batch in batches:
            for conversation, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                turns = [tuple(t.values()) for t in turns]
                if held.full(turns):
                    out.append(held.row())
                    held = Sequence()
                    if len(out) >= 64:
                        yield pa.RecordBatch.from_pylist(out, _PACKED)
                        out = []
                held.add(conversation, turns)
        if held.leaves:
            out.append(held.row())
        if out:
            yield pa.RecordBatch.from_pylist(out, _PACKED)

    return ordered.mapInArrow(run, SEQUENCES)


def read_back(packed: DataFrame) -> DataFrame:
    """From sequences alone, one row per conversation: its turns, what the loss mask covers, and its formatted length.

    A conversation is its last node and what that may attend to, in order.
    """

    def run(batches):
        for batch in batches:
            for sequence in batch.to_pylist():
                text, nodes, out = sequence["text"], sequence["nodes"], []
                for leaf in sequence["leaves"]:
                    node = nodes[leaf["node"]]
                    shown = "".join(text[s["start"] : s["end"]] for s in [*node["attends"], node])
                    learnt, at = [], leaf["node"]
                    while at >= 0:
                        n = nodes[at]
                        learnt.append(unescaped(text[n["loss_start"] : n["loss_end"]]))
                        at = n["parent"]
                    learnt = "".join(reversed(learnt))
                    turns = list(parsed(shown))
                    digest = hashlib.sha256()
                    for role, said in turns:
                        digest.update(f"{role}\n{said}\n".encode("utf-8", "replace"))
                    loss = hashlib.sha256(learnt.encode("utf-8", "replace")).hexdigest()
                    out.append((leaf["conversation"], len(turns), digest.hexdigest(), len(learnt), loss, len(shown)))
                columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return packed.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
