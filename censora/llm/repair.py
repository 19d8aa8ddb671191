"""Conversation structure repair: the cheapest edits that make the roles read ``(s?(ua)+)?``, by a checkpointed dynamic program.

A conversation is first reduced to one short record per row (role initial, fault), without texts. Costs are computed backwards:
for each place and each of four states (nothing yet, after the system turn, after a user turn, after an assistant turn), what
the rest costs at least. Only the vectors at about √n checkpoints are stored. Walking forward, a block's vectors are recomputed
from the checkpoint behind it, and of the edits on a cheapest way the one with the ASCII-least initial is taken, which gives the
ASCII-least string of edits: D(elete) < I(nsert) < K(eep) < R(erole). Then the rows pass by once more in order, each conversation
behind its edits, and come out repaired; so no task holds a conversation's texts.

Edits: Keep is free; Rerole to user or assistant costs 1; Delete 2, and a blank or duplicate row must go; Insert an empty user or
assistant turn 5; a truncated row that is not deleted costs 5 more.

Faults, the first that applies: blank (nothing but ASCII white space), duplicate (role and text of an earlier row of the
conversation), truncated (the last character that is not white space is none of ``.!?``).

Defined results: rows are ordered by turn (NULL first), those of equal turn by a digest of role and text; NULL roles and texts
are empty; a NULL conversation id is a conversation of its own; a conversation of which nothing remains has no edits; an empty
table gives an empty one; other columns are ignored. What one task holds is a conversation's records (80 bytes a row).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censora.llm.frames import slices

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
_NEVER = 1 << 60
# States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn. 0 and 3 may end.
_NEXT = (2, 2, 3, 2)
_ROLE = ("user", "user", "assistant", "user")
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
_LEGAL = {"su", "ua", "au"}
OK, BLANK, DUPLICATE, CUT = range(4)

Costs = tuple[int, int, int, int]
# What is left to pay when all rows are done: insertions alone.
_END: Costs = (0, 2 * INSERT, INSERT, 0)


def _with_insertions(costs: list[int]) -> Costs:
    """Two insertions at most are worth while at one place: after them the state is one that was left."""
    user, assistant = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return min(costs[0], INSERT + user), min(costs[1], INSERT + user), user, assistant


def _before(initial: str, fault: int, after: Costs) -> Costs:
    """The costs before a row, from those after it."""
    costs = []
    extra = TRUNCATED if fault == CUT else 0
    for state in range(4):
        best = DELETE + after[state]
        if fault in (OK, CUT):
            best = min(best, REROLE + extra + after[_NEXT[state]])
            kept = _KEEP[state].get(initial)
            if kept is not None:
                best = min(best, extra + after[kept])
        costs.append(best)
    return _with_insertions(costs)


def edits(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """The least cost for rows of (role initial, fault), and the ASCII-least initials of edits with that cost."""
    n = len(rows)
    step = isqrt(n) + 1
    checkpoints = {n: _END}
    costs = _END
    for i in range(n - 1, -1, -1):
        costs = _before(*rows[i], costs)
        if i % step == 0:
            checkpoints[i] = costs
    total, state, done = costs[0], 0, []
    for start in range(0, n, step):
        stop = min(start + step, n)
        block = [checkpoints[stop]]
        for i in range(stop - 1, start - 1, -1):
            block.append(_before(*rows[i], block[-1]))
        block.reverse()
        for (initial, fault), now, after in zip(rows[start:stop], block, block[1:]):
            extra = TRUNCATED if fault == CUT else 0
            while True:
                if now[state] == DELETE + after[state]:
                    done.append("D")
                elif now[state] == INSERT + now[_NEXT[state]]:
                    done.append("I")
                    state = _NEXT[state]
                    continue
                elif fault in (OK, CUT) and now[state] == extra + after[_KEEP[state].get(initial, state)] and initial in _KEEP[state]:
                    done.append("K")
                    state = _KEEP[state][initial]
                else:
                    done.append("R")
                    state = _NEXT[state]
                break
    while _END[state]:
        done.append("I")
        state = _NEXT[state]
    return total, "".join(done)


def applied(audit: str, rows: Iterable[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired rows of (role, text)."""
    state, at = 0, 0

    def inserted():
        nonlocal state, at
        while audit[at : at + 1] == "I":
            yield _ROLE[state], ""
            state, at = _NEXT[state], at + 1

    for role, text in rows:
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "K":
            yield role, text
            state = _KEEP[state][role[:1]]
        elif edit == "R":
            yield _ROLE[state], text
            state = _NEXT[state]
    yield from inserted()


def _ordered(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    whole = F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    return rows.withColumn("key", F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))


AUDIT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _audited(records: list[dict]) -> tuple:
    seen, rows, counts, turns = set(), [], [0] * 4, set()
    illegal, last = 0, None
    for r in records:
        fault = BLANK if r["fault"] == BLANK else DUPLICATE if r["key"] in seen else r["fault"]
        seen.add(r["key"])
        counts[fault] += 1
        if r["turn"] is not None:
            turns.add(r["turn"])
        if last is not None and last + r["initial"] not in _LEGAL:
            illegal += 1
        last = r["initial"]
        rows.append((last, fault))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return min(gaps, (1 << 63) - 1), counts[BLANK], counts[DUPLICATE], counts[CUT], illegal, *edits(rows)


def audits(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``gaps`` in its turns, ``blank``, ``duplicate`` and ``truncated`` rows, ``illegal`` neighbours, ``cost`` and ``audit``."""
    rows = _ordered(conversations, conv_id, turn, role, text)
    bare = F.rtrim("text", F.lit(" \t\n\v\f\r"))
    fault = F.when(bare == "", BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), CUT).otherwise(OK)
    record = F.struct("turn", "key", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(record)).alias("records"))

    def run(batches):
        for batch in slices(batches):
            out = [_audited(records) for records in batch.column(1).to_pylist()]
            columns = [pa.array([r[i] for r in out], pa.string() if i == 6 else pa.int64()) for i in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["conv_id", *names])

    names = [f.strip().split()[0] for f in AUDIT.split(",")]
    return whole.mapInArrow(run, f"conv_id {dict(whole.dtypes)['conv_id']}, {AUDIT}")


def repaired(conversations: DataFrame, audited: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired rows: ``conv_id``, ``place`` (from 0), ``role``, ``text``, each conversation in one stretch of one partition."""
    rows = _ordered(conversations, conv_id, turn, role, text).select("conv_id", F.lit(1).alias("_kind"), "turn", "key", "role", "text")
    no = F.lit(None)
    first = audited.select("conv_id", F.lit(0).alias("_kind"), no.cast("long").alias("turn"), no.cast("string").alias("key"), F.lit("").alias("role"), F.col("audit").alias("text"))
    stream = rows.unionByName(first).repartition("conv_id").sortWithinPartitions("conv_id", "_kind", "turn", "key").select("conv_id", "_kind", "role", "text")

    def told(batches):
        for batch in slices(batches):
            yield from zip(*(batch.column(i).to_pylist() for i in range(4)))

    def run(batches):
        source, out = told(batches), []
        following = next(source, None)

        def own(conversation):
            nonlocal following
            while following is not None and following[1] == 1 and following[0] == conversation:
                row = following
                following = next(source, None)
                yield row[2:]

        while following is not None:
            conversation, _, _, audit = following
            following = next(source, None)
            for place, (said, what) in enumerate(applied(audit, own(conversation))):
                out.append((conversation, place, said, what))
                if len(out) >= 1024:
                    yield _rows(out, kind)
                    out = []
        if out:
            yield _rows(out, kind)

    kind = pa.string() if dict(rows.dtypes)["conv_id"] == "string" else pa.int64()
    return stream.mapInArrow(run, f"conv_id {dict(rows.dtypes)['conv_id']}, place long, role string, text string")


def _rows(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (kind, pa.int64(), pa.string(), pa.string()))], ["conv_id", "place", "role", "text"])


def digests(mended: DataFrame) -> DataFrame:
    """``conv_id`` and the SHA-256 of its rows ``role:text`` joined by line feeds, of a frame as ``repaired`` gives it."""

    def run(batches):
        out, digest, conversation = [], None, None
        for batch in slices(batches):
            for own, place, role, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if place == 0:
                    if digest is not None:
                        out.append((conversation, digest.hexdigest()))
                    conversation, digest = own, hashlib.sha256()
                else:
                    digest.update(b"\n")
                digest.update(f"{role}:{text}".encode("utf-8", "replace"))
        if digest is not None:
            out.append((conversation, digest.hexdigest()))
        kind = pa.string() if text_id else pa.int64()
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], kind), pa.array([r[1] for r in out], pa.string())], ["conv_id", "repaired_sha256"])

    text_id = dict(mended.dtypes)["conv_id"] == "string"
    return mended.mapInArrow(run, f"conv_id {dict(mended.dtypes)['conv_id']}, repaired_sha256 string")
