"""Shards of near equal size by longest-processing-time scheduling of groups that must stay together.

Groups go, largest first, to the shard with the least load. Groups alike in row size and number of copies are one class,
and a class is scheduled at once: what a heap of the shards would do with k equal groups is found by levelling the loads.
So the schedule sees one row per class, of which there are at most about the square root of twice the total bytes
(distinct sizes add up), and never a list of groups. Groups are numbered within their class and rows within their group
in blocks, so neither a class nor a group of any share of the rows meets in one task.

Defined results: a NULL text has no bytes and is in one group with empty texts; rows of equal text, repeated rows
included, share a shard and take neighbouring slots; equal sizes are told apart by the hash of the text; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censora.llm.frames import numbered, text_of
from censora.session import materialise

# Bytes that a row takes beside its text.
ROW_BYTES = 8


def assign(loads: list[int], size: int, times: int) -> list[int]:
    """How many of ``times`` equal groups of ``size`` each shard gets from a heap of (load, shard); ``loads`` grow by them.

    All shards are first raised to the highest level that uses up no more groups than there are, then the heap deals the rest.
    """
    taken = [0] * len(loads)

    def below(level: int) -> list[int]:
        # Groups a shard gets while its load is below the level.
        return [max(0, -(-(level - load) // size)) for load in loads]

    if times > len(loads):
        low, high = min(loads), max(loads) + size * times
        while low < high:
            middle = (low + high + 1) // 2
            if sum(below(middle)) <= times:
                low = middle
            else:
                high = middle - 1
        taken = below(low)
        for k, n in enumerate(taken):
            loads[k] += n * size
    heap = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(heap)
    for _ in range(times - sum(taken)):
        load, k = heapq.heappop(heap)
        taken[k] += 1
        loads[k] = load + size
        heapq.heappush(heap, (loads[k], k))
    return taken


def schedule(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, list[int], list[int], list[int]]]:
    """For classes (row size, copies, groups): (row size, copies, first group number, shard, first slot), lists in parallel."""
    loads, rows, out = [0] * shards, [0] * shards, []
    for size, copies, groups in sorted(classes, key=lambda c: (-c[0] * c[1], -c[0])):
        first, starts, to, slots = 0, [], [], []
        for shard, n in enumerate(assign(loads, size * copies, groups)):
            if n:
                starts.append(first)
                to.append(shard)
                slots.append(rows[shard])
                first += n
                rows[shard] += n * copies
        out.append((size, copies, starts, to, slots))
    return out


def sharded(docs: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` (0, 1, 2, … in each shard) of every row."""
    spark = docs.sparkSession
    raw = text_of(docs, text).cast("binary")
    sized = docs.select(
        F.col(doc_id).alias("doc_id"), (F.octet_length(raw) + ROW_BYTES).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.sha2(raw, 256).alias("group")
    )
    rows = materialise(sized, "sized")
    groups = materialise(rows.groupBy("group", "size").agg(F.count(F.lit(1)).alias("copies")), "groups")
    classes = [tuple(r) for r in groups.groupBy("size", "copies").count().collect()]
    if not classes:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    columns = list(zip(*schedule(classes, shards)))
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = (pa.int64(), pa.int64(), longs, ints, longs)
    plan = spark.createDataFrame(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["size", "copies", "starts", "to", "slots"]))
    placed = numbered(groups, ["size", "copies"], ["group"], "nth").join(materialise(plan, "schedule"), ["size", "copies"])
    # The last part of the class that starts at or before the group's number.
    part = F.size(F.filter("starts", lambda s: s <= F.col("nth")))
    placed = placed.select(
        "group",
        F.element_at("to", part).alias("shard"),
        (F.element_at("slots", part) + (F.col("nth") - F.element_at("starts", part)) * F.col("copies")).alias("start"),
    )
    copies = numbered(rows, ["group"], ["doc_id", "text_crc32"], "copy")
    found = copies.join(placed, "group")
    return found.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("copy")).alias("slot"))


def balance(bytes_per_shard: np.ndarray) -> float:
    """The fullest shard over the mean."""
    return float(bytes_per_shard.max() / max(1.0, bytes_per_shard.mean()))
