import heapq
import random
import zlib
from collections import defaultdict

from censora.llm import frames, sharding
from censora.llm.queries import QUERIES
from censora.session import materialise


def by_heap(loads, size, times):
    heap, taken = [(load, k) for k, load in enumerate(loads)], [0] * len(loads)
    heapq.heapify(heap)
    for _ in range(times):
        load, k = heapq.heappop(heap)
        taken[k] += 1
        heapq.heappush(heap, (load + size, k))
    return taken


def test_classes_are_dealt_as_a_heap_deals_groups():
    pick = random.Random(12)
    for _ in range(1500):
        loads = [pick.randint(0, 50) for _ in range(pick.randint(1, 6))]
        size, times = pick.randint(1, 20), pick.randint(0, 60)
        after = list(loads)
        assert sharding.assign(after, size, times) == by_heap(loads, size, times)
        assert after == [load + size * n for load, n in zip(loads, by_heap(loads, size, times))]


def check(rows, texts, shards):
    """Groups stay together, slots have no gaps, and loads are those of the schedule over all groups."""
    slots, where, load = defaultdict(list), defaultdict(set), [0] * shards
    size = lambda t: len((t or "").encode()) + 8
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        where[r["size"], r["text_crc32"]].add(r["shard"])
        load[r["shard"]] += r["size"]
    for held in slots.values():
        assert sorted(held) == list(range(len(held)))
    assert all(len(s) == 1 for s in where.values())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), size(t), zlib.crc32((t or "").encode())) for i, t in texts)
    groups = defaultdict(int)
    for _, t in texts:
        groups[t or ""] += size(t)
    want = [0] * shards
    for total in sorted(groups.values(), reverse=True):
        k = min(range(shards), key=lambda k: (want[k], k))
        want[k] += total
    assert sorted(load) == sorted(want)


def test_awkward_rows(clashing):
    texts = [(r["doc_id"], r["text"]) for r in clashing.collect()]
    check(sharding.sharded(clashing, 3).collect(), texts, 3)
    assert sharding.sharded(clashing.limit(0), 3).count() == 0


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op3_shards"](spark, folder).collect()
    assert {r["law"] for r in rows} == {"bytes"} and {r["grown_shard"] for r in rows} == {None}
    check(rows, [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()], 24)


def test_hot_groups_are_numbered_in_blocks(spark, many_tasks, monkeypatch):
    monkeypatch.setattr(frames, "BLOCK_ROWS", 50)
    rows = [(0 if i % 3 else i, i) for i in range(3_000)] + [(0, 5), (0, 5)]
    stored = materialise(spark.createDataFrame(rows, "k long, i long"), "numbers")
    numbered = frames.numbered(stored, ["k"], ["i"], "n")
    held = defaultdict(list)
    for r in numbered.collect():
        held[r["k"]].append(r["n"])
    assert all(sorted(v) == list(range(len(v))) for v in held.values()) and len(held[0]) == 2_003
    assert frames.numbered(stored.limit(0), ["k"], ["i"], "n").count() == 0
