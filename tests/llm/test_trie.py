import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from censora.llm import queries, trie
from censora.queries import Tables

DDL = "conv_id long, turn long, role string, text string"


def brute(sequences):
    """From {conv: [(role, text), …]}: the rows of the trie."""
    members = {}
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(conv)
    out = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * (len(p[-1][1]) if p else 0) for p in below)
        ends = sorted(c for c in convs if len(sequences[c]) == len(path))
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        kids = sum(len(p) == len(path) + 1 for p in below)
        out.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), kids, len(childless), saved, digest))
    return sorted(map(str, out))


def told(df):
    return sorted(str(tuple(r)) for r in df.collect())


def gathered(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(turns)] for c, turns in out.items()}


@pytest.fixture
def rows():
    pick = random.Random(21)
    out = [(None, 0, "user", "nobody"), (5000, None, "user", "first"), (5000, 3, None, None), (5001, 0, "user", "é\U0001f600" * 50)]
    out += [(6000, k, "user", f"turn {k % 3}") for k in range(120)]
    for conv in range(160):
        for turn in range(pick.randint(1, 5)):
            out.append((conv, turn, ("user", "assistant")[turn % 2], pick.choice(["yes", "no", "maybe", f"only {conv}"])))
    for conv in range(200, 300):
        out += [(conv, 0, "user", "the same"), (conv, 1, "assistant", "for all")]
    return out


@pytest.mark.parametrize("shard", [7, 40, 200_000])
def test_nodes_for_all_sizes_of_shards(spark, rows, many_tasks, monkeypatch, shard):
    # Tasks read the constants of their own process, so the cutting is tried here by hand.
    said = spark.createDataFrame(rows, DDL).repartition(5)
    assert told(trie.nodes(trie.turn_keys(said))) == brute(gathered(rows))
    batches = [pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array([["k"] * (i % 4) for i in range(30)]), pa.array([[1] * (i % 4) for i in range(30)])], ["c", "k", "n"])] * 3
    monkeypatch.setattr(trie, "SHARD_TURNS", shard)
    cut = list(trie._shards(batches))
    assert [c for s in cut for c in s[0]] == list(range(30)) * 3
    assert all(len(s[0]) == 1 or len(s[0]) + len(s[2]) <= shard for s in cut) and all(s[1].sum() == len(s[2]) == len(s[3]) for s in cut)


def test_small_shards_are_merged(spark, rows, many_tasks):
    said = trie.turn_keys(spark.createDataFrame(rows, DDL))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert told(trie.nodes(said)) == brute(gathered(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_double_array_finds_paths_and_nothing_else():
    pick = random.Random(22)
    for ids in (1, 3, 40, 2000):
        paths = sorted({tuple(pick.randrange(ids) for _ in range(pick.randint(0, 6))) for _ in range(400)})
        lengths = np.array([len(p) for p in paths])
        codes = np.array([c for p in paths for c in p], np.int64)
        parents, last, _ = trie.levels(np.cumsum(lengths) - lengths, lengths, codes)
        array = trie.DoubleArray(np.concatenate(parents), np.concatenate(last))
        known = {p[:d] for p in paths for d in range(len(p) + 1)}
        states = {p: array.find(p) for p in known}
        assert min(states.values()) == 0 and len(set(states.values())) == len(known)
        for p in list(known)[:200]:
            for c in range(-1, ids + 2):
                assert array.find((*p, c)) == states.get((*p, c), -1)
        assert len(array.base) <= 2 * (len(known) + ids)


def test_query_rebuilds(spark, rows, tmp_path):
    spark.createDataFrame(rows, DDL).write.parquet(str(tmp_path / "conversations.parquet"))
    own, built = gathered(rows), {}
    for conv, turns in own.items():
        h = zlib.crc32(str(conv).encode()) % 6
        built[conv] = own.get(conv - conv % 100, [])[:h] + turns[h:]
    assert told(queries.prefix_trie(Tables(spark, str(tmp_path)))) == brute(built)


def test_turnless_and_empty(spark):
    one = spark.createDataFrame([(101, 0, "user", "gone")], DDL)
    none = trie.turn_keys(one).selectExpr("conv_id", "slice(turns, 1, 0) AS turns")
    assert told(trie.nodes(none)) == brute({101: []})
    assert trie.nodes(trie.turn_keys(one.limit(0))).count() == 0
    extra = one.selectExpr("*", "1 AS key", "2 AS chars", "3 AS turns", "4 AS path")
    assert told(trie.nodes(trie.turn_keys(extra))) == brute({101: [("user", "gone")]})
