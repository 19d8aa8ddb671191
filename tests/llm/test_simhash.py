import random

import numpy as np
import pytest
import xxhash

from censora.llm import components, simhash
from censora.llm.queries import QUERIES
from censora.session import materialise


def brute_print(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """Smallest id of each row's component, from all pairs."""
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if bin(a ^ b).count("1") <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    ids = {}
    for (doc_id, _), k in zip(rows, label):
        if doc_id is not None:
            ids[k] = min(ids.get(k, doc_id), doc_id)
    return sorted((str(d), f"{p:016x}", str(ids.get(k))) for (d, p), k in zip(rows, label))


def test_fingerprints_by_the_book():
    pick = random.Random(4)
    for _ in range(300):
        text = "".join(pick.choice("aB \tcÄ \n") for _ in range(pick.randint(0, 60)))
        assert simhash.fingerprint(text) == brute_print(text), text


def test_the_trees_lose_no_link():
    pick = np.random.default_rng(5)
    seeds = pick.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = np.concatenate([seeds, *(seeds[pick.integers(0, 400, 700)] ^ (np.uint64(1) << pick.integers(0, 64, 700).astype(np.uint64)) for _ in range(3))])
    # One dense group, all within a few bits of each other.
    dense = seeds[0] ^ (np.uint64(1) << pick.integers(0, 64, 800).astype(np.uint64)) ^ (np.uint64(1) << pick.integers(0, 64, 800).astype(np.uint64))
    own = np.unique(np.concatenate([near, dense]))
    n = len(own)
    want = np.arange(n)
    i, j = np.nonzero(np.bitwise_count(own[:, None] ^ own[None, :]) <= 2)
    simhash.join_labels(want, i, j)
    for leaf in (16, 200, 5_000):
        labels = np.arange(n)
        tree = simhash.build(own[::3], leaf)
        lived = np.zeros(n, int)
        for _, at, home in simhash.route(tree, own, np.arange(n), np.ones(n, bool)):
            local = np.arange(len(at))
            simhash.link(own[at], np.flatnonzero(home), np.arange(len(at)), local)
            simhash.join_labels(labels, at, at[local])
            lived[at[home]] += 1
        assert (lived == 1).all()
        assert (labels == want).all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(5, 5)]
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {i: 0 for i in range(1, 61)} | {k: 100 for k in range(101, 160)}


@pytest.mark.parametrize("table", ["documents", "clashing"])
def test_awkward_rows(request, table):
    docs = request.getfixturevalue(table)
    want = brute_components([(r["doc_id"], brute_print(r["text"])) for r in docs.collect()])
    found = simhash.near_duplicates(docs).select("doc_id", simhash.hex_print().alias("f"), "component_id").collect()
    assert sorted((str(a), b, str(c)) for a, b, c in found) == want


def test_one_document_of_each_group_stays(clashing):
    stay = simhash.deduplicated(clashing)
    assert stay.columns == clashing.columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == ["1", "10", "2", "5", "8", "9", "None"]
    assert simhash.deduplicated(clashing.limit(0)).count() == 0


def test_query_equals_all_pairs(spark, tmp_path):
    docs = materialise(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), "docs")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = brute_components(sorted((r["doc_id"], brute_print(r["text"])) for r in docs.collect()))
    got = QUERIES["op10_simhash"](spark, str(tmp_path)).collect()
    assert sorted((str(a), b, str(c)) for a, b, c in got) == want
    assert any(r["doc_id"] != r["component_id"] for r in got)
