import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from censora.llm import bpe
from censora.llm import packing as K
from censora.llm.queries import QUERIES
from censora.session import materialise


def check(plan, demand, capacity):
    used = np.zeros(capacity + 1, int)
    for config, n in plan.items():
        assert n > 0 and sum(config) <= capacity
        for v in config:
            used[v] += n
    assert (used == demand).all()


def test_price_is_the_best_of_all_contents():
    pick = np.random.default_rng(10)
    for _ in range(20):
        values = np.where(pick.random(13) < 0.5, pick.random(13), 0.0)
        values[0] = 0
        best, last = K.price(values, 12)
        brute = [0.0] * 13
        for size in range(1, 13):
            brute[size] = max([brute[size - 1], *(brute[size - v] + values[v] for v in range(1, size + 1) if values[v])])
        assert np.allclose(best, brute)
        for size in range(13):
            content = K.contents(size, last)
            assert sum(content) <= size and np.isclose(sum(values[content]) if content else 0, best[size])


@pytest.mark.parametrize("kind", ["two", "thirds", "few", "one", "full", "none"])
def test_plans_hold_every_piece_and_beat_best_fit(kind):
    pick, capacity = np.random.default_rng(11), 256
    lengths = {
        "two": np.concatenate([pick.integers(80, 150, 3000), pick.integers(40, 90, 3000)]),
        "thirds": pick.integers(60, 120, 5000),
        "few": pick.choice([85, 87, 64, 128, 43, 112], 4000),
        "one": np.array([5]),
        "full": np.full(9, 256),
        "none": np.zeros(0, int),
    }[kind]
    demand = np.bincount(lengths, minlength=capacity + 1)
    plan = K.solve(demand, capacity)
    check(plan, demand, capacity)
    plain = K.best_fit(demand, capacity)
    check(plain, demand, capacity)
    assert -(-lengths.sum() // capacity) <= plan.total() <= plain.total()


def validate(rows, texts, tokenizer, capacity):
    """All pieces are there, in order, whole, and sequences have neither gap nor overlap."""
    docs, places = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for doc_id, text, copies in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)]
        want = [(k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *ids[a:b]))) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in docs[doc_id]) == sorted(want * copies)
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_awkward_rows(clashing, tokenizer, tokenizer_path):
    rows = K.packed_documents(clashing, tokenizer_path, 512).collect()
    texts = {r["doc_id"]: r["text"] for r in clashing.collect()}
    count = validate(rows, [(i, t, 2 if i == 6 else 1) for i, t in texts.items()], tokenizer, 512)
    assert count == -(-sum(r["length"] for r in rows) // 512)
    assert K.packed_documents(clashing.limit(0), tokenizer_path, 512).count() == 0


def test_sequences_hold_the_ids(documents, tokenizer, tokenizer_path):
    cut = materialise(K.pieces(documents.where("doc_id IN (1, 8, 9)"), tokenizer_path, 64, with_ids=True), "pieces")
    packed = K.pack(cut, 64)
    held = {r["sequence_id"]: bytes(r["ids"]) for r in K.sequences(packed).collect()}
    for r in packed.collect():
        assert held[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])


def test_query_over_the_whole_table(spark, tokenizer):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op6_packing"](spark, folder).collect()
    texts = [(r["doc_id"], r["text"], 1) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    count = validate(rows, texts, tokenizer, 2048)
    assert count <= -(-sum(r["length"] for r in rows) // 2048) + 2


def test_ids_survive_a_cache_that_overflows_within_a_batch(tokenizer, tokenizer_path, monkeypatch):
    monkeypatch.setattr(K, "KNOWN_WORDS", 40)
    ids, pick = K.LibraryIds(tokenizer_path), np.random.default_rng(18)
    for _ in range(60):
        texts = [" ".join("".join(pick.choice(list("abcde"), pick.integers(1, 5))) for _ in range(pick.integers(0, 80))) for _ in range(5)]
        assert [np.frombuffer(b, "<u4").tolist() for b in ids.batch(texts)] == [e.ids for e in tokenizer.encode_batch(texts)]


def test_ids_by_the_second_library_are_those_of_the_first(tokenizer, tokenizer_path, monkeypatch):
    coder = bpe.vocabulary(tokenizer_path)
    assert coder.regular
    monkeypatch.setattr(K, "LONG", 60)
    ids, pick = K.LibraryIds(tokenizer_path, True), np.random.default_rng(33)
    strings = [s.decode("utf-8", "ignore") for s in coder.strings]
    texts = ["", " ", "a" * 3000 + " b", " " * 500, "<|endoftext|>x<|endoftext|>", "é漢字\U0001f600\x00 's 'S  \n\n 12"]
    texts += ["".join(strings[i] for i in pick.integers(0, len(strings), pick.integers(1, 40))) for _ in range(2000)]
    texts += ["".join(pick.choice(list("abeinrst ' \n1."), pick.integers(0, 90))) for _ in range(2000)]
    assert [np.frombuffer(b, "<u4").tolist() for b in ids.batch(texts)] == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_vocabulary_out_of_order_is_not_regular(tokenizer_path):
    def small(merges):
        coder = object.__new__(bpe.Bpe)
        strings = [bytes([b]) for b in range(256)]
        known = {s: i for i, s in enumerate(strings)}
        coder.first, coder.bits, coder.specials, coder.pairs = list(range(256)), 9, {}, {}
        for _, b in merges:
            known.setdefault(b, len(strings))
            strings.append(b) if b not in strings else None
        for rank, (a, b) in enumerate(merges, 1):
            coder.pairs[known[a] << 9 | known[b[len(a) :]]] = rank << 9 | known[b]
        coder.strings = strings
        return coder.regular

    assert small([(b"a", b"ab"), (b"ab", b"abc")])
    assert not small([(b"a", b"ab"), (b"b", b"bc"), (b"ab", b"abc"), (b"a", b"abc")])  # two merges make one string
    assert not small([(b"b", b"bc"), (b"a", b"ab"), (b"ab", b"abc")])  # no text comes to the last string
