import random

import corpus_pipeline
from censora.llm import shingles, simhash


def brute_set(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_staying(texts):
    """Smallest id of each component, from all pairs."""
    own, label = {i: brute_set(t) for i, t in texts.items()}, {i: i for i in texts}
    near = [(i, j) for i in own for j in own if i < j and 9 * len(own[i] & own[j]) >= 4 * (len(own[i]) + len(own[j]))]
    changed = True
    while changed:
        changed = False
        for i, j in near:
            least = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = least
    return {i for i in texts if label[i] == i}, near


def edited(pick, words, edits):
    words = list(words)
    for _ in range(edits):
        at = pick.randrange(len(words))
        words[at : at + 1] = pick.choice([[], [f"new{pick.random()}"], [words[at], f"more{pick.random()}"]])
    return words


def corpus():
    """Chains of edited copies of every length, one dense group, and a passage that many other texts share."""
    pick = random.Random(8)
    fresh = lambda n: [f"w{pick.randrange(10_000)}" for _ in range(n)]
    passage, dense, rows = fresh(40), fresh(120), []
    for n in [1, 2, 4, 5, 6, 8, 9, 10, 12, 15, 20, 30, 45, 60, 90, 150, 300, 700] * 2:
        words = fresh(n)
        rows.append(words)
        for k in range(6):
            words = edited(pick, words or ["x"], max(0, n // 45) if k % 2 else 1)
            rows.append(words)
    rows += [edited(pick, dense, 1) for _ in range(60)]
    rows += [fresh(60) + passage for _ in range(30)] + [["a", "b"]] * 3
    pick.shuffle(rows)
    return dict(enumerate(map(" ".join, rows))) | {10_000: "", 10_001: " \n"}


def test_similar_sets_share_opening_and_prefix_hashes():
    pick, similar = random.Random(9), 0
    for _ in range(6_000):
        n = pick.choice([1, 2, 3, 4, 5, 7, 9, 12, 20, 40, 100, 400])
        a = {pick.getrandbits(64) for _ in range(n)}
        b = set(pick.sample(sorted(a), len(a) - pick.randint(0, n // 5))) | {pick.getrandbits(64) for _ in range(pick.randint(0, n // 4))}
        if b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
            similar += 1
            one, two = (set(shingles.opening(shingles.np.array(sorted(x), "u8")).tolist()) for x in (a, b))
            assert len(one & two) >= max(shingles.needed(len(a)), shingles.needed(len(b))) >= 1, (len(a), len(b))
            # Whatever the common order, some hash is in the first fifth of both, and the first such one passes the bound of places.
            order = {x: pick.random() for x in a | b}
            ranked = [sorted(x, key=order.get) for x in (a, b)]
            first = next(x for x in ranked[0] if x in b)
            places = [r.index(first) + 1 for r in ranked]
            assert all(5 * (at - 1) <= len(r) for at, r in zip(places, ranked))
            assert 9 * (1 + min(len(r) - at for at, r in zip(places, ranked))) >= 4 * (len(a) + len(b))
    assert similar > 1_000


def test_tasks_count_met_hashes_like_all_sets_together():
    pick = random.Random(11)
    pool = [pick.getrandbits(64) for _ in range(300)]
    owns = [shingles.np.array(sorted({*pick.sample(pool, 8), *(pick.getrandbits(64) for _ in range(4))}), "u8") for _ in range(60)]
    whole = [(k, own, shingles.opening(own)) for k, own in enumerate(owns, 1)]
    rows = [r for part in range(3) for r in shingles.met_rows([(k, part, o, len(own)) for k, own, o in whole[part::3]]).to_pylist()]
    prints = {}
    for r in rows:
        prints.setdefault(r["sig"], set()).add(r["print"])
    for k, _, first in whole:
        met = sum(any(x in other for j, _, other in whole if j != k) for x in first)
        assert sum(-r["n"] if r["n"] < 0 else r["n"] * (len(prints[r["sig"]]) > 1) for r in rows if r["print"] == k) == met


def test_sketches_rule_out_no_similar_sets():
    pick, ruled_out = random.Random(10), 0
    for k in range(600):
        n = pick.choice([1, 3, 9, 40, 400, 1_900, 2_100, 9_000])
        a = {pick.getrandbits(64) for _ in range(n)}
        b = set(pick.sample(sorted(a), len(a) - pick.randint(0, n // 5))) | {pick.getrandbits(64) for _ in range(pick.randint(0, n // 4))}
        b = b if k % 3 else {pick.getrandbits(64) for _ in range(n)}
        sketches = [shingles.sketch(shingles.np.array(sorted(x), "u8")) for x in (a, b)]
        maybe = shingles.may_be_similar(*sketches, len(a), len(b))
        assert maybe or 9 * len(a & b) < 4 * (len(a) + len(b))
        ruled_out += not maybe and k % 3 == 0
    assert ruled_out > 150


def test_stage_equals_all_pairs(spark, tmp_path):
    texts = corpus()
    want, near = brute_staying(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect()} == want
    # Most of these pairs are further apart than two bits.
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    assert sum((prints[i] ^ prints[j]).bit_count() > 2 for i, j in near) > len(near) / 2


def test_awkward_rows(clashing):
    stay = shingles.deduplicated(clashing)
    assert stay.columns == clashing.columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == ["1", "10", "2", "5", "8", "9", "None"]
    assert shingles.deduplicated(clashing.limit(0)).count() == 0


def test_trees_give_partners_within_reach(spark):
    pick = random.Random(12)
    marks = {pick.getrandbits(64) for _ in range(300)}
    for mark in list(marks):
        for _ in range(3):
            bits = pick.sample(range(64), pick.randint(1, 6))
            marks.add(mark ^ sum(1 << b for b in bits))
    signed = sorted(m - (1 << 64) * (m >> 63) for m in marks)
    got = simhash.partners(spark.createDataFrame([(m,) for m in signed], "print long"), shingles.REACH).collect()
    near = {m: [o for o in signed if o < m and ((m ^ o) & (2**64 - 1)).bit_count() <= shingles.REACH] for m in signed}
    assert {(r["u"], min(s["v"] for s in got if s["u"] == r["u"])) for r in got} == {(m, min(o)) for m, o in near.items() if o}
    assert all(r["v"] in near[r["u"]] for r in got) and len(got) > 300


def test_links_start_from_the_trees(spark):
    """Candidates of equal and of near fingerprints, by the operator of op10."""
    pick = random.Random(13)
    words = [f"w{pick.randrange(10_000)}" for _ in range(2_000)]
    texts = [" ".join(words), " ".join(edited(pick, words, 1)), " ".join(f"x{k}" for k in range(50))]
    known = shingles.sets(spark.createDataFrame(list(enumerate(texts)), "print long, text string"))
    rows = {r["print"]: r["mark"] for r in known.collect()}
    assert all(simhash.print_of(shingles.shingles(t)) == rows[k] % 2**64 for k, t in enumerate(texts))
    assert [sorted(r) for r in shingles.near_marks(known).collect()] == [[0, 1]]


def test_sets_of_a_hash_meet_in_blocks(spark, monkeypatch):
    """Near copies that are not similar enough: no row for each pair, none that is similar is lost."""
    monkeypatch.setattr(shingles, "BLOCK", 16)
    pick = random.Random(14)
    base = [pick.getrandbits(64) for _ in range(100)]
    owns = {}
    for k in range(90):
        kept = base[:1] + pick.sample(base[1:], 84 if k % 9 else 97)
        owns[k] = shingles.np.array(sorted({*kept, *(pick.getrandbits(64) for _ in range(100 - len(kept)))}), "u8")
    apart = spark.createDataFrame([(7, k, k // 2, len(own), 1) for k, own in owns.items()] + [(8, 0, 0, 100, 1), (8, 2, 1, 100, 1)], "sig long, print long, root long, size int, place long")
    sketches = spark.createDataFrame([(k, bytearray(shingles.sketch(own))) for k, own in owns.items()], "_print long, _sketch binary")
    got = [tuple(r) for r in shingles.meetings(apart, sketches).distinct().collect()]
    pairs = [(i, j) for i in owns for j in owns if i < j and i // 2 != j // 2]
    similar = {(i, j) for i, j in pairs if 9 * len({*owns[i].tolist()} & {*owns[j].tolist()}) >= 4 * (len(owns[i]) + len(owns[j]))}
    assert similar and similar <= {*got} <= {*pairs} and len(got) < len(pairs) / 10


def cloud(pick, n, cut):
    """Near copies of one set, each two of which may be similar enough or not."""
    base = [pick.getrandbits(64) for _ in range(100)]
    kept = [pick.sample(base, 100 - pick.choice(cut)) for _ in range(n)]
    return {k: shingles.np.array(sorted({*own, *(pick.getrandbits(64) for _ in range(100 - len(own)))}), "u8") for k, own in enumerate(kept)}


def similar_of(owns, pairs):
    sets = {k: {*own.tolist()} for k, own in owns.items()}
    return {(i, j) for i, j in pairs if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}


def groups_of(edges, label):
    label = dict(label)
    for i, j in edges:
        least, most = sorted((label[i], label[j]))
        label = {k: least if x == most else x for k, x in label.items()}
    return label


def test_a_forest_joins_all_similar_sets():
    pick = random.Random(15)
    for _ in range(20):
        owns = cloud(pick, 60, (2, 5, 6, 7, 9))
        root = {k: k - k % pick.choice([1, 3]) for k in owns}
        starts = shingles.np.cumsum([0, *map(len, owns.values())])
        later = [(i, shingles.np.array([j for j in owns if j > i and root[j] != root[i]], int)) for i in owns]
        one, two = shingles.forest(shingles.np.array([*root.values()]), later, shingles.np.concatenate([*owns.values()]).view("i8"), starts)
        got, want = {*zip(one, two)}, similar_of(owns, [(i, j) for i, others in later for j in others.tolist()])
        assert got <= want and len(one) < len({*root.values()}) and groups_of(got, root) == groups_of(want, root)
        assert len(want) > 3 * len(got)


def test_sets_of_a_hash_become_a_forest(spark, monkeypatch):
    """Blocks of many and of large sets, hashes of one block beside them; a forest within two blocks joins what all pairs join."""
    pick = random.Random(16)
    owns = cloud(pick, 90, (2, 6, 7, 9))
    rows = [(sig, k, k, len(own), 1) for sig in (7, 8) for k, own in owns.items() if sig == 7 or k % 9 == 0]
    apart = spark.createDataFrame(rows, "sig long, print long, root long, size int, place long")
    sketches = spark.createDataFrame([(k, bytearray(shingles.sketch(own))) for k, own in owns.items()], "_print long, _sketch binary")
    known = spark.createDataFrame([(k, own.view("i8").tolist()) for k, own in owns.items()], "print long, set array<long>")
    want = similar_of(owns, [(i, j) for i in owns for j in owns if i < j])
    for name, size in (("BLOCK", 16), ("BLOCK", 1_024), ("BLOCK_HASHES", 3_000)):
        monkeypatch.setattr(shingles, name, size)
        got = [tuple(r) for r in shingles.meetings(apart, sketches, known).collect()]
        label = {k: k for k in owns}
        assert {*got} <= want and groups_of(got, label) == groups_of(want, label)
        assert size != 1_024 or len(got) < 2 * len(owns) < len(want)


def test_near_copies_do_not_become_pairs(spark, monkeypatch):
    """The last comparison of ``links`` returns few of the pairs that sketches leave, and loses no link."""
    pick, counts, plain = random.Random(17), [], shingles.meetings
    words = [f"w{k}" for k in range(300)]
    texts = {k: " ".join(edited(pick, words, pick.choice([1, 4, 6, 7, 8]))) for k in range(150)}

    def counted(apart, sketches, *known):
        found = shingles.materialise(plain(apart, sketches, *known), "counted")
        counts.extend([found.count(), plain(apart, sketches).count()])
        return found

    monkeypatch.setattr(shingles, "meetings", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    want, near = brute_staying(texts)
    assert {r["doc_id"] for r in shingles.deduplicated(docs).collect()} == want
    assert len(near) > 10 * len(texts) and len(counts) == 2 and 0 < 5 * counts[0] < counts[1], counts
