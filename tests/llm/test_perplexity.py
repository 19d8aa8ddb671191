import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa

from censora.llm import frames
from censora.llm import perplexity as P
from censora.llm.queries import QUERIES

SPACE = r"[^\x20\x09-\x0D]+"


def brute_measures(text):
    text = text or ""
    words = re.findall(SPACE, text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    seen, twice = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE, line):
            twice += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), twice, len(covered))


def test_measures_by_the_book():
    pick = random.Random(6)
    for _ in range(600):
        text = "".join(pick.choice("ab é#|\n\t \x1f\xa0") for _ in range(pick.randint(0, 80)))
        assert tuple(P.measures(text)) == brute_measures(text), text


def brute_model(texts):
    """Interpolated modified Kneser-Ney from dictionaries of byte strings, counted in documents."""
    counts = {}
    for t in texts:
        whole = P._BEFORE + t.encode()
        for g in {whole[i : i + P.ORDER] for i in range(len(whole) - P.ORDER + 1)}:
            counts[g] = counts.get(g, 0) + 1
    levels = {P.ORDER: counts}
    for order in range(P.ORDER - 1, 0, -1):
        left = {}
        for g in levels[order + 1]:
            left[g[1:]] = left.get(g[1:], 0) + 1
        levels[order] = left

    def discount(order):
        n = [0] + [sum(c == k for c in levels[order].values()) for k in (1, 2, 3, 4)]
        if not all(n[1:]):
            return [0, 1.0, 1.0, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, 1.0, 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
        return [min(max(x, 0), top) for x, top in zip(d, (0, 1.0, 1.99, 2.99))]

    offs = {o: discount(o) for o in levels}

    def p(g):
        if not g:
            return 1 / 256
        level, off = levels[len(g)], offs[len(g)]
        context = [level.get(g[:-1] + bytes([w]), 0) for w in range(256)]
        total = sum(context)
        if not total:
            return p(g[1:])
        own = context[g[-1]]
        return (own - off[min(own, 3)]) / total + sum(off[min(c, 3)] for c in context) / total * p(g[1:])

    def score(text):
        whole = P._BEFORE + text.encode()
        grams = [whole[i : i + P.ORDER] for i in range(len(whole) - P.ORDER + 1)]
        return -sum(math.log(p(g)) for g in grams) / len(grams)

    return score


TEXTS = ["the cat sat on the mat.", "The dog, the cat; the CAT!", "12 naïve 漢字 dogs on the mat", "a", "", None, "on on on on", "naïve dogs sat on the mat", "the 漢字 cat"]


def frame(spark, texts):
    return spark.createDataFrame([(t, "en") for t in texts], "text string, lang string").repartition(3)


def test_scores_are_those_of_kneser_ney(spark):
    model, brute = P.train(frame(spark, TEXTS)), brute_model([t for t in TEXTS if t])
    entries = model.toArrow()
    scorer = P.Scorer(P.arrays(entries["key"].to_numpy(), entries["value"].to_numpy()))
    asked = [*TEXTS, "a cat on a dog", "zzz qq\n|", "the cat sat on the mat."]
    for _ in range(2):
        for text, score in zip(asked, scorer.log_perplexities(asked)):
            assert score is None if not text else abs(score - brute(text)) < 1e-5, text
    for context in (b"the c", b"zzzzz", b"n the", b"dogs "):
        grams = np.array([int.from_bytes(context + bytes([w])) for w in range(256)], np.uint64)
        assert abs(np.exp(P.log_probability(scorer.model, grams)).sum() - 1) < 1e-5


def test_a_model_too_large_for_a_broadcast(spark, monkeypatch):
    docs = frame(spark, TEXTS)
    model = P.train(docs)
    one = sorted(str(tuple(r)) for r in P.scores(docs, model, keep=("lang",)).collect())
    monkeypatch.setattr(P, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(P, "PART_BYTES", 40)
    two = P.scores(docs, model, keep=("lang",))
    assert "CoGroup" in two._jdf.queryExecution().toString()
    assert sorted(str(tuple(r)) for r in two.collect()) == one
    judged = P.judged(docs)
    assert judged.count() == len(TEXTS) and P.judged(docs.limit(0)).count() == 0


def test_the_model_grows_with_the_corpus(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    part = docs.where("doc_id % 10 = 0")
    assert P.train(docs).count() > 2 * P.train(part).count()


def test_long_texts_are_counted_and_scored_in_steps_alike(monkeypatch):
    pick = random.Random(8)
    texts = ["".join(pick.choice("ab é.") for _ in range(n)) for n in (0, 1, 4, 5, 6, 50, 3000)] + [None, "x" * 100]
    whole = P.merged(list(P.document_counts(texts)))
    model = P.arrays(P.keyed(P.PROBABILITY, P.ORDER, whole[0]), -1.0 / whole[1])
    scores = P.Scorer(model).log_perplexities(texts)
    brute = {}
    for t in texts:
        e = P._BEFORE + (t or "").encode()
        for g in {e[i : i + P.ORDER] for i in range(len(e) - P.ORDER + 1)} if t else ():
            brute[int.from_bytes(g)] = brute.get(int.from_bytes(g), 0) + 1
    assert dict(zip(*(a.tolist() for a in whole))) == brute
    monkeypatch.setattr(P, "STEP", 7)
    again = P.merged(list(P.document_counts(texts)))
    assert all((a == b).all() for a, b in zip(whole, again))
    assert np.allclose([s or 0 for s in scores], [s or 0 for s in P.Scorer(model).log_perplexities(texts)])


def peak(work):
    """Bytes that ``work`` takes at most, and what it returns."""
    tracemalloc.start()
    try:
        found = work()
        return tracemalloc.get_traced_memory()[1], found
    finally:
        tracemalloc.stop()


def test_counting_holds_no_ngram_many_times():
    pick = np.random.default_rng(3)
    parts = [(np.unique(pick.integers(0, 1 << 48, 100_000, np.uint64)), n) for n in (1, 2, 256)]
    parts = [(grams, np.full(len(grams), n, np.int64)) for grams, n in parts]
    parts.append((parts[0][0][::2], np.full(len(parts[0][0][::2]), 5, np.int64)))
    rows, total = sum(len(g) for g, _ in parts), sum(int(c.sum()) for _, c in parts)
    most, (grams, counts) = peak(lambda: P.merged(list(parts)))
    assert most < 45 * rows and counts.sum() == total and (grams[1:] > grams[:-1]).all()
    assert dict(zip(grams.tolist(), counts.tolist()))[int(parts[0][0][0])] == 6
    # Counts beyond two bytes take the other way.
    assert P.merged([(grams[:3], np.full(3, 70_000)), (grams[:2], np.ones(2, np.uint16))])[1].tolist() == [70_001, 70_001, 70_000]
    texts = ["".join(map(chr, pick.integers(97, 123, 4000))) for _ in range(200)]
    assert peak(lambda: [1 for _ in P.document_counts(texts)])[0] < 55 * 200 * 4000


def test_whole_texts_reach_workers_in_bounded_batches(spark):
    before = spark.conf.get(frames.BATCH_SETTING, None)
    spark.conf.unset(frames.BATCH_SETTING)
    try:
        docs = spark.range(0, 2000, 1, 1).selectExpr("repeat(char(65 + id % 26), 10000) AS text", "'en' AS lang")
        P.gram_counts(docs)
        sizes = docs.select("text").mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long")
        found = [r["n"] for r in sizes.collect()]
        assert max(found) <= frames.BATCH_BYTES + 20_000 and sum(found) >= 20_000_000
        # A bound that the session has set stays.
        spark.conf.set(frames.BATCH_SETTING, "123456")
        P.gram_counts(docs)
        assert spark.conf.get(frames.BATCH_SETTING) == "123456"
    finally:
        spark.conf.unset(frames.BATCH_SETTING)
        if before is not None:
            spark.conf.set(frames.BATCH_SETTING, before)


def test_awkward_rows(clashing):
    judged = P.judged(clashing.withColumnRenamed("_lang", "other"))
    rows = judged.collect()
    assert len(rows) == 11
    for r in rows:
        assert tuple(r[m] for m in P.Measures._fields) == brute_measures(r["text"] if len(r["text"] or "") < 1000 else "")[:5] or r["doc_id"] == 5
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    empty = P.judged(clashing.limit(0).drop("_lang"))
    assert empty.count() == 0 and "kept" in empty.columns


def test_bands_reject_both_ends(spark):
    pick = random.Random(7)
    words = ["".join(pick.choice(["ri", "ver", "sto", "ne", "gre", "en", "wal", "ker"]) for _ in range(3)) for _ in range(200)]
    plain = [" ".join(pick.choice(words) for _ in range(80)) for _ in range(60)]
    noise = ["".join(pick.choice("QZXJ#~^{}9") if pick.random() < 0.8 else " " for _ in range(600))]
    dull = [" ".join("a" * k for k in range(1, 80))]
    docs = spark.createDataFrame([(t, "en") for t in plain + noise + dull], "text string, lang string")
    kept = {r["text"]: r["kept"] for r in P.judged(docs).where("NOT base_failed").collect()}
    assert all(kept[t] for t in plain)
    assert not kept[noise[0]] and not kept[dull[0]]


def test_query_over_the_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = dict(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect())
    rows = QUERIES["op9_perplexity"](spark, folder).collect()
    assert {r["doc_id"] for r in rows} == set(texts)
    for r in rows[:60]:
        assert tuple(r[m] for m in P.Measures._fields) == brute_measures(texts[r["doc_id"]])
    good = [r for r in rows if not r["base_failed"]]
    assert sum(r["kept"] for r in good) > 0.9 * len(good)
