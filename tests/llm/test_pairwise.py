import zlib

import numpy as np
import pytest

from censora.llm import pairwise as B
from censora.llm.queries import QUERIES


def test_weights_are_a_stationary_point():
    pick = np.random.default_rng(8)
    truth = np.array([2.0, -1.0, 0.0])
    d = pick.normal(size=(4000, 3))
    d[pick.random(4000) > 1 / (1 + np.exp(-d @ truth))] *= -1
    w = B.fit_differences(d)
    p = 1 / (1 + np.exp(d @ w))
    assert np.abs(d.T @ p / len(d) - B.RIDGE * w).max() < 1e-6
    assert np.abs(w - truth).max() < 0.25


def test_threshold_is_the_quantile():
    pick = np.random.default_rng(9)
    rows = pick.normal(size=(500, len(B.FEATURES)))
    good = rows[:, 0] > -0.8
    ranking = B.fit(rows, good)
    score = ranking.score(rows)
    assert abs((score < B.ACCEPT).mean() - (~good).mean()) < 0.01
    assert (np.argsort(score) == np.argsort(ranking.raw(rows))).all()
    assert abs((B.fit(rows, good, 0.5).score(rows) < B.ACCEPT).mean() - 0.5) < 0.01


@pytest.mark.parametrize("labels", [[], [(1, 1), (5, 1)], [(1, None), (None, 0)]])
def test_without_two_kinds_of_labels(spark, clashing, labels):
    table = spark.createDataFrame(labels, "doc_id long, quality int")
    rows = B.scored(clashing, B.train(clashing, table)).collect()
    assert len(rows) == 11 and {(r["score"], r["predicted"]) for r in rows} == {(0.5, 1)}


def test_awkward_rows(spark, clashing):
    table = spark.createDataFrame([(i, int(i != 3)) for i in range(1, 11)], "doc_id long, quality int")
    rows = B.scored(clashing, B.train(clashing, table)).collect()
    assert len(rows) == 11 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] == 6 or r["doc_id"] == 1}) == 1
    assert B.scored(clashing.limit(0), B.train(clashing, table)).count() == 0


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    truth = dict(spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality").collect())
    rows = QUERIES["op2_quality"](spark, folder).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(r["predicted"], truth[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == t for p, t in held]) >= 0.95
