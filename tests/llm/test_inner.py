import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from censora.llm import inner


def brute(rows, k, asked):
    """(query id, rank, id, score) from all pairs; rows are (id, vector)."""
    sound = [(n, i, [math.floor(64 * x) for x in v]) for n, (i, v) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, i, q in sound:
        if i is None or not asked(i):
            continue
        scored = [(-sum(a * b for a, b in zip(q, x)), j is None, j if j is not None else 0, m) for m, j, x in sound if m != n]
        out += [(i, rank, None if missing else j, -score) for rank, (score, missing, j, _) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def run(spark, rows, k, **small):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    return sorted(str(tuple(r)) for r in inner.top_k(df, F.col("id") % 5 == 0, k).collect())


@pytest.fixture
def small_blocks(monkeypatch):
    for name, value in (("SEEDS", 20), ("CHUNK", 40), ("BLOCK", 16), ("STEP", 8)):
        monkeypatch.setattr(inner, name, value)


def test_equals_all_pairs(spark, small_blocks):
    pick = np.random.default_rng(13)
    shape = pick.normal(size=(4, 12))
    rows = []
    for i in range(320):
        v = shape[pick.integers(4)] * pick.gamma(2.0) + pick.normal(size=12) * 0.2
        rows.append((i, [float(np.float32(x)) for x in v]))
    assert run(spark, rows, 7) == brute(rows, 7, lambda i: i % 5 == 0)


def test_awkward_rows(spark, small_blocks):
    same = [0.5, -0.25, 1.0]
    rows = [(i, same) for i in range(0, 90)]  # ties without end
    rows += [(100, None), (105, [0.5, None, 1.0]), (110, [float("nan"), 1.0, 1.0]), (115, [float("inf"), 0.0, 0.0]), (None, [2.0, 2.0, 2.0])]
    rows += [(120, []), (125, [1.0]), (130, [0.0, 0.0, 0.0]), (5, [3.0, 3.0, 3.0]), (5, [3.0, 3.0, 3.0]), (140, [-1.0, -1.0, -1.0])]
    assert run(spark, rows, 6) == brute(rows, 6, lambda i: i % 5 == 0)


def test_wide_vectors_are_scored_in_whole_numbers(spark, small_blocks):
    pick = np.random.default_rng(34)
    rows = [(i, [float(np.float32(x)) for x in pick.normal(size=4)]) for i in range(150)]
    # Scores that differ in the last of more than fifty-three bits, copies, both signs, and a query that only wide ones beat.
    rows += [(200 + i, [float(2**24 + i), float(2**24 - i), float(-(2**23)), 0.5 * i]) for i in range(60)]
    rows += [(300 + i, [300000.0, -300000.0, 1.0]) for i in range(30)]
    rows += [(400, [-1.5e7, -1.5e7, 0.0, 1.0]), (405, [0.0, 0.0, 0.0, 0.0]), (None, [3e6, 3e6, 0.0, 0.0]), (410, [float("inf"), 1.0, 1.0, 1.0])]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(spark, rows, 7) == brute(rows, 7, lambda i: i % 5 == 0)
    assert run(spark, rows[150:240], 7) == brute(rows[150:240], 7, lambda i: i % 5 == 0)  # no other vectors


def test_scores_beyond_a_long_are_its_end(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [-1e30, 0.0]), (3, [2e30, 5.0]), (4, [0.5, 0.5])]
    end = 2**63 - 1
    assert run(spark, rows, 4)[:2] == [f"(0, 1, 1, {end})", f"(0, 2, 3, {end})"]
    assert run(spark, rows, 4)[3] == f"(0, 4, 2, {-end - 1})"


def test_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (5, [0.5, 0.5]), (7, [-1.0, 0.0])]
    assert run(spark, rows, 20) == brute(rows, 20, lambda i: i % 5 == 0)
    assert run(spark, rows[:1], 20) == []
    assert run(spark, [(0, []), (1, [])], 20) == ["(0, 1, 1, 0)"]
    assert inner.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("id") % 5 == 0, 3).collect() == []


def test_bounds_leave_pairs_unscored(monkeypatch):
    pick = np.random.default_rng(14)
    x = np.floor(pick.normal(size=(4000, 32)) * np.exp(pick.normal(size=(4000, 1))) * 64)
    x = x[np.argsort(-(x * x).sum(1), kind="stable")]
    q, rows = x[:40] * 0.5, np.arange(4000)
    turn = np.linalg.svd(x, full_matrices=False)[2].T
    scored = []
    real = np.partition
    monkeypatch.setattr(inner.np, "partition", lambda m, *a, **b: scored.append(m.shape) or real(m, *a, **b))
    best = inner.best_of(np.floor(q), np.full(40, -1), np.full(40, -np.inf), x, rows, rows, turn, 5)
    want = np.sort(np.floor(q) @ x.T, axis=1)[:, -5:]
    assert (np.sort(best // 4000, axis=1) == want).all()
    assert sum(r * (c - 5) for r, c in scored) < 0.5 * 40 * 4000
