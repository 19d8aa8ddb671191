import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from censora.operators import joins as J
from censora.operators import ordering as O


def sample(n=4000, seed=3):
    """Three keys, one with most rows; repeated values, NULLs, negatives and a heavy value."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        key = rng.choices(["hot", "a", None], [8, 1, 1])[0]
        value = rng.choice([None, 5.0, round(rng.uniform(-50, 1e6), 2), float(rng.randrange(20))])
        out.append((key, value))
    return out


def brute(data, key):
    return sorted(v for k, v in data if k == key and v is not None)


def cont(values, p):
    position = (len(values) - 1) * p
    low, high = math.floor(position), math.ceil(position)
    return values[low] + (values[high] - values[low]) * (position - low)


@pytest.mark.parametrize("block_rows", [10, 300, 1_000_000])
def test_percentiles_equal_brute_force(spark, block_rows):
    data = sample()
    df = spark.createDataFrame(data, "k string, v double")
    points = {"p0": 0.0, "p25": 0.25, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    got = {r.k: r for r in O.percentiles(df, ["k"], "v", points, block_rows).collect()}
    assert set(got) == {"hot", "a", None}
    for key, row in got.items():
        values = brute(data, key)
        assert row.n == len(values)
        for name, p in points.items():
            assert row[name] == cont(values, p), (key, name)


def test_quantile_definitions_of_the_fixture(frame):
    df = frame("v double", *[(float(v),) for v in (10, 20, 30, 40, 100)])
    got = O.percentiles(df, [], "v", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}).first()
    assert (got.p25, got.p50, got.p75, got.p90) == (20, 30, 40, 76)
    floor = O.floor_rank_quantiles(df, [], "v", {"p50": 0.5, "p90": 0.9}).first()
    assert (floor.p50, floor.p90) == (30, 40)
    four = frame("v double", (1.0,), (2.0,), (3.0,), (4.0,))
    median = O.medians(four, [], "v").first()
    assert (median.median, median.upper_median) == (2.5, 3.0)


def test_ranked_equals_brute_force(spark):
    rng = random.Random(5)
    data = [(i, float(rng.randrange(40))) for i in range(300)]
    df = spark.createDataFrame(data, "id int, v double")
    got = {r.id: r for r in O.ranked(df, "v", ["id"]).collect()}
    order = sorted(data, key=lambda r: (-r[1], r[0]))
    for place, (i, v) in enumerate(order):
        row = got[i]
        assert row.position == place + 1
        assert row.rank == 1 + sum(1 for _, w in data if w > v)
        assert row.percent_rank == sum(1 for _, w in data if w < v) / (len(data) - 1)
        assert row.prev_value == (order[place - 1][1] if place else None)


def test_previous_row_across_blocks_and_a_hot_key(spark):
    rng = random.Random(11)
    data = [(rng.choices([1, 2, None], [9, 1, 1])[0], rng.randrange(5000), i) for i in range(1500)]
    df = spark.createDataFrame(data, "k int, t long, id int")
    got = O.with_previous(df, ["k"], ["t", "id"], F.floor(F.col("t") / 10), ["id", "t"])
    want = []
    for key in (1, 2, None):
        last = (None, None)
        for k, t, i in sorted((r for r in data if r[0] == key), key=lambda r: (r[1], r[2])):
            want.append((k, t, i, *last))
            last = (i, t)
    assert rows(got) == sorted(want, key=lambda r: tuple((v is None, str(v)) for v in r))


def test_nearest_within_equals_brute_force(spark):
    rng = random.Random(2)
    start = 1_700_000_000
    left = [(rng.choice(["a", "b", None]), start + rng.randrange(40_000), i) for i in range(300)]
    right = [(rng.choice(["a", "b", None]), start + rng.randrange(40_000), float(i)) for i in range(60)]
    ldf = spark.createDataFrame(left, "k string, s long, id int").withColumn("ts", F.timestamp_seconds("s"))
    rdf = spark.createDataFrame(right, "k string, s long, v double").withColumn("rt", F.timestamp_seconds("s"))
    got = J.nearest_within(ldf, rdf.drop("s"), ["k"], "ts", "rt", ["v"], 900, block_s=60).collect()
    assert len(got) == len(left)
    for r in got:
        near = sorted((abs(s - r.s), s) for k, s, _ in right if k is not None and k == r.k and abs(s - r.s) <= 900)
        assert r.distance_s == (near[0][0] if near else None)
        if near:
            assert int(r.matched_at.timestamp()) in {s for d, s in near if d == near[0][0]}


def test_band_edges_and_gaps(frame):
    bands = frame("band int, lower double, upper double", (1, 0.0, 100.0), (2, 110.0, 200.0), (10, 210.0, 220.0))
    df = frame("v double", (50.0,), (105.0,), (150.0,), (250.0,), (-1.0,))
    got = J.with_band(df, F.col("v"), bands, "decile").collect()
    assert [r.decile for r in got] == [1, None, 2, 10, 1]
