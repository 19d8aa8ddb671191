"""One key holds a third of all rows or more: results stay whole, and no plan pairs rows or funnels a fact into one task."""

import os
import sys

import pytest
from pyspark.sql import functions as F

from censora.operators import ordering as O
from censora.operators import reshape as R
from censora.queries import load
from censora.sources import tables

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from plan_check import findings

N = 200_000


@pytest.fixture(scope="module")
def skewed(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    value = ((F.col("id") * 7919) % 100_003).cast("double") / 100
    return spark.range(N).select("id", key.alias("k"), value.alias("v"))


def test_order_statistics_of_a_hot_group(skewed):
    got = O.percentiles(skewed, ["k"], "v", {"p50": 0.5, "p90": 0.9})
    exact = skewed.groupBy("k").agg(F.percentile("v", [0.5, 0.9]).alias("p"), F.count("v").alias("m"))
    off = got.join(exact, "k").where((F.col("n") != F.col("m")) | (F.abs(F.col("p50") - F.col("p")[0]) > 1e-9) | (F.abs(F.col("p90") - F.col("p")[1]) > 1e-9))
    assert off.count() == 0 and got.count() == exact.count()


def test_outliers_do_not_crowd_a_block(spark):
    values = spark.range(100_000).select((F.col("id") / 100).alias("v")).unionByName(spark.createDataFrame([(1e15,), (-1e15,)], "v double"))
    blocks = O._with_block(O.value_counts(values, [], "v"), [], 5_000)
    assert blocks.groupBy("block").count().agg(F.max("count")).first()[0] <= 2 * 5_000
    got = O.percentiles(values, [], "v", {"p0": 0.0, "p50": 0.5, "p100": 1.0}, 5_000).first()
    assert (got.p0, got.p50, got.p100) == (-1e15, 499.995, 1e15)


def test_a_tie_of_a_third_of_all_rows_is_split(spark, many_tasks):
    from censora.operators.paging import positioned

    rows = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.col("id") % 1000).alias("v"))
    got = O.ranked(rows, "v", ["id"])
    assert got.where("v = 7").agg(F.count_distinct("position"), F.count_distinct("rank")).first()[:] == (20_040, 1)
    assert got.agg(F.count_distinct("position"), F.max("position")).first()[:] == (60_000, 60_000)
    plan = positioned(rows, [F.desc("v"), F.col("id")])
    sizes = plan.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes < 40_000


def test_keep_first_of_a_hot_group(skewed):
    first, repeats = R.keep_first(skewed, ["k"], ["id"])
    assert first.count() + repeats.count() == N
    assert first.where("k = 'hot'").first().id == 0


def test_previous_row_of_a_hot_group(skewed):
    got = O.with_previous(skewed, ["k"], ["id"], F.floor(F.col("id") / 1000), ["id"])
    assert got.where("k = 'hot' and prev_id <> id - 3").count() == 0
    assert got.where("prev_id is null").count() == skewed.select("k").distinct().count()


def test_hot_partition_is_written_by_many_tasks(skewed, many_tasks, tmp_path):
    path = str(tmp_path / "t")
    small = skewed.select("id", F.when(F.col("k") == "hot", "hot").otherwise("rest").alias("k"))
    tables.write_partitioned(small, path, ["k"], ["id"], row_group=10_000)
    assert len([f for f in os.listdir(f"{path}/k=hot") if f.endswith(".parquet")]) > 1


@pytest.mark.parametrize(
    "name",
    ["d11_asof_nearest", "d13_band_join", "d14_interval_overlap", "d17_sites_near", "d22_covering_polygons", "f13_trailing_history", "m3_class_by_minute", "m15_air_index", "j2_composition_by_sector", "i1_cube_query"],
)
def test_plans_do_not_pair_rows(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = load()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert not set(findings(plan)) - {"one-partition window"}


def test_filters_and_columns_reach_the_scan(spark):
    plan = load()["g9_exact_count"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity" in plan and "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan
