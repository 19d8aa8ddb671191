"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs once to warm up and then once for the clock; the result is computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import time
from dataclasses import replace

from censora.operators import paging
from censora.plans import cube as Q
from censora.plans import cube_catalogue as C
from censora.queries import Tables, load
from censora.queries.storage import microdata
from censora.session import local_session, materialise, shared_dir
from censora.sources import readers
from censora.sources import tables as stored

DIRECTORY = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINES = (
    "i1_cube_query", "i1_cube_no_join_needed", "i2_with_parents", "i5_unfold_virtual_dimension", "i3_members_from_facts", "i3_members_from_catalogue", "i1_cube_many_groups",
    "e1_group_agg", "e2_count_distinct", "e5_weighted_mean", "e8_percentile_cont_lines", "e19_preaggregate", "d11_asof_nearest",
    "d16_radius_search", "f7_weighted_moving_average", "f12_climatology", "g6_cursor_page", "h8_dedup_keep_first", "h11_choose_key",
    "j1_labour_indicators", "j18_census_fact", "k6_row_compare", "k8_observation_marks", "l2_subtree_totals", "m1_minute_summaries",
    "m3_class_by_minute", "a5_decide_types",
)


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(run) -> float:
    run()
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=int(CPUS) if CPUS.isdigit() else 8)
    registry = load()
    seconds = {name: timed(lambda n=name: drain(registry[n](spark, DIRECTORY))) for name in HEADLINES}

    tables = Tables(spark, DIRECTORY)
    # Speed-up of a cube query answered by a stored rollup over the same query on the fact.
    dimensions, measures = ("year", "segment", "flag"), ("revenue", "lines")
    rollup = materialise(Q.rollup_frame(C.SALES, tables, dimensions, measures), "bench-rollup")
    routed = replace(C.SALES, rollups=(Q.Rollup(dimensions, measures, lambda _t: rollup),))
    question = Q.CubeQuery(measures, ("year", "segment"))
    seconds["cube_raw"] = timed(lambda: drain(Q.plan(C.SALES, question, tables)))
    seconds["cube_from_rollup"] = timed(lambda: drain(Q.plan(routed, question, tables)))

    # A page of partitioned microdata: the first one, and one far into the table.
    rows, path = microdata(tables), shared_dir(spark, "bench-microdata")
    stored.write_partitioned(rows, path, ["periodo", "ent"], ["con"])
    key = ["periodo", "ent", "con"]
    deep = rows.orderBy(*key).offset(int(rows.count() * 0.9)).limit(1).first()
    for name, cursor in (("page_first", None), ("page_deep", paging.encode_cursor([deep[k] for k in key]))):
        scan = readers.scan_partitions(spark, path, rows.schema)
        seconds[name] = timed(lambda s=scan, c=cursor: paging.cursor_page(s, key, 100, c).collect())

    lines = tables.lineitem.count()
    minutes = 20 * 43_200
    print(
        json.dumps(
            {
                "metric": "warm seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(DIRECTORY.rstrip("/")).removeprefix("sf"),
                "cube_rows_per_sec": round(lines / seconds["i1_cube_query"]),
                "rollup_speedup": round(seconds["cube_raw"] / seconds["cube_from_rollup"], 2),
                "pulse_minutes_per_sec": round(minutes / seconds["m3_class_by_minute"]),
            }
        )
    )


if __name__ == "__main__":
    main()
