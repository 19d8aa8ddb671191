import re

import pytest

import __spark_entry__ as contract
from censora.queries import load

SMOKE = ["a5_strict_types", "c6_synonym_search", "e8_percentile_cont", "g6_cursor_page", "i1_cube_query", "k7_intake_rules", "l2_subtree_totals", "m2_punctuality"]


def test_every_query_has_sql_and_columns_of_the_same_name():
    assert {name for name, q in load().items() if q.sql is None} == set()
    assert set(load()) <= set(contract.queries())
    assert len(load()) >= 240


def test_names_say_their_operator():
    assert all(re.match(r"^[a-m]\d+_[a-z0-9_]+$", name) for name in load())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", SMOKE)
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    folder = "/root/testdata/sf0.001"
    for table in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    df = contract.queries()[name](spark, folder)
    got = df.toArrow()
    cursor = db.execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(got.column_names) == sorted(names)
    order = [names.index(c) for c in sorted(names)]
    mine = sorted(repr(tuple(r)) for r in zip(*[got.column(c).to_pylist() for c in sorted(names)]))
    assert mine == sorted(repr(tuple(r[i] for i in order)) for r in want)
