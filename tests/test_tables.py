import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from censora.operators import hierarchy as H
from censora.operators import paging as P
from censora.operators import quality as Q
from censora.operators import reshape as R
from censora.operators.filters import clean_extremes, current_alerts, in_filter
from censora.sources import readers, tables, typing


def test_strict_types(frame):
    df = frame(
        "code string, n string, x string, mixed string, big string, blank string",
        ("01", "1", "1.5", "1", "99999999999999999999", ""),
        ("10", "-2", " 2 ", "*", "1", " "),
        ("11", "", "-.5e3", "3", "2", None),
    )
    got = typing.strict_types(df)
    assert dict(got.dtypes) == {"code": "string", "n": "bigint", "x": "double", "mixed": "string", "big": "double", "blank": "string"}
    assert [r.n for r in got.collect()] == [1, -2, None]


def test_keep_first_is_idempotent(frame):
    df = frame("k string, v int, arrival int", ("a", 1, 3), ("a", 2, 1), ("b", 3, 2), ("a", 4, 9), (None, 5, 4), (None, 6, 5))
    first, repeats = R.keep_first(df, ["k"], ["arrival"])
    assert rows(first) == [("a", 2, 1), ("b", 3, 2), (None, 5, 4)]
    assert rows(repeats) == [("a", 1, 3), ("a", 4, 9), (None, 6, 5)]
    again, none = R.keep_first(first, ["k"], ["arrival"])
    assert rows(again) == rows(first) and none.count() == 0


def test_key_choice_takes_the_first_unique(frame):
    df = frame("a int, b int, tipo int, d_sem int", (1, 1, 1, 1), (1, 1, 1, 2), (1, 1, 2, 1), (2, 1, 1, 1))
    got = R.choose_key(df, [["a", "b"], ["a", "b", "tipo"], ["a", "b", "tipo", "d_sem"]]).orderBy("place").collect()
    assert [r.is_unique for r in got] == [False, False, True]
    assert [r.key for r in got if r.chosen] == ["a,b,tipo,d_sem"]


@pytest.mark.parametrize("size", [1, 7, 30])
def test_cursor_walk_returns_every_row_once(spark, size):
    df = spark.range(60).select((F.col("id") % 7).alias("a"), F.concat(F.lit("k"), F.col("id").cast("string")).alias("b"), "id")
    cursor, seen = None, []
    while True:
        page = P.cursor_page(df, ["a", "b"], size, cursor).orderBy("position").collect()
        seen += [(r.a, r.b) for r in page]
        cursor = page[-1].next_cursor
        if cursor is None:
            break
        if size == 1 and len(seen) == 9:
            break
    want = sorted((i % 7, f"k{i}") for i in range(60))
    assert seen == want[: len(seen)] and (size == 1 or len(seen) == 60)


def test_bad_cursors_are_refused(spark):
    df = spark.range(3).select("id", F.lit("x").alias("b"))
    for bad in ("???", P.encode_cursor([1]), P.encode_cursor(["x", "b"]), P.encode_cursor([1, 2])):
        with pytest.raises(ValueError, match="cursor"):
            P.cursor_page(df, ["id", "b"], 2, bad)


def test_null_order(frame):
    df = frame("k int, v int", (1, None), (2, 5), (3, 9))
    assert [r.k for r in df.orderBy(*P.ordered("v", True, ["k"])).collect()] == [3, 2, 1]
    assert [r.k for r in df.orderBy(*P.ordered("v", False, ["k"])).collect()] == [2, 3, 1]
    assert [r.k for r in df.orderBy(P.postgres_order("v", True)).collect()] == [1, 3, 2]


def test_reconcile_to_half_the_last_digit(frame):
    mine = frame("geo string, value double", ("a", 71.54), ("b", 71.56), ("c", 71.4), ("d", 1.0))
    told = frame("geo string, published string", ("a", "71.5"), ("b", "71.5"), ("c", "71"), ("e", "2"))
    got = Q.reconcile(mine, told, ["geo"], Q.published_tolerance(F.col("published")))
    assert {r.geo: r.status for r in got.collect()} == {"a": "equal", "b": "different", "c": "equal", "d": "only_calculated", "e": "only_official"}
    total = Q.reconcile_summary(got).first()
    assert (total.equal, total.different) == (2, 1)


def test_profiles_see_changes(spark):
    df = spark.range(100).select("id", (F.col("id") * 0.1).alias("x"), F.col("id").cast("string").alias("s"), (F.col("id") > 5).alias("b"))
    same = Q.compare_profiles(Q.fidelity_profile(df), Q.fidelity_profile(df.repartition(7)))
    assert same.where("not same").count() == 0
    changed = Q.compare_profiles(Q.fidelity_profile(df), Q.fidelity_profile(df.where("id <> 50")))
    assert {r.column for r in changed.where("not same").collect()} == {"*", "id", "x", "s", "b"}


def test_tree(frame):
    pairs = [("72", None), ("722", "72"), ("7225", "722"), ("72251", "7225"), ("722511", "72251"), ("73", None)]
    tree = frame("code string, parent string, name string", *[(c, p, f"n{c}") for c, p in pairs])
    assert [r.ancestor for r in H.ancestors(tree, "722511").orderBy("level").collect()] == ["72", "722", "7225", "72251"]
    leaves = frame("code string, n long", ("722511", 5), ("722", 2), ("73", 1))
    got = {r.code: (r.direct, r.total) for r in H.subtree_totals(tree, leaves).collect()}
    assert got["72"] == (0, 7) and got["722"] == (2, 7) and got["73"] == (1, 1)
    path = {r.code: r.path for r in H.paths(tree).collect()}
    assert path["7225"] == "n72 › n722 › n7225"
    chain = tree.sparkSession.createDataFrame([(str(i), str(i - 1) if i else None) for i in range(40)], "code string, parent string")
    assert H.closure(chain).count() == 40 * 41 // 2
    assert H.ancestors(chain, "39").count() == 39
    total = {r.code: r.total for r in H.subtree_totals(chain, chain.selectExpr("code", "1L AS n")).collect()}
    assert total == {str(i): 40 - i for i in range(40)}
    round_trip = tree.sparkSession.createDataFrame([("a", "b"), ("b", "a")], "code string, parent string")
    with pytest.raises(ValueError, match="back to itself"):
        H.closure(round_trip)


def test_sheet_fill_down_keeps_every_number(frame):
    cells = frame(
        "sheet string, row int, col int, value string",
        ("s", 0, 1, "Total"), ("s", 0, 2, "Men"),
        ("s", 1, 0, "A"), ("s", 1, 1, "10"), ("s", 1, 2, "4"),
        ("s", 2, 0, None), ("s", 2, 1, "7"), ("s", 2, 2, "*"),
        ("s", 3, 0, "B"), ("s", 3, 1, "1"),
    )
    facts = R.sheet_to_long(cells, 0, [0])
    got = rows(facts.select("d1", "column", "text", "value"))
    assert ("A", "Total", "7", 7.0) in got and ("A", "Men", "*", None) in got and len(got) == 5
    assert R.numbers_lost(cells, facts, 0, [0]).first().lost == 0


def test_clean_extremes(frame):
    df = frame("high double, low double", (20.0, 10.0), (5.0, 9.0), (60.0, 10.0), (None, -40.0))
    got = [(r.high, r.low, list(r.dropped)) for r in clean_extremes(df, "high", "low").collect()]
    assert got == [(20.0, 10.0, []), (None, None, ["crossed"]), (None, 10.0, ["out_of_range"]), (None, None, ["out_of_range"])]


def test_alerts_in_force(frame):
    now = dt.datetime(2026, 3, 2, 12)
    hour = dt.timedelta(hours=1)
    schema = "identifier string, message string, starts timestamp, expires timestamp, references string"
    df = frame(
        schema,
        ("A1", "Alert", now - hour, now + hour, None),
        ("A2", "Update", now - hour, now + hour, "x,a3,y x,A9,y"),
        ("A3", "Alert", now - hour, now + hour, ""),
        ("A4", "Cancel", now - hour, now + hour, None),
        ("A5", "Alert", now - hour, now, None),
        ("A6", "Alert", now + 7 * hour, None, None),
        ("A7", "Alert", now + 6 * hour, None, None),
    )
    got = {r.identifier for r in current_alerts(df, F.lit(now)).collect()}
    assert got == {"A1", "A2", "A7"}


def test_filter_limits():
    with pytest.raises(ValueError):
        in_filter("x", [])
    with pytest.raises(ValueError):
        in_filter("x", list(range(501)))


def test_csv_encodings_bom_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿Clave,Nombre\n01,Ñandú\n".encode())
    (tmp_path / "b.csv").write_bytes('clave,NOMBRE\n02,"Peñón, el ""alto"""\n'.encode("latin-1"))
    (tmp_path / "c.csv").write_bytes("clave,extra\n03,x\n".encode())
    got = readers.read_csv_text(spark, [str(tmp_path / "*.csv")])
    assert set(got.columns) == {"clave", "nombre", "extra"}
    assert rows(got.select("clave", "nombre", "extra")) == [("01", "Ñandú", ""), ("02", 'Peñón, el "alto"', ""), ("03", "", "x")]


def test_partitioned_microdata(spark, many_tasks, tmp_path):
    df = spark.range(1000).select(
        F.lit("2025T1").alias("periodo"), F.when(F.col("id") < 900, "09").otherwise("01").alias("ent"), F.col("id").alias("con")
    ).select("con", "periodo", "ent")
    counts = tables.write_partitioned(df, str(tmp_path / "m"), ["periodo", "ent"], ["con"], row_group=100)
    assert rows(counts) == [("2025T1", "01", 100), ("2025T1", "09", 900)]
    one = readers.scan_partitions(spark, str(tmp_path / "m"), df.schema, periodo="2025T1", ent="09")
    assert one.count() == 900 and one.first().ent == "09"
    # The hot state is spread over several files, each with its own key range.
    assert one.select(F.input_file_name()).distinct().count() > 1


def test_slice_reload(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).alias("part"))
    path = str(tmp_path / "s")
    assert tables.reload_slice(df, path, "part", 0) == "loaded"
    assert tables.reload_slice(df, path, "part", 0) == "complete"
    assert tables.reload_slice(df, path, "part", 1) == "loaded"
    assert spark.read.schema(df.schema).parquet(path).count() == 10


def test_export_is_complete_unless_limited(spark, tmp_path):
    df = spark.range(20).select("id", F.lit('a "b", c').alias("t"))
    assert tables.export(df, str(tmp_path / "x"), "csv", {"id": "Clave"}, limit=5, order=[F.desc("id")])
    assert not tables.export(df, str(tmp_path / "y"), "csv")
    with pytest.raises(ValueError, match="order"):
        tables.export(df, str(tmp_path / "w"), "csv", limit=5)
    back = spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "x"))
    assert back.columns == ["Clave", "t"] and back.count() == 5 and back.first().t == 'a "b", c'
    assert spark.read.option("header", True).csv(str(tmp_path / "y")).count() == 20
    with pytest.raises(ValueError):
        tables.export(df, str(tmp_path / "z"), "xlsx")


def test_constraints(frame):
    df = frame("id int, ref int, pct double", (1, 1, 50.0), (1, 9, 150.0), (2, None, None))
    got = Q.constraint_check(df, ["id"], {"fk": ("ref", frame("k int", (1,)), "k")}, {"pct": F.col("pct").between(0, 100)})
    assert rows(got) == [("fk", 1), ("pct", 1), ("primary_key", 1)]


def test_a_published_text_that_is_no_number_differs(frame):
    got = Q.reconcile(frame("k int, value double", (1, 5.0), (2, 5.0)), frame("k int, published string", (1, "N/D")), ["k"], F.lit(0.1))
    assert {r.k: r.status for r in got.collect()} == {1: "different", 2: "only_calculated"}
