import itertools

import pytest
from conftest import rows

from censora.plans import cube as Q
from censora.plans.cube_catalogue import CUBES

FACTS = "year int, level string, ent string, mun string, age_17 long, age_18 long, age_19 long, w long"


class Tables:
    def __init__(self, spark, facts):
        self.spark, self.facts = spark, facts


@pytest.fixture
def tables(spark, frame):
    return Tables(
        spark,
        frame(
            FACTS,
            (2024, "nacional", "00", None, 30, 40, None, 70),
            (2024, "entidad", "01", None, 10, 15, None, 25),
            (2024, "entidad", "02", None, 20, 25, None, 45),
            (2024, "municipio", "01", "001", 10, 15, None, 25),
        ),
    )


PEOPLE = Q.Cube(
    key="people",
    topic="test",
    fact=lambda t: t.facts,
    measures=(Q.Measure("w", "sum(w)"), Q.Measure("share", "avg(w)", kind="rate")),
    dimensions=(
        Q.Dimension("year", "year", kind="temporal"),
        Q.Dimension("level", "level", partition=("mun",)),
        Q.Dimension("ent", "ent", "concat('E', ent)", "geographic", codes={"01": "INE-01"}),
        Q.Dimension("mun", "mun", parent="ent"),
        Q.Dimension("age", "age", virtual=tuple(Q.Member(str(a), f"age {a}", {"w": f"sum(age_{a})"}) for a in (17, 18, 19))),
    ),
    default={"measures": ("w",), "columns": ("level",)},
)


def ask(tables, *args, **kw):
    return Q.plan(PEOPLE, Q.CubeQuery(*args, **kw), tables)


def test_nested_universes_are_not_added(tables):
    with pytest.raises(Q.CubeError, match="contain one another"):
        ask(tables, ("w",), ("year",))
    assert ask(tables, ("w",), ("year",), {"level": ["entidad"]}).first().w == 70
    assert ask(tables, ("w",), ("mun",)).count() == 2  # grouping by mun tells the levels apart


def test_virtual_dimension_unfolds_and_folds(tables):
    got = ask(tables, ("w",), ("year", "age"), {"level": ["entidad"]}, order="age", descending=False)
    assert [(r.age_id, r.age, r.w) for r in got.orderBy("position").collect()] == [("17", "age 17", 30), ("18", "age 18", 40), ("19", "age 19", None)]
    assert ask(tables, ("w",), (), {"level": ["entidad"], "age": ["17", "18"]}).first().w == 70
    with pytest.raises(Q.CubeError, match="not broken down"):
        ask(tables, ("share",), ("age",), {"level": ["entidad"]})


def test_parents_come_first(tables):
    got = ask(tables, ("w",), ("mun",), {"level": ["municipio"]}, parents=True)
    assert got.columns[:3] == ["ent_id", "ent", "mun"]
    assert got.first().ent_cve == "INE-01"


def test_limit_and_truncation(tables):
    got = ask(tables, ("w",), ("level",), limit=2).orderBy("position").collect()
    assert [r.w for r in got] == [70, 70] and all(r.truncated for r in got)
    assert not ask(tables, ("w",), ("level",), limit=3).first().truncated


def test_results_are_complete_and_in_order(spark, frame, monkeypatch):
    from censora.operators import paging

    monkeypatch.setattr(paging, "TOP", 10)
    df = spark.range(3_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 7 ELSE id % 50 END AS v").repartition(5)
    order = paging.ordered("v", True, ["id"])
    want = {r.id: i for i, r in enumerate(sorted(df.collect(), key=lambda r: (-r.v, r.id)), 1)}
    got = paging.truncated(df, order).collect()
    assert {r.id: r.position for r in got} == want and not any(r.truncated for r in got)
    cut = paging.truncated(df, order, 1_000).collect()
    assert {r.id for r in cut} == {i for i, p in want.items() if p <= 1_000} and all(r.truncated for r in cut)


def test_every_complaint_is_told():
    with pytest.raises(Q.CubeError, match="nope.*several times"):
        Q.check_query(PEOPLE, Q.CubeQuery(("nope",), ("year",)))


@pytest.mark.parametrize(
    "query",
    [
        Q.CubeQuery(("nope",), ("level",)),
        Q.CubeQuery(("w",), ("nope",)),
        Q.CubeQuery(("w", "w"), ("level",)),
        Q.CubeQuery(("w",), ("level", "level")),
        Q.CubeQuery(("w",), ("level",), order="year"),
        Q.CubeQuery(("w",), ("level",), limit=0),
        Q.CubeQuery(("w",), ("level",), {"level": []}),
        Q.CubeQuery(("w",), ("level",), {"ent": ["x"] * 501}),
        Q.CubeQuery((), ("level",)),
    ],
)
def test_bad_queries_are_refused(query):
    with pytest.raises(Q.CubeError):
        Q.check_query(PEOPLE, query)


def test_mandatory_filter():
    cube = next(c for c in CUBES if c.required)
    with pytest.raises(Q.CubeError, match="only read filtered by"):
        Q.check_query(cube, Q.CubeQuery(("events",), ("hour",)))


def test_stocks_take_the_last_period(spark, frame):
    facts = frame("month string, fund string, stock long, flow long", ("01", "a", 10, 1), ("02", "a", 30, 2), ("01", "b", 5, 4))
    cube = Q.Cube(
        key="funds",
        topic="test",
        fact=lambda t: t.facts,
        measures=(Q.Measure("stock", "sum(stock)", kind="stock"), Q.Measure("flow", "sum(flow)")),
        dimensions=(Q.Dimension("month", "month", kind="temporal"), Q.Dimension("fund", "fund")),
        time="month",
    )
    t = Tables(spark, facts)
    got = Q.plan(cube, Q.CubeQuery(("stock", "flow"), ("fund",)), t)
    assert rows(got.select("fund", "stock", "flow")) == [("a", 30, 3), ("b", 5, 4)]
    by_month = Q.plan(cube, Q.CubeQuery(("stock",), ("month",)), t)
    assert rows(by_month.select("month", "stock")) == [("01", 15), ("02", 30)]
    total = Q.plan(cube, Q.CubeQuery(("stock", "flow")), t).first()
    assert (total.stock, total.flow) == (30, 7)  # the last month of all funds together


def test_rollup_answers_what_it_holds(spark, frame):
    data = [(y, s, p, y * i % 7) for i, (y, s, p) in enumerate(itertools.product((1, 2), "ab", "xyz"), 1)]
    facts = frame("y int, s string, p string, v long", *data)
    dims = tuple(Q.Dimension(k, k) for k in "ysp")
    cube = Q.Cube(key="c", topic="t", fact=lambda t: t.facts, measures=(Q.Measure("v", "sum(v)"), Q.Measure("m", "max(v)", kind="rate")), dimensions=dims)
    t = Tables(spark, facts)
    stored = Q.rollup_frame(cube, t, ("y", "s"), ("v",))
    t.facts = frame("y int, s string, p string, v long")  # a routed query must not read the fact
    routed = Q.Cube(**{**cube.__dict__, "rollups": (Q.Rollup(("y", "s"), ("v",), lambda _t: stored),)})
    got = rows(Q.plan(routed, Q.CubeQuery(("v",), ("s",), {"y": [2]}), t).select("s", "v"))
    want = sorted({(s, sum(r[3] for r in data if r[0] == 2 and r[1] == s)) for s in "ab"})
    assert got == want
    assert Q.plan(routed, Q.CubeQuery(("m",), ("s",)), t).count() == 0  # not additive: goes to the fact
    with pytest.raises(Q.CubeError):
        Q.rollup_frame(cube, t, ("y",), ("m",))


def test_definitions_hold():
    assert len(CUBES) >= 10
    for cube in CUBES:
        Q.check_definition(cube)
    with pytest.raises(Q.CubeError):
        Q.check_definition(Q.Cube(**{**PEOPLE.__dict__, "required": ("nope",)}))
