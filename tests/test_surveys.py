import pytest
from conftest import rows
from pyspark.sql import functions as F

from censora.operators import aggregates as A
from censora.plans import reports as R
from censora.plans import surveys as S

PERSON = "periodo string, ent string, eda int, clase1 int, clase2 int, sub_o int, tcco int, tue2 int, pos_ocu int, rama int, seg_soc int, remune2c int, rama_est2 int, fac long"


@pytest.fixture
def persons(frame):
    people = [
        ("01", 30, 1, 1, 0, 0, 1, 1, 3, 1, 100),
        ("01", 40, 1, 1, 1, 2, 5, 3, 6, 2, 50),
        ("01", 14, 1, 1, 0, 0, 5, 4, 6, 2, 999),
        ("01", 20, 1, 2, 0, 0, 0, 0, 0, 0, 30),
        ("02", 60, 2, 0, 0, 0, 0, 0, 0, 0, 20),
        ("02", 25, 0, 0, 0, 0, 0, 0, 0, 0, 7),
    ]
    return frame(PERSON, *[("2025T1", *p[:10], 0, p[8], p[10]) for p in people])


def test_labour_indicators_of_the_fixture(persons):
    nation = S.labour_indicators(persons).where("ent = '00'").first()
    assert [nation[k] for k in S.labour_domains()] == [200, 180, 20, 150, 30, 50, 50, 50]
    assert nation.tasa_participacion == 90.0
    assert nation.tasa_desocupacion == pytest.approx(100 / 6)
    assert nation.tasa_informalidad_til1 == pytest.approx(100 / 3)


def test_states_add_up_to_the_nation(persons):
    table = S.labour_indicators(persons)
    for name in S.labour_domains():
        parts = table.where("ent <> '00'").agg(F.sum(name)).first()[0]
        assert parts == table.where("ent = '00'").first()[name]


def test_missing_answers_count_as_no(frame):
    person = frame(PERSON, ("2025T1", "01", 30, 1, 1, None, None, None, None, None, None, None, None, 10))
    got = S.labour_indicators(person).where("ent = '01'").first()
    assert (got.ocupados_total, got.informales_total, got.subocupados_total) == (10, 0, 0)


def test_composition_is_zero_filled(persons):
    got = S.composition(persons, "pos_ocu", range(1, 5)).where("ent = '00'").orderBy("pos_ocu").collect()
    assert [(r.pos_ocu, r.total) for r in got] == [(1, 100), (2, 0), (3, 50), (4, 0)]
    assert sum(r.pct for r in got) == pytest.approx(100)


def test_vandalism_alone_makes_no_victim(frame):
    people = frame("id_per string, edition int, ent int, sex int, w long", ("a", 2024, 1, 1, 10), ("b", 2024, 1, 1, 30), ("c", 2024, 1, 1, 60))
    offences = frame("id_per string, code int", ("a", 3), ("b", 3), ("b", 5), ("b", 6), ("c", None))
    got = S.prevalence(people, offences).first()
    assert (got.people, got.victims, got.rate, got.year) == (100, 30, 30_000.0, 2023)


def test_register_grains_agree(frame):
    records = frame("year int, ent int, sex int", (2020, 1, 1), (2020, 1, 7), (2020, None, 2), (2020, 1, 1))
    recodes = {"year": F.col("year"), "ent": F.coalesce("ent", F.lit(99)), "sex": S.sex_code(F.col("sex"))}
    got = S.register_grains(records, ["year", "ent", "sex"], recodes, {"full": ("year", "ent", "sex"), "year": ("year",)})
    assert rows(got) == [("full", 2020, 1, 1, 2), ("full", 2020, 1, 9, 1), ("full", 2020, 99, 2, 1), ("year", 2020, None, None, 4)]


def test_anthropometry_rules(frame):
    schema = "ent int, sex int, age int, w long, pregnant boolean, kg_1 double, kg_2 double, cm_1 double, cm_2 double, old_kg_1 double, old_kg_2 double, old_cm_1 double, old_cm_2 double"

    def adult(age=30, sex=1, w=10, preg=False, kg=(70.0, 72.0), cm=(170.0, 170.0), old=(None,) * 4):
        return (1, sex, age, w, preg, *kg, *cm, *old)

    df = frame(
        schema,
        adult(),  # 24.6: normal
        adult(kg=(100.0, 222.222)),  # one reading, 34.6: obese
        adult(kg=(222.222, 222.222)),  # not weighed
        adult(sex=2, preg=True),
        adult(cm=(120.0, 120.0)),  # not plausible
        adult(age=65, old=(50.0, 50.0, 170.0, 170.0)),  # columns of their own
        adult(age=19),
    )
    got = {r.age_group: r for r in S.anthropometry(df).collect()}
    assert (got["30-39"].n, got["30-39"].normal, got["30-39"].obese) == (2, 10, 10)
    assert (got["60-69"].underweight, got["60-69"].people) == (10, 10)
    assert len(got) == 2


def test_weighted_mean_and_share(frame):
    df = frame("x long, w long", (10, 1), (20, 3), (0, 6))
    got = df.agg(A.weighted_mean("x", "w"), A.weighted_mean("x", "w", F.col("x") > 0), A.weighted_share(F.col("x") > 0, "w")).first()
    assert tuple(got) == (7.0, 17.5, 40.0)


def test_money_mean_does_not_depend_on_order(spark):
    values = [0.1 * i for i in range(1, 2000)]
    a = spark.createDataFrame([(v,) for v in values], "x double").repartition(7)
    b = spark.createDataFrame([(v,) for v in reversed(values)], "x double").coalesce(1)
    assert a.agg(A.money_mean("x")).first()[0] == b.agg(A.money_mean("x")).first()[0]


def test_silent_fund_and_null_net(frame):
    funds = frame("fund int, name string", (1, "a"), (2, "b"))
    resources = frame("month string, fund int, kind string, cents long", ("2025-01", 1, "sar_total", 100), ("2025-02", 2, "sar_total", 50))
    got = rows(R.fund_snapshot(funds, resources, ("sar_total",), "sar_total", "2025-01").select("fund", "sar_total", "pct_system"))
    assert got == [(1, 100, 100.0), (2, None, None)]
    flows = frame("month string, inflow long, outflow long", ("2025-01", 10, 4), ("2025-02", 10, None))
    assert rows(R.net_flows(flows, ["month"]).select("month", "net")) == [("2025-01", 6), ("2025-02", None)]


def test_identity_closes_within_five_cents(frame):
    df = frame("month string, kind string, cents long", ("1", "total", 1000), ("1", "a", 996), ("2", "total", 1000), ("2", "a", 990))
    got = rows(R.resource_composition(df, ["a"], "total").select("month", "closes"))
    assert got == [("1", True), ("2", False)]


def test_economic_census_rules(frame):
    files = frame(
        "ent string, c1 string, c2 string, ue string, arrival long",
        ("01", "72", "", "10", 1),
        ("01", "72", "722", "4", 2),
        ("01", "72", "722", "5", 3),  # same key later: a repeat
        ("01", "72", "72", "9", 4),  # a higher level repeated below: dropped
        ("02", "72", "", "C", 5),  # withheld
    )
    levels = frame("code string, true_level int", ("72", 1), ("722", 2))
    fact, repeats = R.census_fact(files, ["c1", "c2"], ["ue"], levels, ["ent", "level", "code"])
    assert rows(fact.select("ent", "level", "code", "ue")) == [("01", 1, "72", 10.0), ("01", 2, "722", 4.0), ("02", 1, "72", None)]
    assert repeats.count() == 1
