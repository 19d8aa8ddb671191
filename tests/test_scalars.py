import random

from pyspark.sql import functions as F

from censora.functions import geo, text
from censora.functions import scalars as S


def test_round_half_even_is_exact(spark):
    rng = random.Random(7)
    values = [2.675, 0.125, 0.375, 1.005, -2.5, 0.5, 1.5, 2.5, 2.665, -2.675, 0.0, 1e9 + 0.005]
    values += [rng.uniform(-1e6, 1e6) for _ in range(3000)]
    values += [rng.randrange(-(10**9), 10**9) / 1000 for _ in range(3000)]
    values += [rng.randrange(-(10**6), 10**6) / 16 for _ in range(1000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", *[S.round_half_even("x", n).alias(f"r{n}") for n in (0, 1, 2, 4)]).collect()
    for r in got:
        for n in (0, 1, 2, 4):
            assert r[f"r{n}"] == round(r.x, n), (r.x, n)


def test_percentile_rank_takes_the_first_interval(frame):
    plain = [float(x) for x in range(10, 31)]
    tied = [9.0, 10.0, 10.0, *[float(x) for x in range(11, 29)]]
    df = frame("g array<double>, v double", (plain, 17.5), (plain, 9.0), (plain, 31.0), (tied, 10.0))
    got = [r[0] for r in df.select(S.percentile_rank_from_grid("g", "v")).collect()]
    assert got == [37.5, 0.0, 100.0, 5.0]


def test_codes_and_periods(frame):
    df = frame("c string, p string", ("7", "2005/03"), ("123", "2005-03"))
    got = df.select(S.zero_pad("c", 2), S.parse_quarter("p"), S.parse_month("p").cast("string")).collect()
    assert tuple(got[0]) == ("07", "2005T3", None)
    assert tuple(got[1]) == ("123", None, "2005-03-01")


def test_number_text(frame):
    df = frame("v string", ("42,106,336",), ("1,23",), ("*",), ("12.5",), ("",))
    got = [tuple(r) for r in df.select(S.clean_number_text("v"), S.number_flag("v")).collect()]
    assert got == [(42106336.0, None), (None, None), (None, "*"), (12.5, None), (None, None)]


def test_trim_decimal_text(frame):
    df = frame("v string", ("12.5000",), ("0.000",), ("100",), ("-0.0",), ("7.",))
    assert [r[0] for r in df.select(S.trim_decimal_text("v")).collect()] == ["12.5", "0", "100", "-0", "7"]


def test_two_digit_years(frame):
    df = frame("y int, r int", (99, 1999), (85, 1990), (12, 2015), (20, 2015), (1998, 2000), (9999, 2000))
    assert [r[0] for r in df.select(S.normalize_year("y", "r")).collect()] == [None, 1985, 2012, 1920, 1998, None]


def test_magnus_humidity(frame):
    df = frame("t double, d double", (20.0, 15.0))
    assert abs(df.select(S.relative_humidity("t", "d")).first()[0] - 72.95) < 0.05


def test_haversine_and_radius(frame):
    df = frame("id long, lat double, lon double", (1, 19.4361, -99.1332), (2, 19.4326, -99.1280))
    got = [r[0] for r in df.select(geo.haversine_m(F.col("lat"), F.col("lon"), 19.4326, -99.1332)).collect()]
    assert got == [389.2, 545.3]


def test_point_in_square(frame):
    ring = geo.ring_of([(0, 0), (10, 0), (10, 10), (0, 10)])
    df = frame("x double, y double", (5.0, 5.0), (15.0, 5.0), (5.0, -1.0))
    assert [r[0] for r in df.select(geo.point_in_ring(F.col("x"), F.col("y"), ring)).collect()] == [True, False, False]


def test_search_by_synonym(frame):
    thesaurus = {"desempleo": ["desocupada", "desocupacion", "desocupados"]}
    df = frame("id int, text string", (1, "Población desocupada"), (2, "Tasa de DESEMPLEO"), (3, "Población total"))
    got = text.synonym_search(df, "text", "Desempleo", thesaurus).orderBy("synonym_only").collect()
    assert [(r.id, r.synonym_only) for r in got] == [(2, 0), (1, 1)]
    many = frame("v string", *[(f"t{i}",) for i in range(20)])
    every = {"a": [f"t{i}" for i in range(20)]}
    assert text.synonym_search(many, "v", "a", every).count() == 20
    assert text.synonym_search(many, "v", "a", {"a": ["t11", "t12", "t13"]}, most=2).count() == 2


def test_folding_is_one_rule_for_texts_and_queries(frame):
    words = ["Kőszeg ŞİŞLİ ﬁn", "Nation\u0301", "Dž ĳ ﬆ", "Ελλάδα Й", "ＷＩＤＥ", "straße Ø"]
    got = [r[0] for r in frame("v string", *[(w,) for w in words]).select(text.strip_accents("v")).collect()]
    assert got == [text.fold(w) for w in words]
    assert got[0] == "koszeg sisli fin" and got[1] == "nation" and got[4] == "wide"
    assert text.synonym_search(frame("v string", ("Población",)), "v", "poblacio\u0301n", {}).count() == 1


def test_slug_and_accents(frame):
    df = frame("v string", ("  Índice   de Población (2020) ",))
    got = df.select(text.strip_accents("v"), text.slugify("v")).first()
    assert tuple(got) == ("indice de poblacion (2020)", "indice-de-poblacion-2020")
