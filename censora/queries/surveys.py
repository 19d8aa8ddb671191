"""Survey estimates and reports (J) over the driver's tables: microdata columns are derived from the keys of the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from censora.functions.scalars import cents, zero_pad
from censora.operators import aggregates as A
from censora.plans import reports as R
from censora.plans import surveys as S
from censora.queries import Tables, query
from censora.queries.aggregates import percentile_sql
from censora.queries.joins import decile_bands

# ------------------------------------------------------------------ labour survey

PERSONS_SQL = """persons AS (SELECT year(l_shipdate)::VARCHAR || 'T' || quarter(l_shipdate)::VARCHAR AS periodo, lpad((l_suppkey % 32 + 1)::VARCHAR, 2, '0') AS ent, (l_quantity + 8)::INTEGER AS eda,
         CASE WHEN l_orderkey % 10 = 0 THEN 0 WHEN l_orderkey % 10 < 4 THEN 2 ELSE 1 END AS clase1,
         CASE WHEN l_orderkey % 10 < 4 THEN 0 WHEN l_orderkey % 17 = 0 THEN 2 ELSE 1 END AS clase2, CASE WHEN l_linenumber = 2 THEN 1 ELSE 0 END AS sub_o,
         (l_partkey % 5)::INTEGER AS tcco, (l_partkey % 8)::INTEGER AS tue2, (l_suppkey % 5 + 1)::INTEGER AS pos_ocu, (l_partkey % 12)::INTEGER AS rama, (l_orderkey % 4)::INTEGER AS seg_soc,
         (l_linenumber % 3)::INTEGER AS remune2c, l_quantity::BIGINT AS fac FROM lineitem),
     masks AS (SELECT periodo, ent, fac, rama, pos_ocu, eda >= 15 AND clase1 IN (1, 2) AS m1, eda >= 15 AND clase1 = 1 AS m2, eda >= 15 AND clase1 = 2 AS m3, eda >= 15 AND clase2 = 1 AS m4, eda >= 15 AND clase2 = 2 AS m5,
         sub_o = 1 AS sub, tcco IN (1, 2, 3) AS crit, tue2 = 5 OR (pos_ocu = 3 AND rama = 6) OR pos_ocu = 4 OR (seg_soc IN (2, 3) AND tue2 = 6)
         OR (pos_ocu = 1 AND remune2c IN (1, 2) AND tue2 NOT IN (5, 6, 7) AND seg_soc IN (2, 3)) OR (pos_ocu = 5 AND seg_soc IN (2, 3)) AS inf FROM persons)"""


def persons(t: Tables):
    order, part, supp, line = (F.col(f"l_{c}") for c in ("orderkey", "partkey", "suppkey", "linenumber"))
    band = order % 10
    return t.lineitem.select(
        F.concat(F.year("l_shipdate").cast("string"), F.lit("T"), F.quarter("l_shipdate").cast("string")).alias("periodo"),
        zero_pad(supp % 32 + 1, 2).alias("ent"),
        (F.col("l_quantity") + 8).cast("int").alias("eda"),
        F.when(band == 0, 0).when(band < 4, 2).otherwise(1).alias("clase1"),
        F.when(band < 4, 0).when(order % 17 == 0, 2).otherwise(1).alias("clase2"),
        F.when(line == 2, 1).otherwise(0).alias("sub_o"),
        (part % 5).cast("int").alias("tcco"),
        (part % 8).cast("int").alias("tue2"),
        (supp % 5 + 1).cast("int").alias("pos_ocu"),
        (part % 12).cast("int").alias("rama"),
        (order % 4).cast("int").alias("seg_soc"),
        (line % 3).cast("int").alias("remune2c"),
        F.col("l_quantity").cast("bigint").alias("fac"),
    )


def _sum(test: str) -> str:
    return f"sum(CASE WHEN {test} THEN fac ELSE 0 END)::BIGINT"


_COUNTS = {
    "pob_15ymas": "m1", "pea_total": "m2", "pnea_total": "m3", "ocupados_total": "m4", "desocupados_total": "m5",
    "subocupados_total": "m4 AND sub", "condcrit_total": "m4 AND crit", "informales_total": "m4 AND inf",
}


@query(
    "j1_labour_indicators",
    f"""WITH {PERSONS_SQL}, s AS (SELECT periodo, ent, {", ".join(f"{_sum(m)} AS {k}" for k, m in _COUNTS.items())} FROM masks GROUP BY 1, 2
            UNION ALL SELECT periodo, '00', {", ".join(f"{_sum(m)} AS {k}" for k, m in _COUNTS.items())} FROM masks GROUP BY 1)
        SELECT *, {", ".join(f"CASE WHEN {d} <> 0 THEN 100.0::DOUBLE * {n} / {d} ELSE 0 END AS {k}" for k, (n, d) in S.RATES.items())} FROM s""",
)
def _(t: Tables):
    return S.labour_indicators(persons(t))


@query(
    "j2_composition_by_sector",
    f"""WITH {PERSONS_SQL}, e AS (SELECT periodo, ent, rama, fac FROM masks WHERE m4 UNION ALL SELECT periodo, '00', rama, fac FROM masks WHERE m4),
             g AS (SELECT periodo, ent, sum(fac)::BIGINT AS tot FROM e GROUP BY 1, 2), k AS (SELECT i::INTEGER AS rama FROM range(12) r(i)),
             c AS (SELECT periodo, ent, rama, sum(fac)::BIGINT AS n FROM e GROUP BY 1, 2, 3)
        SELECT g.periodo, g.ent, k.rama, coalesce(c.n, 0) AS total, 100.0::DOUBLE * coalesce(c.n, 0) / tot AS pct FROM g CROSS JOIN k LEFT JOIN c ON c.periodo = g.periodo AND c.ent = g.ent AND c.rama = k.rama""",
)
def _(t: Tables):
    return S.composition(persons(t), "rama", range(12))


# ------------------------------------------------------------------ registers

DEATHS_SQL = """raw AS (SELECT year(o_orderdate)::INTEGER AS year, CASE WHEN o_custkey % 40 = 39 THEN NULL ELSE (o_custkey % 33)::INTEGER END AS ent, CASE WHEN o_orderkey % 25 = 0 THEN NULL ELSE (o_orderkey % 570)::INTEGER END AS mun,
         (o_orderkey % 4)::INTEGER AS sex, (o_custkey % 32)::INTEGER AS age, left(o_orderpriority, 1)::INTEGER AS cause FROM orders),
     coded AS (SELECT year, coalesce(ent, 99) AS ent, coalesce(mun, 999) AS mun, CASE WHEN sex IN (1, 2) THEN sex ELSE 9 END AS sex,
         CASE WHEN age = 1 THEN '<1' WHEN age BETWEEN 2 AND 7 THEN '1-14' WHEN age BETWEEN 8 AND 10 THEN '15-29' WHEN age BETWEEN 11 AND 16 THEN '30-59' WHEN age BETWEEN 17 AND 29 THEN '60+' ELSE 'NE' END AS age_group, cause FROM raw)"""


@query(
    "j3_vital_statistics",
    f"""WITH {DEATHS_SQL} SELECT 'place' AS grain, year, ent, mun, sex, age_group, CAST(NULL AS INTEGER) AS cause, count(*) AS n FROM coded GROUP BY ALL
        UNION ALL SELECT 'cause', year, ent, NULL, sex, age_group, cause, count(*) FROM coded GROUP BY ALL UNION ALL SELECT 'list', year, ent, NULL, sex, NULL, cause, count(*) FROM coded GROUP BY ALL""",
)
def _(t: Tables):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    raw = t.orders.select(
        F.year("o_orderdate").alias("year"),
        F.when(cust % 40 != 39, (cust % 33).cast("int")).alias("ent"),
        F.when(order % 25 != 0, (order % 570).cast("int")).alias("mun"),
        (order % 4).cast("int").alias("sex"),
        (cust % 32).cast("int").alias("age"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("cause"),
    )
    recodes = {
        "year": F.col("year"),
        "ent": F.coalesce("ent", F.lit(99)),
        "mun": F.coalesce("mun", F.lit(999)),
        "sex": S.sex_code(F.col("sex")),
        "age_group": S.age_code_group(F.col("age")),
        "cause": F.col("cause"),
    }
    grains = {
        "place": ("year", "ent", "mun", "sex", "age_group"),
        "cause": ("year", "ent", "sex", "age_group", "cause"),
        "list": ("year", "ent", "sex", "cause"),
    }
    return S.register_grains(raw, ["year", "ent", "mun", "sex", "age", "cause"], recodes, grains)


@query(
    "j3_births",
    """WITH raw AS (SELECT year(o_orderdate)::INTEGER AS reg, CASE WHEN o_orderkey % 19 = 0 THEN 99 ELSE (year(o_orderdate) - o_custkey % 4)::INTEGER % 100 END AS born, (o_custkey % 60)::INTEGER AS mother, (o_orderkey % 9)::INTEGER AS ord FROM orders),
            y AS (SELECT *, CASE WHEN born = 99 THEN NULL WHEN born >= 85 OR born > reg % 100 THEN 1900 + born ELSE 2000 + born END AS byear FROM raw)
       SELECT reg AS year, CASE WHEN byear IS NULL THEN 'NE' WHEN byear = reg THEN 'mismo' WHEN byear = reg - 1 THEN 'anterior' ELSE 'antes' END AS timeliness,
              CASE WHEN mother < 15 THEN '<15' WHEN mother >= 50 THEN '50+' ELSE (mother // 5 * 5)::VARCHAR || '-' || (mother // 5 * 5 + 4)::VARCHAR END AS mother_group,
              CASE WHEN ord < 1 THEN 'NE' WHEN ord >= 6 THEN '6+' ELSE ord::VARCHAR END AS birth_order, count(*) AS n FROM y GROUP BY ALL""",
)
def _(t: Tables):
    registered = F.year("o_orderdate")
    raw = t.orders.select(
        registered.alias("reg"),
        F.when(F.col("o_orderkey") % 19 == 0, 99).otherwise((registered - F.col("o_custkey") % 4).cast("int") % 100).alias("born"),
        (F.col("o_custkey") % 60).cast("int").alias("mother"),
        (F.col("o_orderkey") % 9).cast("int").alias("ord"),
    )
    tuples = raw.groupBy("reg", "born", "mother", "ord").agg(A.rows().alias("n"))
    return tuples.groupBy(
        F.col("reg").alias("year"),
        S.birth_timeliness(F.col("born"), F.col("reg")).alias("timeliness"),
        S.mother_group(F.col("mother")).alias("mother_group"),
        S.birth_order(F.col("ord")).alias("birth_order"),
    ).agg(F.sum("n").alias("n"))


# ------------------------------------------------------------------ perception, prevalence, users, women, adults


@query(
    "j4_perception",
    """WITH p AS (SELECT year(o_orderdate)::INTEGER AS year, (o_custkey % 32 + 1)::INTEGER AS ent, (o_orderkey % 2 + 1)::INTEGER AS sex, (o_custkey % 100 + 1) AS w,
              unnest([{'scope': 'colonia', 'a': (o_orderkey % 3)::INTEGER}, {'scope': 'municipio', 'a': (o_orderkey % 5)::INTEGER}, {'scope': 'entidad', 'a': (o_orderkey % 7)::INTEGER}]) AS s FROM orders)
       SELECT year, ent, sex, s.scope AS scope, sum(w)::BIGINT AS total, sum(CASE WHEN s.a = 2 THEN w ELSE 0 END)::BIGINT AS insecure, sum(CASE WHEN s.a = 1 THEN w ELSE 0 END)::BIGINT AS secure,
              sum(CASE WHEN s.a NOT IN (1, 2) THEN w ELSE 0 END)::BIGINT AS undecided FROM p GROUP BY 1, 2, 3, 4""",
)
def _(t: Tables):
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    people = t.orders.select(
        F.year("o_orderdate").alias("year"),
        (cust % 32 + 1).cast("int").alias("ent"),
        (order % 2 + 1).cast("int").alias("sex"),
        (cust % 100 + 1).alias("w"),
        *[(order % m).cast("int").alias(f"ap_{m}") for m in (3, 5, 7)],
    )
    return S.perception(people, {"colonia": "ap_3", "municipio": "ap_5", "entidad": "ap_7"})


@query(
    "j5_prevalence",
    """WITH p AS (SELECT o_orderkey AS id_per, year(o_orderdate)::INTEGER AS edition, (o_custkey % 32 + 1)::INTEGER AS ent, (o_orderkey % 2 + 1)::INTEGER AS sex, o_custkey % 100 + 1 AS w FROM orders),
            v AS (SELECT DISTINCT l_orderkey AS id_per FROM lineitem WHERE l_partkey % 15 + 1 <> 3 AND l_returnflag = 'R'),
            g AS (SELECT edition, ent, sex, sum(w)::BIGINT AS people, sum(CASE WHEN v.id_per IS NOT NULL THEN w ELSE 0 END)::BIGINT AS victims FROM p LEFT JOIN v USING (id_per) GROUP BY 1, 2, 3)
       SELECT edition, ent, sex, people, victims, edition - 1 AS year, 100000 * victims / people AS rate FROM g""",
)
def _(t: Tables):
    people = t.orders.select(
        F.col("o_orderkey").alias("id_per"),
        F.year("o_orderdate").alias("edition"),
        (F.col("o_custkey") % 32 + 1).cast("int").alias("ent"),
        (F.col("o_orderkey") % 2 + 1).cast("int").alias("sex"),
        (F.col("o_custkey") % 100 + 1).alias("w"),
    )
    offences = t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("id_per"), (F.col("l_partkey") % 15 + 1).alias("code")
    )
    return S.prevalence(people, offences)


@query(
    "j6_user_crosstab",
    """SELECT year(l_shipdate)::INTEGER AS edition, (l_suppkey % 33)::INTEGER AS ent, CASE WHEN l_partkey % 3 IN (1, 2) THEN (l_partkey % 3)::INTEGER ELSE 9 END AS sex,
              CASE WHEN l_quantity + 3 < 6 THEN 'NE' WHEN l_quantity + 3 < 12 THEN '6-11' WHEN l_quantity + 3 < 18 THEN '12-17' WHEN l_quantity + 3 < 25 THEN '18-24' WHEN l_quantity + 3 < 35 THEN '25-34'
                   WHEN l_quantity + 3 < 45 THEN '35-44' WHEN l_quantity + 3 < 55 THEN '45-54' ELSE '55+' END AS age_group,
              CASE WHEN l_orderkey % 3 = 1 THEN 1 ELSE 2 END AS internet, CASE WHEN l_orderkey % 2 = 1 THEN 1 ELSE 2 END AS computer, sum(l_linenumber)::BIGINT AS people FROM lineitem GROUP BY ALL""",
)
def _(t: Tables):
    users = t.lineitem.select(
        F.year("l_shipdate").alias("edition"),
        (F.col("l_suppkey") % 33).cast("int").alias("ent"),
        (F.col("l_partkey") % 3).cast("int").alias("sex"),
        (F.col("l_quantity") + 3).alias("age"),
        (F.col("l_orderkey") % 3).alias("internet"),
        (F.col("l_orderkey") % 2).alias("computer"),
        F.col("l_linenumber").alias("w"),
    )
    return S.user_crosstab(users)


FLAGS = ("vtot", "vpsi", "vfis", "vsex", "veco")


@query(
    "j7_flag_prevalence",
    f"""WITH w AS (SELECT o_custkey % 32 + 1 AS ent, CASE WHEN c_custkey IS NULL THEN 'NE' WHEN a < 15 THEN 'NE' WHEN a < 25 THEN '15-24' WHEN a < 35 THEN '25-34' WHEN a < 45 THEN '35-44' WHEN a < 55 THEN '45-54' WHEN a < 65 THEN '55-64' ELSE '65+' END AS age_group,
                 o_custkey % 100 + 1 AS fac, {", ".join(f"o_orderkey % {i + 2} = 1 AS {f}" for i, f in enumerate(FLAGS))}
                 FROM orders LEFT JOIN (SELECT c_custkey, 12 + c_custkey % 70 AS a FROM customer WHERE c_custkey % 8 <> 0) ON c_custkey = o_custkey)
        SELECT ent, age_group, sum(fac)::BIGINT AS women, {", ".join(f"sum(CASE WHEN {f} THEN fac ELSE 0 END)::BIGINT AS {f}" for f in FLAGS)} FROM w GROUP BY 1, 2""",
)
def _(t: Tables):
    women = t.orders.select(
        F.col("o_custkey").alias("id_per"),
        (F.col("o_custkey") % 32 + 1).alias("ent"),
        (F.col("o_custkey") % 100 + 1).alias("w"),
        *[(F.col("o_orderkey") % (i + 2)).alias(f) for i, f in enumerate(FLAGS)],
    )
    ages = t.customer.where("c_custkey % 8 <> 0").select(
        F.col("c_custkey").alias("id_per"), (F.col("c_custkey") % 70 + 12).alias("age")
    )
    return S.flag_totals(women, ages, FLAGS)


@query(
    "j8_fertile_women",
    """WITH w AS (SELECT (l_suppkey % 32 + 1) AS ent, (l_quantity + 8)::INTEGER AS age, (l_partkey % 6)::INTEGER AS place, l_orderkey % 3 AS preg, l_linenumber AS w FROM lineitem)
       SELECT ent, (age // 5 * 5)::VARCHAR || '-' || (age // 5 * 5 + 4)::VARCHAR AS age_group, CASE WHEN place BETWEEN 1 AND 4 THEN place ELSE 9 END AS place_size, CASE WHEN preg = 1 THEN 1 ELSE 2 END AS pregnant, sum(w)::BIGINT AS women
       FROM w WHERE age BETWEEN 15 AND 49 GROUP BY ALL""",
)
def _(t: Tables):
    women = t.lineitem.select(
        (F.col("l_suppkey") % 32 + 1).alias("ent"),
        (F.col("l_quantity") + 8).cast("int").alias("age"),
        (F.col("l_partkey") % 6).cast("int").alias("place_size"),
        (F.col("l_orderkey") % 3).alias("pregnant"),
        F.col("l_linenumber").alias("w"),
    )
    return S.fertile_women(women)


@query(
    "j9_anthropometry",
    """WITH r AS (SELECT l_suppkey % 32 + 1 AS ent, l_partkey % 2 + 1 AS sex, (l_quantity + 35)::INTEGER AS age, l_linenumber - 1 AS w, l_orderkey % 13 = 0 AS preg,
                CASE WHEN l_orderkey % 9 = 0 THEN NULL ELSE (40 + l_partkey % 70)::DOUBLE END AS k1, CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE (41 + l_partkey % 70)::DOUBLE END AS k2,
                CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE (125 + l_suppkey * 7 % 80)::DOUBLE END AS c1, (126 + l_suppkey * 7 % 80)::DOUBLE AS c2 FROM lineitem),
            b AS (SELECT *, CASE WHEN age >= 60 THEN coalesce((k1 + k2) / 2, k1, k2) + 1 ELSE coalesce((k1 + k2) / 2, k1, k2) END AS kg, coalesce((c1 + c2) / 2, c1, c2) / 100 AS m FROM r WHERE age >= 20),
            i AS (SELECT *, kg / (m * m) AS bmi FROM b), k AS (SELECT * FROM i WHERE m BETWEEN 1.3::DOUBLE AND 2.0::DOUBLE AND bmi BETWEEN 10 AND 58 AND NOT (sex = 2 AND preg) AND w > 0)
       SELECT ent, sex, CASE WHEN age < 40 THEN '30-39' WHEN age < 50 THEN '40-49' WHEN age < 60 THEN '50-59' WHEN age < 70 THEN '60-69' WHEN age < 80 THEN '70-79' ELSE '80+' END AS age_group, count(*) AS n, sum(w)::BIGINT AS people,
              sum(CASE WHEN bmi < 18.5 THEN w ELSE 0 END)::BIGINT AS underweight, sum(CASE WHEN bmi >= 18.5 AND bmi < 25 THEN w ELSE 0 END)::BIGINT AS normal,
              sum(CASE WHEN bmi >= 25 AND bmi < 30 THEN w ELSE 0 END)::BIGINT AS overweight, sum(CASE WHEN bmi >= 30 THEN w ELSE 0 END)::BIGINT AS obese FROM k GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    order, part, supp = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    kg_1 = F.when(order % 9 == 0, 222.222).otherwise((part % 70 + 40).cast("double"))
    kg_2 = F.when(order % 11 == 0, 222.222).otherwise((part % 70 + 41).cast("double"))
    cm_1 = F.when(order % 10 == 0, 222.2).otherwise((supp * 7 % 80 + 125).cast("double"))
    cm_2 = (supp * 7 % 80 + 126).cast("double")
    shift = lambda c: F.when(c < 222, c + 1)  # noqa: E731  the columns used from the age of 60 on read one kilo more
    adults = t.lineitem.select(
        (supp % 32 + 1).alias("ent"),
        (part % 2 + 1).alias("sex"),
        (F.col("l_quantity") + 35).cast("int").alias("age"),
        (F.col("l_linenumber") - 1).alias("w"),
        (order % 13 == 0).alias("pregnant"),
        kg_1.alias("kg_1"), kg_2.alias("kg_2"), cm_1.alias("cm_1"), cm_2.alias("cm_2"),
        shift(kg_1).alias("old_kg_1"), shift(kg_2).alias("old_kg_2"), cm_1.alias("old_cm_1"), cm_2.alias("old_cm_2"),
    )
    return S.anthropometry(adults)


# ------------------------------------------------------------------ households

HOUSEHOLDS_SQL = """spent AS (SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN round(l_extendedprice * 100)::BIGINT ELSE 0 END)::BIGINT AS food, sum(CASE WHEN l_returnflag = 'N' THEN round(l_extendedprice * 100)::BIGINT ELSE 0 END)::BIGINT AS housing,
         sum(CASE WHEN l_returnflag = 'R' THEN round(l_extendedprice * 100)::BIGINT ELSE 0 END)::BIGINT AS transport FROM lineitem GROUP BY 1),
     hh AS (SELECT o_orderkey, (o_orderkey % 10 + 1)::INTEGER AS decil, (o_custkey % 32 + 1) AS ent, o_custkey % 100 + 1 AS w, round(o_totalprice * 100)::BIGINT AS income, food, housing, transport, food + housing + transport AS spending
         FROM orders JOIN spent ON l_orderkey = o_orderkey)"""
CATEGORIES = ("food", "housing", "transport")


def households(t: Tables):
    by_flag = {"food": "A", "housing": "N", "transport": "R"}
    spent = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        *[F.sum(F.when(F.col("l_returnflag") == f, cents("l_extendedprice")).otherwise(0)).alias(k) for k, f in by_flag.items()]
    )
    rows = t.orders.select(
        "o_orderkey",
        (F.col("o_orderkey") % 10 + 1).cast("int").alias("decil"),
        (F.col("o_custkey") % 32 + 1).alias("ent"),
        (F.col("o_custkey") % 100 + 1).alias("w"),
        cents("o_totalprice").alias("income"),
    )
    return rows.join(spent, "o_orderkey").withColumn("spending", F.col("food") + F.col("housing") + F.col("transport"))


def _mean(x: str, test: str = "true") -> str:
    return f"sum(CASE WHEN {test} THEN {x} * w END)::BIGINT / sum(CASE WHEN {test} THEN w END)::BIGINT / 100"


@query(
    "j10_households_by_decile",
    f"""WITH {HOUSEHOLDS_SQL} SELECT decil, count(*) AS n, sum(w)::BIGINT AS expanded, {_mean("income")} AS mean_income, {_mean("income")} / 3 AS mean_income_monthly, {_mean("spending")} AS mean_spending,
            {_mean("spending")} / 3 AS mean_spending_monthly, 100 * sum(w)::BIGINT / (SELECT sum(w)::BIGINT FROM hh) AS share FROM hh GROUP BY 1""",
)
def _(t: Tables):
    return R.household_summary(households(t), ["decil"])


@query(
    "j10_spending_structure",
    f"""WITH {HOUSEHOLDS_SQL}, g AS (SELECT ent, sum(w)::BIGINT AS w, sum(food * w)::BIGINT AS food, sum(housing * w)::BIGINT AS housing, sum(transport * w)::BIGINT AS transport FROM hh GROUP BY 1),
             l AS (SELECT ent, w, food + housing + transport AS tot, unnest(['food', 'housing', 'transport']) AS category, unnest([food, housing, transport]) AS v FROM g)
        SELECT ent, category, v / w / 100 / 3 AS mean_monthly, 100 * v / tot AS pct FROM l""",
)
def _(t: Tables):
    return R.category_structure(households(t), CATEGORIES, ["ent"])


@query(
    "j11_place_versus_nation",
    f"""WITH {HOUSEHOLDS_SQL}, g AS (SELECT {", ".join(f"{_mean(c)} / 3 AS n_{c}, {_mean(c, 'ent = 9')} / 3 AS p_{c}" for c in CATEGORIES)} FROM hh),
             l AS (SELECT unnest(['food', 'housing', 'transport']) AS category, unnest([p_food, p_housing, p_transport]) AS place, unnest([n_food, n_housing, n_transport]) AS nation FROM g)
        SELECT *, place - nation AS delta, CASE WHEN nation > 0 THEN (place - nation) / nation * 100 END AS delta_pct FROM l""",
)
def _(t: Tables):
    return R.place_versus_nation(households(t), F.col("ent") == 9, CATEGORIES)


@query(
    "j11_activity_share",
    """WITH a AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R'), h AS (SELECT o_custkey % 100 + 1 AS w, o_custkey % 32 + 1 = 9 AS here, l_orderkey IS NOT NULL AS active FROM orders LEFT JOIN a ON l_orderkey = o_orderkey),
            g AS (SELECT sum(CASE WHEN active THEN w ELSE 0 END)::BIGINT AS nation, sum(w)::BIGINT AS nation_all, sum(CASE WHEN active AND here THEN w ELSE 0 END)::BIGINT AS place, sum(CASE WHEN here THEN w ELSE 0 END)::BIGINT AS place_all FROM h)
       SELECT *, 100 * nation / nation_all AS pct_nation, 100 * place / place_all AS pct_place, (100 * place / place_all) / (100 * nation / nation_all) AS ratio FROM g""",
)
def _(t: Tables):
    rows = t.orders.select("o_orderkey", (F.col("o_custkey") % 100 + 1).alias("w"), (F.col("o_custkey") % 32 + 1).alias("ent"))
    activity = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.activity_share(rows, activity, ["o_orderkey"], F.col("ent") == 9)


_P = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}


@query(
    "j11_pay_in_deciles",
    f"""WITH b AS (SELECT d AS band, min(o_totalprice) AS lower, max(o_totalprice) AS upper FROM (SELECT o_totalprice, ntile(10) OVER (ORDER BY o_totalprice, o_orderkey) AS d FROM orders) GROUP BY 1),
             p AS ({percentile_sql("lineitem", "", "l_extendedprice", _P)}),
             r AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) - 1 AS rn, count(*) OVER () AS n FROM part),
             m AS (SELECT (max(v) FILTER (rn = (n - 1) // 2) + max(v) FILTER (rn = n // 2)) / 2 * 100 AS extra FROM r),
             s AS (SELECT 'A' AS scenario, unnest(['p25', 'p50', 'p75', 'p90']) AS percentile, unnest([p25, p50, p75, p90]) + 0.0::DOUBLE AS income FROM p UNION ALL SELECT 'B', unnest(['p25', 'p50', 'p75', 'p90']), unnest([p25, p50, p75, p90]) + extra FROM p, m)
        SELECT *, CAST(coalesce((SELECT min(band) FROM b WHERE lower <= income AND income <= upper), CASE WHEN income > (SELECT max(upper) FROM b) THEN 10 WHEN income < (SELECT min(lower) FROM b) THEN 1 END) AS INTEGER) AS decile FROM s""",
)
def _(t: Tables):
    extra = R.median_of(t.part, "p_retailprice") * 100
    return R.pay_in_household_deciles(t.lineitem, "l_extendedprice", decile_bands(t.orders, "o_totalprice"), extra)


# ------------------------------------------------------------------ directory, institutions, dashboard

UNITS_SQL = """units AS (SELECT year(o_orderdate)::INTEGER AS edition, lpad((o_custkey % 32 + 1)::VARCHAR, 2, '0') AS ent, left(o_orderpriority, 1) AS activity, count(*) AS n FROM orders GROUP BY 1, 2, 3)"""


@query(
    "j12_directory_series",
    f"""WITH {UNITS_SQL}, e AS (SELECT DISTINCT edition FROM units) SELECT e.edition, coalesce(sum(n), 0)::BIGINT AS units FROM e LEFT JOIN units u ON u.edition = e.edition AND u.ent = '09' AND starts_with(u.activity, '2') GROUP BY 1""",
)
def _(t: Tables):
    summary = A.preaggregate(
        t.orders,
        [
            F.year("o_orderdate").alias("edition"),
            zero_pad(F.col("o_custkey") % 32 + 1, 2).alias("ent"),
            F.substring("o_orderpriority", 1, 1).alias("activity"),
        ],
    )
    editions = summary.select("edition").distinct()
    return R.directory_series(editions, summary, (F.col("ent") == "09") & F.col("activity").startswith("2"))


@query(
    "j13_institutions",
    """WITH p AS (SELECT c_nationkey AS institution, year(o_orderdate)::INTEGER AS cycle, c_mktsegment AS name, o_custkey % 7 AS state, o_custkey AS campus, round(o_totalprice)::BIGINT AS enrolled FROM orders JOIN customer ON c_custkey = o_custkey),
            c AS (SELECT institution, cycle, max(name) AS name, count(DISTINCT state) AS states, count(DISTINCT campus) AS campuses, count(*) AS programmes, sum(enrolled)::BIGINT AS enrolled FROM p GROUP BY 1, 2),
            x AS (SELECT institution, min(cycle) AS first_cycle, max(cycle) AS last_cycle, count(*) AS cycles FROM c GROUP BY 1)
       SELECT x.*, name, states, campuses, programmes, enrolled FROM x JOIN c ON c.institution = x.institution AND c.cycle = x.last_cycle""",
)
def _(t: Tables):
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    programmes = joined.select(
        F.col("c_nationkey").alias("institution"),
        F.year("o_orderdate").alias("cycle"),
        F.col("c_mktsegment").alias("name"),
        (F.col("o_custkey") % 7).alias("state"),
        F.col("o_custkey").alias("campus"),
        F.round("o_totalprice").cast("bigint").alias("enrolled"),
    )
    return R.institutions(programmes)


def payroll(t: Tables):
    key = F.col("p_partkey")
    return t.part.select(
        F.col("p_type").alias("sector"),
        F.col("p_name").alias("position"),
        F.when(key % 2 == 0, "M").otherwise("F").alias("sex"),
        (F.col("p_size") + 15).alias("age"),
        F.date_sub(F.lit("2024-03-15").cast("date"), (key * 13 % 14000).cast("int")).alias("hired"),
        F.when(key % 23 != 0, F.col("p_retailprice")).alias("gross"),
        F.when(key % 23 != 0, F.round(F.col("p_retailprice") * 0.8, 2)).alias("net"),
    )


def _dashboard(part: str):
    return lambda t: R.payroll_dashboard(payroll(t), F.lit("2024-03-15").cast("date"))[part]


PAY_SQL = """pay AS (SELECT p_type AS sector, p_name AS position, p_partkey % 2 = 0 AS man, p_size + 15 AS age, DATE '2024-03-15' - (p_partkey * 13 % 14000)::INTEGER AS hired, p_retailprice AS gross, p_partkey % 23 <> 0 AS paid FROM part)"""
_MEAN = "sum(round(gross * 100)::BIGINT)::BIGINT / (100 * count(*))"
_MEN = "sum(CASE WHEN man THEN round(gross * 100)::BIGINT END)::BIGINT / (100 * count(*) FILTER (man))"
_WOMEN = "sum(CASE WHEN NOT man THEN round(gross * 100)::BIGINT END)::BIGINT / (100 * count(*) FILTER (NOT man))"

query(
    "j14_dashboard_overview",
    f"""WITH {PAY_SQL}, k AS (SELECT * FROM pay WHERE paid), q AS ({percentile_sql("k", "", "gross", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9})})
        SELECT count(*) AS total, count(DISTINCT sector) AS sectors, {_MEAN} AS avg_gross, min(gross) AS min_gross, max(gross) AS max_gross, count(*) FILTER (man) AS men, count(*) FILTER (NOT man) AS women, {_MEN} AS avg_men, {_WOMEN} AS avg_women,
               sum(round(round(gross * 0.8::DOUBLE, 2) * 100)::BIGINT)::BIGINT / (100 * count(*)) AS avg_net,
               sum(round(gross * 100)::BIGINT - round(round(gross * 0.8::DOUBLE, 2) * 100)::BIGINT)::BIGINT / (count(*) * 100) AS avg_deduction, sum(year(DATE '2024-03-15') - year(hired) - CASE WHEN '03-15' < strftime(hired, '%m-%d') THEN 1 ELSE 0 END)::BIGINT / count(*) AS avg_seniority,
               100 * (sum(round(gross * 100)::BIGINT - round(round(gross * 0.8::DOUBLE, 2) * 100)::BIGINT)::BIGINT / (count(*) * 100)) / ({_MEAN}) AS deduction_pct, any_value(q.p25) AS p25, any_value(q.median) AS median, any_value(q.p75) AS p75, any_value(q.p90) AS p90 FROM k, q""",
)(_dashboard("overview"))
query("j14_dashboard_sectors", f"WITH {PAY_SQL} SELECT sector, count(*) AS n, {_MEAN} AS avg_gross, {_MEN} AS avg_men, {_WOMEN} AS avg_women FROM pay WHERE paid GROUP BY 1")(_dashboard("sectors"))
query("j14_dashboard_top_positions", f"WITH {PAY_SQL} SELECT position, count(*) AS n, {_MEAN} AS avg_gross FROM pay WHERE paid GROUP BY 1 ORDER BY 3 DESC, 2 DESC, 1 LIMIT 10")(_dashboard("top_positions"))
query(
    "j14_dashboard_pay_by_age",
    f"""WITH {PAY_SQL} SELECT CASE WHEN age < 26 THEN '18-25' WHEN age < 36 THEN '26-35' WHEN age < 46 THEN '36-45' WHEN age < 56 THEN '46-55' ELSE '56+' END AS age_class, {_MEAN} AS avg_gross FROM pay WHERE paid AND age >= 18 GROUP BY 1""",
)(_dashboard("pay_by_age"))
query(
    "j14_dashboard_seniority",
    f"""WITH {PAY_SQL}, y AS (SELECT *, year(DATE '2024-03-15') - year(hired) - CASE WHEN '03-15' < strftime(hired, '%m-%d') THEN 1 ELSE 0 END AS years FROM pay)
        SELECT CASE WHEN years < 3 THEN '0-2 años' WHEN years < 6 THEN '3-5 años' WHEN years < 11 THEN '6-10 años' WHEN years < 21 THEN '11-20 años' WHEN years < 31 THEN '21-30 años' ELSE '30+ años' END AS seniority, count(*) AS n,
               count(*) FILTER (paid) AS with_pay, sum(CASE WHEN paid THEN round(gross * 100)::BIGINT END)::BIGINT / (100 * count(*) FILTER (paid)) AS avg_gross FROM y GROUP BY 1""",
)(_dashboard("seniority"))


# ------------------------------------------------------------------ retirement funds

RESOURCES_SQL = """resources AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, c_nationkey AS fund, CASE left(o_orderpriority, 1) WHEN '1' THEN 'workers' WHEN '2' THEN 'housing' WHEN '3' THEN 'bonds' WHEN '4' THEN 'savings' ELSE 'other' END AS kind, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents
         FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
     reported AS (SELECT * FROM resources UNION ALL SELECT month, fund, 'sar_total', sum(cents)::BIGINT FROM resources GROUP BY 1, 2)"""
KINDS = ("workers", "housing", "bonds", "savings", "other")


def resources(t: Tables):
    number = F.substring("o_orderpriority", 1, 1)
    kind = F.when(number == "1", "workers").when(number == "2", "housing").when(number == "3", "bonds").when(number == "4", "savings")
    parts = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(
            F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("c_nationkey").alias("fund"), kind.otherwise("other").alias("kind")
        )
        .agg(A.money_sum("o_totalprice").alias("cents"))
    )
    totals = parts.groupBy("month", "fund").agg(F.lit("sar_total").alias("kind"), F.sum("cents").alias("cents"))
    return parts.unionByName(totals)


@query(
    "j15_resource_totals",
    f"WITH {RESOURCES_SQL} SELECT month, sum(cents)::BIGINT AS cents, count(DISTINCT fund) AS funds FROM reported WHERE kind = 'sar_total' GROUP BY 1",
)
def _(t: Tables):
    totals = resources(t).where("kind = 'sar_total'")
    return totals.groupBy("month").agg(F.sum("cents").alias("cents"), F.count_distinct("fund").alias("funds"))


@query(
    "j15_fund_snapshot",
    f"""WITH {RESOURCES_SQL}, s AS (SELECT fund, max(CASE WHEN kind = 'sar_total' THEN cents END) AS sar_total, max(CASE WHEN kind = 'workers' THEN cents END) AS workers FROM reported WHERE month = '1997-06' GROUP BY 1)
        SELECT n_nationkey AS fund, n_name, sar_total, workers, 100 * sar_total / (SELECT sum(sar_total)::BIGINT FROM s) AS pct_system FROM nation LEFT JOIN s ON fund = n_nationkey""",
)
def _(t: Tables):
    funds = t.nation.select(F.col("n_nationkey").alias("fund"), "n_name")
    return R.fund_snapshot(funds, resources(t), ("sar_total", "workers"), "sar_total", "1997-06")


@query(
    "j15_composition_identity",
    f"""WITH {RESOURCES_SQL}, m AS (SELECT month, sum(CASE WHEN kind = 'sar_total' THEN cents END)::BIGINT AS total, coalesce(sum(CASE WHEN kind IN ('workers', 'housing', 'bonds', 'savings') THEN cents END), 0)::BIGINT AS parts FROM reported GROUP BY 1)
        SELECT month, total, parts, total / 100 - parts / 100 AS delta, CASE WHEN total / 100 > 0 THEN 100 * (total / 100 - parts / 100) / (total / 100) ELSE 0 END AS delta_pct, abs(total / 100 - parts / 100) <= 0.05 AS closes FROM m""",
)
def _(t: Tables):
    return R.resource_composition(resources(t), KINDS[:4], "sar_total")


FLOWS_SQL = """flows AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, s_nationkey AS fund, sum(CASE WHEN l_returnflag = 'A' THEN round(l_extendedprice * 100)::BIGINT END)::BIGINT AS inflow, sum(CASE WHEN l_returnflag = 'R' AND l_linenumber < 5 THEN round(l_extendedprice * 100)::BIGINT END)::BIGINT AS outflow
         FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


def flows(t: Tables):
    by_supplier = t.lineitem.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_suppkey").alias("s_suppkey")).agg(
        A.money_sum("l_extendedprice", F.col("l_returnflag") == "A").alias("inflow"),
        A.money_sum("l_extendedprice", (F.col("l_returnflag") == "R") & (F.col("l_linenumber") < 5)).alias("outflow"),
    )
    return by_supplier.join(t.supplier, "s_suppkey").select("month", F.col("s_nationkey").alias("fund"), "inflow", "outflow")


@query("j15_net_flows", f"WITH {FLOWS_SQL} SELECT month, fund, inflow, outflow, inflow - outflow AS net FROM flows")
def _(t: Tables):
    return R.net_flows(flows(t), ["month", "fund"])


@query(
    "j15_transfer_identity",
    """WITH x AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, c_nationkey AS fund, CASE WHEN c_nationkey % 5 <> 4 THEN count(*) END AS ceded FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
            y AS (SELECT month, fund, ceded, CASE WHEN fund % 7 <> 6 THEN ceded END AS received FROM x)
       SELECT month, coalesce(sum(ceded), 0)::BIGINT AS ceded, coalesce(sum(received), 0)::BIGINT AS received, count(*) FILTER (ceded IS NOT NULL OR received IS NOT NULL) AS reporting, (coalesce(sum(received), 0) - coalesce(sum(ceded), 0))::BIGINT AS delta,
              coalesce(sum(received), 0) = coalesce(sum(ceded), 0) AS closes FROM y GROUP BY 1""",
)
def _(t: Tables):
    counts = (
        t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
        .groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("c_nationkey").alias("fund"))
        .agg(A.rows().alias("n"))
    )
    ceded = F.when(F.col("fund") % 5 != 4, F.col("n"))
    return R.transfer_identity(counts.select("month", ceded.alias("ceded"), F.when(F.col("fund") % 7 != 6, ceded).alias("received")))


@query(
    "j15_price_series",
    """WITH p AS (SELECT l_suppkey % 10 AS fund, l_returnflag AS sub, l_shipdate::DATE AS date, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2, 3)
       SELECT fund, sub, min(date) AS first, max(date) AS last, count(*) AS points, min(price) AS low, max(price) AS high, arg_max(price, date) AS last_price FROM p GROUP BY 1, 2""",
)
def _(t: Tables):
    prices = t.lineitem.groupBy(
        (F.col("l_suppkey") % 10).alias("fund"), F.col("l_returnflag").alias("sub"), F.to_date("l_shipdate").alias("date")
    ).agg(F.max("l_extendedprice").alias("price"))
    return R.price_series(prices)


RATES_SQL = """rates AS (SELECT s_nationkey AS fund, strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN s_nationkey % 6 <> 5 THEN sum(round(l_discount * 100)::BIGINT)::BIGINT / (100 * count(*)) END AS rate FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)"""


def rates(t: Tables):
    """Commission of each fund and month: a mean discount; some funds report none."""
    lines = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    cents = F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / (100 * F.count(F.lit(1)))
    grouped = lines.groupBy(F.col("s_nationkey").alias("fund"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(cents.alias("all"))
    return grouped.select("fund", "month", F.when(F.col("fund") % 6 != 5, F.col("all")).alias("rate"))


@query(
    "j15_commission_snapshot",
    f"""WITH {RATES_SQL}, now AS (SELECT fund, round(rate, 4) AS rate FROM rates WHERE month = '1997-06'), f AS (SELECT count(rate) AS reporting, round(sum(rate::DECIMAL(18, 6))::DOUBLE / count(rate), 4) AS mean_rate, min(rate) AS low, max(rate) AS high FROM now)
        SELECT n_nationkey AS fund, n_name, rate, f.* FROM nation LEFT JOIN now ON fund = n_nationkey, f WHERE n_nationkey <> 7""",
)
def _(t: Tables):
    # One fund has no commission on the balance and is left out.
    funds = t.nation.where("n_nationkey <> 7").select(F.col("n_nationkey").alias("fund"), "n_name")
    return R.rate_snapshot(funds, rates(t), "1997-06")


@query("j15_commission_series", f"WITH {RATES_SQL} SELECT fund, min(month) AS first, max(month) AS last, count(rate) AS points, min(rate) AS low, max(rate) AS high, arg_max(rate, month) FILTER (rate IS NOT NULL) AS last_rate FROM rates WHERE rate IS NOT NULL GROUP BY 1")
def _(t: Tables):
    known = rates(t).where("rate is not null")
    return known.groupBy("fund").agg(
        F.min("month").alias("first"), F.max("month").alias("last"), F.count("rate").alias("points"), F.min("rate").alias("low"), F.max("rate").alias("high"), F.max_by("rate", "month").alias("last_rate")
    )


ASSETS_SQL = """assets AS (SELECT s_nationkey AS fund, l_returnflag || l_linestatus AS sub, strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN (s_nationkey + month(min(l_shipdate))) % 5 <> 0 THEN sum(round(l_extendedprice * 100)::BIGINT)::BIGINT END AS cents FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3)"""


def assets(t: Tables):
    """Net assets of each fund, sub-fund and month, in cents; some cells are reported empty."""
    lines = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    grouped = lines.groupBy(
        F.col("s_nationkey").alias("fund"), F.concat("l_returnflag", "l_linestatus").alias("sub"), F.date_format("l_shipdate", "yyyy-MM").alias("month")
    ).agg(A.money_sum("l_extendedprice").alias("all"))
    told = (F.col("fund") + F.substring("month", 6, 2).cast("int")) % 5 != 0
    return grouped.select("fund", "sub", "month", F.when(told, F.col("all")).alias("cents"))


@query(
    "j15_net_assets_matrix",
    f"""WITH {ASSETS_SQL}, m AS (SELECT fund, sub, month, cents / 100 AS amount FROM assets WHERE month BETWEEN '1997-05' AND '1997-08'),
             f AS (SELECT month, count(*) AS cells, count(*) FILTER (amount IS NULL) AS empty, coalesce(sum(amount::DECIMAL(18, 6))::DOUBLE, 0) AS total, min(amount) AS low, max(amount) AS high FROM m GROUP BY 1)
        SELECT m.*, cells, empty, total, low, high FROM m JOIN f USING (month)""",
)
def _(t: Tables):
    amounts = assets(t).withColumn("amount", F.col("cents") / 100).drop("cents")
    return R.matrix_snapshot(amounts, ["month"], "amount", F.col("month").between("1997-05", "1997-08"))


@query(
    "j15_net_assets_by_fund",
    f"WITH {ASSETS_SQL} SELECT fund, month, count(*) AS subs, count(cents) AS told, sum(cents)::BIGINT AS cents FROM assets GROUP BY 1, 2",
)
def _(t: Tables):
    return assets(t).groupBy("fund", "month").agg(A.rows().alias("subs"), F.count("cents").alias("told"), F.sum("cents").alias("cents"))


RETURNS_SQL = """returns AS (SELECT s_nationkey AS fund, l_returnflag AS sub, CASE l_linenumber % 3 WHEN 0 THEN '12m' WHEN 1 THEN '36m' ELSE '60m' END AS term, strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN s_nationkey % 8 <> 3 THEN round(sum(round(l_tax * 100)::BIGINT)::BIGINT / count(*), 4) END AS pct,
         sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS assets FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3, 4)"""


def returns(t: Tables):
    lines = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    number = F.col("l_linenumber") % 3
    grouped = lines.groupBy(
        F.col("s_nationkey").alias("fund"), F.col("l_returnflag").alias("sub"), F.when(number == 0, "12m").when(number == 1, "36m").otherwise("60m").alias("term"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
    ).agg(F.round(F.sum(F.round(F.col("l_tax") * 100).cast("bigint")) / F.count(F.lit(1)), 4).alias("all"), A.money_sum("l_extendedprice").alias("assets"))
    return grouped.select("fund", "sub", "term", "month", F.when(F.col("fund") % 8 != 3, F.col("all")).alias("pct"), "assets")


@query(
    "j15_returns_matrix",
    f"""WITH {RETURNS_SQL}, m AS (SELECT fund, sub, term, month, pct FROM returns WHERE month = '1997-06'),
             f AS (SELECT term, count(*) AS cells, count(*) FILTER (pct IS NULL) AS empty, coalesce(sum(pct::DECIMAL(18, 6))::DOUBLE, 0) AS total, min(pct) AS low, max(pct) AS high FROM m GROUP BY 1)
        SELECT m.*, cells, empty, total, low, high FROM m JOIN f USING (term)""",
)
def _(t: Tables):
    return R.matrix_snapshot(returns(t).drop("assets"), ["term"], "pct", F.col("month") == "1997-06")


@query(
    "j15_returns_system",
    f"""WITH {RETURNS_SQL} SELECT sub, term, month, count(pct) AS funds, (sum(pct::DECIMAL(12, 6) * assets::DECIMAL(20, 0)))::DOUBLE / (sum(CASE WHEN pct IS NOT NULL THEN assets END))::BIGINT::DOUBLE AS pct FROM returns GROUP BY 1, 2, 3""",
)
def _(t: Tables):
    return R.system_returns(returns(t))


MEASURES_SQL = """cells AS (SELECT s_nationkey AS fund, l_returnflag AS sub, strftime(l_shipdate, '%Y-%m') AS month, sum(round(l_discount * 100)::BIGINT)::BIGINT / count(*) AS var, sum(l_quantity::BIGINT)::BIGINT / count(*) AS ppp, CASE WHEN s_nationkey % 4 <> 1 THEN max(l_tax) END AS pid FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2, 3),
     measures AS (SELECT * FROM cells UNPIVOT INCLUDE NULLS (value FOR measure IN (var, ppp, pid)))"""


@query(
    "j15_measure_matrix",
    f"""WITH {MEASURES_SQL}, m AS (SELECT fund, sub, month, measure, value FROM measures WHERE month = '1996-03'),
             f AS (SELECT measure, count(*) AS cells, count(*) FILTER (value IS NULL) AS empty, coalesce(sum(value::DECIMAL(18, 6))::DOUBLE, 0) AS total, min(value) AS low, max(value) AS high FROM m GROUP BY 1)
        SELECT m.*, cells, empty, total, low, high FROM m JOIN f USING (measure)""",
)
def _(t: Tables):
    lines = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    wide = lines.groupBy(F.col("s_nationkey").alias("fund"), F.col("l_returnflag").alias("sub"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        (F.sum(F.round(F.col("l_discount") * 100).cast("bigint")) / A.rows()).alias("var"),
        (F.sum(F.col("l_quantity").cast("bigint")) / A.rows()).alias("ppp"),
        F.max("l_tax").alias("top"),
    )
    wide = wide.select("fund", "sub", "month", "var", "ppp", F.when(F.col("fund") % 4 != 1, F.col("top")).alias("pid"))
    return R.matrix_snapshot(wide.unpivot(["fund", "sub", "month"], ["var", "ppp", "pid"], "measure", "value"), ["measure"], "value", F.col("month") == "1996-03")


@query(
    "j15_account_totals",
    """WITH a AS (SELECT c_nationkey AS fund, strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus AS measure, CASE WHEN c_nationkey % 9 <> 2 THEN count(DISTINCT o_custkey) END AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3)
       SELECT measure, month, sum(n)::BIGINT AS accounts, count(DISTINCT CASE WHEN n IS NOT NULL THEN fund END) AS funds FROM a GROUP BY 1, 2""",
)
def _(t: Tables):
    joined = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    counts = joined.groupBy(F.col("c_nationkey").alias("fund"), F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderstatus").alias("measure")).agg(
        F.count_distinct("o_custkey").alias("all")
    )
    return R.account_totals(counts.select("fund", "month", "measure", F.when(F.col("fund") % 9 != 2, F.col("all")).alias("n")))


@query(
    "j15_contributors",
    """WITH y AS (SELECT year(o_orderdate)::INTEGER AS year, count(DISTINCT o_custkey) AS contributors, (SELECT count(*) FROM customer) AS active FROM orders GROUP BY 1), p AS (SELECT *, round(100 * contributors / active, 2) AS pct FROM y)
       SELECT year, contributors, active, pct, round(100 - pct, 2) AS gap_pct, (SELECT arg_min(year, (pct, year)) FROM p) AS least_year, (SELECT arg_max(year, (pct, -year)) FROM p) AS most_year FROM p""",
)
def _(t: Tables):
    active = t.customer.agg(A.rows().alias("n")).scalar()
    years = t.orders.groupBy(F.year("o_orderdate").alias("year")).agg(F.count_distinct("o_custkey").alias("contributors"))
    return R.contributor_coverage(years.withColumn("active", active))


PRICES_SQL = "p AS (SELECT l_suppkey % 10 AS fund, l_returnflag AS sub, l_shipdate::DATE AS date, max(l_extendedprice) AS price FROM lineitem GROUP BY 1, 2, 3)"


def prices(t: Tables):
    return t.lineitem.groupBy((F.col("l_suppkey") % 10).alias("fund"), F.col("l_returnflag").alias("sub"), F.to_date("l_shipdate").alias("date")).agg(F.max("l_extendedprice").alias("price"))


@query(
    "j15_price_comparison",
    f"""WITH {PRICES_SQL}, w AS (SELECT * FROM p WHERE sub = 'N' AND date BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'), f AS (SELECT fund, arg_min(price, date) AS first_price, count(*) AS points FROM w GROUP BY 1)
        SELECT w.fund, sub, date, price, first_price, points, 100 * (price - first_price) / first_price AS change_pct FROM w JOIN f USING (fund)""",
)
def _(t: Tables):
    day = lambda d: F.lit(d).cast("date")
    return R.price_comparison(prices(t), "N", day("1997-01-01"), day("1997-06-30"))


@query(
    "j15_price_snapshot",
    f"""WITH {PRICES_SQL}, m AS (SELECT * FROM p WHERE date BETWEEN DATE '1997-03-03' AND DATE '1997-03-07'), f AS (SELECT date, count(*) AS cells, 0::BIGINT AS empty, sum(price::DECIMAL(18, 6))::DOUBLE AS total, min(price) AS low, max(price) AS high FROM m GROUP BY 1)
        SELECT m.*, cells, empty, total, low, high FROM m JOIN f USING (date)""",
)
def _(t: Tables):
    day = lambda d: F.lit(d).cast("date")
    return R.matrix_snapshot(prices(t), ["date"], "price", F.col("date").between(day("1997-03-03"), day("1997-03-07")))


# ------------------------------------------------------------------ layers, contest, economic census, series


@query(
    "j16_layer_inventory",
    """WITH c AS (SELECT p_type AS layer, lpad((p_partkey % 32 + 1)::VARCHAR, 2, '0') AS state, count(*) AS objects FROM part GROUP BY 1, 2), t AS (SELECT layer, sum(objects)::BIGINT AS layer_objects FROM c GROUP BY 1),
            d AS (SELECT p_type AS layer, count(*) + CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS declared FROM part GROUP BY 1)
       SELECT c.layer, state, objects, layer_objects, declared, layer_objects = declared AS matches FROM c JOIN t USING (layer) JOIN d USING (layer)""",
)
def _(t: Tables):
    objects = t.part.select(F.col("p_type").alias("layer"), zero_pad(F.col("p_partkey") % 32 + 1, 2).alias("state"))
    declared = t.part.groupBy(F.col("p_type").alias("layer")).agg(
        (A.rows() + F.when(F.col("p_type") == "PROMO", 1).otherwise(0)).cast("bigint").alias("declared")
    )
    return R.layer_inventory(objects, declared)


@query(
    "j17_contest_distribution",
    """WITH s AS (SELECT o_custkey % 40 AS programme, floor(o_totalprice / 4500)::BIGINT % 121 AS score, count(*) AS n FROM orders GROUP BY 1, 2) SELECT *, (sum(n) OVER (PARTITION BY programme))::BIGINT AS people FROM s""",
)
def _(t: Tables):
    scores = t.orders.select(
        (F.col("o_custkey") % 40).alias("programme"), (F.floor(F.col("o_totalprice") / 4500) % 121).alias("score")
    )
    return R.contest_distribution(scores)


@query(
    "j17_contest_ratios",
    """WITH a AS (SELECT o_custkey % 40 AS programme, sum(o_orderkey % 7)::BIGINT AS places, count(*) AS applied, count(*) FILTER (o_orderstatus = 'F') AS selected FROM orders GROUP BY 1)
       SELECT *, 100 * selected / applied AS acceptance_pct, applied / places AS applicants_per_place FROM a""",
)
def _(t: Tables):
    rows = t.orders.select(
        (F.col("o_custkey") % 40).alias("programme"),
        (F.col("o_orderkey") % 7).alias("places"),
        F.lit(1).cast("bigint").alias("applied"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).cast("bigint").alias("selected"),
    )
    return R.contest_ratios(rows)


CENSUS_SQL = """files AS (SELECT year(l_shipdate)::INTEGER AS year, lpad((l_suppkey % 32 + 1)::VARCHAR, 2, '0') AS ent, l_linenumber AS stratum, (l_partkey % 20)::VARCHAR AS c1, CASE WHEN l_partkey % 3 > 0 THEN (l_partkey % 20)::VARCHAR || '-' || (l_partkey % 7)::VARCHAR ELSE '' END AS c2,
         CASE WHEN l_partkey % 3 > 1 THEN CASE WHEN l_orderkey % 11 = 0 THEN (l_partkey % 20)::VARCHAR ELSE (l_partkey % 20)::VARCHAR || '-' || (l_partkey % 7)::VARCHAR || '-' || (l_partkey % 2)::VARCHAR END ELSE '' END AS c3,
         CASE WHEN l_orderkey % 6 = 0 THEN 'C' ELSE l_quantity::BIGINT::VARCHAR END AS ue, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE l_extendedprice END AS va, l_orderkey * 100000000 + l_partkey * 1000 + l_suppkey AS arrival FROM lineitem),
     lev AS (SELECT *, CASE WHEN c3 <> '' THEN 3 WHEN c2 <> '' THEN 2 ELSE 1 END AS level, CASE WHEN c3 <> '' THEN c3 WHEN c2 <> '' THEN c2 ELSE c1 END AS code FROM files),
     keep AS (SELECT * FROM lev WHERE 1 + length(code) - length(replace(code, '-', '')) >= level),
     fact AS (SELECT year, ent, level, code, stratum, CASE WHEN ue = 'C' THEN NULL ELSE ue::DOUBLE END AS ue, va, arrival FROM (SELECT *, row_number() OVER (PARTITION BY year, ent, level, code, stratum ORDER BY arrival, ue, va) AS rn FROM keep) WHERE rn = 1)"""


def census(t: Tables):
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    top = (part % 20).cast("string")
    mid = F.concat_ws("-", top, (part % 7).cast("string"))
    low = F.when(order % 11 == 0, top).otherwise(F.concat_ws("-", mid, (part % 2).cast("string")))
    files = t.lineitem.select(
        F.year("l_shipdate").alias("year"),
        zero_pad(F.col("l_suppkey") % 32 + 1, 2).alias("ent"),
        F.col("l_linenumber").alias("stratum"),
        top.alias("c1"),
        F.when(part % 3 > 0, mid).otherwise("").alias("c2"),
        F.when(part % 3 > 1, low).otherwise("").alias("c3"),
        F.when(order % 6 == 0, "C").otherwise(F.col("l_quantity").cast("bigint").cast("string")).alias("ue"),
        F.when(order % 10 == 0, "N/A").otherwise(F.col("l_extendedprice").cast("string")).alias("va"),
        (order * 100_000_000 + part * 1000 + F.col("l_suppkey")).alias("arrival"),
    )
    codes = files.select(F.explode(F.array("c1", "c2", "c3")).alias("code")).where("code <> ''").distinct()
    true_level = F.size(F.split("code", "-"))
    catalogue = codes.select("code", true_level.alias("true_level"))
    return R.census_fact(files, ["c1", "c2", "c3"], ["ue", "va"], catalogue, ["year", "ent", "level", "code", "stratum"])


@query("j18_census_fact", f"WITH {CENSUS_SQL} SELECT * FROM fact")
def _(t: Tables):
    return census(t)[0]


@query(
    "j18_census_scopes",
    f"WITH {CENSUS_SQL} SELECT CASE WHEN ent < '10' THEN 'first' ELSE 'rest' END AS scope, count(*) AS rows, (count(ue) + count(va))::BIGINT AS cells FROM fact GROUP BY 1",
)
def _(t: Tables):
    fact, _repeats = census(t)
    return R.scope_counts(fact, F.when(F.col("ent") < "10", "first").otherwise("rest"), ["ue", "va"])


OBSERVED_SQL = """obs AS (SELECT l_partkey AS series, l_suppkey % 32 AS area, strftime(l_shipdate, '%Y/%m') AS period, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS value FROM lineitem)"""


def observed(t: Tables):
    return t.lineitem.select(
        F.col("l_partkey").alias("series"),
        (F.col("l_suppkey") % 32).alias("area"),
        F.date_format("l_shipdate", "yyyy/MM").alias("period"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("value"),
    )


@query(
    "j19_series_catalogue",
    f"""WITH {OBSERVED_SQL}, d AS (SELECT series, min(period) AS f, max(period) AS l, count(DISTINCT area) AS areas, count(*) AS observations FROM obs WHERE value IS NOT NULL GROUP BY 1)
        SELECT series, p_name AS name, CASE WHEN p_size % 5 = 0 THEN '1990/01' ELSE f END AS first, l AS last, areas, observations FROM d LEFT JOIN part ON p_partkey = series""",
)
def _(t: Tables):
    metadata = t.part.select(
        F.col("p_partkey").alias("series"),
        F.col("p_name").alias("name"),
        F.when(F.col("p_size") % 5 == 0, "1990/01").alias("first"),
        F.lit(None).cast("string").alias("last"),
    )
    return R.series_catalogue(observed(t), metadata)


@query("j19_period_catalogue", f"WITH {OBSERVED_SQL} SELECT period, count(*) AS n FROM obs WHERE value IS NOT NULL GROUP BY 1")
def _(t: Tables):
    return R.period_catalogue(observed(t))
