"""Estimates from survey and register microdata: every indicator is a weighted conditional sum of one grouped pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censora.functions.scalars import BMI_CLASSES, bmi, bmi_class, normalize_year
from censora.operators.aggregates import weighted_total
from censora.operators.filters import measured, plausible_body
from censora.operators.joins import flag_has_any

# Fixed values of the labour survey: working age, rates as (numerator, denominator).
WORKING_AGE = 15
RATES = {
    "tasa_participacion": ("pea_total", "pob_15ymas"),
    "tasa_desocupacion": ("desocupados_total", "pea_total"),
    "tasa_subocupacion": ("subocupados_total", "ocupados_total"),
    "tasa_informalidad_til1": ("informales_total", "ocupados_total"),
    "tasa_ocupacion_critica_tcco": ("condcrit_total", "ocupados_total"),
}
# Fixed values of the registers: age groups by age code, the offence that makes no victim.
AGE_CODES = {"<1": (1, 1), "1-14": (2, 7), "15-29": (8, 10), "30-59": (11, 16), "60+": (17, 29)}
VANDALISM = 3
# Age groups (low, high) of the surveys.
USER_AGES = ((6, 11), (12, 17), (18, 24), (25, 34), (35, 44), (45, 54), (55, 200))
WOMEN_AGES = ((15, 24), (25, 34), (35, 44), (45, 54), (55, 64), (65, 200))
FERTILE_AGES = ((15, 19), (20, 24), (25, 29), (30, 34), (35, 39), (40, 44), (45, 49))
ADULT_AGES = ((20, 29), (30, 39), (40, 49), (50, 59), (60, 69), (70, 79), (80, 200))
OLD_AGE = 60


def age_group(age: Column, groups: Sequence[tuple[int, int]], missing: str = "NE") -> Column:
    ladder = F.lit(missing)
    for low, high in reversed(groups):
        label = f"{low}+" if high >= 200 else f"{low}-{high}"
        ladder = F.when(age.between(low, high), label).otherwise(ladder)
    return ladder


def _or(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests])


def informal() -> Column:
    """Informality: unit in the informal sector, unpaid or own-account work in given branches, or work without benefits."""
    unit, position, branch = F.col("tue2"), F.col("pos_ocu"), F.col("rama")
    uncovered = F.col("seg_soc").isin(2, 3)
    formal_unit = ~unit.isin(5, 6, 7)
    return _or(
        unit == 5,
        (position == 3) & (branch == 6),
        position == 4,
        uncovered & (unit == 6),
        (position == 1) & F.col("remune2c").isin(1, 2) & formal_unit & uncovered,
        (position == 5) & uncovered,
    )


def labour_domains() -> dict[str, Column]:
    adult = F.col("eda") >= WORKING_AGE
    employed = adult & (F.col("clase2") == 1)
    return {
        "pob_15ymas": adult & F.col("clase1").isin(1, 2),
        "pea_total": adult & (F.col("clase1") == 1),
        "pnea_total": adult & (F.col("clase1") == 2),
        "ocupados_total": employed,
        "desocupados_total": adult & (F.col("clase2") == 2),
        "subocupados_total": employed & (F.col("sub_o") == 1),
        "condcrit_total": employed & F.col("tcco").isin(1, 2, 3),
        "informales_total": employed & informal(),
    }


def labour_indicators(persons: DataFrame) -> DataFrame:
    """Eight weighted counts and five rates by quarter and state; state '00' is the nation, added up from the states."""
    counts = labour_domains()
    states = persons.groupBy("periodo", "ent").agg(*[weighted_total("fac", F.coalesce(m, F.lit(False))).alias(k) for k, m in counts.items()])
    nation = states.groupBy("periodo").agg(F.lit("00").alias("ent"), *[F.sum(k).alias(k) for k in counts])
    rates = {
        k: F.when(F.col(den) != 0, 100.0 * F.col(num) / F.col(den)).otherwise(0.0) for k, (num, den) in RATES.items()
    }
    return nation.unionByName(states).withColumns(rates)


def composition(persons: DataFrame, code: str, codes: Sequence[int], names: tuple[str, str] = ("total", "pct")) -> DataFrame:
    """Employed people by ``code`` with their share of the group, for every code of the list (0 where there is nobody).

    The codes are columns of one wide aggregate, unfolded at the end: no cross join with the code list.
    """
    total, pct = names
    employed = persons.where((F.col("eda") >= WORKING_AGE) & (F.col("clase2") == 1))
    cells = [weighted_total("fac", F.col(code) == k).alias(f"c{k}") for k in codes]
    states = employed.groupBy("periodo", "ent").agg(F.sum("fac").alias("all"), *cells)
    nation = states.groupBy("periodo").agg(F.lit("00").alias("ent"), F.sum("all").alias("all"), *[F.sum(f"c{k}").alias(f"c{k}") for k in codes])
    rows = F.array(*[F.struct(F.lit(k).alias(code), F.col(f"c{k}").alias(total)) for k in codes])
    long = nation.unionByName(states).select("periodo", "ent", "all", F.explode(rows).alias("r"))
    share = F.when(F.col("all") != 0, 100.0 * F.col(f"r.{total}") / F.col("all")).otherwise(0.0)
    return long.select("periodo", "ent", f"r.{code}", f"r.{total}", share.alias(pct))


def register_grains(records: DataFrame, raw: Sequence[str], recodes: Mapping[str, Column], grains: Mapping[str, Sequence[str]]) -> DataFrame:
    """Several summaries of a register from one pass: raw tuples are counted first, recoded once, then grouped per grain.

    All grains come back in one frame with a ``grain`` column; columns a grain does not use are NULL.
    """
    tuples = records.groupBy(*raw).agg(F.count(F.lit(1)).alias("n"))
    coded = tuples.select(*[c.alias(k) for k, c in recodes.items()], "n")
    wide = sorted({c for columns in grains.values() for c in columns}, key=list(recodes).index)
    # One row per tuple and grain, then a single grouping.
    rows = F.array(
        *[
            F.struct(F.lit(g).alias("grain"), *[(F.col(c) if c in columns else F.lit(None).cast(coded.schema[c].dataType)).alias(c) for c in wide])
            for g, columns in grains.items()
        ]
    )
    spread = coded.select(F.explode(rows).alias("g"), "n").select("g.*", "n")
    return spread.groupBy("grain", *wide).agg(F.sum("n").alias("n"))


def sex_code(sex: Column) -> Column:
    return F.when(sex.isin(1, 2), sex).otherwise(9)


def age_code_group(code: Column) -> Column:
    ladder = F.lit("NE")
    for label, (low, high) in AGE_CODES.items():
        ladder = F.when(code.between(low, high), label).otherwise(ladder)
    return ladder


def birth_timeliness(birth_year: Column, registered: Column) -> Column:
    """Born in the year of registration, the year before, earlier, or not stated; two-digit years are completed first."""
    year = normalize_year(birth_year, registered)
    return (
        F.when(year.isNull(), "NE").when(year == registered, "mismo").when(year == registered - 1, "anterior").otherwise("antes")
    )


def mother_group(age: Column) -> Column:
    low = F.floor(age / 5) * 5
    band = F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string"))
    return F.when(age.isNull() | (age >= 99), "NE").when(age < 15, "<15").when(age >= 50, "50+").otherwise(band)


def birth_order(order: Column) -> Column:
    return F.when(order.isNull() | (order >= 99) | (order < 1), "NE").when(order >= 6, "6+").otherwise(order.cast("string"))


def perception(people: DataFrame, scopes: Mapping[str, str]) -> DataFrame:
    """Σw in all, insecure (2), secure (1) and undecided by year, state, sex and scope; ``scopes`` maps names to columns."""
    answers = F.array(*[F.struct(F.lit(s).alias("scope"), F.col(c).alias("answer")) for s, c in scopes.items()])
    long = people.select("year", "ent", "sex", "w", F.explode(answers).alias("a")).select("year", "ent", "sex", "w", "a.*")
    answer = F.coalesce("answer", F.lit(9))
    return long.groupBy("year", "ent", "sex", "scope").agg(
        F.sum("w").alias("total"),
        weighted_total("w", answer == 2).alias("insecure"),
        weighted_total("w", answer == 1).alias("secure"),
        weighted_total("w", ~answer.isin(1, 2)).alias("undecided"),
    )


def prevalence(people: DataFrame, offences: DataFrame, per: int = 100_000) -> DataFrame:
    """People and victims (at least one offence other than vandalism) by edition, state and sex, with the rate.

    ``people(id_per, edition, ent, sex, w)``, ``offences(id_per, code)``; the survey asks about the year before its edition.
    """
    counted = offences.where(F.col("code").isNotNull() & (F.col("code") != VANDALISM))
    flagged = flag_has_any(people, counted, ["id_per"], "victim")
    groups = flagged.groupBy("edition", "ent", "sex").agg(
        F.sum("w").alias("people"), weighted_total("w", F.col("victim") == 1).alias("victims")
    )
    return groups.withColumn("year", F.col("edition") - 1).withColumn("rate", F.try_divide(per * F.col("victims"), F.col("people")))


def user_crosstab(users: DataFrame) -> DataFrame:
    """Σw by edition, state, sex, age group, use of internet and of a computer (1 yes, 2 no)."""
    yes_no = lambda c: F.when(F.col(c) == 1, 1).otherwise(2)
    return users.groupBy(
        "edition",
        F.when(F.col("ent") > 0, F.col("ent")).otherwise(0).alias("ent"),
        sex_code(F.col("sex")).alias("sex"),
        age_group(F.col("age"), USER_AGES).alias("age_group"),
        yes_no("internet").alias("internet"),
        yes_no("computer").alias("computer"),
    ).agg(F.sum("w").alias("people"))


def flag_totals(women: DataFrame, ages: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Σw of every 0/1 flag by state and age group; the age comes from another table of the survey and may be missing."""
    joined = women.join(ages.select("id_per", "age"), "id_per", "left")
    return joined.groupBy("ent", age_group(F.col("age"), WOMEN_AGES).alias("age_group")).agg(
        F.sum("w").alias("women"), *[weighted_total("w", F.coalesce(F.col(f) == 1, F.lit(False))).alias(f) for f in flags]
    )


def fertile_women(women: DataFrame) -> DataFrame:
    """Σw of women aged 15–49 by state, age group, size of place (9 unknown) and whether ever pregnant (1 yes, 2 no)."""
    kept = women.where(F.col("age").between(15, 49))
    return kept.groupBy(
        "ent",
        age_group(F.col("age"), FERTILE_AGES).alias("age_group"),
        F.when(F.col("place_size").between(1, 4), F.col("place_size")).otherwise(9).alias("place_size"),
        F.when(F.col("pregnant") == 1, 1).otherwise(2).alias("pregnant"),
    ).agg(F.sum("w").alias("women"))


def mean_of_measured(first: str, second: str) -> Column:
    """Mean of the two readings that were taken; sentinels and NULLs do not count."""
    a, b = measured(first), measured(second)
    return F.coalesce((a + b) / 2, a, b)


def anthropometry(adults: DataFrame) -> DataFrame:
    """Body-mass classes of adults by state, sex and age group: sample, Σw and Σw per class.

    Two readings of weight and height are averaged; from the age of 60 on they come from columns of their own.
    ``adults(ent, sex, age, w, pregnant, kg_1, kg_2, cm_1, cm_2, old_kg_1, old_kg_2, old_cm_1, old_cm_2)``.
    """
    old = F.col("age") >= OLD_AGE
    kg = F.when(old, mean_of_measured("old_kg_1", "old_kg_2")).otherwise(mean_of_measured("kg_1", "kg_2"))
    cm = F.when(old, mean_of_measured("old_cm_1", "old_cm_2")).otherwise(mean_of_measured("cm_1", "cm_2"))
    body = adults.where("age >= 20").withColumn("kg", kg).withColumn("m", cm / 100).withColumn("bmi", bmi("kg", "m"))
    kept = body.where(plausible_body(F.col("m"), F.col("bmi"), (F.col("sex") == 2) & F.col("pregnant"), F.col("w")))
    kept = kept.withColumn("class", bmi_class("bmi"))
    return kept.groupBy("ent", "sex", age_group(F.col("age"), ADULT_AGES).alias("age_group")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("w").alias("people"),
        *[weighted_total("w", F.col("class") == c).alias(c) for c in BMI_CLASSES],
    )
