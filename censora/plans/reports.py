"""Reports over registers, payrolls, households, funds, directories and economic censuses."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.functions.scalars import bucketize, cents, clean_number_text, completed_years, deepest_code
from censora.operators import aggregates as A
from censora.operators.joins import all_members, with_band
from censora.operators.ordering import join_null_safe, medians, percentiles
from censora.operators.reshape import keep_first

# Months of the quarter a household survey covers; seniority and age classes of the payroll dashboard.
MONTHS_PER_QUARTER = 3
SENIORITY_EDGES = (3, 6, 11, 21, 31)
SENIORITY_LABELS = ("0-2 años", "3-5 años", "6-10 años", "11-20 años", "21-30 años", "30+ años")
AGE_EDGES = (26, 36, 46, 56)
AGE_LABELS = ("18-25", "26-35", "36-45", "46-55", "56+")


# ------------------------------------------------------------------ households


def household_summary(households: DataFrame, by: Sequence[str] = (), amounts: Sequence[str] = ("income", "spending")) -> DataFrame:
    """Sample, expanded households and weighted quarterly and monthly means, with the share of all households.

    ``households(…, w, income, spending)`` holds money in whole cents.
    """
    means = {}
    for name in amounts:
        quarterly = A.weighted_mean(name, "w") / 100
        means[f"mean_{name}"] = quarterly
        means[f"mean_{name}_monthly"] = quarterly / MONTHS_PER_QUARTER
    rows = households.groupBy(*by).agg(A.rows().alias("n"), F.sum("w").alias("expanded"), *[c.alias(k) for k, c in means.items()])
    return A.share_of_total(rows, "expanded", "share") if by else rows


def category_structure(households: DataFrame, categories: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Weighted monthly mean of every spending category and its percentage of the group's total, one row per category."""
    wide = households.groupBy(*by).agg(*[F.sum(F.col(c) * F.col("w")).alias(c) for c in categories], F.sum("w").alias("w"))
    total = sum((F.col(c) for c in categories[1:]), F.col(categories[0]))
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"),
                (F.col(c) / F.col("w") / 100 / MONTHS_PER_QUARTER).alias("mean_monthly"),
                F.try_divide(100 * F.col(c), total).alias("pct"),
            )
            for c in categories
        ]
    )
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")


def place_versus_nation(households: DataFrame, place: Column, categories: Sequence[str]) -> DataFrame:
    """Each category's monthly mean in one place and in the nation: difference, percentage and ratio."""
    wide = households.agg(
        *[(A.weighted_mean(c, "w") / 100 / MONTHS_PER_QUARTER).alias(f"n_{c}") for c in categories],
        *[(A.weighted_mean(c, "w", place) / 100 / MONTHS_PER_QUARTER).alias(f"p_{c}") for c in categories],
    )
    rows = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"p_{c}").alias("place"), F.col(f"n_{c}").alias("nation")) for c in categories])
    long = wide.select(F.explode(rows).alias("r")).select("r.*")
    return long.withColumn("delta", F.col("place") - F.col("nation")).withColumn(
        "delta_pct", F.when(F.col("nation") > 0, (F.col("place") - F.col("nation")) / F.col("nation") * 100)
    )


def activity_share(households: DataFrame, activity: DataFrame, keys: Sequence[str], place: Column) -> DataFrame:
    """Households with at least one activity record, expanded, in the nation and in a place, as percentages and ratio."""
    active = activity.select(*keys).distinct().withColumn("active", F.lit(True))
    rows = households.join(active, list(keys), "left").withColumn("active", F.coalesce("active", F.lit(False)))
    totals = rows.agg(
        A.weighted_total("w", F.col("active")).alias("nation"),
        F.sum("w").alias("nation_all"),
        A.weighted_total("w", F.col("active") & place).alias("place"),
        A.weighted_total("w", place).alias("place_all"),
    )
    pct = lambda a, b: F.try_divide(100 * F.col(a), F.col(b))
    out = totals.withColumn("pct_nation", pct("nation", "nation_all")).withColumn("pct_place", pct("place", "place_all"))
    return out.withColumn("ratio", F.try_divide(F.col("pct_place"), F.col("pct_nation")))


def pay_in_household_deciles(payroll: DataFrame, pay: str, bands: DataFrame, second_income: Column) -> DataFrame:
    """Deciles of household income where pay percentiles fall: alone (A) and together with a second median income (B)."""
    points = {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9}
    wide = percentiles(payroll, [], pay, points).withColumn("extra", second_income)
    rows = F.array(
        *[
            F.struct(F.lit(s).alias("scenario"), F.lit(p).alias("percentile"), (F.col(p) + extra).alias("income"))
            for s, extra in (("A", F.lit(0.0)), ("B", F.col("extra")))
            for p in points
        ]
    )
    long = wide.select(F.explode(rows).alias("r")).select("r.*")
    return with_band(long, F.col("income"), bands, "decile")


# ------------------------------------------------------------------ payroll dashboard


def payroll_dashboard(payroll: DataFrame, as_of: Column) -> dict[str, DataFrame]:
    """The five tables of the payroll dashboard from ``payroll(sector, position, sex, age, hired, gross, net)``."""
    paid = payroll.where("gross is not null")
    men, women = F.col("sex") == "M", F.col("sex") == "F"
    overview = paid.agg(
        A.rows().alias("total"),
        F.count_distinct("sector").alias("sectors"),
        A.money_mean("gross").alias("avg_gross"),
        F.min("gross").alias("min_gross"),
        F.max("gross").alias("max_gross"),
        A.count_where(men).alias("men"),
        A.count_where(women).alias("women"),
        A.money_mean("gross", men).alias("avg_men"),
        A.money_mean("gross", women).alias("avg_women"),
        A.money_mean("net").alias("avg_net"),
        (F.sum(F.round(F.col("gross") * 100).cast("bigint") - F.round(F.col("net") * 100).cast("bigint")) / (F.count("net") * 100)).alias("avg_deduction"),
        (F.sum(completed_years("hired", as_of)) / F.count("hired")).alias("avg_seniority"),
    ).withColumn("deduction_pct", F.when(F.col("avg_gross") > 0, 100 * F.coalesce("avg_deduction", F.lit(0.0)) / F.col("avg_gross")).otherwise(0.0))
    spread = percentiles(paid, [], "gross", {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9}).drop("n")
    # Two one-row frames side by side: read the second as a scalar struct.
    row = spread.select(F.struct("*").alias("s")).scalar()
    overview = overview.withColumn("s", row).select("*", "s.*").drop("s")
    sectors = paid.groupBy("sector").agg(
        A.rows().alias("n"),
        A.money_mean("gross").alias("avg_gross"),
        A.money_mean("gross", men).alias("avg_men"),
        A.money_mean("gross", women).alias("avg_women"),
    )
    positions = paid.groupBy("position").agg(A.rows().alias("n"), A.money_mean("gross").alias("avg_gross"))
    top = positions.orderBy(F.desc("avg_gross"), F.desc("n"), "position").limit(10)
    by_age = (
        paid.where("age >= 18").groupBy(bucketize("age", AGE_EDGES, AGE_LABELS).alias("age_class")).agg(A.money_mean("gross").alias("avg_gross"))
    )
    years = completed_years("hired", as_of)
    seniority = (
        payroll.where("hired is not null")
        .groupBy(bucketize(years, SENIORITY_EDGES, SENIORITY_LABELS).alias("seniority"))
        .agg(A.rows().alias("n"), F.count("gross").alias("with_pay"), A.money_mean("gross").alias("avg_gross"))
    )
    return {"overview": overview, "sectors": sectors, "top_positions": top, "pay_by_age": by_age, "seniority": seniority}


# ------------------------------------------------------------------ directory, institutions, contests, layers


def directory_series(editions: DataFrame, summary: DataFrame, predicate: Column) -> DataFrame:
    """Units per edition under a filter; an edition without any shows 0."""
    joined = all_members(editions, summary.withColumn("_hit", F.lit(True)), ["edition"], predicate)
    return joined.groupBy("edition").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("units"))


def institutions(programmes: DataFrame) -> DataFrame:
    """Reference table from the facts: first and last cycle, number of cycles, and name and figures of the last cycle.

    ``programmes(institution, cycle, name, state, campus, enrolled)``.
    """
    cycles = programmes.groupBy("institution", "cycle").agg(
        F.max("name").alias("name"),
        F.count_distinct("state").alias("states"),
        F.count_distinct("campus").alias("campuses"),
        A.rows().alias("programmes"),
        F.sum("enrolled").alias("enrolled"),
    )
    figures = F.struct("name", "states", "campuses", "programmes", "enrolled")
    out = cycles.groupBy("institution").agg(
        F.min("cycle").alias("first_cycle"),
        F.max("cycle").alias("last_cycle"),
        A.rows().alias("cycles"),
        F.max_by(figures, "cycle").alias("last"),
    )
    return out.select("institution", "first_cycle", "last_cycle", "cycles", "last.*")


def contest_distribution(scores: DataFrame) -> DataFrame:
    """People per score of each programme with the programme's ``people``; a programme has as many rows as scores exist."""
    counts = scores.groupBy("programme", "score").agg(A.rows().alias("n"))
    return counts.withColumn("people", F.sum("n").over(W.partitionBy("programme")))


def contest_ratios(applications: DataFrame) -> DataFrame:
    """Offer, applicants and selected of each programme with their ratios; ``applications(programme, places, applied, selected)``."""
    totals = applications.groupBy("programme").agg(*[F.sum(c).alias(c) for c in ("places", "applied", "selected")])
    return totals.withColumn("acceptance_pct", F.try_divide(100 * F.col("selected"), F.col("applied"))).withColumn(
        "applicants_per_place", F.try_divide(F.col("applied"), F.col("places"))
    )


def layer_inventory(objects: DataFrame, declared: DataFrame) -> DataFrame:
    """Objects per layer and state next to the layer's declared national total: ``matches`` when they add up to it."""
    counts = objects.groupBy("layer", "state").agg(A.rows().alias("objects"))
    totals = counts.groupBy("layer").agg(F.sum("objects").alias("layer_objects"))
    checked = totals.join(declared, "layer", "full_outer").withColumn(
        "matches", F.coalesce(F.col("layer_objects") == F.col("declared"), F.lit(False))
    )
    return counts.join(checked, "layer", "right")


# ------------------------------------------------------------------ retirement funds


def fund_snapshot(funds: DataFrame, resources: DataFrame, kinds: Sequence[str], total_kind: str, month: str) -> DataFrame:
    """Every fund at one month: its amount per kind of resource and its share of the system; silent funds show NULLs."""
    pivot = (
        resources.where(F.col("month") == month)
        .groupBy("fund")
        .agg(*[F.max(F.when(F.col("kind") == k, F.col("cents"))).alias(k) for k in kinds])
    )
    rows = funds.join(pivot, "fund", "left")
    return A.share_of_total(rows, total_kind, "pct_system")


def resource_composition(resources: DataFrame, components: Sequence[str], total_kind: str) -> DataFrame:
    """Accounting identity per month: the components against the reported total."""
    months = resources.groupBy("month").agg(
        F.sum(F.when(F.col("kind") == total_kind, F.col("cents"))).alias("total"),
        F.coalesce(F.sum(F.when(F.col("kind").isin(*components), F.col("cents"))), F.lit(0)).alias("parts"),
    )
    return months.withColumns(A.closing(F.col("parts") / 100, F.col("total") / 100))


def net_flows(flows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Inflow, outflow and net per period; net is NULL when either side is."""
    sums = flows.groupBy(*by).agg(F.sum("inflow").alias("inflow"), F.sum("outflow").alias("outflow"))
    return sums.withColumn("net", F.col("inflow") - F.col("outflow"))


def transfer_identity(transfers: DataFrame) -> DataFrame:
    """Accounts ceded and received per month over all funds: every transfer is counted once on each side."""
    sums = transfers.groupBy("month").agg(
        F.coalesce(F.sum("ceded"), F.lit(0)).alias("ceded"),
        F.coalesce(F.sum("received"), F.lit(0)).alias("received"),
        A.count_where(F.col("ceded").isNotNull() | F.col("received").isNotNull()).alias("reporting"),
    )
    return sums.withColumn("delta", F.col("received") - F.col("ceded")).withColumn("closes", F.col("delta") == 0)


def price_series(prices: DataFrame) -> DataFrame:
    """Coverage of each (fund, sub-fund): first and last date, points, lowest and highest price, last price."""
    return prices.groupBy("fund", "sub").agg(
        F.min("date").alias("first"),
        F.max("date").alias("last"),
        A.rows().alias("points"),
        F.min("price").alias("low"),
        F.max("price").alias("high"),
        F.max_by("price", "date").alias("last_price"),
    )


def rate_snapshot(funds: DataFrame, rates: DataFrame, when: str, decimals: int = 4) -> DataFrame:
    """Every fund's ``rate`` at one month, silent ones with NULL, next to the figures of all that report: how many, their
    simple mean, lowest and highest. ``rates(fund, month, rate)``."""
    now = rates.where(F.col("month") == when).select("fund", F.round("rate", decimals).alias("rate"))
    figures = now.agg(
        F.struct(
            F.count("rate").alias("reporting"),
            F.round(A.exact_mean(F.col("rate")), decimals).alias("mean_rate"),
            F.min("rate").alias("low"),
            F.max("rate").alias("high"),
        ).alias("f")
    ).scalar()
    return funds.join(now, "fund", "left").withColumn("f", figures).select(*funds.columns, "rate", "f.*")


def matrix_snapshot(values: DataFrame, keys: Sequence[str], value: str, when: Column) -> DataFrame:
    """All reported cells (fund × sub-fund, with a term or a measure) of one date, with the cells, the empty ones, the total
    and the range of each group of ``keys``; NULL means reported without a figure."""
    cells = values.where(when)
    amount = F.col(value).cast("decimal(18,6)")
    figures = cells.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(F.col(value).isNull()).alias("empty"),
        F.coalesce(F.sum(amount).cast("double"), F.lit(0.0)).alias("total"),
        F.min(value).alias("low"),
        F.max(value).alias("high"),
    )
    return join_null_safe(cells, figures, keys)


def system_returns(returns: DataFrame) -> DataFrame:
    """Return of the whole system per sub-fund, term and month: weighted by the assets of the funds that report one.

    ``returns(fund, sub, term, month, pct, assets)``; ``assets`` in whole cents."""
    weighted = F.sum(F.when(F.col("pct").isNotNull(), F.col("pct").cast("decimal(12,6)") * F.col("assets").cast("decimal(20,0)")))
    weight = F.sum(F.when(F.col("pct").isNotNull(), F.col("assets")))
    return returns.groupBy("sub", "term", "month").agg(
        F.count("pct").alias("funds"), (F.try_divide(weighted.cast("double"), weight.cast("double"))).alias("pct")
    )


def account_totals(accounts: DataFrame) -> DataFrame:
    """Accounts of each measure and month over all funds, with the funds that report it; ``accounts(fund, month, measure, n)``."""
    return accounts.groupBy("measure", "month").agg(F.sum("n").alias("accounts"), F.count_distinct(F.when(F.col("n").isNotNull(), F.col("fund"))).alias("funds"))


def contributor_coverage(years: DataFrame) -> DataFrame:
    """Contributors as percent of the active population per year, the gap to all of it, and the years of least and most cover.

    ``years(year, contributors, active)``; a year is one row."""
    rows = years.withColumn("pct", F.round(100 * F.col("contributors") / F.col("active"), 2)).withColumn("gap_pct", F.round(100 - F.col("pct"), 2))
    ends = rows.agg(
        F.struct(F.min_by("year", F.struct("pct", "year")).alias("least_year"), F.max_by("year", F.struct("pct", -F.col("year"))).alias("most_year")).alias("e")
    ).scalar()
    return rows.withColumn("e", ends).select(*rows.columns, "e.*")


def price_comparison(prices: DataFrame, sub: str, since: Column, until: Column) -> DataFrame:
    """The prices of one sub-fund in all funds that have it, day by day in a window, each with the change in percent since the
    fund's first price in the window."""
    window = prices.where((F.col("sub") == sub) & F.col("date").between(since, until))
    first = window.groupBy("fund").agg(F.min_by("price", "date").alias("first_price"), F.count(F.lit(1)).alias("points"))
    return window.join(first, "fund").withColumn("change_pct", F.try_divide(100 * (F.col("price") - F.col("first_price")), F.col("first_price")))


# ------------------------------------------------------------------ economic census, series catalogue


def census_fact(
    files: DataFrame, levels: Sequence[str], variables: Sequence[str], activity_levels: DataFrame, key: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(fact, repeats) of an economic census from its text files.

    The deepest filled code of ``levels`` gives the level; a row whose code belongs to a higher level repeats a row that is
    already there and is dropped; marks become NULL; the first row of each key stays, in ``arrival`` order.
    ``activity_levels(code, true_level)`` is the catalogue of activities.
    """
    level, code = deepest_code(*levels)
    rows = files.withColumn("level", level).withColumn("code", code)
    rows = rows.join(activity_levels, "code", "left")
    rows = rows.where(F.coalesce(F.col("true_level") >= F.col("level"), F.lit(True))).drop("true_level")
    typed = rows.withColumns({v: clean_number_text(v) for v in variables})
    return keep_first(typed.select(*key, *variables, "arrival"), list(key), ["arrival"])


def scope_counts(fact: DataFrame, scope: Column, variables: Sequence[str]) -> DataFrame:
    """Rows per scope and cells with a figure."""
    filled = sum((F.col(v).isNotNull().cast("int") for v in variables[1:]), F.col(variables[0]).isNotNull().cast("int"))
    return fact.groupBy(scope.alias("scope")).agg(A.rows().alias("rows"), F.sum(filled).alias("cells"))


def series_catalogue(observations: DataFrame, metadata: DataFrame) -> DataFrame:
    """Catalogue derived from the observations: first and last period, areas and observations, joined to the metadata.

    Published periods of the metadata win over derived ones. ``observations(series, area, period, value)``,
    ``metadata(series, name, first, last)``.
    """
    derived = observations.where("value is not null").groupBy("series").agg(
        F.min("period").alias("seen_first"),
        F.max("period").alias("seen_last"),
        F.count_distinct("area").alias("areas"),
        A.rows().alias("observations"),
    )
    joined = derived.join(metadata, "series", "left")
    return joined.select(
        "series", "name",
        F.coalesce("first", "seen_first").alias("first"),
        F.coalesce("last", "seen_last").alias("last"),
        "areas", "observations",
    )


def period_catalogue(observations: DataFrame) -> DataFrame:
    return observations.where("value is not null").groupBy("period").agg(A.rows().alias("n"))


def median_of(df: DataFrame, value: str) -> Column:
    """Global median as a scalar."""
    return medians(df, [], value).select("median").scalar()


def money_by(df: DataFrame, by: Sequence[Column | str], amounts: Mapping[str, str]) -> DataFrame:
    """Sums of money columns in whole cents."""
    return df.groupBy(*by).agg(*[F.sum(cents(c)).alias(k) for k, c in amounts.items()])
