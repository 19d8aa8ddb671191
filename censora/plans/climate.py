"""Weather feeds: step checks, quality marks, witness comparison, climatology, completeness, forecast errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.functions.scalars import percentile_rank_from_grid, relative_humidity, round_half_even
from censora.operators.aggregates import exact_mean
from censora.operators.calendar import worst_and_current_run
from censora.operators.ordering import medians, with_previous

# Fixed values of the verification rules.
MAX_HUMIDITY_GAP = 8
DEW_ALLOWANCE_C = 0.5
STEP_TEMPERATURE = (8, 2)  # °C, plus °C per hour
STEP_PRESSURE = 6  # hPa per hour
STEP_HOURS = 3
LAPSE_C_PER_M = 0.0065
WITNESS_MIN = 48
WITNESS_TOLERANCE_C, WITNESS_TOLERANCE_INITIAL_C = 4, 6
WITNESS_DAYS = 30
PHYSICAL_RANGES = {
    "humidity_pct": (1, 100, "humedad-fuera-de-rango"),
    "pressure_hpa": (870, 1085, "presion-fuera-de-rango"),
    "wind_ms": (0, 75, "viento-fuera-de-rango"),
    "wind_dir": (0, 360, "direccion-fuera-de-rango"),
}
# Fixed values of the climatology: half window in days, years needed for a normal and for a reference, days of a full year.
HALF_WINDOW_DAYS = 7
MIN_YEARS, MIN_YEARS_REFERENCE = 24, 10
MIN_DAYS_PER_YEAR = 292
MIN_FRACTION = 0.8
PERIODS = ((1991, 2020), (1981, 2010))
# A day with this much rain is wet; a reading this late came with the second batch (minutes).
WET_MM, SECOND_BATCH_MIN = 0.1, 20
LEAD_EDGES_H, LEAD_BINS = (24, 48, 72), ("0-24", "24-48", "48-72", "72-120")


def _marks(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(code)) for test, code in pairs]))


def step_checks(readings: DataFrame) -> DataFrame:
    """Previous reading of the station joined on (``prev_*``), with ``step_marks``: jumps and repeated readings.

    Stations are cut by day for the look-up, so a long series is not one task's work.
    """
    fields = ["instant", "temp_c", "dew_c", "humidity_pct", "pressure_hpa"]
    rows = with_previous(readings, ["station"], ["instant"], F.date_trunc("day", "instant"), fields)
    hours = (F.unix_seconds(F.col("instant").cast("timestamp")) - F.unix_seconds(F.col("prev_instant").cast("timestamp"))) / 3600
    near = (hours > 0) & (hours <= STEP_HOURS)
    base, per_hour = STEP_TEMPERATURE
    return rows.withColumn(
        "step_marks",
        _marks(
            (
                (hours == 1)
                & (F.col("temp_c") == F.col("prev_temp_c"))
                & (F.col("dew_c") == F.col("prev_dew_c"))
                & (F.col("humidity_pct") == F.col("prev_humidity_pct")),
                "igual-a-la-hora-anterior",
            ),
            (near & (F.abs(F.col("temp_c") - F.col("prev_temp_c")) > base + per_hour * hours), "salto-temperatura"),
            (near & (F.abs(F.col("pressure_hpa") - F.col("prev_pressure_hpa")) > STEP_PRESSURE * hours), "salto-presion"),
        ),
    )


def observation_marks(readings: DataFrame, records: DataFrame) -> DataFrame:
    """Every reading with its ``marks``; nothing is dropped. ``records(station, month, record_low, record_high)``."""
    local_month = F.month(F.from_utc_timestamp(F.col("instant").cast("timestamp"), "-06:00"))
    rows = step_checks(readings).withColumn("month", local_month).join(records, ["station", "month"], "left")
    temp, dew, humidity = F.col("temp_c"), F.col("dew_c"), F.col("humidity_pct")
    dew_above = dew > temp + DEW_ALLOWANCE_C
    physical = _marks(
        (temp.isNull(), "sin-temperatura"),
        (~temp.between(F.col("record_low"), F.col("record_high")), "fuera-de-record"),
        (dew_above, "rocio-mayor"),
        (~dew_above & (F.abs(relative_humidity(temp, dew) - humidity) > MAX_HUMIDITY_GAP), "humedad-incongruente"),
        *[(~F.col(c).between(low, high), code) for c, (low, high, code) in PHYSICAL_RANGES.items()],
    )
    return rows.withColumn("marks", F.concat(physical, "step_marks")).drop("step_marks", "record_low", "record_high")


def witness_difference(temp: Column, witness_temp: Column, height_diff_m: Column) -> Column:
    """Station minus airport brought to the station's height, in whole hundredths of a degree."""
    raw = (temp - (witness_temp + LAPSE_C_PER_M * height_diff_m)) * 100
    return (F.floor(raw + 0.5) / 100).cast("double")


def witness_history(pairs: DataFrame, days: int = WITNESS_DAYS) -> DataFrame:
    """Typical difference and tolerance from the station's own trailing days (this reading excluded).

    ``pairs(station, instant, diff)`` is hourly, so a window holds at most 24 values per day. A station is cut into spans as
    long as the window; each gets the span before it as well, so that a task holds two windows of one station at most.
    """
    length = days * 86_400_000_000
    micros = F.unix_micros(F.col("instant").cast("timestamp"))
    rows = pairs.withColumn("_us", micros).withColumn("_own", F.floor(micros / length))
    spans = rows.withColumn("_span", F.explode(F.array("_own", F.col("_own") + 1)))
    window = W.partitionBy("station", "_span").orderBy("_us").rangeBetween(-length, -1)
    held = spans.withColumn("history", F.sort_array(F.collect_list("diff").over(window))).where("_span = _own")
    enough = F.size("history") >= WITNESS_MIN
    typical = F.when(enough, F.get("history", F.floor(F.size("history") / 2).cast("int"))).otherwise(0.0)
    return (
        held.withColumn("compared", F.size("history").cast("bigint"))
        .withColumn("typical", typical)
        .withColumn("tolerance", F.when(enough, WITNESS_TOLERANCE_C).otherwise(WITNESS_TOLERANCE_INITIAL_C))
        .drop("_us", "_own", "_span", "history")
    )


def witness_check(pairs: DataFrame) -> DataFrame:
    """Adds ``differs``: the reading departs from what is typical of its pair by more than the tolerance."""
    return witness_history(pairs).withColumn("differs", F.abs(F.col("diff") - F.col("typical")) > F.col("tolerance"))


def distribution_level(daily: DataFrame, min_years: int, min_reference: int, min_days: int, periods) -> DataFrame:
    """Which period describes each station: the first with enough years, else the first as a mere reference."""
    years = (
        daily.where("tmax is not null")
        .groupBy("station", F.year("day").alias("year"))
        .agg(F.count(F.lit(1)).alias("days"))
        .where(F.col("days") >= min_days)
    )
    counts = years.groupBy("station").agg(
        *[F.count(F.when(F.col("year").between(a, b), 1)).alias(f"years_{i}") for i, (a, b) in enumerate(periods)]
    )
    stations = daily.select("station").distinct().join(counts, "station", "left").na.fill(0)
    level = F.when(F.col("years_0") >= min_reference, "reference").otherwise("insufficient")
    chosen = F.lit(0)
    for i in reversed(range(len(periods))):
        level = F.when(F.col(f"years_{i}") >= min_years, "normal").otherwise(level)
        chosen = F.when(F.col(f"years_{i}") >= min_years, i).otherwise(chosen)
    ends = F.array(*[F.struct(F.lit(a).alias("since"), F.lit(b).alias("until")) for a, b in periods])
    needed = F.when(level == "normal", min_years).when(level == "reference", min_reference)
    return stations.select("station", level.alias("level"), F.get(ends, chosen).alias("period"), needed.alias("needed"))


def climatology(
    daily: DataFrame,
    half_window: int = HALF_WINDOW_DAYS,
    min_years: int = MIN_YEARS,
    min_reference: int = MIN_YEARS_REFERENCE,
    min_days: int = MIN_DAYS_PER_YEAR,
    periods=PERIODS,
    variables: Sequence[str] = ("tmax", "tmin"),
) -> DataFrame:
    """Distribution of each calendar day from the ±k days around it over the years of the station's period.

    ``daily(station, day, tmax, tmin)`` holds one row per day, shuffled once: the years of a calendar day are folded to one
    array, and the window looks ±k places along the 366 arrays of a station. A distribution has at most (2k+1) × years values.
    In common years the window of 29 February is that of the 28th. Means are rounded once, after averaging.
    """
    level = distribution_level(daily, min_years, min_reference, min_days, periods)
    since, until = F.make_date("period.since", F.lit(1), F.lit(1)), F.make_date("period.until", F.lit(12), F.lit(31))
    near = F.col("day").between(F.date_sub(since, half_window), F.date_add(until, half_window))
    kept = daily.join(level, "station").where(near)
    # One row per station and place in a leap year of 366 days, with the readings of all years; the ends are repeated beyond
    # the turn of the year, and one place more is looked at, for the 29 February that a common year lacks.
    place = F.dayofyear(F.make_date(F.lit(2000), F.month("day"), F.dayofmonth("day")))
    reading = F.struct("day", *variables)
    folded = kept.groupBy("station", "level", "needed", "period", place.alias("place")).agg(F.collect_list(reading).alias("readings"))
    grid = level.withColumn("place", F.explode(F.sequence(F.lit(1), F.lit(366))))
    reach = half_window + 1
    turns = F.array(*[F.col("place") + 366 * k for k in (-1, 0, 1)])
    seats = F.explode(F.filter(turns, lambda p: p.between(1 - reach, 366 + reach)))
    along = W.partitionBy("station").orderBy("seat").rangeBetween(-reach, reach)
    laid = grid.join(folded.select("station", "place", "readings"), ["station", "place"], "left").withColumn("seat", seats)
    looked = laid.withColumn("around", F.flatten(F.collect_list("readings").over(along))).where(F.col("seat").between(1, 366))
    label = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("place") - 1), "MM-dd")

    def centre(year: Column) -> Column:
        """The day of this place in a year; in common years the 28th stands for 29 February."""
        leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
        short = (F.col("place") == 60) & ~leap
        return F.make_date(year, F.substring(label, 1, 2).cast("int"), F.when(short, 28).otherwise(F.substring(label, 4, 2).cast("int")))

    def years_of(r: Column) -> Column:
        """The year in whose window a reading lies; around the turn of the year not its own."""
        own = F.year(r["day"])
        tried = F.transform(F.array(own, own - 1, own + 1), lambda y: F.when(F.abs(F.datediff(r["day"], centre(y))) <= half_window, y))
        return F.get(F.filter(tried, lambda y: y.isNotNull()), F.lit(0))

    inside = F.filter(
        F.transform("around", lambda r: F.struct(years_of(r).alias("year"), *[r[v].alias(v) for v in variables])),
        lambda r: r["year"].between(F.col("period.since"), F.col("period.until")),
    )
    rows = looked.select("station", label.alias("date"), "level", "needed", inside.alias("inside"))

    def own(variable: str) -> Column:
        pairs = F.transform("inside", lambda r: F.struct(r["year"].alias("year"), r[variable].alias("value")))
        return F.struct(F.lit(variable).alias("variable"), F.filter(pairs, lambda r: r["value"].isNotNull()).alias("own"))

    one = F.array(*map(own, variables))
    stats = rows.select("station", "date", "level", "needed", F.explode(one).alias("o")).select("station", "date", "level", "needed", "o.variable", F.col("o.own").alias("own"))
    total = F.aggregate("own", F.lit(0).cast("decimal(28,6)"), lambda a, r: (a + r["value"].cast("decimal(18,6)")).cast("decimal(28,6)"))
    stats = stats.where(F.size("own") > 0).select(
        "station", "date", "variable", "level", "needed",
        F.size("own").cast("bigint").alias("n"),
        F.size(F.array_distinct(F.transform("own", lambda r: r["year"]))).cast("bigint").alias("years"),
        (total.cast("double") / F.size("own")).alias("mean"),
        F.array_sort(F.transform("own", lambda r: r["value"])).alias("sorted"),
    )
    enough = (F.col("years") >= F.col("needed")) & (F.col("n") >= MIN_FRACTION * (2 * half_window + 1) * F.col("needed"))

    def percentile(percent: Column) -> Column:
        position = (F.col("n") - 1) * percent / 100
        low, high = F.get("sorted", F.floor(position).cast("int")), F.get("sorted", F.ceil(position).cast("int"))
        return round_half_even(low + (high - low) * (position - F.floor(position)), 1)

    return stats.select(
        "station", "date", "variable", "level", "n", "years",
        F.when(enough, round_half_even("mean", 1)).alias("mean"),
        F.when(enough, F.transform(F.sequence(F.lit(0), F.lit(100), F.lit(5)), percentile)).alias("grid"),
    )


def day_extremes(readings: DataFrame) -> DataFrame:
    """Highest reading from 6:00 and lowest up to 10:00 of each local day, among readings without marks."""
    local = F.from_utc_timestamp(F.col("instant").cast("timestamp"), "-06:00")
    clean = readings.where("temp_c is not null and size(marks) = 0").withColumn("local", local)
    clean = clean.withColumn("day", F.to_date("local"))
    minute = F.hour("local") * 60 + F.minute("local")
    by_high = F.struct(F.col("temp_c"), -F.unix_seconds(F.col("local")))
    by_low = F.struct(F.col("temp_c"), F.unix_seconds(F.col("local")))
    return clean.groupBy("station", "day").agg(
        F.max(F.when(minute >= 360, F.col("temp_c"))).alias("high"),
        F.max_by("instant", F.when(minute >= 360, by_high)).alias("high_at"),
        F.min(F.when(minute <= 600, F.col("temp_c"))).alias("low"),
        F.min_by("instant", F.when(minute <= 600, by_low)).alias("low_at"),
    )


def versus_normal(extremes: DataFrame, normals: DataFrame) -> DataFrame:
    """Day extremes against the day's distribution: difference to the mean and percentile rank."""
    grids = normals.groupBy("station", "date").agg(
        *[F.max(F.when(F.col("variable") == v, F.col(c))).alias(f"{v}_{c}") for v in ("tmax", "tmin") for c in ("mean", "grid")]
    )
    joined = extremes.withColumn("date", F.date_format("day", "MM-dd")).join(grids, ["station", "date"], "left")
    tenth = lambda x: round_half_even(x, 1)
    return joined.select(
        "station", "day", "high", "low",
        tenth(F.col("high") - F.col("tmax_mean")).alias("high_vs_mean"),
        tenth(F.col("low") - F.col("tmin_mean")).alias("low_vs_mean"),
        F.round(percentile_rank_from_grid("tmax_grid", "high")).alias("high_rank"),
        F.round(percentile_rank_from_grid("tmin_grid", "low")).alias("low_rank"),
    )


def completeness(slots: DataFrame) -> DataFrame:
    """Completeness of each station over the watched hours.

    ``slots(station, hour, local_hour, watched, arrived, marked, delay_min)`` is the hour calendar of the window. An hour
    without batch and without reading is not watched and shows as "·" in the strip (L arrived, M marked, F missing). Blocks
    of six local hours show what was watched, missing and missing in percent; a reading that comes later than the first batch
    (``SECOND_BATCH_MIN``) came with the second.
    """
    letter = F.when(~F.col("watched"), "·").when(F.col("marked"), "M").when(F.col("arrived"), "L").otherwise("F")
    rows = slots.withColumn("letter", letter)
    missing = F.col("watched") & ~F.col("arrived")
    watched = rows.where("watched")
    blocks = {f"{h:02d}": F.col("local_hour").between(h, h + 5) for h in (0, 6, 12, 18)}
    told = F.col("arrived") & F.col("delay_min").isNotNull()
    counts = watched.groupBy("station").agg(
        F.count(F.lit(1)).alias("watched"),
        F.count_if("arrived").alias("arrived"),
        F.count_if("marked").alias("marked"),
        F.count_if(missing).alias("missing"),
        F.max(F.when(F.col("arrived"), F.col("hour"))).alias("last_reading"),
        *[F.count_if(inside).alias(f"watched_{b}") for b, inside in blocks.items()],
        *[F.count_if(missing & inside).alias(f"missing_{b}") for b, inside in blocks.items()],
        F.try_divide(100 * F.count_if(told & (F.col("delay_min") > SECOND_BATCH_MIN)), F.count_if(told)).alias("second_batch_pct"),
    )
    for b in blocks:
        counts = counts.withColumn(f"missing_{b}_pct", F.try_divide(100 * F.col(f"missing_{b}"), F.col(f"watched_{b}")))
    streaks = worst_and_current_run(watched.withColumn("gone", missing), ["station"], "hour", F.col("gone"))
    delays = medians(watched.where("delay_min is not null"), ["station"], "delay_min").select(
        "station", F.col("median").alias("median_delay_min")
    )
    # One letter per hour of the window: the array is as long as the calendar.
    strips = rows.groupBy("station").agg(
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("hour", "letter"))), lambda s: s["letter"])).alias("strip")
    )
    return (
        strips.join(counts, "station", "left")
        .join(streaks, "station", "left")
        .join(delays, "station", "left")
        .withColumn("arrived_pct", F.try_divide(100 * F.col("arrived"), F.col("watched")))
    )


def national_completeness(slots: DataFrame) -> DataFrame:
    """One row over all stations: readings watched and arrived, and the hours at which every watched station reported."""
    hours = slots.where("watched").groupBy("hour").agg(F.count(F.lit(1)).alias("watched"), F.count_if("arrived").alias("arrived"))
    sums = hours.agg(
        F.sum("watched").alias("watched"),
        F.sum("arrived").alias("arrived"),
        F.count(F.lit(1)).alias("hours"),
        F.count_if(F.col("watched") == F.col("arrived")).alias("complete_hours"),
    )
    return sums.withColumn("arrived_pct", F.try_divide(100 * F.col("arrived"), F.col("watched")))


def rain_share(daily: DataFrame, half_window: int, wet: float = WET_MM) -> DataFrame:
    """Share of wet days around each calendar day, over all years: ``daily(station, day, rain)``; of leap days only their own.

    Days are folded to counts per calendar day first; the window then looks ±k places along the 366 of them."""
    place = F.dayofyear(F.make_date(F.lit(2000), F.month("day"), F.dayofmonth("day")))
    folded = daily.where("rain is not null").groupBy("station", place.alias("place")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rain") >= wet).alias("k"))
    turns = F.filter(F.array(*[F.col("place") + 366 * k for k in (-1, 0, 1)]), lambda p: p.between(1 - half_window, 366 + half_window))
    along = W.partitionBy("station").orderBy("seat").rangeBetween(-half_window, half_window)
    seats = folded.withColumn("seat", F.explode(turns))
    summed = seats.withColumn("days", F.sum("n").over(along)).withColumn("wet_days", F.sum("k").over(along)).where(F.col("seat") == F.col("place"))
    label = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.col("place") - 1), "MM-dd")
    return summed.select("station", label.alias("date"), "days", "wet_days", F.round(F.col("wet_days") / F.col("days"), 3).alias("rain_share"))


def monthly_recheck(daily: DataFrame, official: DataFrame, variable: str, least_days: int = 20) -> DataFrame:
    """Monthly means from the daily record against the official normals: a month of a year counts with enough days, and the
    mean over the years is compared. ``official(station, month, normal)``."""
    months = daily.where(F.col(variable).isNotNull()).groupBy("station", F.year("day").alias("year"), F.month("day").alias("month"))
    means = months.agg(F.count(F.lit(1)).alias("days"), exact_mean(F.col(variable)).alias("mean")).where(F.col("days") >= least_days)
    over = means.groupBy("station", "month").agg(F.count(F.lit(1)).alias("years"), exact_mean(F.round("mean", 6)).alias("computed"))
    joined = official.join(over, ["station", "month"], "left")
    return joined.withColumn("difference", F.round(F.col("computed") - F.col("normal"), 2))


def versus_monthly_normal(extremes: DataFrame, official: DataFrame) -> DataFrame:
    """Day extremes against the official normals of their month: ``official(station, month, tmax, tmin)``."""
    joined = extremes.withColumn("month", F.month("day")).join(official, ["station", "month"], "left")
    tenth = lambda x: round_half_even(x, 1)
    return joined.select("station", "day", "high", "low", tenth(F.col("high") - F.col("tmax")).alias("high_vs_month"), tenth(F.col("low") - F.col("tmin")).alias("low_vs_month"))


def lead_bin(lead_hours: Column) -> Column:
    first, second, third = LEAD_EDGES_H
    a, b, c, d = LEAD_BINS
    return F.when(lead_hours < first, a).when(lead_hours < second, b).when(lead_hours < third, c).otherwise(d)


def frozen_forecast(consulted: DataFrame) -> DataFrame:
    """The last value consulted before each forecast hour: later answers never change it."""
    return (
        consulted.where("consulted < hour")
        .groupBy("station", "hour")
        .agg(F.max_by("temp_c", "consulted").alias("temp_c"), F.max("consulted").alias("consulted"))
    )


def batch_book(readings: DataFrame, stations: Column) -> DataFrame:
    """Per hour: stations received, missing and marked, first and last arrival; ``stations`` is the array of all of them."""
    book = readings.groupBy("hour").agg(
        F.count_distinct("station").alias("received"),
        F.array_sort(F.collect_set("station")).alias("present"),
        F.count_if("marked").alias("marked"),
        F.min("arrived").alias("first_arrival"),
        F.max("arrived").alias("last_arrival"),
    )
    return book.withColumn("missing", F.array_except(stations, "present")).drop("present")


def changed_source_time(refreshes: DataFrame, keys: Sequence[str], seen: str, source_time: str) -> DataFrame:
    """Refreshes that brought a new observation: the source's own time differs from the refresh before."""
    rows = with_previous(refreshes, keys, [seen], F.date_trunc("minute", seen), [source_time])
    return rows.withColumn("is_new", ~F.col(source_time).eqNullSafe(F.col(f"prev_{source_time}")))
