"""Air-quality index: base concentrations from moving averages, categories by cut points, worst pollutant per station."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censora.functions.scalars import round_half_up
from censora.operators.calendar import stuck_since, trailing

# Fixed values of the air-quality norm: upper limits (inclusive) of the first four categories, conversion factors of the
# weighted average, decimals of each concentration.
CUTS = {
    "PM2.5": (15, 25, 79, 130),
    "PM10": (45, 50, 132, 213),
    "O3": (0.058, 0.09, 0.135, 0.175),
    "NO2": (0.053, 0.106, 0.16, 0.213),
    "SO2": (0.035, 0.075, 0.185, 0.304),
    "CO": (5, 9, 12, 16),
}
FACTORS = {"PM2.5": 0.694, "PM10": 0.714}
CATEGORIES = ("Buena", "Aceptable", "Mala", "Muy mala", "Extremadamente mala")
WEIGHTED_HOURS = 12
CO_HOURS, CO_NEEDED = 8, 6
FRESH_HOURS = 3
# A sensor is stuck if its last six values, all within fifteen hours, are the same.
STUCK_VALUES, STUCK_WITHIN_HOURS = 6, 15


def weighted_concentration(slots: Column, factor: Column) -> Column:
    """Weighted moving average of up to 12 hourly ``slots`` (structs ``slot`` 0 = newest, ``value``), NULL unless two of the
    three newest are there. The weight is the spread ratio, at least 0.5, raised to the age of the hour."""
    values = F.transform(slots, lambda s: s["value"])
    high, low = F.array_max(values), F.array_min(values)
    ratio = F.when(high > 0, 1 - (high - low) / high).otherwise(1.0)
    weight = F.when(ratio > 0.5, round_half_up(ratio, 2)).otherwise(0.5)
    powers = F.transform(slots, lambda s: F.struct(F.pow(weight, s["slot"]).alias("p"), s["value"].alias("v")))
    top = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x["v"] * x["p"])
    bottom = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x["p"])
    recent = F.size(F.filter(slots, lambda s: s["slot"] <= 2))
    return F.when(recent >= 2, round_half_up(top / bottom * factor, 0))


def base_concentrations(hours: DataFrame, keys: Sequence[str] = ("station", "pollutant")) -> DataFrame:
    """Base concentration as of every measured hour.

    ``hours(station, pollutant, hour, value)`` holds one row per hour with a value; ``hour`` is a whole hour number.
    Hours keep their slot: a gap is a missing slot, not a shorter average.
    """
    keys = list(keys)
    history = F.collect_list(F.struct("hour", "value")).over(trailing(keys, "hour", WEIGHTED_HOURS - 1))
    marked = stuck_since(hours, keys, "hour", "value", STUCK_VALUES).withColumn("history", history)
    newest_first = F.array_sort(
        F.transform("history", lambda h: F.struct((F.col("hour") - h["hour"]).cast("int").alias("slot"), h["value"].alias("value")))
    )
    marked = marked.withColumn("slots", newest_first)
    whole = F.transform(
        "slots", lambda s: F.struct(s["slot"].alias("slot"), round_half_up(s["value"], 0).alias("value"))
    )
    marked = marked.withColumn("whole", whole).withColumn(
        "factor", F.when(F.col("pollutant") == "PM2.5", FACTORS["PM2.5"]).otherwise(FACTORS["PM10"])
    )
    eight = F.filter("slots", lambda s: s["slot"] < CO_HOURS)
    total = F.aggregate(eight, F.lit(0.0), lambda acc, s: acc + s["value"])
    concentration = (
        F.when(F.col("pollutant").isin(*FACTORS), weighted_concentration(F.col("whole"), F.col("factor")))
        .when(F.col("pollutant") == "CO", F.when(F.size(eight) >= CO_NEEDED, round_half_up(total / F.size(eight), 2)))
        .otherwise(round_half_up("value", 3))
    )
    return marked.withColumn("concentration", concentration).select(*keys, "hour", "value", "stuck_since", "concentration")


def category(pollutant: Column, concentration: Column) -> Column:
    """0-based category: limits are inclusive, above the last one comes 4."""
    ladder = F.lit(None).cast("int")
    for name, cuts in CUTS.items():
        step = F.when(concentration.isNull(), F.lit(None).cast("int"))
        for i, cut in enumerate(cuts):
            step = step.when(concentration <= cut, i)
        ladder = F.when(pollutant == name, step.otherwise(len(cuts))).otherwise(ladder)
    return ladder


def index_by_hour(hours: DataFrame, grid: DataFrame) -> DataFrame:
    """Index of each ``grid(station, hour)``: the worst category among pollutants whose newest value is at most three hours
    old and whose sensor is not stuck; the earlier pollutant of the norm's list wins a tie."""
    # A value counts for its own hour and the three that follow; of several the newest decides, usable or not.
    spread = base_concentrations(hours).withColumn("at", F.explode(F.sequence("hour", F.col("hour") + FRESH_HOURS)))
    newest = spread.groupBy("station", F.col("at").alias("hour"), "pollutant").agg(
        F.max_by(F.struct("stuck_since", "concentration"), "hour").alias("newest")
    )
    stuck = F.coalesce(F.col("hour") - F.col("newest.stuck_since") <= STUCK_WITHIN_HOURS, F.lit(False))
    usable = newest.where(~stuck & F.col("newest.concentration").isNotNull())
    graded = usable.withColumn("category", category(F.col("pollutant"), F.col("newest.concentration")))
    order = F.array_position(F.array(*[F.lit(name) for name in CUTS]), F.col("pollutant"))
    worst = graded.groupBy("station", "hour").agg(
        F.max("category").alias("category"),
        F.max_by("pollutant", F.struct("category", -order)).alias("pollutant"),
        F.count(F.lit(1)).alias("pollutants"),
    )
    label = F.get(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    return grid.join(worst, ["station", "hour"], "left").withColumn("quality", label)
