"""Event feeds and live delivery: first-seen latency, deliveries per minute, forecast accuracy by lead time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from censora.operators.aggregates import error_stats
from censora.operators.ordering import order_statistics
from censora.plans.climate import lead_bin


def first_seen(items: DataFrame, keys: Sequence[str], seen: str) -> DataFrame:
    """The first reading of each item: repeats of an item collapse map-side."""
    rest = [c for c in items.columns if c not in keys]
    best = items.groupBy(*keys).agg(F.min_by(F.struct(*rest), seen).alias("row"))
    return best.select(*keys, "row.*")


def event_latency(items: DataFrame, keys: Sequence[str], origin: str, seen: str, by: Sequence[str] = ()) -> DataFrame:
    """Seconds from an event's origin to its first reading: n, median, 90th percentile (floor rank) and maximum.

    Events older than the very first reading are left out: they were already there when the reading began.
    """
    began = items.agg(F.min(seen).alias("began")).scalar()
    fresh = first_seen(items, keys, seen).withColumn("began", began).where(F.col(origin) > F.col("began"))
    latency = (F.unix_millis(F.col(seen)) - F.unix_millis(F.col(origin))) / 1000
    ranks = {
        "median_s": lambda n: F.floor((n - 1) * F.lit(0.5)),
        "p90_s": lambda n: F.floor((n - 1) * F.lit(0.9)),
        "max_s": lambda n: n - 1,
    }
    return order_statistics(fresh.withColumn("latency", latency), by, "latency", ranks)


def delivery_minutes(acks: DataFrame) -> DataFrame:
    """Per minute of arrival: visible deliveries, hidden ones, worst latency and first and last visible delivery.

    ``acks(page, reading, arrived, sent, visible)``; a page confirms a reading once, the first confirmation counts.
    """
    once = first_seen(acks, ["page", "reading"], "arrived")
    latency = F.greatest(F.unix_millis("arrived") - F.unix_millis("sent"), F.lit(0))
    shown = F.col("visible")
    return once.groupBy(F.date_trunc("minute", "arrived").alias("minute")).agg(
        F.count_if(shown).alias("deliveries"),
        F.count_if(~shown).alias("hidden"),
        F.coalesce(F.max(F.when(shown, latency)), F.lit(0)).alias("worst_ms"),
        F.min(F.when(shown, F.col("arrived"))).alias("first"),
        F.max(F.when(shown, F.col("arrived"))).alias("last"),
    )


def lead_time_accuracy(forecasts: DataFrame, readings: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean absolute error and bias of forecasts by hours of lead; every issue counts, marked readings do not.

    ``forecasts(station, hour, issued, temp_c)``, ``readings(station, hour, temp_c, marked)``.
    """
    measured = readings.where("not marked and temp_c is not null").select("station", "hour", F.col("temp_c").alias("measured"))
    pairs = forecasts.where((F.col("hour") > F.col("issued")) & F.col("temp_c").isNotNull()).join(measured, ["station", "hour"])
    lead = (F.unix_seconds("hour") - F.unix_seconds("issued")) / 3600
    return error_stats(pairs, [*by, lead_bin(lead).alias("lead_h")], F.col("temp_c") - F.col("measured"))

