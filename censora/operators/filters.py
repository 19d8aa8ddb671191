"""Predicates that reach the scan, and cleaning rules that mark instead of dropping."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits of a filter's value list, of plausible heights (m) and body-mass indexes, of daily temperatures (°C).
MAX_FILTER_VALUES = 500
HEIGHT_RANGE_M = (1.3, 2.0)
BMI_RANGE = (10, 58)
NOT_MEASURED = 222.2
TEMPERATURE_RANGE_C = (-30, 55)


def in_filter(dimension: Column | str, values: Sequence, most: int = MAX_FILTER_VALUES) -> Column:
    """Membership in a list of literals; a list of more than ``most`` is refused (join a table instead)."""
    if not values:
        raise ValueError("a filter needs at least one value")
    if len(values) > most:
        raise ValueError(f"at most {most} values per filter")
    return (F.col(dimension) if isinstance(dimension, str) else dimension).isin(*values)


def all_of(predicates: Sequence[Column | None]) -> Column:
    """Conjunction of the predicates that are present; none present means no filter."""
    present = [p for p in predicates if p is not None]
    return reduce(lambda a, b: a & b, present, F.lit(True))


def optional_equals(filters: Mapping[str, object | None]) -> Column:
    return all_of([None if value is None else F.col(name) == F.lit(value) for name, value in filters.items()])


def between(column: Column | str, low=None, high=None) -> Column:
    """Inclusive range with optional ends."""
    column = F.col(column) if isinstance(column, str) else column
    return all_of([None if low is None else column >= F.lit(low), None if high is None else column <= F.lit(high)])


def prefix_or_exact(column: str, code: str, full_length: int) -> Column:
    """A complete code is matched exactly, a shorter one as a prefix; both push down."""
    return F.col(column) == code if len(code) == full_length else F.col(column).startswith(code)


def census_level(state: str, municipality: str, locality: str) -> Column:
    """Level of a census row by its keys: zeros mark totals, 9998/9999 the summary of one- and two-dwelling places."""
    return (
        F.when(F.col(locality).isin("9998", "9999"), "small_places")
        .when(F.col(state) == "00", "nation")
        .when(F.col(municipality) == "000", "state")
        .when(F.col(locality) == "0000", "municipality")
        .otherwise("locality")
    )


def measured(column: Column | str) -> Column:
    """Readings at or above the not-measured sentinel become NULL."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column < NOT_MEASURED, column)


def plausible_body(height_m: Column, index: Column, pregnant: Column, weight: Column) -> Column:
    return (
        height_m.between(*HEIGHT_RANGE_M) & index.between(*BMI_RANGE) & ~F.coalesce(pregnant, F.lit(False)) & (weight > 0)
    )


def clean_extremes(df: DataFrame, high: str, low: str) -> DataFrame:
    """Daily extremes: a maximum below the minimum voids both, values out of range become NULL; ``dropped`` says why."""
    crossed = F.coalesce(F.col(high) < F.col(low), F.lit(False))
    in_range = lambda c: F.col(c).between(*TEMPERATURE_RANGE_C)
    dropped = F.when(crossed, F.array(F.lit("crossed"))).otherwise(
        F.array_compact(
            F.array(*[F.when(~in_range(c), F.lit("out_of_range")) for c in (high, low)])
        )
    )
    return df.withColumns(
        {
            "dropped": dropped,
            high: F.when(~crossed & in_range(high), F.col(high)),
            low: F.when(~crossed & in_range(low), F.col(low)),
        }
    )


def current_alerts(alerts: DataFrame, now: Column, horizon_hours: int = 6) -> DataFrame:
    """Alerts in force: not cancelled, not named by another message, not expired and starting within the horizon.

    ``references`` holds "sender,identifier,date" triples separated by blanks.
    """
    named = (
        alerts.select(F.explode(F.split("references", r"\s+")).alias("ref"))
        .select(F.lower(F.get(F.split("ref", ","), F.lit(1))).alias("superseded"))
        .where("superseded is not null and superseded <> ''")
        .distinct()
    )
    live = alerts.where(
        (F.col("message") != "Cancel")
        & (F.col("expires").isNull() | (F.col("expires") > now))
        & (F.col("starts").isNull() | (F.col("starts") <= now + F.make_dt_interval(hours=F.lit(horizon_hours))))
    )
    return live.join(named, F.lower(live["identifier"]) == named["superseded"], "left_anti")
