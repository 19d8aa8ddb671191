"""Series on a calendar grid: densification, runs, rolling windows.

Every input holds at most one row per key and slot, so a key's partition is never longer than the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def slots(start: Column, end: Column, step: str) -> Column:
    """All slot instants from start to end, both included."""
    return F.explode(F.sequence(start, end, F.expr(f"INTERVAL {step}")))


def densify(series: DataFrame, keys: Sequence[str], slot: str, start: Column, end: Column, step: str) -> DataFrame:
    """One row per key of the series and slot of the calendar; slots without a row keep NULLs."""
    grid = series.select(*keys).distinct().withColumn(slot, slots(start, end, step))
    return grid.join(series, [*keys, slot], "left")


def runs(df: DataFrame, keys: Sequence[str], slot: str, flag: Column) -> DataFrame:
    """Islands of consecutive rows with equal ``flag``: ``run`` numbers them per key, ``run_length`` counts their rows."""
    along = W.partitionBy(*keys).orderBy(slot)
    inside = W.partitionBy(*keys, "_flag").orderBy(slot)
    marked = df.withColumn("_flag", flag)
    island = F.row_number().over(along) - F.row_number().over(inside)
    out = marked.withColumn("run", island)
    return out.withColumn("run_length", F.count(F.lit(1)).over(W.partitionBy(*keys, "_flag", "run"))).withColumnRenamed(
        "_flag", "run_flag"
    )


def worst_and_current_run(df: DataFrame, keys: Sequence[str], slot: str, missing: Column) -> DataFrame:
    """Longest run of missing slots per key and the run that is still open at the last slot."""
    islands = runs(df, keys, slot, missing)
    per_run = islands.groupBy(*keys, "run_flag", "run").agg(
        F.count(F.lit(1)).alias("length"), F.max(slot).alias("last")
    )
    gap = F.when(F.col("run_flag"), F.col("length")).otherwise(0)
    return per_run.groupBy(*keys).agg(F.max(gap).alias("worst_run"), F.max_by(gap, "last").alias("current_run"))


def hour_number(instant: Column | str) -> Column:
    instant = F.col(instant) if isinstance(instant, str) else instant
    return F.floor(F.unix_seconds(instant.cast("timestamp")) / 3600)


def trailing(keys: Sequence[str], order: str | Column, back: int, last: int = 0):
    """Range window over a whole-number order column: the ``back`` units before, up to ``last``."""
    return W.partitionBy(*keys).orderBy(order).rangeBetween(-back, last)


def rolling_mean(df: DataFrame, keys: Sequence[str], hour: str, value: str, hours: int, needed: int, name: str) -> DataFrame:
    """Mean of the last ``hours`` hours where at least ``needed`` of them hold a value; sums run from the newest hour back."""
    window = trailing(keys, hour, hours - 1)
    values = F.transform(
        F.reverse(F.array_sort(F.collect_list(F.when(F.col(value).isNotNull(), F.struct(hour, value))).over(window))),
        lambda s: s[value],
    )
    total = F.aggregate("_values", F.lit(0.0), lambda acc, v: acc + v)
    out = df.withColumn("_values", values)
    return out.withColumn(name, F.when(F.size("_values") >= needed, total / F.size("_values"))).drop("_values")


def stuck_since(df: DataFrame, keys: Sequence[str], order: str, value: str, times: int = 6, name: str = "stuck_since") -> DataFrame:
    """Where the last ``times`` values are all equal, the ``order`` of the first of them; else NULL.

    How far back that may lie is for the caller to say: equal readings days apart are no stuck sensor.
    """
    window = W.partitionBy(*keys).orderBy(order).rowsBetween(-(times - 1), 0)
    same = (F.count(value).over(window) == times) & (F.min(value).over(window) == F.max(value).over(window))
    return df.withColumn(name, F.when(same, F.min(order).over(window)))


def stuck(df: DataFrame, keys: Sequence[str], order: str, value: str, within: int, times: int = 6, name: str = "stuck") -> DataFrame:
    """True where the last ``times`` values are all equal and lie within the last ``within`` units of ``order``."""
    marked = stuck_since(df, keys, order, value, times, "_since")
    return marked.withColumn(name, F.coalesce(F.col(order) - F.col("_since") <= within, F.lit(False))).drop("_since")
