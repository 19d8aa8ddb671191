"""Aggregates of statistical tables. All of them fold map-side first; totals are read as scalars, never as one-task windows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from censora.functions.scalars import bucketize, cents, pct_change

# Fixed value: an accounting identity closes when its difference is at most this.
CLOSING_TOLERANCE = 0.05


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rows() -> Column:
    return F.count(F.lit(1))


def count_where(test: Column) -> Column:
    return F.count(F.when(test, 1))


def money_sum(x: Column | str, test: Column | None = None) -> Column:
    """Sum in whole cents; the same in any order of addition."""
    amount = cents(_col(x))
    return F.sum(amount if test is None else F.when(test, amount))


def money_mean(x: Column | str, test: Column | None = None) -> Column:
    """Mean of money from whole cents, NULL over no rows."""
    kept = _col(x) if test is None else F.when(test, _col(x))
    return F.try_divide(F.sum(cents(kept)), F.count(kept) * 100)


def weighted_total(w: Column | str, test: Column | None = None) -> Column:
    """Σw, or Σw of the rows that pass (0 when none does)."""
    return F.sum(_col(w)) if test is None else F.sum(F.when(test, _col(w)).otherwise(0))


def weighted_mean(x: Column | str, w: Column | str, test: Column | None = None) -> Column:
    """Σxw / Σw over the domain; NULL over an empty domain."""
    x, w = _col(x), _col(w)
    if test is None:
        return F.try_divide(F.sum(x * w), F.sum(w))
    return F.try_divide(F.sum(F.when(test, x * w)), F.sum(F.when(test, w)))


def weighted_share(test: Column, w: Column | str) -> Column:
    """Percentage of Σw that passes the test."""
    return F.try_divide(100 * weighted_total(w, test), F.sum(_col(w)))


def share_of_total(df: DataFrame, measure: str, name: str) -> DataFrame:
    """100 · measure / Σ measure over the whole frame."""
    total = df.agg(F.sum(measure).alias("total")).scalar()
    return df.withColumn(name, F.try_divide(100 * F.col(measure), total))


def distribution(df: DataFrame, x: str, edges: Sequence[float], labels: Sequence[str], order: str = "from_value") -> DataFrame:
    """Rows per bucket; ``order`` holds the smallest value seen, by which the report is sorted."""
    return (
        df.where(F.col(x).isNotNull())
        .groupBy(bucketize(x, edges, labels).alias("bucket"))
        .agg(rows().alias("n"), F.min(x).alias(order))
        .orderBy(order)
    )


def gap_report(df: DataFrame, by: Sequence[Column | str], amount: str, men: Column, women: Column) -> DataFrame:
    """Mean amount of men and women, their counts and the gap in percent of the women's mean."""
    means = df.groupBy(*by).agg(
        money_mean(amount, men).alias("avg_m"),
        money_mean(amount, women).alias("avg_f"),
        count_where(men).alias("count_m"),
        count_where(women).alias("count_f"),
    )
    return means.withColumn("gap_pct", pct_change("avg_m", "avg_f"))


def cohort_sums(df: DataFrame, cohorts: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Sums of wide cohort columns as one row per (group, cohort), with the number of rows that carry data."""
    wide = df.groupBy(*by).agg(
        F.count(F.coalesce(*cohorts)).alias("with_data"), *[F.sum(c).alias(c) for c in cohorts]
    )
    return wide.unpivot([*by, "with_data"], list(cohorts), "cohort", "total")


def preaggregate(df: DataFrame, grain: Sequence[Column | str], sums: Mapping[str, Column | str] | None = None) -> DataFrame:
    """Summary at the finest useful grain: ``n`` rows and additive sums. Its Σn must equal the rows of ``df``."""
    return df.groupBy(*grain).agg(rows().alias("n"), *[F.sum(_col(c)).alias(k) for k, c in (sums or {}).items()])


def coarsen(summary: DataFrame, grain: Sequence[str], sums: Sequence[str], names: Mapping[str, str] | None = None, edition: str | None = None) -> DataFrame:
    """A coarser summary from a finer one; each name column keeps the name of the latest edition.

    The largest name wins among several of one edition, so that the result does not depend on row order.
    """
    labels = [F.max_by(F.col(c), F.struct(edition, c)).alias(out) for out, c in (names or {}).items()]
    return summary.groupBy(*grain).agg(*[F.sum(c).alias(c) for c in sums], *labels)


def exact_mean(value: Column) -> Column:
    """Mean over the values that are there: added as exact decimals, so it does not depend on order, and not rounded."""
    return F.sum(value.cast("decimal(18,6)")).cast("double") / F.count(value)


def error_stats(df: DataFrame, by: Sequence[Column | str], error: Column | str) -> DataFrame:
    """Number of errors, mean absolute error and bias; averaged first, rounded by whoever publishes them."""
    error = _col(error)
    return df.groupBy(*by).agg(rows().alias("n"), exact_mean(F.abs(error)).alias("mae"), exact_mean(error).alias("bias"))


def closing(parts: Column, total: Column, tolerance: float = CLOSING_TOLERANCE) -> dict[str, Column]:
    """Columns of an accounting identity: ``delta``, ``delta_pct`` and whether it ``closes``."""
    delta = total - parts
    return {
        "delta": delta,
        "delta_pct": F.when(total > 0, 100 * delta / total).otherwise(0.0),
        "closes": F.abs(delta) <= tolerance,
    }


def side_by_side(df: DataFrame, key: str, pair: tuple, measures: Mapping[str, Column]) -> DataFrame:
    """One row per measure with the figures of two groups."""
    wide = df.where(F.col(key).isin(*pair)).groupBy(key).agg(*[m.cast("double").alias(k) for k, m in measures.items()])
    long = wide.unpivot([key], list(measures), "measure", "value")
    return long.groupBy("measure").agg(
        F.max(F.when(F.col(key) == pair[0], F.col("value"))).alias("first"),
        F.max(F.when(F.col(key) == pair[1], F.col("value"))).alias("second"),
    )


def coverage(df: DataFrame, series: Sequence[str], period: str, expected: Column) -> DataFrame:
    """First and last period, points and missing periods of each series; ``expected`` counts periods from first to last."""
    spans = df.groupBy(*series).agg(
        F.min(period).alias("first"), F.max(period).alias("last"), F.count_distinct(period).alias("points")
    )
    return spans.withColumn("gaps", expected - F.col("points"))
