"""Order-based operators that never put a whole group into one task.

A group may hold a third of all rows, so ranks, order statistics and previous-row look-ups work in two levels: the group is
cut into blocks, each block is handled on its own, and only one summary row per block is combined along the group.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.operators.paging import positioned
from censora.session import materialise

# Distinct (group, value) pairs that one block of value-ordered work holds.
BLOCK_ROWS = 200_000


def value_counts(df: DataFrame, group: Sequence[str], value: Column | str) -> DataFrame:
    """Distinct (group, value) pairs with their number of rows; repeats collapse map-side before the shuffle."""
    value = F.col(value) if isinstance(value, str) else value
    rows = df.select(*group, value.alias("value")).where(F.col("value").isNotNull())
    return rows.groupBy(*group, "value").agg(F.count(F.lit(1)).alias("copies"))


def _with_block(pairs: DataFrame, group: Sequence[str], block_rows: int) -> DataFrame:
    """Pairs, stored, with the number of their ``block``; blocks are in (group, value) order and of nearly equal size.

    The edges are quantiles that Spark samples when it ranges the pairs, so neither a hot group nor outliers nor a crowd of
    close values make a block large.
    """
    stored = materialise(pairs, "pairs")
    blocks = -(-stored.count() // block_rows)
    if blocks <= 1:
        # Always 0, but not a literal: a join on two literals would become a product.
        return stored.withColumn("block", F.when(F.col("copies") > 0, 0).otherwise(1))
    return materialise(stored.repartitionByRange(blocks, *group, "value").withColumn("block", F.spark_partition_id()), "blocks")


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet, as they do in a grouping; the keys of ``left`` are kept."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = F.lit(True)
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_r_{key}"))
    joined = left.join(renamed, on, how)
    return joined if how in ("left_anti", "left_semi") else joined.drop(*[f"_r_{key}" for key in keys])


def order_statistics(
    df: DataFrame,
    group: Sequence[str],
    value: Column | str,
    ranks: Mapping[str, Callable[[Column], Column]],
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact values at 0-based ranks: ``ranks[name](n)`` says which rank of the n sorted values goes to column ``name``.

    Returns one row per group: ``group``, ``n`` and the named values. Only the blocks that hold a wanted rank are sorted.
    """
    group = list(group)
    pairs = _with_block(value_counts(df, group, value), group, block_rows)
    wanted = F.array(*[F.struct(F.lit(k).alias("name"), f(F.col("n")).cast("long").alias("rank")) for k, f in ranks.items()])
    keys = [*group, "block"]
    per_block = pairs.groupBy(*keys).agg(F.sum("copies").alias("rows"))
    per_block = (
        per_block.withColumn("n", F.sum("rows").over(W.partitionBy(*group)))
        .withColumn("below", F.sum("rows").over(W.partitionBy(*group).orderBy("block")) - F.col("rows"))
        .withColumn("wanted", wanted)
    )
    inside = join_null_safe(pairs, _holding(per_block), keys)
    last = F.col("below") + F.sum("copies").over(W.partitionBy(*keys).orderBy("value")) - 1
    inside = inside.withColumn("last", last).withColumn("first", F.col("last") - F.col("copies") + 1)
    hits = inside.select(*group, "n", "value", F.explode(
        F.filter("wanted", lambda w: (w["rank"] >= F.col("first")) & (w["rank"] <= F.col("last")))
    ).alias("hit"))
    return hits.groupBy(*group).agg(
        F.max("n").alias("n"), *[F.max(F.when(F.col("hit.name") == k, F.col("value"))).alias(k) for k in ranks]
    )


def _holding(blocks: DataFrame) -> DataFrame:
    """The blocks that hold a wanted rank, with those ranks only."""
    inside = F.filter(
        "wanted", lambda w: (w["rank"] >= F.col("below")) & (w["rank"] < F.col("below") + F.col("rows"))
    )
    return blocks.withColumn("wanted", inside).where(F.size("wanted") > 0).drop("rows")


def percentiles(
    df: DataFrame, group: Sequence[str], value: Column | str, points: Mapping[str, float], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Exact ``percentile_cont``: position (n−1)·p with linear interpolation between the two neighbours."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for name, p in points.items():
        ranks[f"{name}__low"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        ranks[f"{name}__high"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    stats = order_statistics(df, group, value, ranks, block_rows)
    out = []
    for name, p in points.items():
        position = (F.col("n") - 1) * F.lit(p)
        low, high = F.col(f"{name}__low"), F.col(f"{name}__high")
        out.append((low + (high - low) * (position - F.floor(position))).alias(name))
    return stats.select(*group, "n", *out)


def floor_rank_quantiles(
    df: DataFrame, group: Sequence[str], value: Column | str, points: Mapping[str, float], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Quantiles that are observed values: the one at rank floor(p·(n−1))."""
    ranks = {name: (lambda n, p=p: F.floor((n - 1) * F.lit(p))) for name, p in points.items()}
    return order_statistics(df, group, value, ranks, block_rows)


def medians(df: DataFrame, group: Sequence[str], value: Column | str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``median`` (midpoint of the two middle values) and ``upper_median`` (value at rank floor(n/2))."""
    stats = order_statistics(
        df,
        group,
        value,
        {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)},
        block_rows,
    )
    return stats.select(
        *group, "n", ((F.col("low") + F.col("high")) / 2).alias("median"), F.col("high").alias("upper_median")
    )


def value_ladder(df: DataFrame, group: Sequence[str], value: Column | str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every distinct (group, value) with ``copies``, ``below`` (rows with a smaller value), ``n`` and ``previous`` value."""
    group = list(group)
    pairs = _with_block(value_counts(df, group, value), group, block_rows)
    per_block = pairs.groupBy(*group, "block").agg(F.sum("copies").alias("in_block"), F.max("value").alias("top"))
    along = W.partitionBy(*group).orderBy("block")
    per_block = (
        per_block.withColumn("before", F.sum("in_block").over(along) - F.col("in_block"))
        .withColumn("carry", F.lag("top").over(along))
        .withColumn("n", F.sum("in_block").over(W.partitionBy(*group)))
        .drop("in_block", "top")
    )
    inside = W.partitionBy(*group, "block").orderBy("value")
    return (
        join_null_safe(pairs, per_block, [*group, "block"])
        .withColumn("below", F.col("before") + F.sum("copies").over(inside) - F.col("copies"))
        .withColumn("previous", F.coalesce(F.lag("value").over(inside), F.col("carry")))
        .select(*group, "value", "copies", "below", "n", "previous")
    )


def ranked(df: DataFrame, value: str, tie_break: Sequence[str]) -> DataFrame:
    """Rank rows by ``value``, largest first, without a one-task window; rows without a value are left out.

    Adds ``rank`` (ties share it), ``percent_rank`` (smallest first, 0..1), ``position`` (ties in ``tie_break`` order) and
    ``prev_value`` (the value of the row one position above; NULL for the first). Positions come from a range sort over value
    and tie-break, so a value shared by any share of the rows is split; a tie is folded to its first and last position.
    """
    placed = materialise(positioned(df.where(F.col(value).isNotNull()), [F.desc(value), *map(F.col, tie_break)]), "placed")
    ties = placed.groupBy(F.col(value).alias("_value")).agg(F.min("position").alias("_first"), F.max("position").alias("_last"))
    above = ties.select(F.col("_value").alias("_above"), (F.col("_last") + 1).alias("_first"))
    ties = ties.join(above, "_first", "left")
    n = placed.count()
    smaller = F.lit(n) - F.col("_last")
    return (
        placed.join(ties, F.col(value) == F.col("_value"))
        .withColumn("rank", F.col("_first"))
        .withColumn("percent_rank", smaller / F.lit(n - 1) if n > 1 else F.lit(0.0))
        .withColumn("prev_value", F.when(F.col("position") > F.col("_first"), F.col(value)).otherwise(F.col("_above")))
        .select(*df.columns, "rank", "position", "percent_rank", "prev_value")
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    fields: Sequence[str],
    prefix: str = "prev_",
) -> DataFrame:
    """The preceding row's ``fields`` per key, ordered by ``order``, with the key's rows cut along ``block``.

    ``block`` must rise with ``order`` (for instants: the hour). Inside a block it is a plain lag; the first row of a block
    takes the last row of the key's previous non-empty block from a one-row-per-block summary.
    """
    keys, order, fields = list(keys), list(order), list(fields)
    rows = df.withColumn("_block", block)
    record = F.struct(*fields)
    summary = rows.groupBy(*keys, "_block").agg(F.max_by(record, F.struct(*order)).alias("_tail"))
    carry = summary.withColumn("_carry", F.lag("_tail").over(W.partitionBy(*keys).orderBy("_block"))).drop("_tail")
    inside = W.partitionBy(*keys, "_block").orderBy(*order)
    here = rows.withColumn("_prev", F.lag(record).over(inside)).withColumn("_seat", F.row_number().over(inside))
    joined = join_null_safe(here, carry, [*keys, "_block"], "left")
    prev = F.when(F.col("_seat") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    out = joined.withColumn("_prev", prev)
    return out.select(*df.columns, *[F.col("_prev")[f].alias(f"{prefix}{f}") for f in fields])
