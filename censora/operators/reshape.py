"""Wide ↔ long, nested series, sheets of cells, keep-first deduplication, key choice, projection to a fixed schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.operators.ordering import join_null_safe


def unfold(df: DataFrame, ids: Sequence[str], members: Mapping[str, str], dimension: str, measure: str) -> DataFrame:
    """One row per id × member from a wide frame; ``members`` maps member ids to columns."""
    long = df.unpivot(list(ids), list(members.values()), dimension, measure)
    back = [F.lit(x) for member, column in members.items() for x in (column, member)]
    return long.withColumn(dimension, F.element_at(F.create_map(*back), F.col(dimension)))


def nested_series(df: DataFrame, keys: Sequence[str], time: str, value: str, chunk: Column) -> DataFrame:
    """Points of each series as sorted arrays, one row per key and ``chunk`` (a year of days, say), so that no array grows
    beyond the calendar of its chunk. ``df`` holds one row per key and time."""
    return df.groupBy(*keys, chunk.alias("chunk")).agg(
        F.array_sort(F.collect_list(F.struct(time, value))).alias("points")
    )


def sheet_to_long(cells: DataFrame, header_row: int, label_columns: Sequence[int]) -> DataFrame:
    """Cells ``(sheet, row, col, value)`` of published sheets → long facts ``(sheet, row, d1.., column, text, value, place)``.

    Merged labels (empty below their first cell) are filled down; column titles come from the header row. A sheet has about
    a million rows at most, so one sheet is one partition of the fill.
    """
    titles = cells.where(F.col("row") == header_row).select("sheet", "col", F.col("value").alias("column"))
    body = cells.where(F.col("row") > header_row)
    down = W.partitionBy("sheet").orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    labels = body.groupBy("sheet", "row").agg(
        *[F.max(F.when(F.col("col") == c, F.col("value"))).alias(f"d{i}") for i, c in enumerate(label_columns, 1)]
    )
    filled = labels.withColumns(
        {f"d{i}": F.last(f"d{i}", ignorenulls=True).over(down) for i in range(1, len(label_columns) + 1)}
    )
    facts = body.where(~F.col("col").isin(*label_columns) & F.col("value").isNotNull())
    return (
        facts.join(titles, ["sheet", "col"])
        .join(filled, ["sheet", "row"])
        .withColumnRenamed("value", "text")
        .withColumn("value", F.col("text").try_cast("double"))
        .withColumn("place", F.col("col"))
        .drop("col")
    )


def numbers_lost(cells: DataFrame, facts: DataFrame, header_row: int, label_columns: Sequence[int]) -> DataFrame:
    """Per sheet the numeric cells read and kept; a load goes on only when they agree."""
    numeric = F.col("value").try_cast("double").isNotNull()
    read = (
        cells.where((F.col("row") > header_row) & ~F.col("col").isin(*label_columns) & numeric)
        .groupBy("sheet")
        .agg(F.count(F.lit(1)).alias("read"))
    )
    kept = facts.where("value is not null").groupBy("sheet").agg(F.count(F.lit(1)).alias("kept"))
    return read.join(kept, "sheet", "full_outer").na.fill(0, ["read", "kept"]).withColumn("lost", F.col("read") - F.col("kept"))


def keep_first(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(first arrival of each key, the repeats). ``arrival`` orders the rows of a key without ties.

    The first rows come from a partial aggregate, so a key with a third of all rows costs one row per map task; the repeats
    are told by (key, arrival), which is spread evenly.
    """
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*arrival)).alias("best"))
    first = best.select(*[F.col(c) if c in keys else F.col("best")[c].alias(c) for c in df.columns])
    identity = list(dict.fromkeys([*keys, *arrival]))
    return first, join_null_safe(df, first.select(*identity), identity, "left_anti")


def latest_version(manifest: DataFrame, keys: Sequence[str], stamp: str, content: Sequence[str]) -> DataFrame:
    """Latest entry per key with ``versions`` seen and ``clash``: several entries of the latest stamp disagree in content."""
    rest = [c for c in manifest.columns if c not in keys]
    per_stamp = manifest.groupBy(*keys, stamp).agg(
        F.max(F.struct(*[c for c in rest if c != stamp])).alias("row"),
        F.count_distinct(F.struct(*content)).alias("contents"),
        F.count(F.lit(1)).alias("entries"),
    )
    latest = per_stamp.groupBy(*keys).agg(
        F.max_by(F.struct(stamp, "row", "contents"), stamp).alias("top"), F.sum("entries").alias("versions")
    )
    columns = [F.col(f"top.{stamp}") if c == stamp else F.col(f"top.row.{c}") for c in rest]
    return latest.select(*keys, *columns, "versions", (F.col("top.contents") > 1).alias("clash"))


def choose_key(df: DataFrame, candidates: Sequence[Sequence[str]]) -> DataFrame:
    """Which candidate key is unique: one row per candidate in order, ``chosen`` marks the first unique one.

    Each candidate is counted from its own groups, which fold map-side.
    """
    counts = []
    for place, columns in enumerate(candidates, 1):
        groups = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
        counts.append(
            groups.agg(
                F.lit(place).alias("place"),
                F.lit(",".join(columns)).alias("key"),
                F.sum("copies").alias("rows"),
                F.count(F.lit(1)).alias("groups"),
                F.max("copies").alias("largest"),
            )
        )
    table = counts[0]
    for more in counts[1:]:
        table = table.unionByName(more)
    unique = F.col("rows") == F.col("groups")
    # As many rows as there are candidates.
    first = F.min(F.when(unique, F.col("place"))).over(W.partitionBy(F.lit(0)))
    return table.withColumn("is_unique", unique).withColumn("chosen", F.coalesce(F.col("place") == first, F.lit(False)))


def project_to_schema(
    df: DataFrame,
    schema: Mapping[str, str],
    aliases: Mapping[str, Sequence[str]] | None = None,
    widths: Mapping[str, int] | None = None,
    extras: str = "extras_json",
) -> DataFrame:
    """Columns of a fixed schema (name → type) taken by name or alias, codes padded to their width, the rest as JSON."""
    aliases, widths = aliases or {}, widths or {}
    used, columns = [], []
    for name, kind in schema.items():
        source = next((c for c in [name, *aliases.get(name, ())] if c in df.columns), None)
        if source is None:
            columns.append(F.lit(None).cast(kind).alias(name))
            continue
        used.append(source)
        value = F.col(source).cast(kind)
        if name in widths:
            value = F.when(F.length(value) >= widths[name], value).otherwise(F.lpad(value, widths[name], "0"))
        columns.append(value.alias(name))
    rest = [c for c in df.columns if c not in used]
    return df.select(*columns, (F.to_json(F.struct(*rest)) if rest else F.lit("{}")).alias(extras))


def width_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Shortest and longest value of each text column and whether any starts with a zero; one pass over the table."""
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.min(F.length(c)).alias("shortest"),
            F.max(F.length(c)).alias("longest"),
            F.coalesce(F.bool_or(F.startswith(F.col(c), F.lit("0"))), F.lit(False)).alias("leading_zero"),
        )
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("profile")).select(F.explode("profile").alias("p")).select("p.*")
