"""Stored tables: partitioned writes with a count check, slices, merges, retention, exports, inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from censora.operators.joins import only_new
from censora.operators.reshape import keep_first

# Fixed value: rows per Parquet row group of microdata.
ROW_GROUP = 2_000


def write_partitioned(df: DataFrame, path: str, partitions: Sequence[str], key: Sequence[str], row_group: int = ROW_GROUP) -> DataFrame:
    """Write by partition, sorted by key, and prove that no row was lost. Returns rows per partition.

    Rows are ranged over (partition, key): a state with a third of all rows is split by key over many tasks, and every file
    covers a narrow key range, which is what cursor pages and row-group statistics need.
    """
    ranged = df.repartitionByRange(*partitions, *key).sortWithinPartitions(*partitions, *key)
    # Counted on the way to the writer: the frame is not computed a second time for it.
    sent = Observation()
    writer = ranged.observe(sent, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").partitionBy(*partitions).option("compression", "zstd")
    writer.option("parquet.block.row.count.limit", row_group).parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    counts = stored.groupBy(*partitions).agg(F.count(F.lit(1)).alias("rows"))
    written = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    expected = sent.get["rows"]
    if written != expected:
        raise RuntimeError(f"{path}: {written} rows written, {expected} expected")
    return counts


def reload_slice(df: DataFrame, path: str, slice_column: str, value) -> str:
    """Load one slice of a partitioned table unless it is already complete: compare counts, replace the slice, recount."""
    spark = df.sparkSession
    wanted = df.where(F.col(slice_column) == F.lit(value))
    expected = wanted.count()
    if _slice_rows(spark, path, df, slice_column, value) == expected:
        return "complete"
    wanted.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(slice_column).parquet(path)
    if _slice_rows(spark, path, df, slice_column, value) != expected:
        raise RuntimeError(f"{path}: slice {value!r} does not hold the {expected} rows it should")
    return "loaded"


def _slice_rows(spark: SparkSession, path: str, df: DataFrame, slice_column: str, value) -> int:
    try:
        stored = spark.read.schema(df.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return -1
    return stored.where(F.col(slice_column) == F.lit(value)).count()


def upsert(existing: DataFrame, arrived: DataFrame, keys: Sequence[str], version: Sequence[str]) -> DataFrame:
    """Latest version of every key of both frames; a partial aggregate, whatever the number of versions."""
    both = existing.unionByName(arrived)
    rest = [c for c in both.columns if c not in keys]
    best = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*version)).alias("row"))
    return best.select(*[F.col(c) if c in keys else F.col("row")[c].alias(c) for c in both.columns])


def insert_ignore(existing: DataFrame, arrived: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """Existing rows and those new keys' first arrivals; keys that are already stored are left as they are."""
    first, _ = keep_first(arrived, keys, arrival)
    return existing.unionByName(only_new(first, existing, keys))


def retain(df: DataFrame, instant: str, now: Column, days: int) -> DataFrame:
    """Rows not older than ``days``; the table is rewritten with what stays, or old day partitions are dropped."""
    return df.where(F.col(instant) >= now - F.make_dt_interval(days=F.lit(days)))


def materialise_summary(df: DataFrame, path: str) -> DataFrame:
    """A summary as a stored table."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def export(
    df: DataFrame, path: str, form: str, titles: Mapping[str, str] | None = None, limit: int | None = None, order: Sequence[Column] | None = None
) -> bool:
    """Files for readers: titles as header, quotes only where needed; everything, from all tasks.

    A ``limit`` must come with the ``order`` that says which rows it keeps. Returns whether it left rows out.
    """
    if limit is not None and not order:
        raise ValueError("a limited export needs an order")
    cut = False if limit is None else df.limit(limit + 1).count() > limit
    rows = df if limit is None else df.orderBy(*order).limit(limit)
    titled = rows.select(*[F.col(c).alias((titles or {}).get(c, c)) for c in df.columns])
    writer = titled.write.mode("overwrite")
    if form == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif form == "json":
        writer.option("ignoreNullFields", False).json(path)
    elif form == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown export format {form!r}")
    return cut


def inventory(tables: Mapping[str, DataFrame], cuts: Mapping[str, str]) -> DataFrame:
    """One row per table and column: rows of the table, type, NULLs, and the latest cut-off; one pass per table."""
    frames = []
    for name, df in tables.items():
        cut = F.max(cuts[name]).cast("string") if name in cuts else F.lit(None).cast("string")
        columns = F.array(
            *[
                F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.count_if(F.col(f"`{f.name}`").isNull()).alias("nulls"))
                for f in df.schema.fields
            ]
        )
        row = df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("rows"), cut.alias("cut"), columns.alias("columns"))
        frames.append(row.select("table", "rows", "cut", F.explode("columns").alias("c")).select("table", "rows", "cut", "c.*"))
    return reduce(lambda a, b: a.unionByName(b), frames)
