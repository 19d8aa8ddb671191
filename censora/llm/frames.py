"""Helpers of this subpackage: gapless numbering without hot tasks, and reading a frame's columns in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Rows that one block of a numbered group holds on average, whatever the size of the group.
BLOCK_ROWS = 100_000
# Rows with whole texts that a worker handles at once.
SLICE_ROWS = 256
# Bytes of an Arrow batch on its way to a worker. Spark's own bound is 64 MB, which both processes hold for every running task.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def blocks_for(rows: int, spark) -> int:
    """How many blocks a group of any size is dealt to: as many as tasks, more where blocks would grow too long."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // BLOCK_ROWS))


def numbered(df: DataFrame, keys: Sequence[str], identity: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``name``: 0, 1, 2, … without gaps within ``keys`` (never NULL), each row's number fixed by the data.

    A group may hold any share of the rows: its rows are dealt to blocks by a hash of ``identity``, numbered within the
    block, and moved up by the sizes of the blocks before. ``df`` is read twice, so pass a stored table.
    """
    spark = df.sparkSession
    keys = list(keys)
    blocks = blocks_for(df.count(), spark)
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*identity), F.lit(blocks)).cast("int"))
    before = W.partitionBy(*keys).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = F.row_number().over(W.partitionBy(*keys, "_block").orderBy(*identity))
    placed = dealt.withColumn("_inside", inside - 1).join(starts, [*keys, "_block"])
    return placed.withColumn(name, (F.col("_start") + F.col("_inside")).cast("long")).drop("_block", "_start", "_inside")


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The column as text, an empty one for NULL."""
    return F.coalesce(df[column].cast("string"), F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Whole texts go to workers in batches of ``BATCH_BYTES`` from here on, unless the session has a bound of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut small, so that what a worker holds in Python does not depend on the session's batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def with_fields(schema: StructType, added: str) -> StructType:
    """The schema with further fields, given as DDL."""
    return StructType([*schema.fields, *StructType.fromDDL(added).fields])


def aside(df: DataFrame, reserved: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``df`` with columns renamed whose names an operator needs, and the way back to the columns of ``df``."""
    taken = {r.lower() for r in reserved}
    names = [f"_own_{i}" if c.lower() in taken else c for i, c in enumerate(df.columns)]

    def back(result: DataFrame) -> DataFrame:
        return result.select(*[F.col(f"`{new}`").alias(old) for new, old in zip(names, df.columns)])

    return df.toDF(*names), back
