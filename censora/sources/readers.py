"""Reading text tables: nothing is typed on the way in; encoding and header are looked at per file, distributed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def file_heads(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Per file: its first line, whether every line is valid UTF-8, and whether some quoted cell holds a line break (a line
    with an odd number of quotes). Lines are checked where they are read."""
    lines = spark.read.text(list(paths)).select(
        "value", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("place")
    )
    first = F.when(F.col("file_block_start") == 0, F.col("place"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.groupBy("file_path").agg(
        F.min_by("value", first).alias("header"), F.bool_and(F.is_valid_utf8("value")).alias("utf8"), F.bool_or(quotes % 2 == 1).alias("broken")
    )


def read_csv_text(spark: SparkSession, paths: Sequence[str], separator: str = ",") -> DataFrame:
    """CSV files as text columns: UTF-8 or, for a file with any other byte, Latin-1. Columns are the union of the headers,
    in order of appearance; what a file does not have is ''. Only files with line breaks inside quotes are read whole.

    One row per distinct header (with encoding) reaches the driver, with the names of its files."""
    kinds = file_heads(spark, paths).groupBy("header", "utf8", "broken").agg(F.array_sort(F.collect_list("file_path")).alias("files"))
    frames = []
    for kind in sorted(kinds.collect(), key=lambda k: k.files[0]):
        reader = spark.read.option("header", True).option("sep", separator).option("escape", '"').option("multiLine", kind.broken)
        df = reader.option("encoding", "UTF-8" if kind.utf8 else "ISO-8859-1").csv(list(kind.files))
        frames.append(df.toDF(*[_clean(c) for c in df.columns]))
    return union_headers(frames)


def _clean(name: str) -> str:
    # A byte-order mark read as Latin-1 is three characters.
    return name.removeprefix(BOM).removeprefix("ï»¿").strip().strip('"').lower()


def union_headers(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of one edition under the union of their columns; text that a file does not carry becomes ''."""
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return merged.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in merged.columns])


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A manifest of one JSON object per line, with a declared schema: no pass over the data to guess it."""
    return spark.read.schema(schema).json(path)


def scan_partitions(spark: SparkSession, path: str, schema: T.StructType, **partitions) -> DataFrame:
    """Rows of the named partitions. The declared schema keeps partition codes as text ("09" is not 9); the filters prune
    folders before any file is opened, and what the caller adds is pushed to the row groups."""
    df = spark.read.schema(schema).parquet(path)
    for name, value in partitions.items():
        if value is not None:
            df = df.where(F.col(name) == F.lit(value))
    return df
