"""Strict typing of text columns: a column becomes a number only if every value is one, and codes with leading zeros never."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed patterns: whole numbers without leading zeros; decimals, also in scientific notation.
INTEGER = r"^-?(0|[1-9]\d*)$"
DECIMAL = r"^-?((0|[1-9]\d*)?\.\d+|(0|[1-9]\d*)(\.\d*)?)([eE][-+]?\d+)?$"


def _trimmed(name: str) -> Column:
    return F.nullif(F.trim(F.col(f"`{name}`")), F.lit(""))


def decide_types(df: DataFrame) -> DataFrame:
    """``(column, type)`` for every text column, from one pass over the table: bigint, double or string."""
    cells = []
    for name in _text_columns(df):
        value = _trimmed(name)
        fits = value.rlike(INTEGER) & value.try_cast("bigint").isNotNull()
        whole = F.bool_and(F.when(value.isNotNull(), fits))
        decimal = F.bool_and(value.rlike(DECIMAL))
        kind = F.when(F.count(value) == 0, "string").when(whole, "bigint").when(decimal, "double").otherwise("string")
        cells.append(F.struct(F.lit(name).alias("column"), kind.alias("type")))
    return df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def strict_types(df: DataFrame) -> DataFrame:
    """Text columns cast to the types ``decide_types`` finds; blanks become NULL. One row per column reaches the driver."""
    kinds = {row["column"]: row["type"] for row in decide_types(df).collect()}
    return df.select(
        *[_trimmed(c).cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns]
    )


def _text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
