"""Deterministic order, positions, truncation flags, offset pages and key-set cursor pages."""

from __future__ import annotations

import base64
import binascii
import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.session import materialise

# Rows up to which a result may meet in one task: a top-N of so many, or a window over a result that is no larger.
TOP = 1_000
_WHOLE = ("byte", "short", "integer", "long")


def ordered(column: str, descending: bool, rest: Sequence[str]) -> list[Column]:
    """The wanted column with NULLs last in both directions, then the remaining columns as tie-break."""
    first = F.desc_nulls_last(column) if descending else F.asc_nulls_last(column)
    return [first, *[F.asc_nulls_last(c) for c in rest if c != column]]


def postgres_order(column: str, descending: bool) -> Column:
    """Ascending with NULLs last, descending with NULLs first."""
    return F.desc_nulls_first(column) if descending else F.asc_nulls_last(column)


def positioned(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """All rows with their ``position`` from 1 in the asked order; nothing is gathered.

    Rows are sorted by ranges and written; a position is the number of rows in the ranges before plus the place within the
    range. Only the sizes of the ranges, one row each, meet in one task.
    """
    # The id holds the number of the partition in its upper bits and the place within it in the lower 33.
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    stored = materialise(ranged, "positions").withColumn("_range", F.shiftright("_at", 33))
    before = W.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    sizes = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    starts = sizes.withColumn("_start", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return stored.join(starts, "_range").withColumn("position", place.cast("long")).drop("_range", "_at", "_start")


def truncated(df: DataFrame, order: Sequence[Column], limit: int | None = None) -> DataFrame:
    """Rows in order with ``position`` and ``truncated``, which says whether ``limit`` left any out; by default all rows."""
    if limit is not None and limit <= TOP:
        # Only limit + 1 rows leave a task; the window that follows sees no others.
        rows, total = _numbered_here(df.orderBy(*order).limit(limit + 1), order), None
    else:
        stored = materialise(df, "result")
        total = stored.count()
        rows = _numbered_here(stored, order) if total <= TOP else positioned(stored, order)
    if limit is None:
        return rows.withColumn("truncated", F.lit(False))
    more = F.count(F.lit(1)).over(W.partitionBy(F.lit(0))) > limit if total is None else F.lit(total > limit)
    return rows.withColumn("truncated", more).where(F.col("position") <= limit)


def _numbered_here(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Positions of a result that one task may hold."""
    return df.withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).cast("long"))


def offset_page(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    """One page by number with the ``total`` of rows and the number of ``pages``."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    rows = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return rows.withColumn("total", total).withColumn("pages", F.ceil(F.col("total") / size))


def encode_cursor(values: Sequence) -> str:
    text = json.dumps(list(values), separators=(",", ":"), default=str, ensure_ascii=False)
    return base64.urlsafe_b64encode(text.encode()).decode().rstrip("=")


def decode_cursor(cursor: str, key: Sequence[str], schema) -> list:
    """The key that a cursor stands for. One that was not made for this key is refused with a ``ValueError``."""
    padded = cursor + "=" * (-len(cursor) % 4)
    try:
        parts = json.loads(base64.urlsafe_b64decode(padded).decode())
        kinds = [type(p) for p in parts] if isinstance(parts, list) else None
    except (binascii.Error, UnicodeDecodeError, json.JSONDecodeError):
        kinds = None
    fitting = [int if schema[name].dataType.typeName() in _WHOLE else str for name in key]
    if kinds != fitting:
        raise ValueError(f"cursor {cursor!r} does not hold a key ({', '.join(key)})")
    return parts


def after(key: Sequence[str], values: Sequence) -> Column:
    """Rows strictly behind the key. The leading part alone is repeated as a plain range so that it reaches the scan."""
    parts = []
    for i, name in enumerate(key):
        equal = [F.col(k) == F.lit(v) for k, v in zip(key[:i], values[:i])]
        parts.append(reduce(lambda a, b: a & b, [*equal, F.col(name) > F.lit(values[i])]))
    return (F.col(key[0]) >= F.lit(values[0])) & reduce(lambda a, b: a | b, parts)


def cursor_column(key: Sequence[str], schema) -> Column:
    """The cursor of each row: the JSON array of its key as URL-safe base64 without padding; text is quoted by JSON's rules."""
    parts = []
    for name in key:
        value = F.col(name) if schema[name].dataType.typeName() in _WHOLE else F.col(name).cast("string")
        # {"v":…} without its frame.
        parts.append(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1))
    text = F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))
    return F.rtrim(F.translate(F.base64(F.encode(text, "UTF-8")), "+/\r\n", "-_"), F.lit("="))


def cursor_page(df: DataFrame, key: Sequence[str], size: int, cursor: str | None = None, most: int = TOP) -> DataFrame:
    """The next ``size`` rows in key order after ``cursor``, with ``has_next`` and ``next_cursor`` (NULL on the last page).

    ``key`` must be unique and without NULLs. Every page costs one pruned scan and a top-N, whatever its number; a size
    beyond ``most`` is refused.
    """
    if not 1 <= size <= most:
        raise ValueError(f"a page has 1 to {most} rows, not {size}")
    rows = df if cursor is None else df.where(after(key, decode_cursor(cursor, key, df.schema)))
    page = truncated(rows, [F.col(k) for k in key], size)
    last = F.max_by(cursor_column(key, df.schema), "position").over(W.partitionBy(F.lit(0)))
    return page.withColumn("has_next", F.col("truncated")).withColumn("next_cursor", F.when(F.col("truncated"), last)).drop("truncated")


def id_page(df: DataFrame, key: str, last_seen, size: int) -> DataFrame:
    return df.where(F.col(key) > F.lit(last_seen)).orderBy(key).limit(size)
