"""Checks as jobs over tables: reconciliation, fidelity, sums, bounds, stores, keys, constraints, cells.

Each check returns its findings as a DataFrame; nothing is fixed or dropped here.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Relative tolerance of profiles, absolute and relative tolerance of published cells.
PROFILE_TOLERANCE = 1e-9
CELL_TOLERANCE = (0.0006, 1e-9)
STATE_CODE = r"^(0[1-9]|[12][0-9]|3[0-2])$"


def published_tolerance(text: Column) -> Column:
    """Half of the last published digit: '71.5' → 0.05, '71' → 0.5."""
    decimals = F.length(F.regexp_extract(text, r"\.(\d+)$", 1))
    return 0.5 * F.pow(F.lit(10.0), -decimals) + 1e-9


def reconcile(calculated: DataFrame, official: DataFrame, keys: Sequence[str], tolerance: Column) -> DataFrame:
    """Calculated against official values: ``delta``, ``delta_pct`` and ``status`` (equal, different, only one side).

    ``calculated(keys…, value)``, ``official(keys…, published)``: the figure as published text, so that ``tolerance`` can
    depend on its digits (column ``published``). A published text that is no number differs from any figure.
    """
    rows = calculated.join(official, list(keys), "full_outer").withColumn("official", F.col("published").try_cast("double"))
    delta = F.col("value") - F.col("official")
    status = (
        F.when(F.col("published").isNull(), "only_calculated")
        .when(F.col("value").isNull(), "only_official")
        .when(F.abs(delta) <= tolerance, "equal")
        .otherwise("different")
    )
    return rows.withColumns(
        {"delta": delta, "delta_pct": F.try_divide(100 * delta, F.col("official")), "status": status}
    )


def reconcile_summary(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per status and the worst delta of a reconciliation."""
    statuses = ("equal", "different", "only_calculated", "only_official")
    return rows.groupBy(*by).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in statuses], F.max(F.abs("delta")).alias("worst_delta")
    )


def fidelity_profile(df: DataFrame) -> DataFrame:
    """One row per column: Σ of numbers (4 decimals, exact), true count of booleans, first|last of dates, distinct texts;
    plus the row count. One pass over everything but the texts; each text column is read alone, so that counting distinct
    values of many columns does not multiply the rows."""
    cells = [F.struct(F.lit("*").alias("column"), F.lit("count").alias("metric"), F.count(F.lit(1)).cast("string").alias("value"))]
    texts = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.NumericType):
            metric, value = "sum", F.coalesce(F.sum(c.cast("decimal(28,4)")), F.lit(0).cast("decimal(38,4)")).cast("string")
        elif isinstance(f.dataType, T.BooleanType):
            metric, value = "true", F.count_if(c).cast("string")
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            metric, value = "range", F.concat_ws("|", F.min(c).cast("string"), F.max(c).cast("string"))
        elif isinstance(f.dataType, T.StringType):
            distinct = df.where(c.isNotNull()).select(c).distinct()
            texts.append(distinct.agg(F.lit(f.name).alias("column"), F.lit("distinct").alias("metric"), F.count(F.lit(1)).cast("string").alias("value")))
            continue
        else:
            metric, value = "filled", F.count(c).cast("string")
        cells.append(F.struct(F.lit(f.name).alias("column"), F.lit(metric).alias("metric"), value.alias("value")))
    plain = df.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")
    return reduce(lambda a, b: a.unionByName(b), texts, plain)


def compare_profiles(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two fidelity profiles side by side; numbers agree within a relative 1e-9, the rest must be equal."""
    a = old.select("column", "metric", F.col("value").alias("old"))
    b = new.select("column", "metric", F.col("value").alias("new"))
    x, y = F.col("old").try_cast("double"), F.col("new").try_cast("double")
    close = F.abs(x - y) <= F.greatest(PROFILE_TOLERANCE * F.greatest(F.abs(x), F.abs(y)), F.lit(1e-4))
    same = F.coalesce(F.col("old") == F.col("new"), F.lit(False)) | (F.col("metric").isin("sum") & F.coalesce(close, F.lit(False)))
    return a.join(b, ["column", "metric"], "full_outer").withColumn("same", same)


def sum_check(parts: DataFrame, part_value: Column, whole: DataFrame, whole_value: Column, tolerance: float = 0.0) -> DataFrame:
    """Do the parts add up to the whole? One row with both sums, their difference and the verdict."""
    total = whole.agg(whole_value.alias("whole")).scalar()
    row = parts.agg(part_value.alias("parts")).withColumn("whole", total)
    delta = F.col("parts") - F.col("whole")
    return row.withColumn("delta", delta).withColumn("adds_up", F.abs(delta) <= tolerance * F.abs(F.col("whole")))


def bounds_check(calculated: DataFrame, bounds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``calculated(keys…, value)`` against ``bounds(keys…, official, tolerance)``: relative delta and ``passing``."""
    rows = bounds.join(calculated, list(keys), "left")
    delta = (F.col("value") - F.col("official")) / F.col("official")
    passing = F.coalesce(F.abs(delta) <= F.col("tolerance"), F.lit(False))
    return rows.withColumn("delta_pct", delta * 100).withColumn("passing", passing)


def store_reconcile(referenced: DataFrame, listing: DataFrame) -> DataFrame:
    """Objects that are referenced but missing, present but unreferenced, or of another size than the manifest says.

    ``referenced(object, bytes)`` and ``listing(object, size)``; agreeing objects are not reported.
    """
    rows = referenced.join(listing, "object", "full_outer")
    finding = (
        F.when(F.col("size").isNull(), "missing")
        .when(F.col("bytes").isNull(), "unreferenced")
        .when(F.col("bytes") != F.col("size"), "size_differs")
    )
    return rows.withColumn("finding", finding).where("finding is not null")


def row_compare(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str], tolerances: Mapping[str, float] | None = None) -> DataFrame:
    """Rows paired by key: how many differ per column (NULLs are equal, floats within their tolerance) and lack a partner."""
    tolerances = tolerances or {}
    a = old.select(*keys, F.struct(*columns).alias("a"))
    b = new.select(*keys, F.struct(*columns).alias("b"))
    both = a.join(b, list(keys), "full_outer")
    paired = F.col("a").isNotNull() & F.col("b").isNotNull()

    def differs(c: str) -> Column:
        x, y = F.col("a")[c], F.col("b")[c]
        exact = ~x.eqNullSafe(y)
        if c in tolerances:
            return exact & ~F.coalesce(F.abs(x - y) < tolerances[c], F.lit(False))
        return exact

    cells = [("only_old", F.count_if(F.col("b").isNull())), ("only_new", F.count_if(F.col("a").isNull()))]
    cells += [(c, F.count_if(paired & differs(c))) for c in columns]
    table = F.array(*[F.struct(F.lit(name).alias("column"), count.alias("differences")) for name, count in cells])
    return both.agg(table.alias("t")).select(F.explode("t").alias("r")).select("r.*")


def key_check(df: DataFrame, key: Sequence[str], domains: Mapping[str, str] | None = None) -> DataFrame:
    """Rows, distinct keys, the largest number of copies, NULL keys and values outside their pattern, as one row."""
    bad = [F.sum((~F.col(c).rlike(p)).cast("bigint")).alias(f"bad_{c}") for c, p in (domains or {}).items()]
    nulls = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in key])
    groups = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"), *bad)
    return groups.agg(
        F.sum("copies").alias("rows"),
        F.count(F.lit(1)).alias("keys"),
        F.max("copies").alias("most_copies"),
        F.coalesce(F.sum(F.when(nulls, F.col("copies"))), F.lit(0)).alias("null_keys"),
        *[F.coalesce(F.sum(f"bad_{c}"), F.lit(0)).alias(f"bad_{c}") for c in (domains or {})],
    )


def constraint_check(
    df: DataFrame, key: Sequence[str], references: Mapping[str, tuple[str, DataFrame, str]], rules: Mapping[str, Column]
) -> DataFrame:
    """Violations ``(constraint, rows)`` of a primary key, of foreign keys and of row rules; 0 where all is well.

    ``references[name] = (column, table, its key)``; ``rules[name]`` must hold for every row (NULL passes, as in SQL).
    """
    copies = df.groupBy(*key).agg(F.count(F.lit(1)).alias("copies"))
    found = [copies.agg(F.lit("primary_key").alias("constraint"), F.count_if(F.col("copies") > 1).alias("rows"))]
    for name, (column, table, target) in references.items():
        used = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("uses"))
        lost = used.join(table.select(F.col(target).alias(column)).distinct(), column, "left_anti")
        found.append(lost.agg(F.lit(name).alias("constraint"), F.coalesce(F.sum("uses"), F.lit(0)).alias("rows")))
    broken = df.agg(
        F.array(*[F.struct(F.lit(n).alias("constraint"), F.count_if(~r).alias("rows")) for n, r in rules.items()]).alias("t")
    )
    found.append(broken.select(F.explode("t").alias("r")).select("r.*"))
    return reduce(lambda a, b: a.unionByName(b), found)


def _unpivoted(df: DataFrame, keys: Sequence[str], variables: Sequence[str], name: str) -> DataFrame:
    return df.select(*keys, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(list(keys), list(variables), "variable", name)


def cell_compare(published: DataFrame, built: DataFrame, keys: Sequence[str], variables: Sequence[str]) -> DataFrame:
    """Per variable: published cells, cells without a row on our side, cells that differ by more than the tolerance."""
    absolute, relative = CELL_TOLERANCE
    mine = _unpivoted(built, keys, variables, "built").withColumn("present", F.lit(True))
    cells = _unpivoted(published, keys, variables, "published").join(mine, [*keys, "variable"], "left")
    a, b = F.col("published"), F.col("built")
    off = F.when(a.isNull() & b.isNull(), False).when(a.isNull() | b.isNull(), True)
    off = off.otherwise(F.abs(a - b) > absolute + relative * F.abs(b))
    here = F.col("present").isNotNull()
    return cells.groupBy("variable").agg(
        F.count(F.lit(1)).alias("cells"), F.count_if(~here).alias("missing"), F.count_if(here & off).alias("different")
    )


def review_states(reports: DataFrame, reviews: DataFrame) -> DataFrame:
    """User reports with their current state: the latest review, or pending."""
    latest = reviews.groupBy("id").agg(F.max_by(F.struct("state", "at"), "at").alias("last"))
    joined = reports.join(latest, "id", "left")
    return joined.select(
        *reports.columns, F.coalesce("last.state", F.lit("pendiente")).alias("state"), F.col("last.at").alias("reviewed_at")
    )
