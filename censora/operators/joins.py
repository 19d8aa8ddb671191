"""Joins with the semantics of statistical tables: catalogues, absent members, as-of, bands, intervals, places, names."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from censora.functions.geo import EARTH_RADIUS_M, box_around, crossing, grid_cell, haversine_m, point_in_ring, ring_box, ring_edges
from censora.functions.text import strip_accents


def with_catalogue(fact: DataFrame, catalogue: DataFrame, on: Column | Sequence[str], how: str = "left") -> DataFrame:
    """Fact joined to its catalogue; ``left`` keeps facts with unknown codes.

    No broadcast hint: Spark broadcasts a catalogue whose measured size is below ``spark.sql.autoBroadcastJoinThreshold``
    and otherwise shuffles, splitting hot codes (AQE skew join).
    """
    return fact.join(catalogue, on, how)


def all_members(catalogue: DataFrame, fact: DataFrame, on: Sequence[str], predicate: Column) -> DataFrame:
    """Every member of the catalogue with the facts that satisfy ``predicate``; members without any appear with NULLs.

    The fact is filtered before the join: a filter after it would turn the outer join into an inner one.
    """
    return catalogue.join(fact.where(predicate), list(on), "left")


def flag_has_any(df: DataFrame, other: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """1 where ``other`` holds at least one row with the key, else 0; rows are never multiplied."""
    keys = other.select(*on).distinct().withColumn(flag, F.lit(1))
    return df.join(keys, list(on), "left").withColumn(flag, F.coalesce(flag, F.lit(0)))


def only_new(df: DataFrame, existing: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(existing.select(*on).distinct(), list(on), "left_anti")


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` per key, as a partial aggregate: a key with many versions is folded map-side."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best"))
    return best.select(*[F.col(c) if c in keys else F.col("best")[c].alias(c) for c in df.columns])


def nearest_within(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    fields: Sequence[str],
    tolerance_s: int,
    block_s: int = 60,
) -> DataFrame:
    """As-of join: for every left row the nearest right row of its key within ±tolerance, the earlier one on a tie.

    No rows are paired: both sides meet in windows over (key, block of ``block_s`` seconds), one running forwards and one
    backwards. What lies beyond the block's edges comes from a summary with one row per key and block. Left rows without a
    match keep NULL ``fields`` and NULL ``distance_s``.
    """
    keys, fields = list(keys), list(fields)

    def block(instant: str) -> Column:
        return F.floor(F.unix_micros(F.col(instant)) / F.lit(block_s * 1_000_000)).cast("long")

    rights = right.select(*keys, F.col(right_time).alias("at"), F.struct(F.col(right_time).alias("at"), *fields).alias("report"))
    rights = rights.dropna(subset=keys).withColumn("block", block("at"))  # a NULL key matches nothing
    lefts = left.select(*keys, block(left_time).alias("block"), F.col(left_time).alias("at"), F.struct(*left.columns).alias("row"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    edges = both.groupBy(*keys, "block").agg(F.min("report").alias("first"), F.max("report").alias("last"))
    up, down = (W.partitionBy(*keys).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in ("block", F.desc("block")))
    edges = edges.select(
        *keys,
        "block",
        F.last("last", ignorenulls=True).over(up).alias("left_edge"),
        F.last("first", ignorenulls=True).over(down).alias("right_edge"),
    )
    # Right rows come before left rows of the same instant, in both directions.
    is_left = F.col("row").isNotNull()
    inside = W.partitionBy(*keys, "block").rowsBetween(W.unboundedPreceding, 0)
    seen = (
        both.withColumn("before", F.last("report", ignorenulls=True).over(inside.orderBy("at", is_left, "report")))
        .withColumn("after", F.last("report", ignorenulls=True).over(inside.orderBy(F.desc("at"), is_left, F.desc("report"))))
        .where(is_left)
        .join(edges, [*keys, "block"], "left")
        .withColumn("before", F.coalesce("before", "left_edge"))
        .withColumn("after", F.coalesce("after", "right_edge"))
    )

    def gap(side: str) -> Column:
        return F.abs(F.unix_micros("at") - F.unix_micros(F.col(side)["at"])) / 1_000_000

    later = F.col("after").isNotNull() & (F.col("before").isNull() | (gap("after") < gap("before")))
    seen = seen.withColumn("nearest", F.when(later, F.col("after")).otherwise(F.col("before")))
    seen = seen.withColumn("distance_s", gap("nearest"))
    hit = F.col("distance_s") <= tolerance_s
    return seen.select(
        "row.*",
        *[F.when(hit, F.col("nearest")[f]).alias(f) for f in fields],
        F.when(hit, F.col("nearest.at")).alias("matched_at"),
        F.when(hit, F.col("distance_s")).alias("distance_s"),
    )


def with_band(df: DataFrame, value: Column, bands: DataFrame, name: str) -> DataFrame:
    """Number of the band with ``lower <= value <= upper``; beyond the ends the first or last band, NULL in a gap.

    ``bands(band, lower, upper)`` is a short ladder (deciles), read as one scalar array: no join at all.
    """
    ladder = bands.agg(F.sort_array(F.collect_list(F.struct("band", "lower", "upper"))).alias("ladder")).scalar()
    marked = df.withColumn("_ladder", ladder).withColumn("_value", value)
    inside = F.get(F.filter("_ladder", lambda b: F.col("_value").between(b["lower"], b["upper"])), F.lit(0))["band"]
    first, last = F.get("_ladder", F.lit(0)), F.get("_ladder", F.size("_ladder") - 1)
    beyond = F.when(F.col("_value") > last["upper"], last["band"]).when(F.col("_value") < first["lower"], first["band"])
    return marked.withColumn(name, F.coalesce(inside, beyond)).drop("_ladder", "_value")


def in_class_on_days(
    log: DataFrame, requests: DataFrame, keys: Sequence[str], since: str, value: str, wanted: Sequence[str], day: Column
) -> DataFrame:
    """``requests(keys…, day)`` with ``in_class``: was the logged value in ``wanted`` at any instant of that day?

    ``log`` is a change log (one row per change, valid until the next). A day counts when some change of the day lands in
    ``wanted`` or when the value carried in from before is in ``wanted`` and lasts past the day's start. Days are the grain:
    the log is folded to one row per key and day, then carried forward along the calendar.
    """
    keys = list(keys)
    folded = (
        log.withColumn("day", day)
        .groupBy(*keys, "day")
        .agg(
            F.max(F.col(value).isin(*wanted)).alias("hit"),
            F.max_by(value, since).alias("closing"),
        )
    )
    asked = requests.select(*keys, "day").distinct().withColumn("asked", F.lit(True))
    days = folded.join(asked, [*keys, "day"], "full_outer")
    carried = F.last("closing", ignorenulls=True).over(
        W.partitionBy(*keys).orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    )
    days = days.withColumn("carried", carried).where("asked")
    hit = F.coalesce("hit", F.lit(False)) | F.coalesce(F.col("carried").isin(*wanted), F.lit(False))
    return days.select(*keys, "day", hit.alias("in_class"))


def radius_search(points: DataFrame, lat0: float, lon0: float, radius_m: float, top: int) -> DataFrame:
    """Points within ``radius_m``, nearest first, with the ``total`` found; the box is filtered before any distance."""
    near = (
        points.where(box_around(F.col("lat"), F.col("lon"), lat0, lon0, radius_m))
        .withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), lat0, lon0))
        .where(F.col("distance_m") <= radius_m)
    )
    total = near.agg(F.count(F.lit(1)).alias("total")).scalar()
    return near.orderBy("distance_m", "id").limit(top).withColumn("total", total)


def sites_near(centres: DataFrame, sites: DataFrame, radius_m: float) -> DataFrame:
    """Pairs (centre, site) within ``radius_m``: each centre is spread over the grid cells its circle can touch, sites meet
    it by equal cell, and the exact distance decides. ``centres(centre, clat, clon)``, ``sites(site, lat, lon, …)``.

    Rows of cells are as high as the radius. A row has as many cells as fit around its parallel, so cells are about square
    at every latitude, the few next to a pole span it, and numbers wrap around at ±180°.
    """
    height = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)

    def row_of(lat: Column) -> Column:
        return F.floor((lat + 90) / height).cast("long")

    def cells_in(row: Column) -> Column:
        # By the parallel of the row that is nearest to a pole: no cell is narrower than the radius.
        edge = F.least(F.greatest(F.abs(row * height - 90), F.abs((row + 1) * height - 90)), F.lit(90.0))
        return F.greatest(F.floor(360 * F.cos(F.radians(edge)) / height), F.lit(1)).cast("long")

    def cell_of(lon: Column, row: Column) -> Column:
        return F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360 * cells_in(row)), cells_in(row)).cast("long")

    rows = centres.withColumn("cy", F.explode(F.sequence(row_of(F.col("clat")) - 1, row_of(F.col("clat")) + 1)))
    # How far the circle reaches to the sides, in cells of that row; a circle that holds a pole reaches all around.
    sine = F.sin(F.radians(F.lit(height))) / F.cos(F.radians("clat"))
    reach = F.when((F.abs("clat") + height >= 90) | (sine >= 1), 180.0).otherwise(F.degrees(F.asin(F.least(sine, F.lit(1.0)))))
    steps = F.least(F.ceil(reach / 360 * cells_in(F.col("cy"))) + 1, F.floor(cells_in(F.col("cy")) / 2)).cast("long")
    around = F.transform(F.sequence(-steps, steps), lambda k: F.pmod(cell_of(F.col("clon"), F.col("cy")) + k, cells_in(F.col("cy"))))
    spread = rows.withColumn("cx", F.explode(F.array_distinct(around)))
    placed = sites.withColumn("cy", row_of(F.col("lat"))).withColumn("cx", cell_of(F.col("lon"), F.col("cy")))
    pairs = placed.join(spread, ["cy", "cx"])
    near = pairs.withColumn("distance_m", haversine_m(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")))
    return near.where(F.col("distance_m") <= radius_m).drop("cx", "cy")


def pick_station(pairs: DataFrame, close_m: float = 5_000) -> DataFrame:
    """Per centre the nearest eligible site, fresh ones within ``close_m`` first and then beyond, plus the nearest close one
    that measures particulates when the first does not.

    ``pairs(centre, site, distance_m, fresh, measures, particulates)``; ``pick`` is 1 for the main site, 2 for the addition.
    """
    fit = pairs.where("fresh and measures")
    order = F.struct(F.col("distance_m") > close_m, F.col("distance_m"), F.col("site"))
    site = F.struct("site", "distance_m", "particulates")
    chosen = fit.groupBy("centre").agg(
        F.min_by(site, order).alias("main"),
        F.min_by(site, F.when(F.col("particulates") & (F.col("distance_m") <= close_m), order)).alias("extra"),
    )
    picks = F.array_compact(
        F.array(
            F.struct(F.lit(1).alias("pick"), F.col("main").alias("s")),
            F.when(
                ~F.col("main.particulates") & F.col("extra").isNotNull(),
                F.struct(F.lit(2).alias("pick"), F.col("extra").alias("s")),
            ),
        )
    )
    return chosen.select("centre", F.explode(picks).alias("p")).select("centre", "p.pick", "p.s.*")


# Edges of a polygon in one row of cells that are columns of their own; rows with more are tested by the whole ring.
FEW_EDGES = 4


def covering_polygons(points: DataFrame, polygons: DataFrame, cell: float = 1.0) -> DataFrame:
    """Pairs (point, polygon) where the polygon's ring holds the point. Polygons are spread over the grid cells of their
    box, points meet them by equal cell, and the ring decides.

    A point crosses only edges that reach its row of cells. Where these are few they are plain columns, so that the test is
    compiled into the join. Both sides are shuffled by cell at any size: pairs are many more than rows, and a broadcast would
    leave all of them to the few tasks that read the points.
    """
    low_x, high_x, low_y, high_y = ring_box(F.col("ring"))
    rows = polygons.withColumn("_edges", ring_edges(F.col("ring"))).withColumn("cx", F.sequence(grid_cell(low_x, cell), grid_cell(high_x, cell)))
    rows = rows.withColumn("cy", F.explode(F.sequence(grid_cell(low_y, cell), grid_cell(high_y, cell))))

    def reaches(e: Column) -> Column:
        low, high = F.least(e["b"]["lat"], e["a"]["lat"]), F.greatest(e["b"]["lat"], e["a"]["lat"])
        return (grid_cell(low, cell) <= F.col("cy")) & (F.isnan(high) | (grid_cell(high, cell) >= F.col("cy")))

    rows = rows.withColumn("_edges", F.filter("_edges", reaches)).where(F.size("_edges") > 0)
    flat = [F.get("_edges", F.lit(k))[end][axis].alias(f"_{end}_{axis}_{k}") for k in range(FEW_EDGES) for end in "ba" for axis in ("lon", "lat")]
    few, many = F.size("_edges") <= FEW_EDGES, F.size("_edges") > FEW_EDGES
    lon, lat = F.col("lon"), F.col("lat")

    def edge(k: int, end: str) -> dict[str, Column]:
        return {axis: F.col(f"_{end}_{axis}_{k}") for axis in ("lon", "lat")}

    crossings = sum((crossing(lon, lat, edge(k, "b"), edge(k, "a")) for k in range(FEW_EDGES)), F.lit(0))
    placed = points.withColumn("cx", grid_cell(lon, cell)).withColumn("cy", grid_cell(lat, cell))

    def meeting(part: DataFrame, inside: Column) -> DataFrame:
        spread = part.withColumn("cx", F.explode("cx")).hint("merge")
        met = placed.join(spread, ["cx", "cy"]).where(inside)
        return met.drop("cx", "cy", "_edges", *[f"_{end}_{axis}_{k}" for k in range(FEW_EDGES) for end in "ba" for axis in ("lon", "lat")])

    by_edges = meeting(rows.where(few).select("*", *flat), crossings % 2 == 1)
    return by_edges.union(meeting(rows.where(many), point_in_ring(lon, lat, F.col("ring"))))


def resolve_names(
    df: DataFrame, name: str, catalogue: DataFrame, code: str, label: str, aliases: Mapping[str, str] | None = None
) -> DataFrame:
    """``code`` of the catalogue for each name, compared without accents and case; ``aliases`` maps old names to labels.

    Names are resolved once per distinct spelling, so a name on many rows costs one look-up.
    """
    folded = strip_accents(name)
    for old, new in (aliases or {}).items():
        folded = F.when(folded == old, F.lit(new)).otherwise(folded)
    spellings = df.select(name).distinct().withColumn("folded", folded)
    known = catalogue.select(code, strip_accents(label).alias("folded"))
    resolved = with_catalogue(spellings, known, ["folded"]).select(name, code)
    return with_catalogue(df, resolved, [name])


def unresolved(df: DataFrame, code: str, name: str) -> DataFrame:
    """Names that found no code, with their rows; a load goes on only when this is empty."""
    return df.where(F.col(code).isNull()).groupBy(name).agg(F.count(F.lit(1)).alias("rows"))


def annotate(df: DataFrame, rules: Sequence[Mapping], start: Column, end: Column, tag: Column | None = None) -> DataFrame:
    """Add ``caveats``: codes of the rules whose period meets [start, end] and, where a rule names tags, the row's tag.

    ``rules`` are a short constant list of dicts ``code, since, until`` and optional ``tags``.
    """
    marks = []
    for rule in rules:
        applies = ~((end < rule["since"]) | (start > rule["until"]))
        if rule.get("tags"):
            applies = applies & tag.isin(*rule["tags"])
        marks.append(F.when(applies, F.lit(rule["code"])))
    return df.withColumn("caveats", F.array_compact(F.array(*marks)))
