"""Distances, bounding boxes, grid cells and polygons on longitude/latitude columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius.
EARTH_RADIUS_M = 6_371_000


def haversine_m(lat: Column, lon: Column, lat0: Column | float, lon0: Column | float) -> Column:
    """Great-circle distance in metres, rounded half up to 0.1 m."""
    lat0 = lat0 if isinstance(lat0, Column) else F.lit(float(lat0))
    lon0 = lon0 if isinstance(lon0, Column) else F.lit(float(lon0))
    half_lat = F.sin(F.radians(lat - lat0) / 2)
    half_lon = F.sin(F.radians(lon - lon0) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat0)) * F.cos(F.radians(lat)) * half_lon * half_lon
    return F.floor(2 * EARTH_RADIUS_M * F.asin(F.sqrt(chord)) * 10 + 0.5).cast("double") / 10


def box_around(lat: Column, lon: Column, lat0: float, lon0: float, radius_m: float) -> Column:
    """Plain range predicates that reach the scan; exact distances are only computed inside them.

    The box is as wide as the circle at its latitude, open in longitude where the circle holds a pole, and in two parts
    where it crosses ±180°. Longitudes are between -180 and 180.
    """
    d_lat = math.degrees(radius_m / EARTH_RADIUS_M) * (1 + 1e-9)
    inside = lat.between(lat0 - d_lat, lat0 + d_lat)
    if abs(lat0) + d_lat >= 90:
        return inside
    # The meridian that touches the circle.
    d_lon = math.degrees(math.asin(math.sin(math.radians(d_lat)) / math.cos(math.radians(lat0)))) * (1 + 1e-9)
    west, east = lon0 - d_lon, lon0 + d_lon
    if west < -180:
        return inside & ((lon >= west + 360) | (lon <= east))
    if east > 180:
        return inside & ((lon >= west) | (lon <= east - 360))
    return inside & lon.between(west, east)


def grid_cell(degrees: Column, cell_degrees: float) -> Column:
    return F.floor(degrees / F.lit(cell_degrees)).cast("long")


def crossing(lon: Column, lat: Column, b: Column, a: Column) -> Column:
    """1 if the edge between the points ``b`` and ``a`` (``lon``, ``lat``) lies to the right of the point, at its latitude."""
    spans = (b["lat"] > lat) != (a["lat"] > lat)
    at = b["lon"] + F.try_divide((a["lon"] - b["lon"]) * (lat - b["lat"]), a["lat"] - b["lat"])
    return F.when(spans & (lon < at), 1).otherwise(0)


def _next_in(ring: Column) -> Column:
    return F.concat(F.slice(ring, -1, 1), F.slice(ring, 1, F.size(ring) - 1))


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Ray casting over ``array<struct<lon,lat>>``: inside when an odd number of edges lie to the right of the point."""
    crossings = F.aggregate(F.zip_with(ring, _next_in(ring), lambda b, a: crossing(lon, lat, b, a)), F.lit(0), lambda acc, c: acc + c)
    return (F.size(ring) >= 3) & (crossings % 2 == 1)


def ring_edges(ring: Column) -> Column:
    """``array<struct<b,a>>``: the edges that some point may cross, in the order of the ring. Level edges and edges without all
    coordinates cross nothing; a ring of fewer than three points has none."""
    edges = F.zip_with(ring, _next_in(ring), lambda b, a: F.struct(b.alias("b"), a.alias("a")))
    whole = F.filter(edges, lambda e: (e["b"]["lat"] != e["a"]["lat"]) & e["b"]["lon"].isNotNull() & e["a"]["lon"].isNotNull())
    return F.when(F.size(ring) >= 3, whole)


def ring_of(points: Sequence[tuple[float, float]]) -> Column:
    """A constant ring from (lon, lat) pairs."""
    return F.array(*[F.struct(F.lit(float(x)).alias("lon"), F.lit(float(y)).alias("lat")) for x, y in points])


def ring_box(ring: Column) -> tuple[Column, Column, Column, Column]:
    """(min lon, max lon, min lat, max lat) of a ring."""
    lons = F.transform(ring, lambda p: p["lon"])
    lats = F.transform(ring, lambda p: p["lat"])
    return F.array_min(lons), F.array_max(lons), F.array_min(lats), F.array_max(lats)
