import math
import random

import pytest
from pyspark.sql import functions as F

from censora.functions import geo
from censora.operators import joins as J
from censora.queries import load


def distance(a, b):
    (lat, lon), (lat0, lon0) = a, b
    chord = math.sin(math.radians(lat - lat0) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(lat0)) * math.sin(math.radians(lon - lon0) / 2) ** 2
    return 2 * geo.EARTH_RADIUS_M * math.asin(math.sqrt(chord))


@pytest.mark.parametrize(("lat", "lon"), [(19.4, -99.1), (70.0, 20.0), (89.5, 10.0), (-89.9, 0.0), (0.0, 179.95), (65.0, -179.9), (90.0, 0.0)])
def test_no_site_is_lost_near_poles_and_the_date_line(frame, lat, lon):
    pick = random.Random(17)
    sites = []
    for i in range(600):
        y = min(90.0, max(-90.0, lat + pick.uniform(-0.6, 0.6)))
        x = lon + pick.uniform(-180, 180) * (1 if abs(lat) > 85 else 0.01)
        sites.append((i, y, (x + 180) % 360 - 180))
    radius = 50_000.0
    want = {i for i, y, x in sites if math.floor(distance((y, x), (lat, lon)) * 10 + 0.5) / 10 <= radius}
    assert want
    rows = frame("site int, lat double, lon double", *sites)
    got = J.sites_near(frame("centre int, clat double, clon double", (1, lat, lon)), rows, radius)
    assert sorted(r.site for r in got.collect()) == sorted(want)
    box = rows.where(geo.box_around(F.col("lat"), F.col("lon"), lat, lon, radius))
    assert want <= {r.site for r in box.collect()}


def holds(ring, x, y):
    """Ray casting as in the reference, edge by edge."""
    inside = False
    for (bx, by), (ax, ay) in zip(ring, ring[-1:] + ring[:-1]):
        if (by > y) != (ay > y) and x < bx + (ax - bx) * (y - by) / (ay - by):
            inside = not inside
    return len(ring) >= 3 and inside


def test_covering_polygons_of_every_shape(frame):
    pick = random.Random(23)
    star = [((2 + 1.9 * (k % 2)) * math.cos(k / 20 * math.pi), (2 + 1.9 * (k % 2)) * math.sin(k / 20 * math.pi)) for k in range(40)]
    rings = [
        [(-0.5, -0.5), (1.5, -0.5), (1.5, 1.0), (-0.5, 1.0)],
        [(0.0, 0.0), (3.0, 0.5), (1.0, 2.5)],
        [(-2.0, -2.0), (2.0, -2.0), (2.0, 2.0), (0.0, -1.0), (-2.0, 2.0)],
        [(-1.0, -1.0), (1.0, 1.0), (1.0, -1.0), (-1.0, 1.0)],
        star,
        [(0.0, 0.0), (1.0, 1.0)],
        [(1.0, 1.0)] * 4,
    ]
    places = [(pick.uniform(-4, 4), pick.uniform(-4, 4)) for _ in range(500)] + [(x / 2, y / 2) for x in range(-6, 7) for y in range(-6, 7)]
    points = frame("point int, lon double, lat double", *[(i, *p) for i, p in enumerate(places)], (-1, None, 0.0), (-2, 0.0, None))
    polygons = frame("polygon int, ring array<struct<lon: double, lat: double>>", *enumerate(rings), (-1, None))
    got = J.covering_polygons(points, polygons)
    assert got.columns == ["point", "lon", "lat", "polygon", "ring"]
    want = sorted((i, k) for i, (x, y) in enumerate(places) for k, ring in enumerate(rings) if holds(ring, x, y))
    assert sorted((r.point, r.polygon) for r in got.collect()) == want
    assert {k for _, k in want} == {0, 1, 2, 3, 4}


def test_points_of_one_file_are_covered_by_many_tasks(spark):
    """The points of d22 are one small file: a broadcast of the polygons left every pair to the one task that read it."""
    plan = load()["d22_covering_polygons"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
