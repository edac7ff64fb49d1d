"""Cells: the rows of full scans, over the antimeridian and the poles, from scans that get ranges of cells."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from corpusframe.operators import geo, postings
from corpusframe.operators.filters import Box, Near, haversine


@pytest.fixture(scope="module")
def points(spark, tmp_path_factory):
    r = random.Random(2)
    rows = [(math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)) for _ in range(3000)]
    rows += [(r.gauss(48, 0.2), r.gauss(11, 0.2)) for _ in range(300)]
    rows += [(90.0, 0.0), (-90.0, 77.0), (0.0, 180.0), (0.0, -180.0), (12.5, 180.0), (-33.0, -180.0), (0.0, 0.0), (89.999, 179.999), (None, 1.0), (1.0, None), (48.0, 371.0), (95.0, 11.0)]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(rows)], "id long, lat double, lon double")
    return postings.written(df.withColumn("cell", geo.cell(F.col("lat"), F.col("lon"))), str(tmp_path_factory.mktemp("cells")), "cell", "id")


def test_numbers(points):
    for r in points.collect():
        if r.lat is None or r.lon is None or abs(r.lat) > 90 or abs(r.lon) > 180:
            assert r.cell is None
        else:
            assert r.cell == geo._number(geo._place(r.lon, -180.0, 360.0), geo._place(r.lat, -90.0, 180.0))
    assert geo._number(geo.SIDE - 1, geo.SIDE - 1) == geo.SIDE**2 - 1 and geo._number(1, 0) == 1 and geo._number(0, 1) == 2


CIRCLES = [(lat, lon, m) for lat, lon in [(48, 11), (0, 180), (0, -180), (12, 179.5), (-33, -179.9), (90, 0), (-89.5, 20), (88, -170), (0, 0), (60, 540)] for m in (10.0, 30_000.0, 900_000.0, 6_000_000.0, 25_000_000.0)]


@pytest.mark.parametrize(("lat", "lon", "metres"), CIRCLES)
def test_circles(lat, lon, metres):
    """The areas hold every point of the circle, by its edge and within."""
    areas = geo.areas(Near("lat", "lon", lat, lon, metres))
    r = random.Random(1)
    for _ in range(300):
        d, a = metres / geo.EARTH_METRES * math.sqrt(r.random()), r.uniform(0, 2 * math.pi)
        p = math.radians(lat)
        q = math.asin(max(-1, min(1, math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(a))))
        to = math.radians(lon) + math.atan2(math.sin(a) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q))
        x, y = geo._place((math.degrees(to) + 180) % 360 - 180, -180.0, 360.0), geo._place(math.degrees(q), -90.0, 180.0)
        assert any(a0 <= x <= a1 and b0 <= y <= b1 for a0, a1, b0, b1 in areas)


def test_ranges_cover_their_areas():
    r = random.Random(9)
    for _ in range(60):
        x, y = sorted(r.sample(range(geo.SIDE), 2)), sorted(r.sample(range(geo.SIDE), 2))
        for most in (4, 48):
            found = geo.ranges([(*x, *y)], most)
            assert len(found) <= max(most, 4) and all(a <= b for a, b in found) and all(found[i][1] + 1 < found[i + 1][0] for i in range(len(found) - 1))
            for _ in range(20):
                n = geo._number(r.randint(*x), r.randint(*y))
                assert any(a <= n <= b for a, b in found)
    assert geo.ranges([(5, 5, 9, 9)]) == [(geo._number(5, 9), geo._number(5, 9))] and geo.ranges([(0, geo.SIDE - 1, 0, geo.SIDE - 1)]) == [(0, geo.SIDE**2 - 1)]


@pytest.mark.parametrize("of", [Near("lat", "lon", 48, 11, 25_000), Near("lat", "lon", 0, 180, 500_000), Near("lat", "lon", 89.9, 5, 800_000), Near("lat", "lon", -90, 0, 100), Near("lat", "lon", 3, -60, 3e7), Box("lat", "lon", 40, 150, -20, -140), Box("lat", "lon", 90, -180, -90, 180), Box("lat", "lon", 49, 10, 47, 12)], ids=str)
def test_areas_give_the_rows_of_a_scan(points, of):
    assert sorted(r.id for r in geo.within(points, of).collect()) == sorted(r.id for r in points.where(of.predicate()).collect())


@pytest.mark.parametrize(("lat", "lon", "k"), [(48, 11, 10), (0, 180, 5), (90, 0, 7), (-60, -120, 40), (10, 10, 5000)])
def test_nearest(points, lat, lon, k):
    km = F.round(haversine(F.col("lat"), F.col("lon"), lat, lon) / 1000, 3)
    want = points.withColumn("km", km).where("lat IS NOT NULL AND lon IS NOT NULL").orderBy("km", "id").limit(k)
    assert [(r.id, r.km) for r in geo.nearest(points, "lat", "lon", lat, lon, k, "id").collect()] == [(r.id, r.km) for r in want.collect()]


def test_the_scan_gets_ranges(points):
    plan = geo.within(points, Near("lat", "lon", 48, 11, 1000))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(cell," in plan and "IsNull(cell)" in plan
    few = sum(b - a + 1 for a, b in geo.ranges(geo.areas(Near("lat", "lon", 48, 11, 1000)))) / geo.SIDE**2
    assert few < 1e-7
