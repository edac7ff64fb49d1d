"""Geography by cells: points have the number of a cell on a space-filling curve, areas are ranges of such numbers.

The grid halves latitudes and longitudes `LEVEL` times; a cell's number is its place on the Z curve, so the cells of a square of the grid are one range.
An area is covered by some ranges, which the scan gets as a filter; then the exact test decides.  A table sorted by cell is read where the
ranges are.  Points that are null or off the globe have no cell and are always tested.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusframe.operators.filters import EARTH_METRES, Box, Near, haversine

LEVEL = 16
SIDE = 1 << LEVEL
RANGES = 48
HALF_ROUND = math.pi * EARTH_METRES
Area = tuple[int, int, int, int]  # of the grid: from x, to x, from y, to y, ends included
_STEPS = ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555))


def _spread(v: Column) -> Column:
    for by, mask in _STEPS:
        v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def cell(lat: Column, lon: Column) -> Column:
    """The number of a point's cell, a long; null where there is none."""
    place = lambda v, low, width: F.least(F.floor((v - low) / width * SIDE).cast("long"), F.lit(SIDE - 1).cast("long"))
    number = _spread(place(lon, -180.0, 360.0)).bitwiseOR(F.shiftleft(_spread(place(lat, -90.0, 180.0)), 1))
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), number)


def _number(x: int, y: int) -> int:
    out = 0
    for v, shift in ((x, 0), (y, 1)):
        for by, mask in _STEPS:
            v = (v | v << by) & mask
        out |= v << shift
    return out


def _place(v: float, low: float, width: float) -> int:
    return max(0, min(math.floor((v - low) / width * SIDE), SIDE - 1))


def _area(bottom: float, top: float, left: float, right: float) -> Area:
    return _place(left, -180.0, 360.0), _place(right, -180.0, 360.0), _place(bottom, -90.0, 180.0), _place(top, -90.0, 180.0)


def areas(of: Near | Box) -> list[Area]:
    """One or two areas of the grid that hold what the filter holds; across the antimeridian it takes two, around a pole all longitudes."""
    if isinstance(of, Box):
        parts = [(of.left, of.right)] if of.left <= of.right else [(of.left, 180.0), (-180.0, of.right)]
        return [_area(of.bottom, of.top, a, b) for a, b in parts]
    reach = of.metres / EARTH_METRES + 1e-9
    bottom, top = of.at_lat - math.degrees(reach), of.at_lat + math.degrees(reach)
    if bottom <= -90 or top >= 90 or reach >= math.pi / 2:
        return [_area(bottom, top, -180.0, 180.0)]
    half = math.degrees(math.asin(min(1.0, math.sin(reach) / math.cos(math.radians(of.at_lat))))) + 1e-9
    if half >= 180:
        return [_area(bottom, top, -180.0, 180.0)]
    lon = (of.at_lon + 180) % 360 - 180
    left, right = lon - half, lon + half
    parts = [(left, right)]
    if left < -180:
        parts = [(-180.0, right), (left + 360, 180.0)]
    elif right >= 180:
        parts = [(left, 180.0), (-180.0, right - 360)]
    return [_area(bottom, top, a, b) for a, b in parts]


def ranges(areas_: list[Area], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of cells that cover the areas: squares are cut into four while there are not too many."""

    def how(x: int, y: int, level: int) -> int:
        """2: within an area, 1: in part, 0: not at all."""
        size = 1 << (LEVEL - level)
        x0, y0 = x * size, y * size
        x1, y1 = x0 + size - 1, y0 + size - 1
        return max((2 if a <= x0 and x1 <= b and c <= y0 and y1 <= d else 1 if x0 <= b and a <= x1 and y0 <= d and c <= y1 else 0) for a, b, c, d in areas_)

    whole, edge, level = [], [(0, 0)], 0
    while edge and level < LEVEL:
        parts = [(how(2 * x + i, 2 * y + j, level + 1), 2 * x + i, 2 * y + j) for x, y in edge for i in (0, 1) for j in (0, 1)]
        inside, cut = [(level + 1, x, y) for k, x, y in parts if k == 2], [(x, y) for k, x, y in parts if k == 1]
        if len(whole) + len(inside) + len(cut) > most:
            break
        whole, edge, level = whole + inside, cut, level + 1
    out: list[tuple[int, int]] = []
    for at, x, y in sorted(whole + [(level, x, y) for x, y in edge], key=lambda s: _number(s[1], s[2]) << 2 * (LEVEL - s[0])):
        first = _number(x, y) << 2 * (LEVEL - at)
        last = first + (1 << 2 * (LEVEL - at)) - 1
        if out and out[-1][1] + 1 == first:
            out[-1] = (out[-1][0], last)
        else:
            out.append((first, last))
    return out


def within(df: DataFrame, of: Near | Box, column: str = "cell") -> DataFrame:
    """The rows in a circle or box, of a table with cells."""
    c = F.col(column)
    return df.where(reduce(lambda a, b: a | b, [c.between(a, b) for a, b in ranges(areas(of))], c.isNull()) & of.predicate())


def nearest(df: DataFrame, lat: str, lon: str, at_lat: float, at_lon: float, k: int, key: str, column: str = "cell", start: float = 10_000.0) -> DataFrame:
    """The k nearest rows with their distance `km`, to the metre, ties by key: circles grow until one holds k, and each reads its own cells only."""
    metres, df = start, df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    while True:
        km = F.round(haversine(F.col(lat), F.col(lon), at_lat, at_lon) / 1000, 3)
        found = within(df, Near(lat, lon, at_lat, at_lon, metres), column).withColumn("km", km)
        if metres >= HALF_ROUND or found.where(F.col("km") < metres / 1000 - 0.001).limit(k).count() >= k:
            return found.orderBy("km", key).limit(k)
        metres = min(metres * 4, HALF_ROUND + 1)
