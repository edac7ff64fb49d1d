"""Filters as predicates: terms, ranges, existence, compounds, geography, tenants, expiry."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_METRES = 6_371_008.8


@dataclass(frozen=True)
class Term:
    field: str
    value: object

    def predicate(self) -> Column:
        return F.col(self.field) == F.lit(self.value)


@dataclass(frozen=True)
class Range:
    """Between min and max; an empty or missing bound is open.  Bounds may be strings: Spark casts them to the column's type."""

    field: str
    min: object = None
    max: object = None
    min_exclusive: bool = False
    max_exclusive: bool = False

    def predicate(self) -> Column:
        c, out = F.col(self.field), F.lit(True)
        if self.min not in (None, ""):
            out = out & (c > F.lit(self.min) if self.min_exclusive else c >= F.lit(self.min))
        if self.max not in (None, ""):
            out = out & (c < F.lit(self.max) if self.max_exclusive else c <= F.lit(self.max))
        return out


@dataclass(frozen=True)
class Exists:
    field: str
    must_exist: bool = True

    def predicate(self) -> Column:
        there = F.col(self.field).isNotNull() & (F.col(self.field).cast("string") != "")
        return there if self.must_exist else ~there


@dataclass(frozen=True)
class Near:
    """Within some metres of a point, on the great circle."""

    lat: str
    lon: str
    at_lat: float
    at_lon: float
    metres: float

    def predicate(self) -> Column:
        # a box of latitude first: it can be pushed to the scan
        reach = math.degrees(self.metres / EARTH_METRES)
        return F.col(self.lat).between(self.at_lat - reach, self.at_lat + reach) & (haversine(F.col(self.lat), F.col(self.lon), self.at_lat, self.at_lon) <= self.metres)


@dataclass(frozen=True)
class Box:
    """A bounding box; left > right crosses the antimeridian."""

    lat: str
    lon: str
    top: float
    left: float
    bottom: float
    right: float

    def predicate(self) -> Column:
        lon = F.col(self.lon)
        across = lon.between(self.left, self.right) if self.left <= self.right else (lon >= self.left) | (lon <= self.right)
        return F.col(self.lat).between(self.bottom, self.top) & across


@dataclass(frozen=True)
class Compound:
    """All of `must`, one of `should` if there are any, none of `must_not`; with operator OR one of `must` and `should`."""

    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()
    operator: str = "AND"

    def predicate(self) -> Column:
        must, should = [f.predicate() for f in self.must], [f.predicate() for f in self.should]
        none = [~F.coalesce(f.predicate(), F.lit(False)) for f in self.must_not]
        if self.operator.upper() == "OR":
            some = [reduce(lambda a, b: a | b, must + should)] if must + should else []
        else:
            some = must + ([reduce(lambda a, b: a | b, should)] if should else [])
        return reduce(lambda a, b: a & b, some + none, F.lit(True))


Filter = Term | Range | Exists | Near | Box | Compound


def haversine(lat: Column, lon: Column, at_lat: float, at_lon: float) -> Column:
    a, b = F.radians(lat), F.radians(lon)
    p, q = F.radians(F.lit(at_lat)), F.radians(F.lit(at_lon))
    h = F.pow(F.sin((a - p) / 2), 2) + F.cos(a) * F.cos(p) * F.pow(F.sin((b - q) / 2), 2)
    return 2 * EARTH_METRES * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def conjunction(filters: Iterable[Filter]) -> Column:
    """Terms of one field are alternatives; everything else must hold."""
    terms: dict[str, list[object]] = {}
    out: list[Column] = []
    for f in filters:
        if isinstance(f, Term):
            terms.setdefault(f.field, []).append(f.value)
        else:
            out.append(f.predicate())
    out += [F.col(name).isin(values) for name, values in terms.items()]
    return reduce(lambda a, b: a & b, out, F.lit(True))


def where(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    return df.where(conjunction(filters))


def delete_where(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    """What is left when the rows that the filters hold for are deleted; rows they are null for stay."""
    return df.where(~F.coalesce(conjunction(filters), F.lit(False)))


def tenant(df: DataFrame, name: object, column: str = "tenant_id") -> DataFrame:
    return df.where(F.col(column) == F.lit(name))


def alive(created: Column, ttl_seconds: Column, as_of: datetime | str) -> Column:
    """Not expired at a given moment; without a lifetime a row never expires."""
    seconds = F.unix_seconds(F.lit(str(as_of)).cast("timestamp")) - F.unix_seconds(created.cast("timestamp"))
    return ttl_seconds.isNull() | (ttl_seconds <= 0) | (seconds < ttl_seconds)


__all__ = ["Box", "Compound", "Exists", "Filter", "Near", "Range", "Term", "alive", "conjunction", "delete_where", "haversine", "tenant", "where"]
