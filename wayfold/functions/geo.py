"""Geometry and scores as column expressions. Angles are degrees, distances kilometres."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def half_up(x: Column) -> Column:
    """Rounding with halves towards plus infinity, unlike ``round``."""
    return F.floor(x + F.lit(0.5))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance."""
    half = lambda a, b: F.sin((F.radians(b) - F.radians(a)) / 2)
    h = half(lat1, lat2) * half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2) * half(lon1, lon2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(h))


def planar_order(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """A monotone stand-in for distance near a point: squared degrees, longitude weighted by cos^2 of the latitude to 2 decimals."""
    weight = F.round(F.pow(F.cos(F.radians(lat0)), F.lit(2.0)), 2)
    return (lat - lat0) * (lat - lat0) + (lon - lon0) * (lon - lon0) * weight


def in_box(lat: Column, lon: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(south, north) & lon.between(west, east)


def cell(x: Column, per_degree: int) -> Column:
    return F.floor(x * per_degree).cast("long")


def neighbour_cells(lat: Column, lon: Column, per_degree: int) -> Column:
    """The 3 x 3 cells (y, x) around a point."""
    around = F.array(*map(F.lit, (-1, 0, 1)))
    y, x = cell(lat, per_degree), cell(lon, per_degree)
    return F.flatten(F.transform(around, lambda i: F.transform(around, lambda j: F.struct((y + i).alias("y"), (x + j).alias("x")))))


def degrees_north(km: float) -> float:
    """The degrees of latitude that points ``km`` apart differ in at most, with room for rounding."""
    return math.degrees(km / EARTH_KM) * 1.001 + 1e-9


def cells_within(lat: Column, lon: Column, km: float, per_degree: int) -> Column:
    """Those of the 3 x 3 cells (y, x) around a point that may hold points at most ``km`` away."""
    north = F.lit(degrees_north(km))
    east = north / F.greatest(F.cos(F.radians(F.least(F.abs(lat) + north, F.lit(90.0)))), F.lit(1e-6)) * 1.001
    cells = lambda x, reach: F.sequence(F.greatest(cell(x - reach, per_degree), cell(x, per_degree) - 1), F.least(cell(x + reach, per_degree), cell(x, per_degree) + 1))
    return F.flatten(F.transform(cells(lat, north), lambda y: F.transform(cells(lon, east), lambda x: F.struct(y.alias("y"), x.alias("x")))))


def travel_minutes(km: Column) -> Column:
    """Up to 1.2 km on foot at 4.5 km/h, 3 minutes at least; else by taxi at 22 km/h plus 5 minutes, 8 at least; 20 if unknown."""
    walk = F.greatest(F.lit(3.0), F.ceil(km / 4.5 * 60).cast("double"))
    ride = F.greatest(F.lit(8.0), F.ceil(km / 22.0 * 60 + 5).cast("double"))
    return F.when(km.isNull(), 20.0).when(km <= 1.2, walk).otherwise(ride)


def rating_points(rating: Column, reviews: Column) -> Column:
    """Points of a rating with at least 20 reviews: (r - 4) * 14, in full from 150 reviews on."""
    weight = F.least(F.lit(1.0), reviews / 150.0)
    return F.when(reviews >= 20, half_up((rating - 4) * 14 * weight)).otherwise(0).cast("long")


def taste_points(taste: Column, dna: Column) -> Column:
    """Sum over traits of weight * (trait - 50) / 14, clamped to 45 either way. Both are maps of trait to number."""
    total = F.aggregate(F.map_entries(taste), F.lit(0.0), lambda a, e: a + e["value"] * (F.coalesce(F.element_at(dna, e["key"]), F.lit(50.0)) - 50) / 14)
    return F.least(F.lit(45.0), F.greatest(F.lit(-45.0), total))


def flat_metres(lat: Column, lon: Column, lat0: Column, lon0: Column) -> Column:
    """Metres on a flat map whose longitudes shrink by the cosine of the middle latitude."""
    north, east = F.radians(lat - lat0), F.radians(lon - lon0) * F.cos(F.radians((lat + lat0) / 2))
    return EARTH_KM * 1000 * F.sqrt(north * north + east * east)


def is_swapped(a: Column, b: Column, lat0: float, lon0: float) -> Column:
    """Whether two coordinates near a city are longitude and latitude rather than latitude and longitude."""
    as_said = F.abs(a - lat0) + F.abs(b - lon0)
    return F.abs(b - lat0) + F.abs(a - lon0) < as_said
