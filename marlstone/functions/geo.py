"""Great-circle distances and their weights as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS = 6372797.6  # metres
GRID = 57600.0  # steps of a degree in the stored precision, 1/16 of an arc second


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres between two points, by the haversine formula."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * RADIUS * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def nearest(points: Column, lon: float, lat: float) -> Column:
    """Metres from (lon, lat) to the nearest of an array of points; null without any."""
    return F.array_min(F.transform(points, lambda p: distance(p["lon"], p["lat"], F.lit(float(lon)), F.lit(float(lat)))))


def weight(metres: Column) -> Column:
    return 1000.0 / (metres + 1000.0)


def stored(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Coordinates at the stored precision: longitude in [0, 360), 0 at the poles."""
    lat = F.round(lat * GRID) / GRID
    lon = F.pmod(F.round(F.pmod(lon, F.lit(360.0)) * GRID) / GRID, F.lit(360.0))
    return F.when(F.abs(lat) == 90.0, F.lit(0.0)).otherwise(lon), lat


def inside(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    """Whether a point lies in a box, which may cross the meridian where longitudes wrap."""
    x, w, e = F.pmod(lon, F.lit(360.0)), west % 360.0, east % 360.0
    across = x.between(w, e) if w <= e else (x >= w) | (x <= e)
    return across & lat.between(south, north)
