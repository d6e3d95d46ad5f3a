"""Distances and road classes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6371000.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres, by the atan2 form."""
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))  # a may pass 1 by rounding, at antipodes


def haversine_asin(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.sin(F.radians(lat2 - lat1) / 2) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(F.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def line_length(coords: Column, form=haversine) -> Column:
    """Metres, by one form of the distance, along an array of structs (lon, lat), summed from left to right; fewer than two points: 0."""
    pairs = F.zip_with(F.slice(coords, 1, F.greatest(F.size(coords) - 1, F.lit(0))), F.slice(coords, 2, F.greatest(F.size(coords) - 1, F.lit(0))), lambda a, b: form(a["lat"], a["lon"], b["lat"], b["lon"]))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def class_family(road_class: Column) -> Column:
    """Lower case, without white space around, and without the mark of a link; null is none."""
    return F.coalesce(F.regexp_replace(F.lower(F.regexp_replace(road_class, r"(?U)^\s+|\s+$", "")), "_link$", ""), F.lit(""))


def class_penalty(road_class: Column) -> Column:
    f = class_family(road_class)
    return F.when(f == "motorway", 1.0).when(f == "trunk", 1.1).when(f == "primary", 1.25).when(f == "secondary", 1.5).otherwise(2.0)


def class_rank(road_class: Column) -> Column:
    f = class_family(road_class)
    return F.when(f == "motorway", 0).when(f == "trunk", 1).when(f == "primary", 2).when(f == "secondary", 3).otherwise(4)


def tile_bounds(z: int, x: int, y: int) -> tuple[float, float, float, float]:
    """West, south, east, north of a web-mercator tile."""
    import math

    n = 2**z
    lat = lambda row: math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * row / n))))
    return x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y)
