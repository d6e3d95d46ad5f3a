"""Road edges as columns: coordinates, orientation, merge keys and ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LINE = "array<struct<lon:double,lat:double>>"
EDGE = f"edge_id string, u long, v long, road_class string, oneway string, name string, ref string, line {LINE}"
#: What edges must agree in to become one.
MERGE_KEY = ("road_class", "oneway", "name", "ref")


def coordinates(line: Column) -> Column:
    """The points that have both coordinates; null lines have none."""
    points = F.filter(line, lambda p: p["lon"].isNotNull() & p["lat"].isNotNull())
    return F.coalesce(points, F.array().cast(LINE))


def oriented(line: Column, u: Column, v: Column, start: Column, end: Column) -> Column:
    """The line of an edge u-v from start to end; no points if these are not its ends, or if it has fewer than two."""
    forth, back = (u == start) & (v == end), (u == end) & (v == start)
    return F.when(F.size(line) < 2, F.array().cast(LINE)).when(forth, line).when(back, F.reverse(line)).otherwise(F.array().cast(LINE))


def points_text(line: Column) -> Column:
    """Seven decimals a coordinate; of inputs with more the engine's rounding of halves would show."""
    return F.array_join(F.transform(line, lambda p: F.format_string("%.7f,%.7f", p["lon"], p["lat"])), ";")


def _id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts]), 256), 1, 24)


def raw_id(way: Column, segment: Column, u: Column, v: Column, road_class: Column, line: Column) -> Column:
    return _id(way, segment, u, v, road_class, points_text(line))


def split_id(edge_id: Column, part: Column, u: Column, v: Column, line: Column) -> Column:
    return _id(edge_id, part, u, v, points_text(line))


def merged_id(parts: Column, u: Column, v: Column, key: list[Column], line: Column) -> Column:
    """parts: ids of the edges that became one; missing attributes count as None."""
    return _id(F.array_join(F.array_sort(F.array_distinct(parts)), ","), u, v, *key, points_text(line))

