"""What a map asks for: cells and facilities as features, tiles, roads and railways, places, routes between regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.functions.geo import tile_bounds
from terracell.functions.lines import simplified
from terracell.sources import arrays

#: Default and largest numbers of features that a listing returns, and the road classes of the overlay.
LIMITS = {"facilities": (10_000, 10_000), "cells": (200_000, 200_000), "places": (10_000, 50_000), "transport": (200_000, 500_000), "catalog": (50, 200)}
OVERLAY_ROADS = ("motorway", "trunk", "secondary")


def limit_of(kind: str, asked: int | None) -> int:
    default, most = LIMITS[kind]
    if asked is None:
        return default
    if not 1 <= asked <= most:
        raise ValueError(f"a limit of {kind} lies between 1 and {most}")
    return asked


def boundary(cell: Column) -> Column:
    """A closed ring (lon, lat) of a cell, counter-clockwise from the south-west; no neighbours' longitudes are more than 180 degrees apart."""
    west, south = quad.west_south(cell)
    n = F.pow(F.lit(2.0), quad.res(cell).cast("double"))
    east, north = west + 360.0 / n, south + 180.0 / n
    point = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return unwrapped(F.array(point(west, south), point(east, south), point(east, north), point(west, north), point(west, south)))


def unwrapped(ring: Column) -> Column:
    """A ring whose longitudes are moved by whole turns until neighbours are at most 180 degrees apart; the last point repeats the first."""

    def step(done: Column, p: Column) -> Column:
        last = F.element_at(done, -1)["lon"]
        turns = F.ceil((F.abs(p["lon"] - last) - 180.0) / 360.0)
        moved = F.when(F.abs(p["lon"] - last) <= 180.0, p["lon"]).otherwise(p["lon"] - F.signum(p["lon"] - last) * turns * 360.0)
        return F.concat(done, F.array(F.struct(moved.alias("lon"), p["lat"].alias("lat"))))

    start = F.array(F.struct(ring[0]["lon"].alias("lon"), ring[0]["lat"].alias("lat")))
    body = F.aggregate(F.slice(ring, 2, F.greatest(F.size(ring) - 2, F.lit(0))), start, step)
    return F.when(F.size(ring) < 2, ring).otherwise(F.concat(body, F.slice(body, 1, 1)))


def feature(kind: str, coordinates: Column, properties: list[str | Column]) -> Column:
    """One GeoJSON feature as text; properties that are null are left out."""
    geometry = F.struct(F.lit(kind).alias("type"), coordinates.alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")))


def pairs_of(line: Column) -> Column:
    return F.transform(line, lambda p: F.array(p["lon"], p["lat"]))


def layer_cells(cells: DataFrame, layer: str, limit: int | None = None, split_threshold: int | None = None) -> DataFrame:
    """feature of the first cells (cell, resolution, layer_value, others) in order of cell; splitting on request is refused."""
    if split_threshold is not None:
        raise ValueError(f"split_threshold is not supported for {layer}")
    others = [c for c in cells.columns if c not in ("cell", "resolution", "layer_value")]
    properties = ["cell", F.lit(layer).alias("layer_name"), F.col("layer_value").cast("string").alias("layer_value"), F.col("resolution").cast("int").alias("resolution"), *others]
    first = cells.orderBy("cell").limit(limit_of("cells", limit))
    return first.select("cell", feature("Polygon", F.array(pairs_of(boundary(F.col("cell")))), properties).alias("feature"))


def facilities(rows: DataFrame, source: str | None = None, org: str | None = None, cell: int | None = None, res: int = 7, limit: int | None = None, key: str = "facility_id") -> DataFrame:
    """Facilities that meet all filters given, in order of id; a filter on a cell is ignored where the table has no such column."""
    for name, value in (("source_name", source), ("org_name", org), (f"cell_r{res}", cell)):
        if value is not None and (name in rows.columns or not name.startswith("cell_r")):
            rows = rows.where(F.col(name) == F.lit(value))
    return rows.orderBy(key).limit(limit_of("facilities", limit))


def tile(points: DataFrame, cells: DataFrame, z: int, x: int, y: int, extent: int = 4096) -> DataFrame:
    """layer, id, geometry (points in the tile's own units, from its north-west corner): facilities by place, cells by their centre; the borders count as inside."""
    west, south, east, north = tile_bounds(z, x, y)
    within = lambda lat, lon: lon.between(west, east) & lat.between(south, north)
    px = lambda lon: F.round((lon - west) / (east - west) * extent).cast("int")
    py = lambda lat: F.round((F.lit(north) - lat) / (north - south) * extent).cast("int")
    spot = lambda lon, lat: F.struct(px(lon).alias("x"), py(lat).alias("y"))
    one = points.where(within(F.col("lat"), F.col("lon"))).select(F.lit("facility_points").alias("layer"), F.col("id").cast("string").alias("id"), F.array(spot(F.col("lon"), F.col("lat"))).alias("geometry"))
    two = cells.where(within(*quad.centre(F.col("cell")))).select(F.lit("h3_cells").alias("layer"), F.col("cell").cast("string").alias("id"), F.transform(boundary(F.col("cell")), lambda p: spot(p["lon"], p["lat"])).alias("geometry"))
    return one.unionByName(two)


def overlay(roads: DataFrame, railways: DataFrame) -> DataFrame:
    """country_code, transport_class, id, line of roads (country_code, fclass, id, line) of the overlay's classes, and of all railways."""
    kind = F.lower(F.trim("fclass"))
    one = roads.where(kind.isin(*OVERLAY_ROADS)).select("country_code", kind.alias("transport_class"), "id", "line")
    return one.unionByName(railways.select("country_code", F.lit("rail").alias("transport_class"), "id", "line"))


def graph_overlay(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """country_code, transport_class, graph_feature_type, id, line of a graph's edges that have a class, and of its nodes if asked for."""
    kind = F.lower(F.trim("road_class"))
    out = edges.where(F.coalesce(kind, F.lit("")) != "").select("country_code", kind.alias("transport_class"), F.lit("edge").alias("graph_feature_type"), F.col("edge_id").alias("id"), "line")
    if nodes is None:
        return out
    point = F.array(F.struct("lon", "lat"))
    return out.unionByName(nodes.select("country_code", F.lit("graph_node").alias("transport_class"), F.lit("node").alias("graph_feature_type"), F.col("node_id").cast("string").alias("id"), point.alias("line")))


def transport(rows: DataFrame, country: str | None, key: str, limit: int | None = None) -> DataFrame:
    """The first features by country and key, of one country or all; an error for a country that has none."""
    if country is not None:
        code = country.strip().upper()
        rows = rows.where(F.col("country_code") == code)
        if rows.isEmpty():
            raise LookupError(f"no roads of {code}")
    return rows.orderBy("country_code", key).limit(limit_of("transport", limit))


def classes(rows: DataFrame) -> DataFrame:
    """One row: the distinct countries and classes of an overlay, sorted; nodes are no class."""
    kind = F.when(F.col("transport_class") != "graph_node", F.col("transport_class"))
    return rows.agg(F.array_sort(F.collect_set("country_code")).alias("countries"), F.array_sort(F.collect_set(kind)).alias("classes"))


def places(raw: DataFrame) -> DataFrame:
    """Populated places from a table with NAME, NAMEASCII, ADM0NAME, ISO_A2, FEATURECLA, POP_MAX, MIN_ZOOM, lon, lat; missing numbers are 0."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    number = lambda c, kind: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0)).cast(kind)
    return raw.select(text("NAME").alias("name"), text("NAMEASCII").alias("name_ascii"), text("ADM0NAME").alias("country_name"), F.upper(text("ISO_A2")).alias("country_code"), text("FEATURECLA").alias("feature_class"), number("POP_MAX", "long").alias("population_max"), number("MIN_ZOOM", "double").alias("min_zoom"), "lon", "lat")


def places_of(rows: DataFrame, country: str | None, limit: int | None = None) -> DataFrame:
    """Places of one country or all, the most populous first; an error for a country without any."""
    if country is not None:
        code = country.strip().upper()
        rows = rows.where(F.col("country_code") == code)
        if rows.isEmpty():
            raise LookupError(f"no places of {code}")
    return rows.orderBy(F.desc("population_max"), "name", "lon", "lat").limit(limit_of("places", limit))


ROUTE = "from_idx int, to_idx int, from_region_h3 string, to_region_h3 string, distance double, duration double, geometry struct<type:string,coordinates:array<array<double>>>"


def route_files(spark: SparkSession, path: str) -> DataFrame:
    """country_code, file, and a route a row of files named *-r7-regions-xx-routes.json; the country is that of the file's content, else of its name; files without one give nothing.

    `routes` is read by ranges of the file, the other fields apart, so a file may be of any size."""
    rows = arrays.elements(spark, path, "routes").select("file", "file_name", F.from_json("text", ROUTE).alias("route"))
    heads = arrays.header(spark, path, "routes").select("file", F.get_json_object("text", "$.country_code").alias("own"))
    rows = rows.join(heads, "file", "left").withColumn("file", F.col("file_name"))
    own, named = F.upper(F.trim("own")), F.upper(F.regexp_extract("file", r"(?i)-r7-regions-([a-z]{2})-routes\.json$", 1))
    rows = rows.withColumn("country_code", F.when(own.rlike("^[A-Z]{2}$"), own).otherwise(named)).where("country_code <> ''")
    return rows.select("country_code", "file", "route.*")


def region_routes(raw: DataFrame, compact: DataFrame | None = None, include_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """Routes (country_code, from_idx, to_idx, distance, duration, line) to show, and counts by country.

    raw: all routes, with line (null: none); compact: routes made smaller before, which are taken for the countries that have them unless routes from a region to itself are wanted."""
    own = F.col("from_idx") == F.col("to_idx")
    bare = F.col("line").isNull() | (F.size("line") < 2)
    wanted = F.lit(True) if include_self else ~own
    counts = raw.groupBy("country_code").agg(F.count(F.lit(1)).alias("routes"), F.count_if(own).alias("self_routes"), F.count_if(wanted & bare).alias("without_line"))
    columns = ["country_code", "from_idx", "to_idx", "distance", "duration", "line"]
    shown = raw.where(wanted & ~bare).select(*columns)
    if compact is not None and not include_self:
        ready = compact.select("country_code").distinct()
        shown = shown.join(ready, "country_code", "left_anti").unionByName(compact.select(*columns))
    return shown, counts


def compacted_routes(raw: DataFrame, tolerance: float, digits: int) -> DataFrame:
    """One route for each two regions: without those from a region to itself or without a line; the shorter of both directions (no distance loses, the first of equals), its line thinned and rounded."""
    rows = raw.where((F.col("from_idx") != F.col("to_idx")) & (F.size("line") >= 2))
    order = F.struct(F.coalesce("distance", F.lit(float("inf"))), "from_idx", "to_idx")
    best = rows.groupBy("country_code", F.least("from_idx", "to_idx").alias("a"), F.greatest("from_idx", "to_idx").alias("b")).agg(F.min_by(F.struct("from_idx", "to_idx", "distance", "duration", "line"), order).alias("r"), F.count(F.lit(1)).alias("directions"))
    return best.select("country_code", "r.from_idx", "r.to_idx", "r.distance", "r.duration", simplified(F.col("r.line"), tolerance, digits).alias("line"), "directions")


def country_codes(text: Column) -> Column:
    """ISO-2 codes of a comma-separated list, in capitals, each once in its first place; null if one of them is no code."""
    parts = F.array_distinct(F.filter(F.transform(F.split(text, ","), lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    return F.when(F.forall(parts, lambda x: x.rlike("^[A-Z]{2}$")), parts)


def first_int(row: Column, *names: str) -> Column:
    """The first of a map's entries that is a whole number."""
    return F.coalesce(*[F.element_at(row, F.lit(n)).try_cast("long") for n in names])


#: What a unit of each feature of a run counts.
WEIGHTS = {"facilities": 1.0, "domain_r4_cell_count": 8.0, "adaptive_leaf_count": 4.0, "smoothing_iterations": 200.0, "adjacency_checks": 0.05}
FALLBACK_SECONDS = 0.02


def complexity(features: Column) -> Column:
    """Weighted sum of a map's features; negative ones count as 0."""
    parts = [F.greatest(F.coalesce(F.element_at(features, F.lit(n)), F.lit(0.0)), F.lit(0.0)) * w for n, w in WEIGHTS.items()]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def runtime_estimate(reports: DataFrame, features: DataFrame) -> DataFrame:
    """seconds, low, high of runs (features map) from calibrations (features map, runtime_seconds): the median of seconds a point, with a band by how many there are."""
    rate = reports.select((F.col("runtime_seconds") / complexity(F.col("features"))).alias("rate")).where("rate > 0")
    known = rate.agg(F.median("rate").alias("rate"), F.count(F.lit(1)).alias("n"))  # calibrations are few
    band = F.when(F.col("n") == 1, 0.4).when(F.col("n") < 3, 0.3).otherwise(0.2)
    seconds = F.coalesce("rate", F.lit(FALLBACK_SECONDS)) * complexity(F.col("features"))
    return features.join(F.broadcast(known)).select("run", seconds.alias("seconds"), (seconds * (1 - band)).alias("low"), (seconds * (1 + band)).alias("high"))
