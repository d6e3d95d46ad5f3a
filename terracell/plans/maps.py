"""Queries of what a map asks for, and of masks from polygons, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions.edges import raw_id
from terracell.functions import quad
from terracell.functions.geo import tile_bounds
from terracell import runs
from terracell.operators import ingest, polygons, serving, tiles
from terracell.plans.cells import POLY, RES, RULES, _cell, _cover, _make, _partition_sql, _quadtree_sql, _up, adaptive_leaves
from terracell.plans.facilities import IDS, PLACES, records
from terracell.plans.roads import EDGE
from terracell.plans.service import route_pairs
from terracell.sources import derived
from terracell.sources.derived import facilities, road_edges, road_nodes, table

TILE = (2, 1, 1)
WEST, SOUTH, EAST, NORTH = tile_bounds(*TILE)


def shapes(spark, sf_dir):
    """The nations' rectangles as polygons."""
    point = lambda x, y: F.struct(F.col(x).alias("lon"), F.col(y).alias("lat"))
    ring = F.array(point("west", "south"), point("east", "south"), point("east", "north"), point("west", "north"))
    return derived.polygons(spark, sf_dir).select(F.lpad(F.col("iso").cast("string"), 2, "0").alias("iso"), "name", F.array(F.array(ring)).alias("shape"))


def facilities_by_filter(spark, sf_dir):
    rows = ingest.facilities(records(spark, sf_dir), (7,))
    return serving.facilities(rows, source="customers", org="BUILDING").select("facility_id", "org_name", "source_name", "cell_r7")


def cell_boundaries(spark, sf_dir):
    """Rings of the adaptive leaves."""
    ring = serving.boundary(F.col("cell"))
    return adaptive_leaves(spark, sf_dir).select("cell", F.size(ring).alias("points"), ring[0]["lon"].alias("west"), ring[0]["lat"].alias("south"), ring[2]["lon"].alias("east"), ring[2]["lat"].alias("north"), (ring[0] == ring[4]).alias("closed"))


def layer_cells(spark, sf_dir):
    """Features of the leaves, in order of cell: what their properties say."""
    cells = adaptive_leaves(spark, sf_dir).select("cell", F.col("res").alias("resolution"), F.col("n").alias("layer_value"))
    got = F.from_json("feature", "type string, geometry struct<type:string,coordinates:array<array<array<double>>>>, properties struct<cell:long,layer_name:string,layer_value:string,resolution:int>")
    rows = serving.layer_cells(cells, "facility_density_adaptive", 500).select(got.alias("f"))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geometry"), F.size(F.col("f.geometry.coordinates")[0]).alias("points"))


def tile_layers(spark, sf_dir):
    found = serving.tile(facilities(spark, sf_dir), adaptive_leaves(spark, sf_dir), *TILE)
    return found.select("layer", "id", F.size("geometry").alias("points"), F.col("geometry")[0]["x"].alias("x"), F.col("geometry")[0]["y"].alias("y"))


ZOOMS = (0, 4)


def tile_pyramid(spark, sf_dir):
    """Facilities and the cells that hold them in the tiles of all zooms: encoded, and read back from the bytes."""
    points = facilities(spark, sf_dir)
    cells = points.select(quad.cell(F.col("lat"), F.col("lon"), RES).alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("layer_value")).withColumn("layer_name", F.lit("density"))
    rows = tiles.read(tiles.pyramid(tiles.features_of(points, cells), *ZOOMS))
    first = F.col("points")[0]
    return rows.groupBy("z", "x", "y", "layer").agg(F.count(F.lit(1)).alias("features"), F.sum(F.size("points")).alias("points"), F.sum(first["x"]).alias("sum_x"), F.sum(first["y"]).alias("sum_y"))


def _roads(spark, sf_dir):
    nodes = road_nodes(spark, sf_dir)
    a, b = (nodes.selectExpr(f"node_id as {k}", f"named_struct('lon', lon, 'lat', lat) as {k}_at") for k in ("u", "v"))
    rows = road_edges(spark, sf_dir).join(a, "u").join(b, "v").withColumn("line", F.array("u_at", "v_at"))
    return rows.select(F.expr("element_at(array('AA', 'BB', 'CC'), cast(u % 3 as int) + 1)").alias("country_code"), F.expr("concat(' ', initcap(road_class))").alias("fclass"), "road_class", F.concat_ws("-", "u", "v").alias("id"), F.expr("u % 13 = 0").alias("rail"), "u", "v", "line")


def transport_overlay(spark, sf_dir):
    """Roads of the overlay's classes and railways (some of the roads) of one country."""
    rows = _roads(spark, sf_dir)
    return serving.transport(serving.overlay(rows.where("not rail"), rows.where("rail")), "aa", "id").select("country_code", "transport_class", "id")


def transport_classes(spark, sf_dir):
    rows = _roads(spark, sf_dir)
    return serving.classes(serving.overlay(rows.where("not rail"), rows.where("rail")))


def graph_overlay(spark, sf_dir):
    rows = _roads(spark, sf_dir)
    edges = rows.select("country_code", raw_id(F.col("u"), F.lit(0), F.col("u"), F.col("v"), F.col("road_class"), F.col("line")).alias("edge_id"), "road_class", "line")
    nodes = road_nodes(spark, sf_dir).select(F.lit("AA").alias("country_code"), "node_id", "lon", "lat")
    return serving.graph_overlay(edges, nodes).groupBy("country_code", "transport_class", "graph_feature_type").agg(F.count(F.lit(1)).alias("features"))


def populated_places(spark, sf_dir):
    raw = table(spark, sf_dir, "customer").selectExpr("concat(' ', c_name) as NAME", "c_name as NAMEASCII", "c_mktsegment as ADM0NAME", "element_at(array('us', 'DE', null), cast(c_custkey % 3 as int) + 1) as ISO_A2", "'Populated place' as FEATURECLA", "case when c_custkey % 5 = 0 then null else cast(c_custkey * 7 as string) end as POP_MAX", "case when c_custkey % 2 = 0 then '3.5' end as MIN_ZOOM", "cast(c_custkey % 360 - 180 as double) as lon", "cast(c_custkey % 180 - 90 as double) as lat")
    return serving.places_of(serving.places(raw), "us")


def _routes(spark, sf_dir):
    """Routes between nations, both ways, from each to itself too; some have no line."""
    rows = route_pairs(spark, sf_dir).select(F.col("a").alias("from_idx"), F.col("b").alias("to_idx"), "distance")
    own = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("from_idx"), F.col("n_nationkey").alias("to_idx"), F.lit(0.0).alias("distance"))
    line = F.array(*[F.struct((F.col("from_idx") * x + F.col("to_idx") * y).cast("double").alias("lon"), F.col(z).cast("double").alias("lat")) for x, y, z in ((1, 0, "from_idx"), (1, 1, "to_idx"), (0, 1, "to_idx"))])
    bare = (F.col("from_idx") + F.col("to_idx")) % 7 == 0
    rows = rows.unionByName(own).withColumns({"line": F.when(~bare, line), "duration": F.col("distance") / 10, "distance": F.when((F.col("from_idx") * F.col("to_idx")) % 5 != 1, F.col("distance") + F.col("from_idx"))})
    return rows.withColumn("country_code", F.when(F.col("from_idx") % 2 == 0, "TW").otherwise("AR"))


def region_route_counts(spark, sf_dir):
    shown, counts = serving.region_routes(_routes(spark, sf_dir))
    return counts.join(shown.groupBy("country_code").agg(F.count(F.lit(1)).alias("shown")), "country_code")


def region_routes_preferred(spark, sf_dir):
    """One country's routes come from the compacted ones, the other's from all."""
    raw = _routes(spark, sf_dir)
    ready = serving.compacted_routes(raw.where("country_code = 'TW'"), 0.001, 3)
    shown, _ = serving.region_routes(raw, ready)
    return shown.select("country_code", "from_idx", "to_idx", "distance")


def routes_compacted(spark, sf_dir):
    rows = _routes(spark, sf_dir).withColumn("country_code", F.lit("TW"))
    return serving.compacted_routes(rows, 0.001, 3).select("from_idx", "to_idx", "distance", "directions")


def run_estimates(spark, sf_dir):
    """Events stand for runs: seconds from features, by the median of calibrations."""
    e = table(spark, sf_dir, "events").withColumn("features", F.expr("map('facilities', cast(user_id as double), 'adaptive_leaf_count', value, 'smoothing_iterations', -1D)"))
    reports = e.where("event_id % 50 = 0").select("features", (F.col("event_id") % 9 + 1).cast("double").alias("runtime_seconds"))
    found = serving.runtime_estimate(reports, e.select(F.col("event_id").alias("run"), "features"))
    return found.select("run", *[F.round(c, 6).alias(c) for c in ("seconds", "low", "high")])


def polygon_cover(spark, sf_dir):
    return polygons.covering(shapes(spark, sf_dir), 5).select(F.col("iso").cast("int").alias("iso"), "cell", F.round("overlap", 9).alias("overlap"))


def polygon_quadtree(spark, sf_dir):
    found = polygons.quadtree(shapes(spark, sf_dir), [3, 4, 5, RES])
    return found.select("cell", F.col("iso").cast("int").alias("iso"))


def polygon_full_cells(spark, sf_dir):
    return polygons.cells_of(shapes(spark, sf_dir), 5, "full").select(F.col("iso").cast("int").alias("iso"), "cell")


def polygon_center_cells(spark, sf_dir):
    return polygons.cells_of(shapes(spark, sf_dir), 5, "center").select(F.col("iso").cast("int").alias("iso"), "cell")


def polygon_points(spark, sf_dir):
    """Facilities of each polygon, borders included."""
    found = polygons.covered_points(facilities(spark, sf_dir).select("id", "lat", "lon"), shapes(spark, sf_dir))
    return found.select("id", F.col("shape_iso").cast("int").alias("iso"))


def polygon_refined(spark, sf_dir):
    """Children that a polygon covers by more than a share, or the cell itself."""
    cells = polygons.covering(shapes(spark, sf_dir), 4).select("iso", "cell")
    return polygons.refined(cells, shapes(spark, sf_dir), 0.15).select(F.col("iso").cast("int").alias("iso"), "cell")


def polygon_uncovered(spark, sf_dir):
    """No point of a polygon lies outside the leaves that were cut to the polygons."""
    return polygons.uncovered_share(shapes(spark, sf_dir), adaptive_leaves(spark, sf_dir)).select("inside", "uncovered", F.round("share", 6).alias("share"))


def features(spark, sf_dir):
    """Three features a nation: two triangles that adjoin and make its rectangle, and a diamond over its east border."""
    point = lambda x, y: F.struct(F.expr(x).cast("double").alias("lon"), F.expr(y).cast("double").alias("lat"))
    lower, upper = [("west", "south"), ("east", "south"), ("west", "north")], [("east", "south"), ("east", "north"), ("west", "north")]
    diamond = [("east - 5", "north - 10"), ("east", "north - 14"), ("east + 5", "north - 10"), ("east", "north - 6")]
    rings = F.explode(F.array(*[F.array(*[point(*c) for c in ring]) for ring in (lower, upper, diamond)])).alias("ring")
    rows = derived.polygons(spark, sf_dir).select(F.lpad(F.col("iso").cast("string"), 2, "0").alias("iso"), "name", rings)
    return rows.select("iso", "name", F.array(F.array("ring")).alias("shape"))


def polygon_union_points(spark, sf_dir):
    """Facilities, each twice, of nations with features that overlap and adjoin."""
    points = facilities(spark, sf_dir).select("id", "lat", "lon")
    found = polygons.covered_points(points.union(points), features(spark, sf_dir))
    return found.select("id", F.col("shape_iso").cast("int").alias("iso"))


def polygon_union_cover(spark, sf_dir):
    """Shares of cells of two rectangles a nation that overlap, united."""
    rows = derived.polygons(spark, sf_dir)
    second = rows.selectExpr("iso", "name", "west + 12.5 as west", "south + 3.25 as south", "east + 7.75 as east", "north + 4.5 as north")
    shapes_ = polygons.boxes(rows.unionByName(second))
    return polygons.covering(shapes_, 6).select(F.col("iso").cast("int").alias("iso"), "cell", F.round("overlap", 9).alias("overlap"))


def run_layers(spark, sf_dir):
    """The layers of a run over true polygons: a mask of one resolution, which gives the partition its base, and the partition cut to the polygons."""
    rows = facilities(spark, sf_dir).withColumn("asof_date", F.expr("concat('2026-02-', 20 + id % 7)"))
    rules = {"base": 2, "root": 2, "min_output": RULES.min_output, "floor": RULES.floor, "most": RULES.most, "target": RULES.target, "interior": RULES.interior}
    config = {"layers": {"country_mask": {"resolution": RULES.base}, "facility_density_adaptive": rules}, "version": "v2"}
    found, _ = runs.computed(rows, config, shapes(spark, sf_dir))
    out = [c.select("cell", "resolution", F.col("layer_value").cast("int").alias("layer_value"), "layer_id", "asof_date") for c, _ in found.values()]
    return out[0].unionByName(out[1])


N_CELL, X_CELL, Y_CELL = "(1::BIGINT << (cell >> 50))::DOUBLE", "((cell >> 25) & 33554431)", "(cell & 33554431)"
BOX = f"{X_CELL} / {N_CELL} * 360.0 - 180.0 AS west, {Y_CELL} / {N_CELL} * 180.0 - 90.0 AS south, {X_CELL} / {N_CELL} * 360.0 - 180.0 + 360.0 / {N_CELL} AS east, {Y_CELL} / {N_CELL} * 180.0 - 90.0 + 180.0 / {N_CELL} AS north"
CODE = "['AA', 'BB', 'CC'][u % 3 + 1]"
SHOWN_ROADS = f"""ov AS (SELECT {CODE} AS country_code, CASE WHEN u % 13 = 0 THEN 'rail' ELSE road_class END AS transport_class, u || '-' || v AS id FROM edge WHERE u % 13 = 0 OR road_class IN ('motorway', 'trunk', 'secondary'))"""
_PAIRS = "SELECT a.n_nationkey AS f, b.n_nationkey AS t, (abs(a.n_nationkey * 53 % 340 - b.n_nationkey * 53 % 340) + abs(a.n_nationkey * 37 % 120 - b.n_nationkey * 37 % 120))::DOUBLE AS d FROM nation a, nation b"
ROUTES = f"rt AS (SELECT f, t, CASE WHEN f * t % 5 <> 1 THEN d + f END AS distance, (f + t) % 7 = 0 AS bare, CASE WHEN f % 2 = 0 THEN 'TW' ELSE 'AR' END AS country_code FROM ({_PAIRS}))"
PACKED = "pk AS (SELECT least(f, t) AS a, greatest(f, t) AS b, arg_min(f, (coalesce(distance, 1e300), f, t)) AS f, arg_min(t, (coalesce(distance, 1e300), f, t)) AS t, min(distance) AS distance, count(*) AS directions FROM rt WHERE f <> t AND NOT bare {more} GROUP BY 1, 2)"
COMPLEX = "(greatest(user_id, 0) + greatest(coalesce(value, 0), 0) * 4)"
SQL = {
    "facilities_by_filter": f"WITH {IDS} SELECT facility_id, org_name, source_name, {_cell('lat', 'lon', 7)} AS cell_r7 FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY record_hash) AS k FROM ids) WHERE k = 1 AND source_name = 'customers' AND org_name = 'BUILDING' ORDER BY facility_id LIMIT 10000",
    "cell_boundaries": f"WITH {_partition_sql()} SELECT cell, 5 AS points, {BOX}, true AS closed FROM final",
    "layer_cells": f"WITH {_partition_sql()} SELECT cell, 'facility_density_adaptive' AS layer_name, n::VARCHAR AS layer_value, res AS resolution, 'Polygon' AS geometry, 5 AS points FROM final ORDER BY cell LIMIT 500",
    "tile_layers": f"""WITH {_partition_sql()}, box AS (SELECT cell, {BOX} FROM final), inb AS (SELECT * FROM box WHERE ({X_CELL} + 0.5) / {N_CELL} * 360.0 - 180.0 BETWEEN {WEST!r} AND {EAST!r} AND ({Y_CELL} + 0.5) / {N_CELL} * 180.0 - 90.0 BETWEEN {SOUTH!r}::DOUBLE AND {NORTH!r}::DOUBLE)
 SELECT 'facility_points' AS layer, id::VARCHAR AS id, 1 AS points, round((lon - ({WEST!r}::DOUBLE)) / {EAST - WEST!r}::DOUBLE * 4096)::INT AS x, round(({NORTH!r}::DOUBLE - lat) / {NORTH - SOUTH!r}::DOUBLE * 4096)::INT AS y FROM places WHERE lon BETWEEN {WEST!r} AND {EAST!r} AND lat BETWEEN {SOUTH!r}::DOUBLE AND {NORTH!r}::DOUBLE
 UNION ALL SELECT 'h3_cells', cell::VARCHAR, 5, round((west - ({WEST!r}::DOUBLE)) / {EAST - WEST!r}::DOUBLE * 4096)::INT, round(({NORTH!r}::DOUBLE - south) / {NORTH - SOUTH!r}::DOUBLE * 4096)::INT FROM inb""",
    "tile_pyramid": f"""WITH {PLACES}, box AS (SELECT cell, {BOX} FROM (SELECT DISTINCT {_cell('lat', 'lon', RES)} AS cell FROM places)),
 f AS (SELECT 'facility_points' AS layer, 1 AS n, lon, lat, lon AS px, lat AS py FROM places UNION ALL SELECT 'h3_cells', 4, ({X_CELL} + 0.5) / {N_CELL} * 360.0 - 180.0, ({Y_CELL} + 0.5) / {N_CELL} * 180.0 - 90.0, west, south FROM box),
 g AS (SELECT z::INT AS z, x::INT AS x, y::INT AS y, x / k * 360 - 180 AS w, (x + 1) / k * 360 - 180 AS e, degrees(atan(sinh(pi() * (1 - 2 * y / k)))) AS t, degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / k)))) AS s
  FROM (SELECT z, pow(2.0, z)::DOUBLE AS k, unnest(range(pow(2, z)::BIGINT)) AS x FROM (SELECT unnest(range({ZOOMS[0]}, {ZOOMS[1] + 1})) AS z)), (SELECT unnest(range({2 ** ZOOMS[1]})) AS y) WHERE y < k)
 SELECT z, x, y, layer, count(*) AS features, sum(n)::BIGINT AS points, sum(round((px - w) / (e - w) * 4096)::INT)::BIGINT AS sum_x, sum(round((t - py) / (t - s) * 4096)::INT)::BIGINT AS sum_y FROM f JOIN g ON lon BETWEEN w AND e AND lat BETWEEN s AND t GROUP BY ALL""",
    "transport_overlay": f"WITH {EDGE}, {SHOWN_ROADS} SELECT * FROM ov WHERE country_code = 'AA'",
    "transport_classes": f"WITH {EDGE}, {SHOWN_ROADS} SELECT list_sort(list(DISTINCT country_code)) AS countries, list_sort(list(DISTINCT transport_class)) AS classes FROM ov",
    "graph_overlay": f"WITH {EDGE} SELECT {CODE} AS country_code, road_class AS transport_class, 'edge' AS graph_feature_type, count(*) AS features FROM edge GROUP BY 1, 2 UNION ALL SELECT 'AA', 'graph_node', 'node', count(*) FROM part",
    "populated_places": "SELECT c_name AS name, c_name AS name_ascii, c_mktsegment AS country_name, 'US' AS country_code, 'Populated place' AS feature_class, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE c_custkey * 7 END::BIGINT AS population_max, CASE WHEN c_custkey % 2 = 0 THEN 3.5 ELSE 0 END::DOUBLE AS min_zoom, (c_custkey % 360 - 180)::DOUBLE AS lon, (c_custkey % 180 - 90)::DOUBLE AS lat FROM customer WHERE c_custkey % 3 = 0 ORDER BY population_max DESC, name, lon, lat LIMIT 10000",
    "region_route_counts": f"WITH {ROUTES} SELECT country_code, count(*) AS routes, count(*) FILTER (WHERE f = t) AS self_routes, count(*) FILTER (WHERE f <> t AND bare) AS without_line, count(*) FILTER (WHERE f <> t AND NOT bare) AS shown FROM rt GROUP BY 1",
    "region_routes_preferred": f"WITH {ROUTES}, {PACKED.format(more='AND f % 2 = 0')} SELECT country_code, f AS from_idx, t AS to_idx, distance FROM rt WHERE country_code = 'AR' AND f <> t AND NOT bare UNION ALL SELECT 'TW', f, t, distance FROM pk",
    "routes_compacted": f"WITH {ROUTES}, {PACKED.format(more='')} SELECT f AS from_idx, t AS to_idx, distance, directions FROM pk",
    "run_estimates": f"""WITH c AS (SELECT *, {COMPLEX} AS points FROM events), k AS (SELECT median((event_id % 9 + 1) / points) AS rate, count(*) AS n FROM c WHERE event_id % 50 = 0 AND points > 0)
 SELECT event_id AS run, round(rate * points, 6) AS seconds, round(rate * points * (1 - CASE WHEN n = 1 THEN 0.4 WHEN n < 3 THEN 0.3 ELSE 0.2 END::DOUBLE), 6) AS low, round(rate * points * (1 + CASE WHEN n = 1 THEN 0.4 WHEN n < 3 THEN 0.3 ELSE 0.2 END::DOUBLE), 6) AS high FROM c, k""",
    "polygon_cover": f"WITH {POLY} SELECT iso, cell, round(overlap, 9) AS overlap FROM {_cover(5)}",
    "polygon_quadtree": _quadtree_sql(),
    "polygon_full_cells": f"WITH {POLY} SELECT iso, cell FROM {_cover(5)} WHERE overlap >= 1 - 1e-9",
    "polygon_center_cells": f"WITH {POLY}, m AS (SELECT iso, cell, ({X_CELL} + 0.5) / {N_CELL} * 360.0 - 180.0 AS lon, ({Y_CELL} + 0.5) / {N_CELL} * 180.0 - 90.0 AS lat FROM {_cover(5)}) SELECT m.iso, cell FROM m JOIN poly ON poly.iso = m.iso WHERE lon BETWEEN west AND east AND lat BETWEEN south AND north",
    "polygon_points": f"WITH {PLACES}, {POLY} SELECT id, iso FROM places JOIN poly ON lon BETWEEN west AND east AND lat BETWEEN south AND north",
    "polygon_union_points": f"""WITH {PLACES}, {POLY} SELECT id, iso FROM places JOIN poly ON lon BETWEEN west AND east AND lat BETWEEN south AND north OR abs(lon - east) / 5 + abs(lat - (north - 10)) / 4 <= 1 + 1e-9, (SELECT unnest([1, 2]) AS twice)""",
    "polygon_union_cover": f"""WITH {POLY}, r AS (SELECT iso, unnest([{{'w': west, 's': south, 'e': east, 't': north}}, {{'w': west + 12.5, 's': south + 3.25, 'e': east + 7.75, 't': north + 4.5}}, {{'w': west + 12.5, 's': south + 3.25, 'e': east, 't': north}}]) AS b, unnest([1, 1, -1]) AS sign FROM poly),
 c AS (SELECT iso, {_make(6, 'x', 'y')} AS cell, sum(sign * greatest(0, least(b.e, x * 5.625 - 174.375) - greatest(b.w, x * 5.625 - 180)) * greatest(0, least(b.t, y * 2.8125 - 87.1875) - greatest(b.s, y * 2.8125 - 90)))::DOUBLE / (5.625 * 2.8125) AS overlap FROM r, (SELECT unnest(range(64)) AS x), (SELECT unnest(range(64)) AS y) GROUP BY ALL)
 SELECT iso, cell, round(overlap, 9) AS overlap FROM c WHERE overlap > 0""",
    "run_layers": f"""WITH {_partition_sql()} SELECT cell, 4 AS resolution, min(iso)::INT AS layer_value, 'country_mask:v2' AS layer_id, '2026-02-26' AS asof_date FROM {_cover(4)} GROUP BY 1
 UNION ALL SELECT cell, res::INT, n::INT, 'facility_density_adaptive:v2', '2026-02-26' FROM final""",
    "polygon_uncovered": f"""WITH {_partition_sql()}, box AS (SELECT min(west) AS w, min(south) AS s, max(east) AS e, max(north) AS t FROM poly),
 pt AS (SELECT id, w + (id + 0.5) / 4096.0::DOUBLE * (e - w) AS lon, s + ((id + 1) * 0.6180339887498949::DOUBLE) % 1.0 * (t - s) AS lat FROM (SELECT unnest(range(4096)) AS id), box),
 hit AS (SELECT id, {_cell('lat', 'lon', 12)} AS cell FROM pt WHERE EXISTS (SELECT 1 FROM poly WHERE lon BETWEEN west AND east AND lat BETWEEN south AND north)),
 met AS (SELECT DISTINCT id FROM (SELECT id, {_up('cell', 'r')} AS leaf FROM hit, (SELECT unnest(range(13)) AS r)) WHERE leaf IN (SELECT cell FROM final))
 SELECT count(*) AS inside, count(*) FILTER (WHERE id NOT IN (SELECT id FROM met)) AS uncovered, round(count(*) FILTER (WHERE id NOT IN (SELECT id FROM met)) / count(*), 6) AS share FROM hit""",
    "polygon_refined": f"""WITH {POLY}, p AS (SELECT iso, cell FROM {_cover(4)}), k AS (SELECT iso, cell, 4::BIGINT * {1 << 50} + ({X_CELL} >> 1) * {1 << 25} + ({Y_CELL} >> 1) AS parent FROM {_cover(5)} WHERE overlap > 0.15)
 SELECT k.iso, k.cell FROM k JOIN p ON p.iso = k.iso AND p.cell = k.parent UNION ALL SELECT iso, cell FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.iso = p.iso AND k.parent = p.cell)""",
}
QUERIES = [facilities_by_filter, cell_boundaries, layer_cells, tile_layers, tile_pyramid, transport_overlay, transport_classes, graph_overlay, populated_places, region_route_counts, region_routes_preferred, routes_compacted, run_estimates, polygon_cover, polygon_quadtree, polygon_full_cells, polygon_center_cells, polygon_points, polygon_refined, polygon_uncovered, polygon_union_points, polygon_union_cover, run_layers]
