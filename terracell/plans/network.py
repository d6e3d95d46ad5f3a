"""Network queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.operators import network, roads, ways
from terracell.plans.cells import _cell, _disk, _make, _split_sql, _up, adaptive_split
from terracell.plans.roads import EDGE, LEN, NODE, PENALTY, RANK, measured
from terracell.sources.derived import road_edges, road_nodes

RES = 3


def spanning_forest(spark, sf_dir):
    return network.spanning_forest(measured(spark, sf_dir), "length_m").select("u", "v", F.round("length_m", 3).alias("length_m"))


def nearest_hub(spark, sf_dir):
    """The nearest junction of three or more edge ends, by cost."""
    edges = measured(spark, sf_dir)
    hubs = roads.degrees(edges).where("degree >= 3").select("node")
    return network.nearest_source(edges, hubs, "cost").select("node", "source", F.round("distance", 3).alias("distance"))


def pruned_edges(spark, sf_dir):
    edges = road_edges(spark, sf_dir)
    return ways.pruned(edges, roads.degrees(edges).where("degree >= 3").select("node"))


def pruned_rings(spark, sf_dir):
    """What is left without any dangling edge."""
    return ways.pruned(road_edges(spark, sf_dir))


def shortest_ways(spark, sf_dir):
    """The way from each junction to the next one by id: its length, nodes and line."""
    nodes = road_nodes(spark, sf_dir)
    a, b = (nodes.selectExpr(f"node_id as {k}", f"named_struct('lon', lon, 'lat', lat) as {k}_at") for k in ("u", "v"))
    edges = measured(spark, sf_dir).join(a, "u").join(b, "v").withColumn("line", F.array("u_at", "v_at"))
    hubs = roads.degrees(edges).where("degree >= 3").select("node")
    found = ways.ways(edges, ways.next_pairs(hubs), "length_m")
    ends = [F.round(F.aggregate("line", F.lit(0.0), lambda x, p: x + p[c]), 6).alias(f"sum_{c}") for c in ("lon", "lat")]
    return found.select("source", "target", F.round("distance", 3).alias("distance"), "hops", F.array_join("nodes", ",").alias("nodes"), *ends)


def edges_at_portals(spark, sf_dir):
    rows = network.split_at_cells(road_edges(spark, sf_dir), road_nodes(spark, sf_dir), RES)
    return rows.select("u", "v", "road_class", "part", F.round("t0", 9).alias("t0"), F.round("t1", 9).alias("t1"), "cell")


def edge_midpoint_cells(spark, sf_dir):
    return network.midpoint_cells(road_edges(spark, sf_dir), road_nodes(spark, sf_dir), RES)


def class_filter_adaptive(spark, sf_dir):
    leaves = adaptive_split(spark, sf_dir).select("cell")
    return network.classes_by_leaf(road_edges(spark, sf_dir), road_nodes(spark, sf_dir), leaves, 9)


N = 1 << RES
ENDS = "ends AS (SELECT e.*, a.lat AS u_lat, a.lon AS u_lon, b.lat AS v_lat, b.lon AS v_lon FROM edge e JOIN node a ON a.node_id = u JOIN node b ON b.node_id = v)"
GRID = f"grid AS (SELECT *, (u_lon + 180.0) / 360.0 * {N} AS x0, (v_lon + 180.0) / 360.0 * {N} AS x1, (u_lat + 90.0) / 180.0 * {N} AS y0, (v_lat + 90.0) / 180.0 * {N} AS y1 FROM ends)"
#: Of rows `mid` (road_class, cell of resolution 9): the covering leaf, and the resolution that counts; beside leaves the least one within a cell.
LEVELS = f"""up AS (SELECT DISTINCT cell, {_up('cell', 'r')} AS leaf FROM mid, (SELECT unnest(range(10)) AS r)),
 top AS (SELECT u.cell, max(u.leaf) AS leaf FROM up u JOIN leaves l ON l.cell = u.leaf GROUP BY 1),
 bare AS (SELECT cell AS fine, {_up('cell', 'r')} AS cell FROM (SELECT DISTINCT cell FROM mid WHERE cell NOT IN (SELECT cell FROM top)), (SELECT DISTINCT cell >> 50 AS r FROM leaves)),
 close AS (SELECT b.fine AS cell, min(d.near >> 50) AS level FROM bare b JOIN {_disk('(SELECT DISTINCT cell FROM bare)')} d ON d.cell = b.cell WHERE d.near IN (SELECT cell FROM leaves) GROUP BY 1),
 lev AS (SELECT mid.*, leaf, coalesce(leaf >> 50, level, 0) AS level FROM mid LEFT JOIN top USING (cell) LEFT JOIN close USING (cell))"""
SHOWN = f"{RANK} <= CASE WHEN level <= 3 THEN 0 WHEN level <= 6 THEN 1 WHEN level <= 8 THEN 2 ELSE 3 END AND road_class NOT IN ('primary_link', 'secondary_link')"
MID = ("(u_lat + v_lat) / 2", "(u_lon + v_lon) / 2")
MEASURED = f"{LEN}, measured AS (SELECT u, v, length_m, length_m * {PENALTY} AS cost FROM meas)"
HUBS = "hub AS (SELECT node FROM (SELECT u AS node FROM edge UNION ALL SELECT v FROM edge) GROUP BY 1 HAVING count(*) >= 3)"
#: Rounds of taking all loose edges, those that `stay` apart; the last round is what is left.
PEEL = """peel(i, u, v, road_class) AS (SELECT 0, * FROM edge UNION ALL SELECT i + 1, u, v, road_class FROM peel WHERE {loose} AND u NOT IN ({leaf}) AND v NOT IN ({leaf}))"""
LEAF = "SELECT node FROM (SELECT u AS node FROM peel UNION ALL SELECT v FROM peel) GROUP BY 1 HAVING count(*) = 1"
#: All ways without a node twice from `start` (node), by the edges' length or cost.
WALK = """step AS (SELECT u, v, {cost} AS c FROM measured UNION ALL SELECT v, u, {cost} FROM measured),
 walk(source, node, d, nodes) AS (SELECT node, node, 0::DOUBLE, [node] FROM start UNION ALL SELECT source, v, d + c, list_append(nodes, v) FROM walk JOIN step ON u = node WHERE NOT list_contains(nodes, v))"""
SQL = {
    #: An edge is in the forest if the edges before it, by length and then ends, don't connect its ends.
    "spanning_forest": f"""WITH RECURSIVE {NODE}, {EDGE}, {MEASURED}, o AS (SELECT *, row_number() OVER (ORDER BY w, u, v) AS k FROM (SELECT least(u, v) AS u, greatest(u, v) AS v, min(length_m) AS w FROM measured WHERE u <> v GROUP BY 1, 2)),
 b AS (SELECT u, v, k FROM o UNION ALL SELECT v, u, k FROM o), reach(k, node) AS (SELECT k, u FROM o UNION SELECT reach.k, b.v FROM reach JOIN b ON b.u = reach.node AND b.k < reach.k)
 SELECT u, v, round(w, 3) AS length_m FROM o WHERE NOT EXISTS (SELECT 1 FROM reach WHERE reach.k = o.k AND reach.node = o.v)""",
    "pruned_edges": f"WITH RECURSIVE {EDGE}, {HUBS}, {PEEL.format(leaf=LEAF + ' AND node NOT IN (SELECT node FROM hub)', loose='EXISTS (' + LEAF + ' AND node NOT IN (SELECT node FROM hub))')} SELECT u, v, road_class FROM peel WHERE i = (SELECT max(i) FROM peel)",
    "pruned_rings": f"WITH RECURSIVE {EDGE}, {PEEL.format(leaf=LEAF, loose=f'EXISTS ({LEAF})')} SELECT u, v, road_class FROM peel WHERE i = (SELECT max(i) FROM peel) AND NOT EXISTS (SELECT 1 FROM (SELECT u AS node FROM peel WHERE i = (SELECT max(i) FROM peel) UNION ALL SELECT v FROM peel WHERE i = (SELECT max(i) FROM peel)) GROUP BY node HAVING count(*) = 1)",
    "nearest_hub": f"WITH RECURSIVE {NODE}, {EDGE}, {HUBS}, {MEASURED}, start AS (SELECT node FROM hub), {WALK.format(cost='cost')} SELECT node, arg_min(source, (d, source)) AS source, round(min(d), 3) AS distance FROM walk GROUP BY 1",
    "shortest_ways": f"""WITH RECURSIVE {NODE}, {EDGE}, {HUBS}, {MEASURED}, start AS (SELECT node FROM hub), {WALK.format(cost='length_m')},
 p AS (SELECT * FROM (SELECT node AS source, lead(node) OVER (ORDER BY node) AS target FROM hub) WHERE target IS NOT NULL),
 w AS (SELECT source, node AS target, min(d) AS distance, arg_min(nodes, d) AS nodes FROM walk GROUP BY 1, 2),
 s AS (SELECT source, target, sum(lon) AS lon, sum(lat) AS lat FROM (SELECT source, target, unnest(nodes) AS node_id FROM w) JOIN node USING (node_id) GROUP BY 1, 2)
 SELECT p.source, p.target, round(distance, 3) AS distance, (len(nodes) - 1)::INT AS hops, array_to_string(nodes, ',') AS nodes, round(lon, 6) AS sum_lon, round(lat, 6) AS sum_lat FROM p LEFT JOIN w USING (source, target) LEFT JOIN s USING (source, target)""",
    "edges_at_portals": f"""WITH {NODE}, {EDGE}, {ENDS}, {GRID}, lines AS (SELECT unnest(range({N + 1})) AS k),
 marks AS (SELECT u, v, road_class, 0::DOUBLE AS t FROM grid UNION SELECT u, v, road_class, 1::DOUBLE FROM grid
 UNION SELECT u, v, road_class, (k - x0) / (x1 - x0) FROM grid, lines WHERE k > least(x0, x1) AND k < greatest(x0, x1)
 UNION SELECT u, v, road_class, (k - y0) / (y1 - y0) FROM grid, lines WHERE k > least(y0, y1) AND k < greatest(y0, y1)),
 parts AS (SELECT u, v, road_class, (row_number() OVER w - 1)::INT AS part, t AS t0, lead(t) OVER w AS t1 FROM marks WINDOW w AS (PARTITION BY u, v ORDER BY t))
 SELECT p.u, p.v, p.road_class, part, round(t0, 9) AS t0, round(t1, 9) AS t1, {_make(RES, f'least(floor(x0 + (t0 + t1) / 2 * (x1 - x0)), {N - 1})', f'least(floor(y0 + (t0 + t1) / 2 * (y1 - y0)), {N - 1})')} AS cell
 FROM parts p JOIN grid g ON g.u = p.u AND g.v = p.v WHERE t1 IS NOT NULL""",
    "edge_midpoint_cells": f"WITH {NODE}, {EDGE}, {ENDS} SELECT u, v, road_class, {_cell(*MID, RES)} AS cell FROM ends",
    "class_filter_adaptive": f"WITH {_split_sql()}, {NODE}, {EDGE}, {ENDS}, mid AS (SELECT u, v, road_class, {_cell(*MID, 9)} AS cell FROM ends), {LEVELS} SELECT u, v, road_class, leaf FROM lev WHERE {SHOWN}",
}
QUERIES = [spanning_forest, nearest_hub, pruned_edges, pruned_rings, shortest_ways, edges_at_portals, edge_midpoint_cells, class_filter_adaptive]
