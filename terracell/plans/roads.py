"""Road-graph queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.operators import roads
from terracell.operators.components import components
from terracell.plans.cells import _cell
from terracell.sources.derived import road_edges, road_nodes, table

NODE = "node AS (SELECT p_partkey AS node_id, (p_partkey * 7919 % 12000) / 100.0::DOUBLE - 60 AS lat, (p_partkey * 104729 % 34000) / 100.0::DOUBLE - 170 AS lon FROM part)"
KIND = "['motorway', 'trunk', 'primary', 'secondary', 'motorway_link', 'tertiary', 'trunk_link', 'residential'][(k // 5) % 8 + 1]"
EDGE = f"edge AS (SELECT * FROM (SELECT k AS u, k + 1 AS v, {KIND} AS road_class FROM (SELECT p_partkey AS k FROM part) WHERE k % 17 <> 0 UNION ALL SELECT k, k + 13, {KIND} FROM (SELECT p_partkey AS k FROM part) WHERE k % 29 = 0) WHERE v <= (SELECT max(p_partkey) FROM part))"
HAV = "2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h))"
LEN = f"""meas AS (SELECT u, v, road_class, {HAV} AS length_m FROM (SELECT e.*, pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2) AS h
 FROM edge e JOIN node a ON a.node_id = u JOIN node b ON b.node_id = v))"""
FAMILY = "regexp_replace(road_class, '_link$', '')"
PENALTY = f"CASE {FAMILY} WHEN 'motorway' THEN 1.0 WHEN 'trunk' THEN 1.1 WHEN 'primary' THEN 1.25 WHEN 'secondary' THEN 1.5 ELSE 2.0 END::DOUBLE"
RANK = f"CASE {FAMILY} WHEN 'motorway' THEN 0 WHEN 'trunk' THEN 1 WHEN 'primary' THEN 2 WHEN 'secondary' THEN 3 ELSE 4 END"
COMP = """both_ways AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge),
walk(a, b) AS (SELECT DISTINCT u, u FROM both_ways UNION SELECT walk.a, e.v FROM walk JOIN both_ways e ON e.u = walk.b), comp AS (SELECT a AS node, min(b) AS component FROM walk GROUP BY 1)"""
WAYS = "way AS (SELECT o_custkey AS way_id, list(o_orderkey % 4000 ORDER BY o_orderkey) AS refs FROM orders GROUP BY 1 HAVING count(*) >= 2)"


def ways(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("way_id"))
    keys = rows.agg(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda x: x % 4000).alias("refs"))  # a customer's orders: a few dozen
    return keys.where(F.size("refs") >= 2)


def road_shared_nodes(spark, sf_dir):
    return roads.shared_nodes(ways(spark, sf_dir))


def road_segments(spark, sf_dir):
    w = ways(spark, sf_dir)
    return roads.segments(w, roads.shared_nodes(w))


def measured(spark, sf_dir):
    return roads.lengths(road_edges(spark, sf_dir), road_nodes(spark, sf_dir))


def edge_lengths(spark, sf_dir):
    return measured(spark, sf_dir).select("u", "v", "road_class", F.round("length_m", 3).alias("length_m"))


def edge_cost(spark, sf_dir):
    return measured(spark, sf_dir).select("u", "v", "road_class", F.round("cost", 3).alias("cost"))


def parallel_min(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey % 500 as u", "l_partkey % 500 as v", "l_extendedprice as length")
    return roads.parallel_min(lines, "length")


def node_degree(spark, sf_dir):
    return roads.degrees(road_edges(spark, sf_dir))


def graph_components(spark, sf_dir):
    return components(road_edges(spark, sf_dir))


def graph_summary(spark, sf_dir):
    return roads.summary(road_edges(spark, sf_dir))


def contract_degree2(spark, sf_dir):
    return roads.contract(road_edges(spark, sf_dir))


def cross_cell_edges(spark, sf_dir):
    return roads.cross_cell(road_edges(spark, sf_dir), road_nodes(spark, sf_dir), 3)


def class_filter_fixed(spark, sf_dir):
    return roads.mainline(road_edges(spark, sf_dir))


def class_rank_by_cell(spark, sf_dir):
    return roads.best_rank(road_edges(spark, sf_dir), road_nodes(spark, sf_dir), 4)


SQL = {
    "road_shared_nodes": f"WITH {WAYS} SELECT ref, count(*)::BIGINT AS ways FROM (SELECT DISTINCT way_id, unnest(refs) AS ref FROM way) GROUP BY 1 HAVING count(*) > 1",
    "road_segments": f"""WITH {WAYS}, r AS (SELECT way_id, len(refs) AS n, unnest(refs) AS ref, generate_subscripts(refs, 1) - 1 AS pos FROM way),
 s AS (SELECT ref FROM (SELECT DISTINCT way_id, ref FROM r) GROUP BY 1 HAVING count(*) > 1),
 e AS (SELECT way_id, ref, pos FROM r WHERE ref IN (SELECT ref FROM s) OR pos = 0 OR pos = n - 1)
 SELECT way_id, (segment - 1)::INT AS segment, u, v, n_refs FROM (SELECT way_id, row_number() OVER w AS segment, ref AS u, lead(ref) OVER w AS v, lead(pos) OVER w - pos + 1 AS n_refs FROM e WINDOW w AS (PARTITION BY way_id ORDER BY pos)) WHERE v IS NOT NULL""",
    "edge_lengths": f"WITH {NODE}, {EDGE}, {LEN} SELECT u, v, road_class, round(length_m, 3) AS length_m FROM meas",
    "edge_cost": f"WITH {NODE}, {EDGE}, {LEN} SELECT u, v, road_class, round(length_m * {PENALTY}, 3) AS cost FROM meas",
    "parallel_min": "SELECT least(l_orderkey % 500, l_partkey % 500) AS u, greatest(l_orderkey % 500, l_partkey % 500) AS v, min(l_extendedprice) AS length FROM lineitem GROUP BY 1, 2",
    "node_degree": f"WITH {EDGE} SELECT node, count(*) AS degree FROM (SELECT u AS node FROM edge UNION ALL SELECT v FROM edge) GROUP BY 1",
    "graph_components": f"WITH RECURSIVE {EDGE}, {COMP} SELECT node, component FROM comp",
    "graph_summary": f"""WITH RECURSIVE {EDGE}, {COMP}, near AS (SELECT u, count(DISTINCT v) AS degree FROM both_ways WHERE u <> v GROUP BY 1)
 SELECT (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM comp) AS nodes, (SELECT count(DISTINCT component) FROM comp) AS components, count(*) FILTER (WHERE degree = 2) AS two, count(*) FILTER (WHERE degree >= 3) AS branch FROM near""",
    "cross_cell_edges": f"WITH {NODE}, {EDGE}, c AS (SELECT node_id, {_cell('lat', 'lon', 3)} AS cell FROM node) SELECT u, v, road_class, a.cell AS u_cell, b.cell AS v_cell FROM edge JOIN c a ON a.node_id = u JOIN c b ON b.node_id = v WHERE a.cell <> b.cell",
    "class_filter_fixed": f"WITH {EDGE} SELECT * FROM edge WHERE road_class IN ('motorway', 'trunk', 'primary', 'secondary')",
    "class_rank_by_cell": f"WITH {NODE}, {EDGE} SELECT {_cell('lat', 'lon', 4)} AS cell, min({RANK})::INT AS best, max({RANK})::INT AS worst FROM edge JOIN node ON node_id = u GROUP BY 1",
}
QUERIES = [road_shared_nodes, road_segments, edge_lengths, edge_cost, parallel_min, node_degree, graph_components, graph_summary, contract_degree2, cross_cell_edges, class_filter_fixed, class_rank_by_cell]
