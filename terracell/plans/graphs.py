"""Queries over road graphs with geometry, and their SQL; chains, feeders and the escalating filter are tested against plain models."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions.edges import raw_id
from terracell.functions.geo import line_length
from terracell.operators import backbone, evaluate, graph
from terracell.operators import portals as portal_ways
from terracell.plans.cells import _cell, _split_sql, _up, adaptive_split
from terracell.plans.network import LEVELS, SHOWN, WALK
from terracell.plans.roads import EDGE, NODE, WAYS, ways
from terracell.sources.derived import road_edges, road_nodes

RES, FINEST = 3, 9


def lines(spark, sf_dir):
    """The derived roads as EDGE: a bend in each line, a name for some."""
    nodes = road_nodes(spark, sf_dir)
    a, b = (nodes.selectExpr(f"node_id as {k}", f"named_struct('lon', lon, 'lat', lat) as {k}_at") for k in ("u", "v"))
    rows = road_edges(spark, sf_dir).join(a, "u").join(b, "v")
    bend = F.expr("named_struct('lon', u_at.lon + (v_at.lon - u_at.lon) / 4, 'lat', u_at.lat + (v_at.lat - u_at.lat) / 2)")
    rows = rows.withColumn("line", F.array("u_at", bend, "v_at"))
    way, segment = F.expr("u div 17"), F.expr("u % 17 + if(v = u + 1, 0, 100)")
    return rows.select(raw_id(way, segment, F.col("u"), F.col("v"), F.col("road_class"), F.col("line")).alias("edge_id"), "u", "v", "road_class", F.lit("yes").alias("oneway"), F.expr("if(floor(u / 40) % 3 = 0, null, concat('road ', floor(u / 40)))").alias("name"), F.lit(None).cast("string").alias("ref"), "line")


def places(spark, sf_dir):
    return road_nodes(spark, sf_dir).select("node_id", "lon", "lat")


def mask(spark, sf_dir):
    return adaptive_split(spark, sf_dir).select("cell")


def _shape(edges, *more):
    return edges.select("edge_id", "u", "v", "road_class", "name", F.size("line").cast("int").alias("points"), F.round(line_length(F.col("line")), 2).alias("length_m"), *more)


def road_lines(spark, sf_dir):
    return _shape(lines(spark, sf_dir))


def raw_graph_edges(spark, sf_dir):
    """Ways whose refs are keys of parts, some of them without a place."""
    rows = ways(spark, sf_dir).select("way_id", F.expr("map('highway', element_at(array('motorway', ' Trunk ', 'path', 'primary_link'), cast(way_id % 4 as int) + 1), 'name', 'w')").alias("tags"), F.expr("transform(refs, x -> x % 250)").alias("refs"))
    edges, _ = graph.raw_graph(rows, places(spark, sf_dir).where("node_id % 31 <> 0"))
    return edges.select("u", "v", "road_class", F.size("line").cast("int").alias("points")).groupBy("u", "v", "road_class", "points").agg(F.count(F.lit(1)).alias("edges"))


def contract_lines(spark, sf_dir):
    return _shape(graph.contracted(lines(spark, sf_dir)))


def contract_protected(spark, sf_dir):
    e = lines(spark, sf_dir)
    return _shape(graph.contracted(e, graph.protected_nodes(e, road_nodes(spark, sf_dir), 1)))


def protected_ends(spark, sf_dir):
    return graph.protected_nodes(road_edges(spark, sf_dir), road_nodes(spark, sf_dir), 1)


def portal_split(spark, sf_dir):
    """Parts of each line, cut at the borders of one resolution: how many, and how many begin or end at a portal."""
    e, _ = graph.split_at_resolution(lines(spark, sf_dir), RES)
    return e.groupBy("road_class").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("u") < 0).alias("from_portal"), F.count_if(F.col("v") < 0).alias("to_portal"))


def portal_split_mask(spark, sf_dir):
    """The same at the borders of the adaptive leaves."""
    e, _ = graph.split_at_mask(lines(spark, sf_dir), mask(spark, sf_dir))
    return e.groupBy("road_class").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("u") < 0).alias("from_portal"), F.count_if(F.col("v") < 0).alias("to_portal"))


def portal_pairs(spark, sf_dir):
    e, portals = graph.split_at_resolution(lines(spark, sf_dir), RES)
    return _shape(backbone.within_cells(e, portals, RES))


def portal_mst(spark, sf_dir):
    e, portals = graph.split_at_resolution(lines(spark, sf_dir), RES)
    return _shape(backbone.within(backbone.midpoint_cell(e, RES), portals, "cell", portal_ways.tree))


def portal_feeders(spark, sf_dir):
    leaves = mask(spark, sf_dir)
    e, portals = graph.split_at_mask(lines(spark, sf_dir), leaves)
    return _shape(backbone.within_mask(e, portals, leaves, FINEST))


def adaptive_portal_run(spark, sf_dir):
    found = backbone.variants(lines(spark, sf_dir), places(spark, sf_dir), ("adaptive_portal_run",), mask=mask(spark, sf_dir), finest=FINEST)
    return _shape(found["adaptive_portal_run"][0])


def adaptive_portal_run_nodes(spark, sf_dir):
    found = backbone.variants(lines(spark, sf_dir), places(spark, sf_dir), ("adaptive_portal_run",), mask=mask(spark, sf_dir), finest=FINEST)
    return found["adaptive_portal_run"][1].select("node_id", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


def class_filter_mask(spark, sf_dir):
    return backbone.shown(lines(spark, sf_dir), mask(spark, sf_dir), FINEST).select("edge_id", "road_class")


def portal_class_filter(spark, sf_dir):
    return backbone.portal_classes(lines(spark, sf_dir)).select("edge_id", "road_class")


def class_escalation(spark, sf_dir):
    return evaluate.escalated(lines(spark, sf_dir), 2).select("edge_id", "u", "v", "road_class")


def graph_report(spark, sf_dir):
    found = evaluate.summary(evaluate.edge_records(lines(spark, sf_dir)))
    return found.select("edges", "nodes", F.round("length_m", -2).alias("length_m"), "components", "largest", *[F.round(c, 9).alias(c) for c in ("largest_share", "two_share", "branch_share")])


def sampled_pairs(spark, sf_dir):
    return evaluate.sampled_pairs(road_edges(spark, sf_dir).select(F.explode(F.array("u", "v")).alias("node")), 1200)


def shortest_paths(spark, sf_dir):
    """Hops between sampled nodes."""
    e = road_edges(spark, sf_dir).withColumn("hops", F.lit(1.0))
    pairs = evaluate.sampled_pairs(e.select(F.explode(F.array("u", "v")).alias("node")), 128)
    return evaluate.pair_distances(e, pairs, "hops")


def variant_comparison(spark, sf_dir):
    e = lines(spark, sf_dir)
    found = evaluate.compared(evaluate.edge_records(e), evaluate.edge_records(graph.contracted(e)), most=16)
    return found.select("pairs", "raw_reachable", "variant_reachable", "reachability_preserved", "shortcuts", "detours", *[F.round(c, 6).alias(c) for c in ("ratio_min", "ratio_max", "ratio_avg", "edges_reduction", "nodes_reduction")], "shared_nodes")


def adaptive_anchors(spark, sf_dir):
    e, portals = graph.split_at_resolution(lines(spark, sf_dir), RES)
    kind = F.when(F.col("node") < 0, "portal").otherwise("junction")
    return graph.anchors(e, portals).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("nodes"))


N = 1 << RES
LINES = f"""{NODE}, {EDGE}, line AS (SELECT e.*, a.lon AS x0, a.lat AS y0, a.lon + (b.lon - a.lon) / 4 AS x1, a.lat + (b.lat - a.lat) / 2 AS y1, b.lon AS x2, b.lat AS y2,
 CASE WHEN floor(u / 40) % 3 = 0 THEN NULL ELSE 'road ' || (u // 40) END AS name FROM edge e JOIN node a ON a.node_id = u JOIN node b ON b.node_id = v),
 ided AS (SELECT *, sha256(concat_ws('|', u // 17, u % 17 + CASE WHEN v = u + 1 THEN 0 ELSE 100 END, u, v, road_class, printf('%.7f,%.7f;%.7f,%.7f;%.7f,%.7f', x0, y0, x1, y1, x2, y2)))[1:24] AS edge_id FROM line)"""


def _metres(x0: str, y0: str, x1: str, y1: str) -> str:
    h = f"pow(sin(radians({y1} - {y0}) / 2), 2) + cos(radians({y0})) * cos(radians({y1})) * pow(sin(radians({x1} - {x0}) / 2), 2)"
    return f"(2 * 6371000.0 * atan2(sqrt({h}), sqrt(greatest(0.0, 1 - ({h})))))"


BOTH_M = f"{_metres('x0', 'y0', 'x1', 'y1')} + {_metres('x1', 'y1', 'x2', 'y2')}"
#: Straight segments in units of the grid's cells, and their crossings of its lines.
CROSSED = f"""seg AS (SELECT edge_id, u, v, road_class, 0 AS seg, x0 AS ax, y0 AS ay, x1 AS bx, y1 AS by_ FROM ided UNION ALL SELECT edge_id, u, v, road_class, 1, x1, y1, x2, y2 FROM ided),
 grid AS (SELECT *, (ax + 180.0) / 360.0 * {{n}} AS gx0, (bx + 180.0) / 360.0 * {{n}} AS gx1, (ay + 90.0) / 180.0 * {{n}} AS gy0, (by_ + 90.0) / 180.0 * {{n}} AS gy1 FROM seg),
 marks AS (SELECT edge_id, seg, 0::DOUBLE AS t FROM grid UNION SELECT edge_id, seg, 1::DOUBLE FROM grid
 UNION SELECT edge_id, seg, (k - gx0) / (gx1 - gx0) FROM (SELECT *, unnest(range(floor(least(gx0, gx1))::BIGINT, ceil(greatest(gx0, gx1))::BIGINT + 1)) AS k FROM grid) WHERE k > least(gx0, gx1) AND k < greatest(gx0, gx1)
 UNION SELECT edge_id, seg, (k - gy0) / (gy1 - gy0) FROM (SELECT *, unnest(range(floor(least(gy0, gy1))::BIGINT, ceil(greatest(gy0, gy1))::BIGINT + 1)) AS k FROM grid) WHERE k > least(gy0, gy1) AND k < greatest(gy0, gy1)),
 piece AS (SELECT edge_id, seg, t AS t0, lead(t) OVER w AS t1 FROM marks WINDOW w AS (PARTITION BY edge_id, seg ORDER BY t))"""
PARTS = """ends AS (SELECT road_class, count(*) AS n FROM ided GROUP BY 1), cut_ AS (SELECT road_class, count(*) AS n, count(DISTINCT edge_id) AS e FROM ({cuts}) JOIN ided USING (edge_id) GROUP BY 1)"""
COUNTS = "SELECT road_class, ends.n + coalesce(cut_.n, 0) AS edges, coalesce(cut_.n, 0) AS from_portal, coalesce(cut_.n, 0) AS to_portal"
MASKED = f"""mid AS (SELECT p.edge_id, p.seg, t0, least(floor(gx0 + (t0 + t1) / 2 * (gx1 - gx0)), {(1 << FINEST) - 1})::BIGINT AS x, least(floor(gy0 + (t0 + t1) / 2 * (gy1 - gy0)), {(1 << FINEST) - 1})::BIGINT AS y FROM piece p JOIN grid USING (edge_id, seg) WHERE t1 IS NOT NULL),
 at9 AS (SELECT edge_id, seg, t0, {FINEST}::BIGINT * {1 << 50} + x * {1 << 25} + y AS cell FROM mid), up9 AS (SELECT c.cell, max(l.cell) AS leaf FROM (SELECT DISTINCT cell, {_up('cell', 'r')} AS above FROM at9, (SELECT unnest(range({FINEST + 1})) AS r)) c JOIN leaves l ON l.cell = c.above GROUP BY 1),
 own AS (SELECT edge_id, seg, coalesce(leaf, -1) AS leaf, lag(coalesce(leaf, -1)) OVER (PARTITION BY edge_id, seg ORDER BY t0) AS before FROM at9 LEFT JOIN up9 USING (cell))"""
#: Midpoints of the lines' ends, and the class rule at them.
LINE_MID = f"mid AS (SELECT edge_id, u, v, road_class, {_cell('(y0 + y2) / 2', '(x0 + x2) / 2', FINEST)} AS cell FROM ided)"
ENDS = "(SELECT DISTINCT node FROM (SELECT u AS node FROM edge UNION SELECT v FROM edge))"
def _pairs_sql(most: int) -> str:
    """CTEs up to `sampled` (k, source, target)."""
    return f"""n AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS rank, count(*) OVER () AS n FROM {ENDS}), o AS (SELECT a.rank AS k, a.node AS source, b.node AS target FROM n a JOIN n b ON b.rank = a.n - 1 - a.rank WHERE a.rank < b.rank AND a.rank < {most}),
 i AS (SELECT a.n // 2 + row_number() OVER (ORDER BY a.rank) - 1 AS k, a.node AS source, b.node AS target FROM n a JOIN n b ON b.rank = a.rank + 1 WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.source = a.node AND o.target = b.node)),
 sampled AS (SELECT * FROM o UNION ALL SELECT * FROM i WHERE k < {most})"""


SQL = {
    "road_lines": f"WITH {LINES} SELECT edge_id, u, v, road_class, name, 3 AS points, round({BOTH_M}, 2) AS length_m FROM ided",
    "raw_graph_edges": f"""WITH {WAYS}, w2 AS (SELECT way_id, list_transform(refs, lambda x: x % 250) AS refs, ['motorway', 'trunk', NULL, 'primary_link'][way_id % 4 + 1] AS road_class FROM way),
 r AS (SELECT way_id, road_class, len(refs) AS n, unnest(refs) AS ref, generate_subscripts(refs, 1) - 1 AS pos FROM w2 WHERE road_class IS NOT NULL), sh AS (SELECT ref FROM (SELECT DISTINCT way_id, ref FROM r) GROUP BY 1 HAVING count(*) > 1),
 e AS (SELECT * FROM r WHERE ref IN (SELECT ref FROM sh) OR pos = 0 OR pos = n - 1), seg AS (SELECT way_id, road_class, pos AS a, lead(pos) OVER w AS b, ref AS u, lead(ref) OVER w AS v FROM e WINDOW w AS (PARTITION BY way_id ORDER BY pos)),
 lost AS (SELECT way_id, pos FROM r WHERE ref NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 31 <> 0))
 SELECT u, v, road_class, (b - a + 1)::INT AS points, count(*) AS edges FROM seg WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lost WHERE lost.way_id = seg.way_id AND lost.pos BETWEEN a AND b) GROUP BY ALL""",
    "protected_ends": f"WITH {NODE}, {EDGE}, c AS (SELECT node_id, {_cell('lat', 'lon', 1)} AS cell FROM node), x AS (SELECT u, v FROM edge JOIN c a ON a.node_id = u JOIN c b ON b.node_id = v WHERE a.cell <> b.cell) SELECT u AS node FROM x UNION SELECT v FROM x",
    "portal_split": f"WITH {LINES}, {CROSSED.format(n=N)}, {PARTS.format(cuts='SELECT edge_id FROM piece WHERE t0 > 0 AND t1 IS NOT NULL')} {COUNTS} FROM ends LEFT JOIN cut_ USING (road_class)",
    "portal_split_mask": f"WITH {_split_sql()}, {LINES}, {CROSSED.format(n=1 << FINEST)}, {MASKED}, {PARTS.format(cuts='SELECT edge_id FROM own WHERE before <> leaf')} {COUNTS} FROM ends LEFT JOIN cut_ USING (road_class)",
    "class_filter_mask": f"WITH {_split_sql()}, {LINES}, {LINE_MID}, {LEVELS} SELECT edge_id, road_class FROM lev WHERE {SHOWN}",
    "portal_class_filter": f"WITH {LINES} SELECT edge_id, road_class FROM ided WHERE road_class IN ('motorway', 'motorway_link', 'trunk', 'trunk_link', 'primary', 'primary_link', 'secondary', 'secondary_link')",
    "sampled_pairs": f"WITH {EDGE}, {_pairs_sql(1200)} SELECT * FROM sampled",
    "shortest_paths": f"""WITH RECURSIVE {NODE}, {EDGE}, measured AS (SELECT u, v, 1 AS hop FROM edge), {_pairs_sql(128)}, start AS (SELECT DISTINCT source AS node FROM sampled), {WALK.format(cost='hop')}
 SELECT s.source, s.target, d AS distance FROM (SELECT DISTINCT source, target FROM sampled) s LEFT JOIN (SELECT source, node, min(d)::DOUBLE AS d FROM walk GROUP BY 1, 2) w ON w.source = s.source AND w.node = s.target""",
    "graph_report": f"""WITH RECURSIVE {LINES}, both_ways AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge), walk(a, b) AS (SELECT DISTINCT u, u FROM both_ways UNION SELECT walk.a, e.v FROM walk JOIN both_ways e ON e.u = walk.b), comp AS (SELECT a AS node, min(b) AS c FROM walk GROUP BY 1),
 size AS (SELECT c, count(*) AS n FROM comp GROUP BY 1), near AS (SELECT u, count(DISTINCT v) AS d FROM both_ways GROUP BY 1), t AS (SELECT (SELECT count(*) FROM comp) AS nodes)
 SELECT (SELECT count(*) FROM edge) AS edges, nodes, (SELECT round(sum({BOTH_M}), -2) FROM ided) AS length_m, (SELECT count(*) FROM size) AS components, (SELECT max(n) FROM size) AS largest,
 round((SELECT max(n) FROM size) / nodes, 9) AS largest_share, round((SELECT count(*) FROM near WHERE d = 2) / nodes, 9) AS two_share, round((SELECT count(*) FROM near WHERE d >= 3) / nodes, 9) AS branch_share FROM t""",
    "adaptive_anchors": f"""WITH {LINES}, {CROSSED.format(n=N)}, deg AS (SELECT node FROM (SELECT u AS node FROM edge UNION ALL SELECT v FROM edge) GROUP BY 1 HAVING count(*) >= 3),
 spot AS (SELECT DISTINCT printf('%.9f|%.9f', (ax + (bx - ax) * t0)::DOUBLE, (ay + (by_ - ay) * t0)::DOUBLE) AS p FROM piece JOIN grid USING (edge_id, seg) WHERE t0 > 0 AND t1 IS NOT NULL)
 SELECT 'portal' AS kind, count(*) AS nodes FROM spot UNION ALL SELECT 'junction', count(*) FROM deg""",
}
QUERIES = [road_lines, raw_graph_edges, contract_lines, contract_protected, protected_ends, portal_split, portal_split_mask, portal_pairs, portal_mst, portal_feeders, adaptive_portal_run, adaptive_portal_run_nodes, class_filter_mask, portal_class_filter, class_escalation, graph_report, sampled_pairs, shortest_paths, variant_comparison, adaptive_anchors]
