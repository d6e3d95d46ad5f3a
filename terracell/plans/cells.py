"""Layer queries over cells and their SQL (recursive where a closure is needed)."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.operators import adaptive, layers
from terracell.plans.facilities import PLACES
from terracell.session import cut
from terracell.sources.derived import facilities, polygons

RES = 6
RULES = adaptive.Rules(base=4, root=2, min_output=4, floor=6, most=9, target=4, interior=4)


def _make(res, x: str, y: str) -> str:
    return f"(({res})::BIGINT * {1 << 50} + ({x})::BIGINT * {1 << 25} + ({y})::BIGINT)"


def _cell(lat: str, lon: str, res: int) -> str:
    n = 1 << res
    return _make(res, f"least(floor(({lon} + 180.0) / 360.0 * {n}), {n - 1})", f"least(floor(({lat} + 90.0) / 180.0 * {n}), {n - 1})")


def _disk(cells: str, k: int = 1, res: str = "(cell >> 50)") -> str:
    """SELECT cell, near of a table of cells."""
    x, y, n = "((cell >> 25) & 33554431)", "(cell & 33554431)", f"(1::BIGINT << {res})"
    return f"(SELECT DISTINCT cell, {_make(res, f'(({x} + dx) % {n} + {n}) % {n}', f'{y} + dy')} AS near FROM {cells}, (SELECT unnest(range({-k}, {k + 1})) AS dx), (SELECT unnest(range({-k}, {k + 1})) AS dy) WHERE {y} + dy >= 0 AND {y} + dy < {n})"


DENSITY = f"{PLACES}, dens AS (SELECT {_cell('lat', 'lon', RES)} AS cell, count(*)::BIGINT AS n FROM places GROUP BY 1)"
CLOSE = """edge AS (SELECT d.cell AS u, d.near AS v FROM {disk} d JOIN {cells} c ON c.cell = d.near),
walk(a, b) AS (SELECT cell, cell FROM {cells} UNION SELECT walk.a, edge.v FROM walk JOIN edge ON edge.u = walk.b), comp AS (SELECT a AS cell, min(b) AS component FROM walk GROUP BY 1)"""
_N = f"(1 << {RES})::DOUBLE"
CENTRED = f"""SELECT *, pow(lat - avg(lat) OVER w, 2) + pow(lon - avg(lon) OVER w, 2) AS far, count(*) OVER w AS size FROM (SELECT *, ((cell & 33554431) + 0.5::DOUBLE) / {_N} * 180.0 - 90.0 AS lat, (((cell >> 25) & 33554431) + 0.5::DOUBLE) / {_N} * 360.0 - 180.0 AS lon FROM comp) WINDOW w AS (PARTITION BY component)"""
SEED = "(SELECT cell FROM dens ORDER BY n DESC, cell LIMIT 1)"
POLY = "poly AS (SELECT n_nationkey AS iso, n_name AS name, (n_nationkey * 53 % 340 - 170) - 10.0 AS west, (n_nationkey * 37 % 120 - 60) - 10.0 AS south, (n_nationkey * 53 % 340 - 170) + 10.0 AS east, (n_nationkey * 37 % 120 - 60) + 10.0 AS north FROM nation)"


def _cover(res: int) -> str:
    n = 1 << res
    w, h = 360.0 / n, 180.0 / n
    wide = f"(least(east, x * {w} - 180.0 + {w}) - greatest(west, x * {w} - 180.0))"
    tall = f"(least(north, y * {h} - 90.0 + {h}) - greatest(south, y * {h} - 90.0))"
    return f"(SELECT iso, name, {_make(res, 'x', 'y')} AS cell, ({wide}::DOUBLE * {tall}::DOUBLE / ({w} * {h})::DOUBLE) AS overlap FROM poly, (SELECT unnest(range({n})) AS x), (SELECT unnest(range({n})) AS y) WHERE {wide} > 0 AND {tall} > 0)"


def points(spark, sf_dir):
    return facilities(spark, sf_dir)


def mask(spark, sf_dir, res=RES):
    return layers.covering(polygons(spark, sf_dir), res)


def occupied(spark, sf_dir):
    return layers.density(points(spark, sf_dir), RES)


def cell_density(spark, sf_dir):
    return occupied(spark, sf_dir)


def density_seed(spark, sf_dir):
    return layers.seed(occupied(spark, sf_dir))


def metro_core(spark, sf_dir):
    return layers.metro_core(points(spark, sf_dir), RES, 2, 2).orderBy("cell")


def hierarchical_counts(spark, sf_dir):
    return layers.hierarchy(points(spark, sf_dir), 2, 8)


def country_mask_fixed(spark, sf_dir):
    return mask(spark, sf_dir).select("iso", "cell", F.round("overlap", 9).alias("overlap"))


def country_mask_first_claim(spark, sf_dir):
    return layers.first_claim(mask(spark, sf_dir))


def country_mask_quadtree(spark, sf_dir):
    return layers.quadtree_mask(polygons(spark, sf_dir), 3, RES)


def country_adjacency(spark, sf_dir):
    claimed = layers.first_claim(mask(spark, sf_dir)).select("cell", "iso")
    near = claimed.select("iso", F.explode(quad.disk(F.col("cell"), 1)).alias("cell"))
    return near.join(claimed.withColumnRenamed("iso", "other"), "cell").where("iso <> other").select("iso", "other").distinct()


def adaptive_domain(spark, sf_dir):
    return mask(spark, sf_dir, 4).select("cell").distinct().select("cell", (quad.parent(F.col("cell"), 3, 4)).alias("parent"))


def partition(spark, sf_dir):
    return adaptive.Partition(points(spark, sf_dir), adaptive.domain_of(mask(spark, sf_dir, 4).select("cell"), RULES.base), RULES)


def _with_res(leaves):
    return leaves.select("cell", quad.res(F.col("cell")).alias("res"), "n")


def adaptive_split(spark, sf_dir):
    return _with_res(partition(spark, sf_dir).split())


def adaptive_leaves(spark, sf_dir):
    """Split, smoothed, merged and cut to the polygons."""
    p = partition(spark, sf_dir)
    leaves = p.compacted(p.smoothed(p.split())[0])
    return _with_res(adaptive.clipped(leaves, polygons(spark, sf_dir), RULES.base))


def adaptive_counters(spark, sf_dir):
    """Neighbours of the split before it is smoothed."""
    return adaptive.counters(adaptive_split(spark, sf_dir), RULES.delta, RULES.root)


def adaptive_smoothed_counters(spark, sf_dir):
    leaves, _ = (p := partition(spark, sf_dir)).smoothed(p.split())
    return adaptive.counters(leaves, RULES.delta, RULES.root)


def boundary_cells(spark, sf_dir):
    return layers.boundary(mask(spark, sf_dir).select("cell").distinct())


def covering_leaf(spark, sf_dir):
    fine = points(spark, sf_dir).select(quad.cell(F.col("lat"), F.col("lon"), 9).alias("cell")).distinct()
    return layers.covering_leaf(fine, adaptive_split(spark, sf_dir).select("cell"))


def ancestor_overlap(spark, sf_dir):
    both = occupied(spark, sf_dir).select("cell").union(layers.density(points(spark, sf_dir), 5).where("n > 3").select("cell"))
    return layers.overlaps(both)


def region_components(spark, sf_dir):
    return layers.regions(occupied(spark, sf_dir).select("cell"))


def region_points(spark, sf_dir):
    return layers.region_points(occupied(spark, sf_dir).select("cell"))


def _far(leaves):
    """Distinct pairs of neighbours, unordered, more than `delta` levels apart."""
    rows = adaptive.adjacency(leaves.select("cell"), RULES.root).where(F.col("delta") > RULES.delta)
    return rows.select(F.least("cell", "leaf").alias("one"), F.greatest("cell", "leaf").alias("two"), "delta").distinct()


def violation_samples(spark, sf_dir):
    """The first three pairs of neighbours too far apart, before the split is smoothed."""
    return _far(adaptive_split(spark, sf_dir)).orderBy("one", "two").limit(3)


def invariant_report(spark, sf_dir):
    p, leaves = points(spark, sf_dir), cut(adaptive_split(spark, sf_dir))
    checks = [
        ("coordinates", p.where("lat not between -90 and 90 or lon not between -180 and 180")),
        ("ids", p.groupBy("id").count().where("count > 1")),
        ("leaves_overlap", layers.overlaps(leaves.select("cell"))),
        ("leaves_repeat", leaves.groupBy("cell").count().where("count > 1")),
        ("occupied_too_coarse", leaves.where(f"n > 0 and res < {RULES.floor}")),
        ("resolution_out_of_range", leaves.where(f"res not between {RULES.min_output} and {RULES.most}")),
        ("resolution_differs", leaves.where(quad.res(F.col("cell")) != F.col("res"))),
        ("negative", leaves.where("n < 0")),
        ("neighbours_too_far", _far(leaves)),
    ]
    out = None
    for name, rows in checks:
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.union(one)
    return out


def _up(cell: str, to) -> str:
    """The ancestor at `to` of a cell of any finer or equal resolution."""
    return _make(to, f"(({cell} >> 25) & 33554431) >> (({cell} >> 50) - ({to}))::INT", f"({cell} & 33554431) >> (({cell} >> 50) - ({to}))::INT")


def _kids(rows: str, res: str = "(cell >> 50) + 1") -> str:
    x, y = "((cell >> 25) & 33554431)", "(cell & 33554431)"
    return f"(SELECT {_make(res, f'{x} * 2 + i', f'{y} * 2 + j')} AS cell FROM {rows}, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j))"


def _split_sql() -> str:
    """Levels of the split, one CTE each, over the domain, its ancestors, and counts at all levels."""
    r = RULES
    key = _up("near", f"least(near >> 50, {r.base})")
    parts = [f"dom AS (SELECT DISTINCT cell FROM {_cover(r.base)})", f"area AS MATERIALIZED (SELECT DISTINCT {_up('cell', 'r')} AS cell FROM dom, (SELECT unnest(range({r.root}, {r.base + 1})) AS r))"]
    parts.append(f"fin AS (SELECT {_cell('lat', 'lon', r.most)} AS cell FROM places WHERE {_cell('lat', 'lon', r.base)} IN (SELECT cell FROM dom))")
    parts.append(f"cnt AS MATERIALIZED (SELECT {_up('cell', 'r')} AS cell, count(*)::BIGINT AS n FROM fin, (SELECT unnest(range({r.root}, {r.most + 1})) AS r) GROUP BY 1)")
    parts.append(f"beside AS MATERIALIZED (SELECT DISTINCT near AS cell FROM {_disk(f'(SELECT cell FROM cnt WHERE cell >> 50 < {r.floor})', r.near_k)} WHERE near <> cell)")
    parts.append(f"f{r.root} AS (SELECT a.cell, coalesce(n, 0) AS n FROM area a LEFT JOIN cnt USING (cell) WHERE a.cell >> 50 = {r.root})")
    for res in range(r.root, r.most + 1):
        full = f"(n > 0 AND {res} < {r.floor} OR n > {r.target} AND {res} < {r.most})"
        if res < max(r.base, r.min_output):
            split = f"({full} OR n = 0)"
        elif res < r.floor - 1:
            band = f"SELECT cell FROM {_disk(f'(SELECT cell FROM f{res} WHERE n = 0)', r.boundary_k)} WHERE {key} NOT IN (SELECT cell FROM area)"
            split = f"({full} OR n = 0 AND (cell IN ({band}) OR cell IN (SELECT cell FROM beside)))"
        else:
            split = full
        parts.append(f"l{res} AS MATERIALIZED (SELECT cell, n, {split} AS splits FROM f{res})")
        if res < r.most:
            kids = _kids(f"(SELECT cell FROM l{res} WHERE splits)")
            parts.append(f"f{res + 1} AS (SELECT k.cell, coalesce(n, 0) AS n FROM {kids} k LEFT JOIN cnt USING (cell) WHERE {_up('k.cell', min(res + 1, r.base))} IN (SELECT cell FROM area))")
    leaves = " UNION ALL ".join(f"SELECT cell, {res} AS res, n FROM l{res} WHERE NOT splits" for res in range(r.root, r.most + 1))
    return f"{PLACES}, {POLY}, {', '.join(parts)}, leaves AS MATERIALIZED ({leaves})"


def _pairs(leaves: str) -> str:
    """SELECT cell, leaf, delta of a table of leaves."""
    return f"(SELECT cell, leaf, (cell >> 50) - (leaf >> 50) AS delta FROM (SELECT cell, {_up('near', 'r')} AS leaf FROM {_disk(leaves)}, (SELECT unnest(range({RULES.root}, {RULES.most + 1})) AS r) WHERE near <> cell AND r <= near >> 50) WHERE leaf IN (SELECT cell FROM {leaves}))"


def _smooth_sql(rounds: int = 6) -> str:
    """So many rounds of forced splits; the last one must find none, as the counters' SQL shows."""
    parts = ["s0 AS MATERIALIZED (SELECT cell, n FROM leaves)"]
    for k in range(rounds):
        parts.append(f"c{k}_ AS MATERIALIZED (SELECT DISTINCT leaf AS cell FROM {_pairs(f's{k}')} WHERE delta > {RULES.delta})")
        parts.append(f"s{k + 1} AS MATERIALIZED (SELECT cell, n FROM s{k} WHERE cell NOT IN (SELECT cell FROM c{k}_) UNION ALL SELECT k.cell, coalesce(n, 0) FROM {_kids(f'c{k}_')} k LEFT JOIN cnt USING (cell))")
    return f"{_split_sql()}, {', '.join(parts)}, smoothed AS MATERIALIZED (SELECT * FROM s{rounds})"


def _partition_sql() -> str:
    r, parts, last = RULES, [], "smoothed"
    for res in range(r.floor - 1, r.min_output, -1):
        parent, near = _up("cell", res - 1), _up("near", res - 1)
        band = f"SELECT cell FROM {_disk(f'g{res}', r.boundary_k)} WHERE {_up('near', min(res - 1, r.base))} NOT IN (SELECT cell FROM area)"
        parts.append(f"g{res} AS (SELECT {parent} AS cell FROM {last} WHERE cell >> 50 = {res} AND n = 0 GROUP BY 1 HAVING count(*) = 4)")
        fine = f"SELECT {near} FROM {_disk(f'(SELECT cell FROM {last} WHERE cell >> 50 > {res - 1 + r.delta})')}"
        parts.append(f"m{res} AS MATERIALIZED (SELECT cell FROM g{res} WHERE {res - 1} <= {r.interior} AND cell NOT IN ({band}) AND cell NOT IN (SELECT cell FROM beside) AND cell NOT IN ({fine}))")
        parts.append(f"p{res} AS MATERIALIZED (SELECT cell, n FROM {last} WHERE NOT (cell >> 50 = {res} AND {parent} IN (SELECT cell FROM m{res})) UNION ALL SELECT cell, 0 FROM m{res})")
        last = f"p{res}"
    n, x, y = "(1::BIGINT << (cell >> 50))", "((cell >> 25) & 33554431)", "(cell & 33554431)"
    inside = f"EXISTS (SELECT 1 FROM poly WHERE least(({x} + 1) / {n}::DOUBLE * 360 - 180, east) > greatest({x} / {n}::DOUBLE * 360 - 180, west) AND least(({y} + 1) / {n}::DOUBLE * 180 - 90, north) > greatest({y} / {n}::DOUBLE * 180 - 90, south))"
    return f"{_smooth_sql()}, {', '.join(parts)}, final AS (SELECT cell, (cell >> 50)::INT AS res, n FROM {last} WHERE {inside})"


def _quadtree_sql() -> str:
    parts, x, y = [f"q3 AS (SELECT iso, cell, overlap FROM {_cover(3)})"], "((cell >> 25) & 33554431)", "(cell & 33554431)"
    for res in range(4, RES + 1):
        kids = f"(SELECT iso, {_make(res, f'{x} * 2 + i', f'{y} * 2 + j')} AS cell FROM q{res - 1}, (SELECT unnest([0, 1]) AS i), (SELECT unnest([0, 1]) AS j) WHERE overlap < 1 - 1e-9 AND overlap > 1e-9)"
        parts.append(f"q{res} AS (SELECT k.iso, k.cell, c.overlap FROM {kids} k JOIN {_cover(res)} c USING (iso, cell))")
    leaves = " UNION ALL ".join(f"SELECT iso, cell FROM q{r} WHERE overlap " + (">= 1 - 1e-9" if r < RES else "> 1e-9") for r in range(3, RES + 1))
    return f"WITH {POLY}, {', '.join(parts)} SELECT cell, min(iso) AS iso FROM ({leaves}) GROUP BY 1"


COUNTED = f"SELECT count(*) AS adjacency_checks, count(*) FILTER (WHERE delta > {RULES.delta}) AS violating_neighbor_pairs, coalesce(max(delta), 0)::INT AS max_neighbor_delta_observed FROM {{pairs}}"
FAR = f"SELECT DISTINCT least(cell, leaf) AS one, greatest(cell, leaf) AS two, delta::INT AS delta FROM {_pairs('leaves')} WHERE delta > {RULES.delta}"
CLAIM = f"claim AS (SELECT cell, min(iso) AS iso FROM {_cover(RES)} GROUP BY 1)"
SQL = {
    "cell_density": f"WITH {DENSITY} SELECT * FROM dens",
    "density_seed": f"WITH {DENSITY} SELECT * FROM dens ORDER BY n DESC, cell LIMIT 1",
    "metro_core": f"""WITH RECURSIVE {DENSITY}, top AS {SEED}, inside AS (SELECT d.cell, d.n FROM dens d JOIN {_disk('top', 2)} k ON k.near = d.cell WHERE d.n >= 2),
 {CLOSE.format(disk=_disk('inside'), cells='inside')} SELECT cell, {RES}::INT AS resolution, n AS layer_value, 'metro_density_core' AS layer_id FROM inside JOIN comp USING (cell) WHERE component = (SELECT component FROM comp WHERE cell = {SEED})""",
    "hierarchical_counts": f"WITH {PLACES} " + " UNION ALL ".join(f"SELECT {_cell('lat', 'lon', r)} AS cell, {r} AS res, count(*)::BIGINT AS n FROM places GROUP BY 1" for r in range(2, 9)),
    "country_mask_fixed": f"WITH {POLY} SELECT iso, cell, round(overlap, 9) AS overlap FROM {_cover(RES)}",
    "country_mask_first_claim": f"WITH {POLY} SELECT cell, min(iso) AS iso, arg_min(name, iso) AS name FROM {_cover(RES)} GROUP BY 1",
    "country_mask_quadtree": _quadtree_sql(),
    "country_adjacency": f"WITH {POLY}, {CLAIM} SELECT DISTINCT a.iso, b.iso AS other FROM {_disk('claim')} d JOIN claim a ON a.cell = d.cell JOIN claim b ON b.cell = d.near WHERE a.iso <> b.iso",
    "adaptive_domain": f"WITH {POLY} SELECT DISTINCT cell, {_make(3, '((cell >> 25) & 33554431) >> 1', '(cell & 33554431) >> 1')} AS parent FROM {_cover(4)}",
    "adaptive_split": f"WITH {_split_sql()} SELECT * FROM leaves",
    "adaptive_leaves": f"WITH {_partition_sql()} SELECT * FROM final",
    "adaptive_counters": f"WITH {_split_sql()} {COUNTED.format(pairs=_pairs('leaves'))}",
    "adaptive_smoothed_counters": f"WITH {_smooth_sql()} {COUNTED.format(pairs=_pairs('smoothed'))}",
    "boundary_cells": f"WITH {POLY}, m AS (SELECT DISTINCT cell FROM {_cover(RES)}) SELECT DISTINCT cell FROM {_disk('m')} WHERE near NOT IN (SELECT cell FROM m)",
    "covering_leaf": f"""WITH {_split_sql()}, fine AS (SELECT DISTINCT {_cell('lat', 'lon', 9)} AS cell FROM places),
 up AS (SELECT cell, {_make('r', '((cell >> 25) & 33554431) >> (9 - r)', '(cell & 33554431) >> (9 - r)')} AS leaf FROM fine, (SELECT unnest(range(10)) AS r))
 SELECT f.cell, (SELECT max(u.leaf) FROM up u JOIN leaves l ON l.cell = u.leaf WHERE u.cell = f.cell) AS leaf FROM fine f""",
    "ancestor_overlap": f"WITH {DENSITY}, five AS (SELECT {_cell('lat', 'lon', 5)} AS cell FROM places GROUP BY 1 HAVING count(*) > 3) SELECT cell FROM dens WHERE {_make(5, '((cell >> 25) & 33554431) >> 1', '(cell & 33554431) >> 1')} IN (SELECT cell FROM five)",
    "region_components": f"WITH RECURSIVE {DENSITY}, {CLOSE.format(disk=_disk('dens'), cells='dens')} SELECT * FROM comp",
    "region_points": f"WITH RECURSIVE {DENSITY}, {CLOSE.format(disk=_disk('dens'), cells='dens')} SELECT component, 'r7c:' || component AS region_id, size, arg_min(cell, (round(far, 9), cell)) AS representative FROM ({CENTRED}) GROUP BY 1, 2, 3",
    "invariant_report": f"""WITH {_split_sql()}, up AS (SELECT l.cell, {_make('r', '((l.cell >> 25) & 33554431) >> (res - r)::INT', '(l.cell & 33554431) >> (res - r)::INT')} AS above FROM leaves l, (SELECT unnest(range(2, 9)) AS r) WHERE r < res)
 SELECT 'coordinates' AS "check", count(*)::BIGINT AS violations FROM places WHERE lat NOT BETWEEN -90 AND 90 OR lon NOT BETWEEN -180 AND 180
 UNION ALL SELECT 'ids', count(*) FROM (SELECT id FROM places GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'leaves_overlap', count(DISTINCT u.cell) FROM up u JOIN leaves l ON l.cell = u.above
 UNION ALL SELECT 'leaves_repeat', count(*) FROM (SELECT cell FROM leaves GROUP BY 1 HAVING count(*) > 1)
 UNION ALL SELECT 'occupied_too_coarse', count(*) FROM leaves WHERE n > 0 AND res < {RULES.floor}
 UNION ALL SELECT 'resolution_out_of_range', count(*) FROM leaves WHERE res NOT BETWEEN {RULES.min_output} AND {RULES.most}
 UNION ALL SELECT 'resolution_differs', count(*) FROM leaves WHERE cell >> 50 <> res
 UNION ALL SELECT 'negative', count(*) FROM leaves WHERE n < 0
 UNION ALL SELECT 'neighbours_too_far', count(*) FROM ({FAR})""",
    "violation_samples": f"WITH {_split_sql()} {FAR} ORDER BY one, two LIMIT 3",
}
QUERIES = [cell_density, density_seed, metro_core, hierarchical_counts, country_mask_fixed, country_mask_first_claim, country_mask_quadtree, country_adjacency, adaptive_domain, adaptive_split, adaptive_leaves, adaptive_counters, adaptive_smoothed_counters, boundary_cells, covering_leaf, ancestor_overlap, region_components, region_points, invariant_report, violation_samples]
