"""Queries over merged, refined and coloured surfaces and simplified lines, and their SQL; colours and lines are tested against plain models."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions.lines import portal_id, simplified
from terracell.operators import surface
from terracell.plans.cells import POLY, _cover, _disk, _make, _split_sql, adaptive_split, country_adjacency, mask
from terracell.plans.facilities import PLACES
from terracell.plans.roads import ways
from terracell.sources.derived import facilities, polygons

BASE, MOST, RES, LEAST = 3, 9, 5, 0.15


def compacted_leaves(spark, sf_dir):
    return surface.compact(adaptive_split(spark, sf_dir), BASE, MOST)


def leaves_at_resolution(spark, sf_dir):
    return surface.at_resolution(adaptive_split(spark, sf_dir), RES)


def leaves_by_resolution(spark, sf_dir):
    rows = adaptive_split(spark, sf_dir).groupBy("res")
    return rows.agg(F.count(F.lit(1)).alias("leaves"), F.count_if(F.col("n") == 0).alias("empty"), F.sum("n").alias("facilities"))


def mask_refined(spark, sf_dir):
    return surface.refined(mask(spark, sf_dir, 4).select("iso", "cell"), polygons(spark, sf_dir), 4, LEAST)


def country_colors(spark, sf_dir):
    return surface.colors(polygons(spark, sf_dir).select("iso"), country_adjacency(spark, sf_dir))


def portal_ids(spark, sf_dir):
    return facilities(spark, sf_dir).select("id", "source", portal_id(RES, F.col("lon"), F.col("lat")).alias("portal"))


def routes_simplified(spark, sf_dir):
    place = lambda k: F.struct(((k * 104729 % 34000) / 100.0 - 170).alias("lon"), ((k * 7919 % 12000) / 100.0 - 60).alias("lat"))
    rows = ways(spark, sf_dir).select("way_id", F.transform("refs", place).alias("line"))
    return rows.withColumn("shape", simplified(F.col("line"), 20.0, 1)).select("way_id", F.size("line").alias("points"), F.size("shape").alias("kept"), F.to_json("shape").alias("shape"))


X, Y, R = "((cell >> 25) & 33554431)", "(cell & 33554431)", "(cell >> 50)"


def _compact_sql() -> str:
    parts = [f"s{MOST} AS (SELECT cell, n FROM leaves)"]
    for r in range(MOST, BASE, -1):
        up = _make(r - 1, f"{X} >> 1", f"{Y} >> 1")
        near = _make(r - 1, f"((near >> 25) & 33554431) >> ((near >> 50) - {r - 1})", f"(near & 33554431) >> ((near >> 50) - {r - 1})")
        parts.append(f"fine{r} AS (SELECT cell FROM s{r} WHERE {R} > {r})")
        parts.append(f"g{r} AS (SELECT {up} AS parent FROM s{r} WHERE {R} = {r} AND n = 0 GROUP BY 1 HAVING count(*) = 4), m{r} AS (SELECT parent FROM g{r} WHERE parent NOT IN (SELECT {near} FROM {_disk(f'fine{r}')}))")
        parts.append(f"s{r - 1} AS (SELECT cell, n FROM s{r} WHERE NOT ({R} = {r} AND {up} IN (SELECT parent FROM m{r})) UNION ALL SELECT parent, 0 FROM m{r})")
    return f"WITH {_split_sql()}, {', '.join(parts)} SELECT cell, n FROM s{BASE}"


_UP, _DOWN = f"greatest({R} - {RES}, 0)", f"greatest({RES} - {R}, 0)"
_SIDE = 1 << (RES - BASE)
SQL = {
    "compacted_leaves": _compact_sql(),
    "leaves_at_resolution": f"""WITH {_split_sql()} SELECT DISTINCT {_make(RES, f'(({X} >> {_UP}) << {_DOWN}) + i', f'(({Y} >> {_UP}) << {_DOWN}) + j')} AS cell
 FROM leaves, (SELECT unnest(range({_SIDE})) AS i), (SELECT unnest(range({_SIDE})) AS j) WHERE i < 1::BIGINT << {_DOWN} AND j < 1::BIGINT << {_DOWN}""",
    "leaves_by_resolution": f"WITH {_split_sql()} SELECT res, count(*) AS leaves, count(*) FILTER (WHERE n = 0) AS empty, sum(n)::BIGINT AS facilities FROM leaves GROUP BY 1",
    "mask_refined": f"""WITH {POLY}, p AS (SELECT iso, cell FROM {_cover(4)}), k AS (SELECT iso, cell, {_make(4, f'{X} >> 1', f'{Y} >> 1')} AS parent FROM {_cover(5)} WHERE overlap > {LEAST})
 SELECT k.iso, k.cell FROM k JOIN p ON p.iso = k.iso AND p.cell = k.parent UNION ALL SELECT iso, cell FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.iso = p.iso AND k.parent = p.cell)""",
    "portal_ids": f"WITH {PLACES} SELECT id, source, -(('0x' || substr(sha256(printf('%d|%.9f|%.9f', {RES}, lon::DOUBLE, lat::DOUBLE)), 1, 13))::BIGINT) AS portal FROM places",
}
QUERIES = [compacted_leaves, leaves_at_resolution, leaves_by_resolution, mask_refined, country_colors, portal_ids, routes_simplified]
