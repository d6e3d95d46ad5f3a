"""Leaves merged, refined and brought to one resolution; colours for neighbouring areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.operators.layers import overlap
from terracell.session import cut


def _above(cell: Column, res: int) -> Column:
    """The ancestor at `res` of a cell of any finer or equal resolution."""
    k = F.pow(F.lit(2.0), (quad.res(cell) - res).cast("double"))
    return quad.make(res, F.floor(quad.col(cell) / k), F.floor(quad.row(cell) / k))


def compact(leaves: DataFrame, base: int, most: int, delta: int = 1) -> DataFrame:
    """cell, n: four empty leaves of one parent become the parent, finest first, never above `base`.

    A merge that would put a leaf more than `delta` levels finer beside the parent is left out.  A level's merges only make leaves of that level
    coarser, so they can't block each other and all are done at once."""
    rows = cut(leaves.select("cell", "n"))
    for res in range(most, base, -1):
        own = quad.res(F.col("cell"))
        empty = rows.where((own == res) & (F.col("n") == 0)).groupBy(quad.parent(F.col("cell"), res - 1, res).alias("parent"))
        full = empty.agg(F.count(F.lit(1)).alias("k")).where("k = 4").select("parent")
        fine = rows.where(own > res - 1 + delta).select(F.explode(quad.disk(F.col("cell"), 1)).alias("near"))
        merged = cut(full.join(fine.select(_above(F.col("near"), res - 1).alias("parent")), "parent", "left_anti"))
        rest = rows.withColumn("parent", F.when(own == res, quad.parent(F.col("cell"), res - 1, res))).join(merged, "parent", "left_anti")
        rows = cut(rest.select("cell", "n").unionByName(merged.select(F.col("parent").alias("cell"), F.lit(0).cast("long").alias("n"))))
    return rows


def at_resolution(leaves: DataFrame, res: int) -> DataFrame:
    """cell: coarser leaves expanded to `res`, finer ones rolled up, each cell once."""
    own, cell = quad.res(F.col("cell")), F.col("cell")
    times = F.pow(F.lit(2.0), (res - own).cast("double"))
    steps = F.sequence(F.lit(0), F.greatest(times.cast("int"), F.lit(1)) - 1)
    spread = leaves.select(F.floor(quad.col(cell) * times).alias("x"), F.floor(quad.row(cell) * times).alias("y"), F.explode(steps).alias("i"), steps.alias("steps"))
    return spread.select("x", "y", "i", F.explode("steps").alias("j")).select(quad.make(res, F.col("x") + F.col("i"), F.col("y") + F.col("j")).alias("cell")).distinct()


def refined(cells: DataFrame, polygons: DataFrame, res: int, least: float) -> DataFrame:
    """iso, cell: a cell's children that the polygon covers by more than `least`; a cell without such children stays."""
    kids = cells.select("iso", F.col("cell").alias("parent"), F.explode(quad.children(F.col("cell"))).alias("cell"))
    boxes = polygons.select("iso", "west", "south", "east", "north")
    kept = kids.join(boxes, "iso").withColumn("overlap", overlap(F.col("cell"))).where(F.col("overlap") > least).select("iso", "parent", "cell")
    lone = cells.join(kept.select("iso", F.col("parent").alias("cell")), ["iso", "cell"], "left_anti")
    return kept.select("iso", "cell").unionByName(lone.select("iso", "cell"))


def colors(areas: DataFrame, near: DataFrame, palette: int = 8, most: int = 5000) -> DataFrame:
    """iso, color: areas (iso) by falling number of neighbours, then by iso, take the least colour that no neighbour has, modulo the palette.

    Each choice needs those before it, so it is made on the driver; more than `most` areas, or as many pairs as they could have on a map, are refused."""
    isos = [r.iso for r in areas.select("iso").distinct().limit(most + 1).collect()]
    pairs = near.select("iso", "other").distinct().limit(8 * most + 1).collect()
    if len(isos) > most or len(pairs) > 8 * most:
        raise ValueError(f"more than {most} areas")
    around: dict = {iso: set() for iso in isos}
    for r in pairs:
        around[r.iso].add(r.other)
        around[r.other].add(r.iso)
    taken: dict = {}
    for iso in sorted(around, key=lambda i: (-len(around[i]), i)):
        used = {taken.get(o) for o in around[iso]}
        taken[iso] = next(c for c in range(len(around) + 1) if c not in used)
    kind = areas.schema["iso"].dataType.simpleString()
    return areas.sparkSession.createDataFrame([(i, c % palette) for i, c in sorted(taken.items())], f"iso {kind}, color int")
