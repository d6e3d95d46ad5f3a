"""Layers over cells: density core, masks, hierarchy, regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.operators.components import components
from terracell.session import cut


def density(points: DataFrame, res: int) -> DataFrame:
    """cell, n of points (lat, lon)."""
    return points.groupBy(quad.cell(F.col("lat"), F.col("lon"), res).alias("cell")).agg(F.count(F.lit(1)).alias("n"))


def seed(cells: DataFrame) -> DataFrame:
    """The fullest cell, the least of equals: one row."""
    return cells.orderBy(F.desc("n"), "cell").limit(1)


def adjacency(cells: DataFrame, k: int = 1) -> DataFrame:
    """u, v: neighbouring cells of one set (cell), by an equi-join on exploded disks."""
    near = cells.select(F.col("cell").alias("u"), F.explode(quad.disk(F.col("cell"), k)).alias("v")).where("u <> v")
    return near.join(cells.select(F.col("cell").alias("v")), "v", "left_semi").select("u", "v")


def regions(cells: DataFrame) -> DataFrame:
    """cell, component (least cell) of the connected regions of a set of cells; lone cells are regions of their own."""
    found = components(adjacency(cells)).select(F.col("node").alias("cell"), "component")
    return cells.join(found, "cell", "left").select("cell", F.coalesce("component", "cell").alias("component"))


def metro_core(points: DataFrame, res: int, k: int, least: int) -> DataFrame:
    """The connected cells of at least `least` points around the fullest cell, within k cells of it; with the latest asof_date where the points have one.

    At most (2k + 1)^2 cells lie in the disk, so its connected part is found in one row, by as many rounds as it has cells."""
    asof = [F.max("asof_date").alias("asof_date")] if "asof_date" in points.columns else []
    cells = points.groupBy(quad.cell(F.col("lat"), F.col("lon"), res).alias("cell")).agg(F.count(F.lit(1)).alias("n"), *asof)
    n = 1 << res
    top = F.max(F.struct(F.col("n").alias("n"), (-F.col("cell")).alias("cell")))
    near = seed(cells).select(F.explode(quad.disk(F.col("cell"), k)).alias("cell"))
    inside = cells.where(F.col("n") >= least).join(F.broadcast(near), "cell")  # a disk of fixed size
    one = inside.agg(F.collect_list(F.struct("cell", "n", *[c for c in ("asof_date",) if asof])).alias("cells"), top.alias("top"))
    gap = lambda a, b: F.abs(quad.col(a) - quad.col(b))
    beside = lambda a, b: (F.least(gap(a, b), n - gap(a, b)) <= 1) & (F.abs(quad.row(a) - quad.row(b)) <= 1)
    grow = lambda part, _: F.filter(F.col("cells"), lambda c: F.exists(part, lambda p: beside(p["cell"], c["cell"])))
    start = F.filter(F.col("cells"), lambda c: c["cell"] == -F.col("top.cell"))
    found = F.aggregate(F.sequence(F.lit(1), F.size("cells")), start, grow)
    rows = one.where("top is not null").select(F.explode(found).alias("c"))
    return rows.select("c.cell", F.lit(res).alias("resolution"), F.col("c.n").alias("layer_value"), F.lit("metro_density_core").alias("layer_id"), *([F.col("c.asof_date")] if asof else []))


def hierarchy(points: DataFrame, least: int, most: int) -> DataFrame:
    """cell, res, n at every resolution from least to most: counted once at the finest, then rolled up."""
    fine = density(points, most)
    rolled = fine.select(F.explode(quad.ancestors(F.col("cell"), least)).alias("cell"), "n")
    return rolled.groupBy("cell").agg(F.sum("n").alias("n")).select("cell", quad.res(F.col("cell")).alias("res"), "n")


def covering(polygons: DataFrame, res: int) -> DataFrame:
    """iso, name, cell, overlap: cells of one resolution that a rectangle meets, with the share of each that it covers."""
    n = 1 << res
    low = lambda v, span, off: F.greatest(F.lit(0), F.floor((F.col(v) + off) / span * n)).cast("int")
    high = lambda v, span, off: F.least(F.lit(n - 1), F.ceil((F.col(v) + off) / span * n) - 1).cast("int")
    rows = polygons.withColumn("x", F.explode(F.sequence(low("west", 360.0, 180.0), high("east", 360.0, 180.0)))).withColumn("y", F.explode(F.sequence(low("south", 180.0, 90.0), high("north", 180.0, 90.0))))
    rows = rows.withColumn("cell", quad.make(res, F.col("x"), F.col("y")))
    w, h = 360.0 / n, 180.0 / n
    wide = F.least(F.col("east"), F.col("x") * w - 180.0 + w) - F.greatest(F.col("west"), F.col("x") * w - 180.0)
    tall = F.least(F.col("north"), F.col("y") * h - 90.0 + h) - F.greatest(F.col("south"), F.col("y") * h - 90.0)
    return rows.withColumn("overlap", wide * tall / (w * h)).where("overlap > 0").select("iso", "name", "cell", "overlap")


def overlap(cell: Column) -> Column:
    """The share of a cell that the row's rectangle (west, south, east, north) covers; 0 or less where it doesn't."""
    west, south = quad.west_south(cell)
    n = F.pow(F.lit(2.0), quad.res(cell).cast("double"))
    w, h = F.lit(360.0) / n, F.lit(180.0) / n
    wide, tall = F.least("east", west + w) - F.greatest("west", west), F.least("north", south + h) - F.greatest("south", south)
    return F.when((wide > 0) & (tall > 0), wide * tall / (w * h)).otherwise(0.0)


def first_claim(covered: DataFrame) -> DataFrame:
    """cell, iso, name: the first polygon in order of iso has a cell."""
    return covered.groupBy("cell").agg(F.min(F.struct("iso", "name")).alias("p")).select("cell", "p.iso", "p.name")


def quadtree_mask(polygons: DataFrame, base: int, most: int, inside: float = 1e-9, outside: float = 1e-9) -> DataFrame:
    """cell, iso: cells that a polygon covers wholly are kept, those it misses go, others split down to `most`."""
    boxes = polygons.select("iso", "west", "south", "east", "north")
    frontier, leaves = covering(polygons, base).select("iso", "cell", "overlap").join(boxes, "iso"), None
    for res in range(base, most + 1):
        done = frontier.where(F.col("overlap") >= 1 - inside) if res < most else frontier.where(F.col("overlap") > outside)
        leaves = done if leaves is None else leaves.unionByName(done)
        if res < most:
            split = frontier.where((F.col("overlap") < 1 - inside) & (F.col("overlap") > outside)).select("iso", "west", "south", "east", "north", F.explode(quad.children(F.col("cell"))).alias("cell"))
            frontier = split.withColumn("overlap", overlap(F.col("cell"))).where("overlap > 0")
    return leaves.groupBy("cell").agg(F.min("iso").alias("iso"))


def boundary(cells: DataFrame) -> DataFrame:
    """Cells with a neighbour outside the set."""
    near = cells.select("cell", F.explode(quad.disk(F.col("cell"), 1)).alias("near"))
    return near.join(cells.select(F.col("cell").alias("near")), "near", "left_anti").select("cell").distinct()


def covering_leaf(queries: DataFrame, leaves: DataFrame, least: int = 0) -> DataFrame:
    """cell, leaf: the finest leaf that holds each query cell (null: none), by an equi-join on exploded ancestors."""
    up = queries.select("cell", F.explode(quad.ancestors(F.col("cell"), least)).alias("leaf"))
    found = up.join(leaves.select(F.col("cell").alias("leaf")), "leaf", "left_semi").groupBy("cell").agg(F.max("leaf").alias("leaf"))
    return queries.join(found, "cell", "left").select("cell", "leaf")


def overlaps(leaves: DataFrame, least: int = 0) -> DataFrame:
    """Leaves that lie inside another leaf."""
    up = leaves.select("cell", F.explode(quad.ancestors(F.col("cell"), least, own=False)).alias("above"))
    return up.join(leaves.select(F.col("cell").alias("above")), "above", "left_semi").select("cell").distinct()


def smooth(leaves: DataFrame, delta: int = 1, rounds: int = 30, most: int = 24) -> DataFrame:
    """cell: leaves of any cover split until neighbours' resolutions differ by delta at most; none of resolution `most` or finer is split.  All violators
    of a round split together; the result is the least set of splits, whatever their order.  operators.adaptive has the same within a domain."""
    cells = cut(leaves.select("cell"))
    for _ in range(rounds):
        near = cells.select("cell", F.explode(quad.disk(F.col("cell"), 1)).alias("near")).where("near <> cell")
        up = near.select("cell", F.explode(quad.ancestors(F.col("near"), 0)).alias("leaf"))
        found = up.join(cells.select(F.col("cell").alias("leaf")), "leaf", "left_semi")
        coarse = cut(found.where(quad.res(F.col("cell")) - quad.res(F.col("leaf")) > delta).where(quad.res(F.col("leaf")) < most).select(F.col("leaf").alias("cell")).distinct())
        if coarse.isEmpty():
            return cells
        fine = coarse.select(F.explode(quad.children(F.col("cell"))).alias("cell"))
        cells = cut(cells.join(coarse, "cell", "left_anti").unionByName(fine))
    raise ValueError("not smooth after the given rounds")


def region_points(cells: DataFrame) -> DataFrame:
    """component, region_id, size, representative: the cell whose centre is nearest to the mean of its region's centres (the least of equals)."""
    lat, lon = quad.centre(F.col("cell"))
    rows = cut(regions(cells)).withColumns({"lat": lat, "lon": lon})
    means = rows.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.avg("lat").alias("mean_lat"), F.avg("lon").alias("mean_lon"))
    far = (F.col("lat") - F.col("mean_lat")) ** 2 + (F.col("lon") - F.col("mean_lon")) ** 2
    best = rows.join(means, "component").groupBy("component").agg(F.first("size").alias("size"), F.min(F.struct(F.round(far, 9).alias("far"), "cell")).alias("p"))
    return best.select("component", F.concat(F.lit("r7c:"), "component").alias("region_id"), "size", F.col("p.cell").alias("representative"))
