"""Adaptive partition of a domain of cells: fine where facilities are, where the domain ends, and beside occupied cells; neighbours differ by few levels."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.operators import polygons as areas
from terracell.operators.layers import density
from terracell.session import cut


@dataclass(frozen=True)
class Rules:
    """Resolutions and limits of a partition.

    root: coarsest, where empty branches start; base: of the domain's cells; min_output: coarsest of the output; floor and most: of occupied leaves;
    target: facilities in a leaf, beyond which it splits until `most`; interior: finest of empty leaves inside; boundary_k, near_k: width of the bands
    in which empty leaves are refined to floor - 1; compact_near: empty leaves beside occupied ones are merged as well; delta: largest step between neighbours."""

    base: int = 4
    root: int = 0
    min_output: int = 5
    floor: int = 7
    most: int = 9
    target: int = 2
    interior: int = 5
    boundary_k: int = 1
    near_k: int = 1
    compact_near: bool = False
    delta: int = 1

    def __post_init__(self) -> None:
        checks = {
            "0 <= root <= base": 0 <= self.root <= self.base,
            "0 <= floor <= most": 0 <= self.floor <= self.most,
            "0 <= min_output <= most": 0 <= self.min_output <= self.most,
            "base <= interior < floor": self.base <= self.interior < self.floor,
            "target >= 1": self.target >= 1,
            "boundary_k, near_k and delta >= 0": min(self.boundary_k, self.near_k, self.delta) >= 0,
        }
        if wrong := [text for text, holds in checks.items() if not holds]:
            raise ValueError(f"not so: {', '.join(wrong)}")


def ancestor(cell: Column, to: int | Column) -> Column:
    """The ancestor at `to` of a cell of any finer or equal resolution."""
    k = F.pow(F.lit(2.0), (quad.res(cell) - to).cast("double"))
    return quad.make(to, F.floor(quad.col(cell) / k), F.floor(quad.row(cell) / k))


def domain_of(mask: DataFrame, base: int) -> DataFrame:
    """cell: mask cells of any resolution as cells of `base`, coarser ones expanded, finer ones rolled up."""
    own, cell = quad.res(F.col("cell")), F.col("cell")
    times = F.pow(F.lit(2.0), (F.lit(base) - own).cast("double"))
    steps = F.sequence(F.lit(0), F.greatest(times.cast("int"), F.lit(1)) - 1)
    spread = mask.select(F.floor(quad.col(cell) * times).alias("x"), F.floor(quad.row(cell) * times).alias("y"), steps.alias("steps"))
    spread = spread.select("x", "y", "steps", F.explode("steps").alias("i")).select("x", "y", "i", F.explode("steps").alias("j"))
    return spread.select(quad.make(base, F.col("x") + F.col("i"), F.col("y") + F.col("j")).alias("cell")).distinct()


class Partition:
    """What the levels of one partition share: the domain with its ancestors, counts at every resolution, cells beside occupied ones."""

    def __init__(self, points: DataFrame, domain: DataFrame, rules: Rules):
        self.rules = rules
        self.area = cut(domain.select(F.explode(quad.ancestors(F.col("cell"), rules.root)).alias("cell")).distinct())
        fine = density(points, rules.most)
        inside = self.within(fine.withColumn("own", ancestor(F.col("cell"), rules.base)), "own").drop("own")
        rolled = inside.select(F.explode(quad.ancestors(F.col("cell"), rules.root)).alias("cell"), "n")
        self.counts = cut(rolled.groupBy("cell").agg(F.sum("n").alias("n")))
        near = self.counts.where(quad.res(F.col("cell")) < rules.floor).select("cell", F.explode(quad.disk(F.col("cell"), rules.near_k)).alias("near"))
        self.near = cut(near.where("near <> cell").select(F.col("near").alias("cell")).distinct())

    def _key(self, cell: Column) -> Column:
        return ancestor(cell, F.least(quad.res(cell), F.lit(self.rules.base)))

    def within(self, cells: DataFrame, key: str = "cell") -> DataFrame:
        """The cells that meet the domain."""
        rows = cells.withColumn("_key", self._key(F.col(key)))
        return rows.join(self.area.select(F.col("cell").alias("_key")), "_key", "left_semi").drop("_key")

    def banded(self, cells: DataFrame) -> DataFrame:
        """cell: those of the cells with a neighbour outside the domain."""
        near = cells.select("cell", F.explode(quad.disk(F.col("cell"), self.rules.boundary_k)).alias("near")).withColumn("_key", self._key(F.col("near")))
        return near.join(self.area.select(F.col("cell").alias("_key")), "_key", "left_anti").select("cell").distinct()

    def counted(self, cells: DataFrame) -> DataFrame:
        return cells.join(self.counts, "cell", "left").select("cell", F.coalesce("n", F.lit(0).cast("long")).alias("n"))

    def children(self, cells: DataFrame) -> DataFrame:
        """cell, n of the children that meet the domain."""
        kids = cells.select(F.explode(quad.children(F.col("cell"))).alias("cell"))
        return self.counted(self.within(kids))

    def _splits(self) -> Column:
        """Whether a cell splits for the facilities that it holds; where a cell does, so do all its ancestors."""
        r, res, n = self.rules, quad.res(F.col("cell")), F.col("n")
        return (n > 0) & (res < r.floor) | (n > r.target) & (res < r.most)

    def split(self) -> DataFrame:
        """cell, n: leaves of the top-down split.

        All cells above the domain's resolution or the coarsest output split.  Down to floor - 1 empty cells may, so each level asks the one before; below,
        counts alone decide, and the leaves of all levels are children of cells that split, found at once."""
        r = self.rules
        start, leaves = max(r.base, r.min_output), []
        frontier = self.counted(self.within(domain_of(self.area.where(quad.res(F.col("cell")) == r.base), start)))
        for res in range(start, r.floor - 1):
            empty = frontier.where("n = 0").select("cell")
            refined = self.banded(empty).union(empty.join(self.near, "cell", "left_semi")).distinct().withColumn("refined", F.lit(True))
            level = cut(frontier.join(refined, "cell", "left").select("cell", "n", (self._splits() | F.coalesce(F.col("refined"), F.lit(False))).alias("splits")))
            leaves.append(level.where("not splits").select("cell", "n"))
            frontier = self.children(level.where("splits"))
        leaves.append(frontier.where(~self._splits()))
        deep = self.counts.where(self._splits() & (quad.res(F.col("cell")) >= max(start, r.floor - 1)))
        leaves.append(self.children(deep).where(~self._splits()))
        out = leaves[0]
        for more in leaves[1:]:
            out = out.unionByName(more)
        return cut(out)

    def smoothed(self, leaves: DataFrame, rounds: int = 100) -> tuple[DataFrame, int]:
        """cell, n with neighbours' resolutions at most `delta` apart, and the number of leaves refined on the way.

        A finer leaf forces the coarser one to split; forced splits only add demands, so all of a round are made at once.  After a round only the new
        leaves, and those that forced a split, are looked at again."""
        r, refined = self.rules, 0
        asking = leaves.select("cell")
        for _ in range(rounds):
            near = asking.where(quad.res(F.col("cell")) > r.root + r.delta).select("cell", F.explode(quad.disk(F.col("cell"), 1)).alias("near")).where("near <> cell")
            levels = F.sequence(F.lit(r.root), quad.res(F.col("near")) - r.delta - 1)
            up = near.select("cell", F.explode(F.transform(levels, lambda k: ancestor(F.col("near"), k))).alias("leaf"))
            forced = cut(up.join(leaves.select(F.col("cell").alias("leaf")), "leaf", "left_semi"))
            coarse = cut(forced.select(F.col("leaf").alias("cell")).distinct())
            n = coarse.count()
            if not n:
                return leaves, refined
            fine = cut(self.children(coarse))
            leaves, refined = cut(leaves.join(coarse, "cell", "left_anti").unionByName(fine)), refined + n
            asking = forced.select("cell").union(fine.select("cell")).distinct().join(leaves, "cell", "left_semi")
        raise ValueError("not smooth after the given rounds")

    def compacted(self, leaves: DataFrame) -> DataFrame:
        """cell, n: empty siblings merged into their parent, finest first, where the parent would not have been refined and no neighbour is too fine for it.

        A level's merges only make leaves of that level coarser, so they can't block each other and all are done at once."""
        r = self.rules
        for res in range(r.floor - 1, r.min_output, -1):
            if res - 1 < r.base:
                break
            own = quad.res(F.col("cell"))
            mine = leaves.where((own == res) & (F.col("n") == 0))
            groups = mine.groupBy(quad.parent(F.col("cell"), res - 1, res).alias("cell")).agg(F.count(F.lit(1)).alias("k")).where("k = 4").select("cell")
            groups = groups.join(self.banded(groups), "cell", "left_anti")
            if not r.compact_near:
                groups = groups.join(self.near, "cell", "left_anti")
            if res - 1 > min(r.interior, r.floor - 1):
                groups = groups.join(self.near, "cell", "left_semi")  # inside, empty leaves are merged at `interior` at the finest
            fine = leaves.where(own > res - 1 + r.delta).select(F.explode(quad.disk(F.col("cell"), 1)).alias("near"))
            merged = cut(groups.join(fine.select(ancestor(F.col("near"), res - 1).alias("cell")), "cell", "left_anti"))
            gone = merged.select(F.explode(quad.children(F.col("cell"))).alias("cell"))
            leaves = cut(leaves.join(gone, "cell", "left_anti").unionByName(merged.withColumn("n", F.lit(0).cast("long"))))
        return leaves


def adjacency(leaves: DataFrame, root: int = 0) -> DataFrame:
    """cell, leaf, delta: for each neighbour, of a leaf's own resolution, that a leaf of that or a coarser resolution covers."""
    near = leaves.select("cell", F.explode(quad.disk(F.col("cell"), 1)).alias("near")).where("near <> cell")
    up = near.select("cell", F.explode(quad.ancestors(F.col("near"), root)).alias("leaf"))
    return up.join(leaves.select(F.col("cell").alias("leaf")), "leaf", "left_semi").select("cell", "leaf", (quad.res(F.col("cell")) - quad.res(F.col("leaf"))).alias("delta"))


def counters(leaves: DataFrame, delta: int, root: int = 0) -> DataFrame:
    """One row: neighbours looked at, those too far apart in resolution, the largest difference."""
    rows = adjacency(leaves, root)
    return rows.agg(F.count(F.lit(1)).alias("adjacency_checks"), F.count_if(F.col("delta") > delta).alias("violating_neighbor_pairs"), F.coalesce(F.max("delta"), F.lit(0)).alias("max_neighbor_delta_observed"))


def clipped(leaves: DataFrame, polygons: DataFrame, base: int) -> DataFrame:
    """Leaves that overlap a rectangle (west, south, east, north) in more than a line; rectangles meet leaves by the cells of `base` that both touch."""
    n = 1 << base
    span = lambda low, high, size, off: F.sequence(F.greatest(F.lit(0), F.floor((F.col(low) + off) / size * n)).cast("int"), F.least(F.lit(n - 1), F.floor((F.col(high) + off) / size * n)).cast("int"))
    spread = polygons.select("west", "south", "east", "north", F.explode(span("west", "east", 360.0, 180.0)).alias("x"), span("south", "north", 180.0, 90.0).alias("ys"))
    spread = spread.select("west", "south", "east", "north", "x", F.explode("ys").alias("y")).select("west", "south", "east", "north", quad.make(base, F.col("x"), F.col("y")).alias("_base"))
    size = F.pow(F.lit(2.0), quad.res(F.col("cell")).cast("double"))
    west, south = quad.west_south(F.col("cell"))
    rows = leaves.select("cell", ancestor(F.col("cell"), base).alias("_base"), west.alias("w"), south.alias("s"), (west + 360.0 / size).alias("e"), (south + 180.0 / size).alias("t"))
    met = rows.join(spread, "_base").where("least(e, east) > greatest(w, west) and least(t, north) > greatest(s, south)").select("cell").distinct()
    return leaves.join(met, "cell", "left_semi")


def partition(points: DataFrame, mask: DataFrame, rules: Rules, polygons: DataFrame | None = None) -> tuple[DataFrame, dict]:
    """cell, resolution, layer_value of the whole partition, and its metadata; an error if neighbours are still too far apart.

    points: lat, lon; mask: cells of any resolution. With polygons (shapes, or rectangles), leaves outside them are dropped at the end. An empty mask gives no leaves."""
    p = Partition(points, domain_of(mask, rules.base), rules)
    leaves, refined = p.smoothed(p.split())
    leaves = p.compacted(leaves)
    found = counters(leaves, rules.delta, rules.root).first().asDict()
    if found["violating_neighbor_pairs"]:
        raise ValueError(f"{found['violating_neighbor_pairs']} neighbours differ by more than {rules.delta} levels, by {found['max_neighbor_delta_observed']} at most")
    out, dropped = leaves, 0
    if polygons is not None:
        out = cut(areas.met(leaves, polygons) if "shape" in polygons.columns else clipped(leaves, polygons, rules.base))
        dropped = leaves.count() - out.count()
    metadata = found | {"smoothing_iterations": refined, "coverage_domain": f"country_mask_r{rules.base}", "params": dict(vars(rules)), "country_intersection_filter_applied": polygons is not None, "country_intersection_cells_dropped": dropped}
    return out.select("cell", quad.res(F.col("cell")).alias("resolution"), F.col("n").alias("layer_value")), metadata
