"""The adaptive partition against a model that works cell by cell, one step at a time."""

import random

import pytest
from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.operators import adaptive
from terracell.operators.adaptive import Rules


def up(c, to):
    r, x, y = c
    return to, x >> (r - to), y >> (r - to)


def kids(c):
    r, x, y = c
    return [(r + 1, 2 * x + i, 2 * y + j) for i in (0, 1) for j in (0, 1)]


def around(c, k):
    r, x, y = c
    return {(r, (x + i) % (1 << r), y + j) for i in range(-k, k + 1) for j in range(-k, k + 1) if 0 <= y + j < 1 << r}


class Plain:
    def __init__(self, points, domain, rules):
        self.r, self.domain = rules, domain
        self.n = {}
        for lat, lon in points:
            c = (rules.most, int((lon + 180) / 360 * (1 << rules.most)), int((lat + 90) / 180 * (1 << rules.most)))
            if up(c, rules.base) in domain:
                for q in range(rules.root, rules.most + 1):
                    self.n[up(c, q)] = self.n.get(up(c, q), 0) + 1
        self.above = {up(c, q) for c in domain for q in range(rules.root, rules.base + 1)}

    def inside(self, c):
        return up(c, min(c[0], self.r.base)) in self.above

    def band(self, c):
        return any(not self.inside(d) for d in around(c, self.r.boundary_k))

    def near(self, c):
        return any(self.n.get(d, 0) for d in around(c, self.r.near_k) - {c})

    def split(self):
        r, out = self.r, {}

        def visit(c):
            n = self.n.get(c, 0)
            if n:
                more = c[0] < r.floor or n > r.target and c[0] < r.most
            else:
                more = c[0] < r.base or c[0] < r.min_output or (self.band(c) or self.near(c)) and c[0] < r.floor - 1
            if not more:
                out[c] = n
            else:
                for d in kids(c):
                    if self.inside(d):
                        visit(d)

        for c in sorted({c for c in self.above if c[0] == r.root}):
            visit(c)
        return out

    @staticmethod
    def cover(leaves, c):
        return next((up(c, q) for q in range(c[0], -1, -1) if up(c, q) in leaves), None)

    def violations(self, leaves):
        return [(c, d) for c in sorted(leaves) for e in around(c, 1) - {c} if (d := self.cover(leaves, e)) and c[0] - d[0] > self.r.delta]

    def smooth(self, leaves):
        leaves, steps = dict(leaves), 0
        while bad := self.violations(leaves):
            coarse = min(d for _, d in bad)
            del leaves[coarse]
            leaves |= {d: self.n.get(d, 0) for d in kids(coarse) if self.inside(d)}
            steps += 1
        return leaves, steps

    def compact(self, leaves):
        r, leaves = self.r, dict(leaves)
        while True:
            for res in range(r.floor - 1, r.min_output, -1):
                for p in sorted({up(c, res - 1) for c in leaves if c[0] == res}):
                    own = [d for d in kids(p) if self.inside(d)]
                    if len(own) < 2 or any(leaves.get(d, 1) for d in own) or p[0] < r.base or self.band(p):
                        continue
                    if self.near(p) and not r.compact_near or not self.near(p) and p[0] > min(r.interior, r.floor - 1):
                        continue
                    tried = {c: n for c, n in leaves.items() if c not in own} | {p: 0}
                    if not self.violations(tried):
                        break
                else:
                    continue
                break
            else:
                return leaves
            leaves = tried


def frame(spark, cells):
    rows = spark.createDataFrame(sorted(cells), "r int, x long, y long")
    return rows.select(quad.make(F.col("r"), F.col("x"), F.col("y")).alias("cell"))


def plain(rows):
    return {(c >> 50, (c >> 25) & 33554431, c & 33554431): n for c, n in ((r.cell, r.n) for r in rows.collect())}


@pytest.mark.parametrize("seed, rules", [(1, Rules(4, 0, 5, 9, 9, 1, 7, 1, 1, True, 1)), (2, Rules(3, 1, 3, 5, 8, 1, 3, 1, 1, False, 1)), (3, Rules(3, 0, 4, 6, 7, 2, 4, 0, 2, True, 0))])
def test_partition(spark, seed, rules):
    r = random.Random(seed)
    side = 1 << rules.base
    domain = {(rules.base, x % side, y) for x, y in ((side - 1, 5), (0, 5), (0, 6), (1, 6))[: 2 if rules.floor == 9 else 4]}
    points = [(r.uniform(-30, 0), r.uniform(-180, -150)) for _ in range(3)] + [(1.0 / (k + 3) - 20, -179.9) for k in range(3)]
    model = Plain(points, domain, rules)
    p = adaptive.Partition(spark.createDataFrame(points, "lat double, lon double"), frame(spark, domain), rules)
    split = p.split()
    want = model.split()
    assert plain(split) == want
    leaves, steps = p.smoothed(split)
    smooth, count = model.smooth(want)
    assert plain(leaves) == smooth and steps == count
    if len(smooth) < 900:  # the model tries one merge after the other
        assert plain(p.compacted(leaves)) == model.compact(smooth)


def test_whole_partition(spark):
    points = spark.createDataFrame([(10.0, 20.0), (10.001, 20.001), (10.002, 20.001)], "lat double, lon double")
    mask = points.select(quad.cell(F.col("lat"), F.col("lon"), 3).alias("cell")).distinct()
    box = spark.createDataFrame([(0.0, 0.0, 21.0, 10.5)], "west double, south double, east double, north double")
    rules = Rules(base=4, root=2, min_output=4, floor=6, most=9, target=1, interior=4)
    out, found = adaptive.partition(points, mask, rules, box)
    assert out.agg(F.sum("layer_value")).first()[0] == 3 and found["violating_neighbor_pairs"] == 0 and found["country_intersection_cells_dropped"] > 0
    none, empty = adaptive.partition(points.limit(0), mask.limit(0), rules)
    assert none.count() == 0 and empty["adjacency_checks"] == 0
    with pytest.raises(ValueError, match="interior"):
        Rules(base=4, interior=8, floor=7)
