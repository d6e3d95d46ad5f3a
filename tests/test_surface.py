"""Simplified lines, colours and merged leaves against plain models."""

import random

import numpy as np
from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.functions.lines import LINE, simplified, thinned
from terracell.operators import surface


def model(points, tolerance):
    """Recursive Douglas-Peucker."""
    if len(points) < 3:
        return points
    (ax, ay), (bx, by) = points[0], points[-1]
    far, at = -1.0, 0
    for k, (x, y) in enumerate(points[1:-1], 1):
        dx, dy = bx - ax, by - ay
        t = 0 if dx == dy == 0 else min(1, max(0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        off = (x - ax - t * dx) ** 2 + (y - ay - t * dy) ** 2
        if off > far:
            far, at = off, k
    if far <= tolerance**2:
        return [points[0], points[-1]]
    return model(points[: at + 1], tolerance)[:-1] + model(points[at:], tolerance)


def test_thinned():
    r = random.Random(3)
    for _ in range(50):
        points = [(r.randint(0, 30), r.randint(0, 30)) for _ in range(r.randint(0, 40))]
        a = np.array(points, float).reshape(-1, 2)
        assert [tuple(p) for p in a[thinned(a, 4.0)]] == model(points, 4.0)


def test_simplified(spark):
    line = [(0.0, 0.0), (1.04, 0.01), (2.0, 0.0), (2.01, 0.0), (2.0, 5.0)]
    rows = spark.createDataFrame([(1, [{"lon": x, "lat": y} for x, y in line]), (2, []), (3, None)], f"id int, line {LINE}")
    found = {r.id: r.shape and [tuple(p) for p in r.shape] for r in rows.select("id", simplified(F.col("line"), 0.1, 1).alias("shape")).collect()}
    assert found == {1: [(0.0, 0.0), (2.0, 0.0), (2.0, 5.0)], 2: [], 3: None}


def test_colors(spark):
    areas = spark.createDataFrame([(i,) for i in "abcde"], "iso string")
    near = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "iso string, other string")
    found = {r.iso: r.color for r in surface.colors(areas, near).collect()}
    assert found == {"c": 0, "a": 1, "b": 2, "d": 1, "e": 0}


def cells(spark, rows):
    return spark.createDataFrame(rows, "r int, x int, y int, n long").select(quad.make(F.col("r"), F.col("x"), F.col("y")).alias("cell"), "n")


def test_compact(spark):
    """Four empty leaves merge twice; a leaf two levels finer beside them holds the upper merge back."""
    square = [(4, x, y, 0) for x in range(4) for y in range(4)]
    at = lambda rows, delta: sorted((r.cell >> 50, r.cell >> 25 & 33554431, r.cell & 33554431) for r in surface.compact(cells(spark, rows), 2, 5, delta).collect())
    assert at(square, 1) == [(2, 0, 0)]
    assert at([(*square[0][:3], 1), *square[1:]], 1) == [(3, 0, 1), (3, 1, 0), (3, 1, 1), (4, 0, 0), (4, 0, 1), (4, 1, 0), (4, 1, 1)]
    beside = [(5, 8, 0, 3)]
    assert (2, 0, 0) not in at(square + beside, 1) and (3, 1, 0) not in at(square + beside, 1)
    assert (2, 0, 0) in at(square + beside, 3)
    assert at([], 1) == []


def test_at_resolution(spark):
    found = surface.at_resolution(cells(spark, [(2, 1, 1, 0), (4, 9, 9, 0), (4, 8, 9, 0)]), 3).collect()
    assert sorted((r.cell >> 25 & 33554431, r.cell & 33554431) for r in found) == [(2, 2), (2, 3), (3, 2), (3, 3), (4, 4)]
