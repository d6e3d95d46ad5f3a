"""A hierarchical cell grid: an equirectangular quadtree, in column arithmetic only.

A cell id holds resolution, column and row: res << 50 | x << 25 | y; ids of one resolution order by (x, y).  Columns wrap around the
antimeridian, rows end at the poles.  Parents and children are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make(res: int | Column, x: Column, y: Column) -> Column:
    res = F.lit(res) if isinstance(res, int) else res
    return F.shiftleft(res.cast("long"), 50).bitwiseOR(F.shiftleft(x.cast("long"), 25)).bitwiseOR(y.cast("long"))


def cell(lat: Column, lon: Column, res: int) -> Column:
    n = 1 << res
    x = F.least(F.floor((lon + 180.0) / 360.0 * n), F.lit(n - 1))
    y = F.least(F.floor((lat + 90.0) / 180.0 * n), F.lit(n - 1))
    return make(res, x, y)


def res(c: Column) -> Column:
    return F.shiftright(c, 50).cast("int")


def col(c: Column) -> Column:
    return F.shiftright(c, 25).bitwiseAND(F.lit((1 << 25) - 1))


def row(c: Column) -> Column:
    return c.bitwiseAND(F.lit((1 << 25) - 1))


def parent(c: Column, to: int, of: int) -> Column:
    """Ancestor at resolution `to` of a cell of resolution `of`."""
    return make(to, F.shiftright(col(c), of - to), F.shiftright(row(c), of - to))


def ancestors(c: Column, least: int, own: bool = True) -> Column:
    """Array of the cell's ancestors from resolution `least` up to its own (or up to its parent)."""
    levels = F.filter(F.sequence(F.lit(least), F.greatest(F.lit(least), res(c))), lambda r: r <= (res(c) if own else res(c) - 1))
    shift = lambda v, r: F.floor(v / F.pow(F.lit(2.0), (res(c) - r).cast("double")))
    return F.transform(levels, lambda r: make(r, shift(col(c), r), shift(row(c), r)))


def children(c: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: make(res(c) + 1, col(c) * 2 + F.floor(k / 2), row(c) * 2 + k % 2))


def disk(c: Column, k: int) -> Column:
    """All cells up to k columns and rows away, the cell included."""
    n = F.pow(F.lit(2.0), res(c).cast("double")).cast("long")
    steps = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in range(-k, k + 1) for dy in range(-k, k + 1)])
    inside = F.filter(steps, lambda s: (row(c) + s["dy"] >= 0) & (row(c) + s["dy"] < n))
    return F.array_distinct(F.transform(inside, lambda s: make(res(c), F.pmod(col(c) + s["dx"], n), row(c) + s["dy"])))


def west_south(c: Column) -> tuple[Column, Column]:
    n = F.pow(F.lit(2.0), res(c).cast("double"))
    return col(c) / n * 360.0 - 180.0, row(c) / n * 180.0 - 90.0


def centre(c: Column) -> tuple[Column, Column]:
    """lat, lon."""
    n = F.pow(F.lit(2.0), res(c).cast("double"))
    return (row(c) + 0.5) / n * 180.0 - 90.0, (col(c) + 0.5) / n * 360.0 - 180.0
