"""Areas as polygons: ISO codes and names of features, shares of cells that they cover, masks by splitting cells, points inside.

A shape is an array of parts, a part an array of rings (the first one outside, the others holes), a ring an array of points; planar degrees.  A code's
features count as one area: where they overlap, once, and where two of them fill a cell together, it is full.  Null and empty shapes have no cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.session import cut
from terracell.sources import arrays, files

SHAPE = "array<array<array<struct<lon:double,lat:double>>>>"
CLIPPED = f"iso string, name string, cell long, overlap double, shape {SHAPE}"
Ring = list


def _within(ring: Ring, axis: int, bound: float, sign: int) -> Ring:
    """The ring's part on one side of a line parallel to an axis; along the line it may run to and fro, which has no area."""
    out = []
    for k, b in enumerate(ring):
        a = ring[k - 1]
        a_in, b_in = sign * (a[axis] - bound) >= 0, sign * (b[axis] - bound) >= 0
        if a_in != b_in:
            t = (bound - a[axis]) / (b[axis] - a[axis])
            point = [a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])]
            point[axis] = bound
            out.append(tuple(point))
        if b_in:
            out.append(b)
    return out


def clipped(shape: list, west: float, south: float, east: float, north: float) -> list:
    """The shape inside a rectangle; parts without area go."""
    out = []
    for part in shape:
        rings = []
        for ring in part:
            for axis, bound, sign in ((0, west, 1), (0, east, -1), (1, south, 1), (1, north, -1)):
                ring = _within(ring, axis, bound, sign)
            if len(ring) > 2:
                rings.append(ring)
            elif not rings:
                break
        if rings and ring_area(rings[0]) > 0:
            out.append(rings)
    return out


def ring_area(ring: Ring) -> float:
    return abs(sum(ring[k - 1][0] * b[1] - b[0] * ring[k - 1][1] for k, b in enumerate(ring))) / 2


def area(shape: list) -> float:
    """Area of the union of the shape's parts."""
    boxes = [(min(x), max(x), min(y), max(y)) for x, y in (zip(*part[0], strict=True) for part in shape)]
    apart = all(a[0] >= b[1] or b[0] >= a[1] or a[2] >= b[3] or b[2] >= a[3] for k, a in enumerate(boxes) for b in boxes[:k]) if len(shape) <= 64 else False
    return sum(ring_area(part[0]) - sum(map(ring_area, part[1:])) for part in shape) if apart else union_area(shape)


def union_area(shape: list) -> float:
    """Area that one part or more covers: in each slab between two neighbouring places where edges end or cross, edges keep their order, so the covered
    height in the slab's middle, times its width, is exact."""
    rows = [(*min(a, b), *max(a, b), k) for k, part in enumerate(shape) for ring in part for a, b in zip(ring[-1:] + ring[:-1], ring, strict=True) if a[0] != b[0]]
    if not rows:
        return 0.0
    e = np.array(rows)
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    start = e[:, 1] - slope * e[:, 0]
    xs = [e[:, 0], e[:, 2]]
    for k in range(len(e)):  # crossings of edges of different parts
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (start[k] - start[:k]) / (slope[:k] - slope[k])
        xs.append(x[(e[:k, 4] != e[k, 4]) & (x > np.maximum(e[:k, 0], e[k, 0])) & (x < np.minimum(e[:k, 2], e[k, 2]))])
    xs = np.unique(np.concatenate(xs))
    total = 0.0
    for left, right in zip(xs[:-1], xs[1:], strict=True):
        own = np.flatnonzero((e[:, 0] <= left) & (e[:, 2] >= right))
        y = slope[own] * ((left + right) / 2) + start[own]
        open_, last = set(), 0.0
        for k in np.argsort(y, kind="stable"):
            if open_:
                total += (y[k] - last) * (right - left)
            last = y[k]
            open_ ^= {e[own[k], 4]}
    return total


def inside(shape: list, x: float, y: float) -> bool:
    """Whether the shape covers a point, its border included."""
    for part in shape:
        odd = False
        for ring in part:
            for k, (bx, by) in enumerate(ring):
                ax, ay = ring[k - 1]
                side = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
                if side == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
                    return True
                if (ay > y) != (by > y) and (side > 0) == (by > ay):
                    odd = not odd
        if odd:
            return True
    return False


def bounds(cell: int) -> tuple[float, float, float, float]:
    """West, south, east, north of a cell."""
    n, x, y = 1 << (cell >> 50), (cell >> 25) & 33554431, cell & 33554431
    return x / n * 360 - 180, y / n * 180 - 90, (x + 1) / n * 360 - 180, (y + 1) / n * 180 - 90


def _plain(shape) -> list:
    return [[[(p["lon"], p["lat"]) for p in ring] for ring in part] for part in shape]


def _named(shape: list) -> list:
    return [[[{"lon": x, "lat": y} for x, y in ring] for ring in part] for part in shape]


def from_geojson(spark: SparkSession, path: str | list[str], include: tuple[str, ...] = (), exclude: tuple[str, ...] = ()) -> DataFrame:
    """iso, name, shape, place of the polygons in GeoJSON files, in order of iso and then of files and features (`place`); other geometries are left out.

    iso: iso_a2, ISO_A2 or the first two letters of GID_0, else the file's name; name: name, NAME, COUNTRY or NAME_0, else the iso. With `include` only those, and
    never one of `exclude`."""
    feature = F.from_json("text", "geometry struct<type:string,coordinates:string>, properties map<string,string>")
    rows = arrays.elements(spark, path, "features").select(F.col("file_name").alias("file"), F.col("element").alias("place"), feature.alias("f"))
    rows = rows.select("file", "place", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("c"), F.col("f.properties").alias("p"))
    known = lambda key: F.when(F.trim(F.element_at("p", F.lit(key))) != "", F.trim(F.element_at("p", F.lit(key))))
    iso = F.upper(F.coalesce(known("iso_a2"), known("ISO_A2"), F.substring(known("GID_0"), 1, 2), F.regexp_extract("file", r"^([^.]+)", 1)))
    points = "array<array<array<array<double>>>>"
    shape = F.when(F.col("type") == "Polygon", F.from_json(F.concat(F.lit("["), "c", F.lit("]")), points)).when(F.col("type") == "MultiPolygon", F.from_json("c", points))
    shape = F.transform(shape, lambda part: F.transform(part, lambda ring: F.transform(ring, lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat")))))
    rows = rows.select(iso.alias("iso"), F.coalesce(known("name"), known("NAME"), known("COUNTRY"), known("NAME_0"), iso).alias("name"), shape.alias("shape"), F.struct("file", "place").alias("place"))
    rows = rows.where("shape is not null")
    if include:
        rows = rows.where(F.col("iso").isin(*(set(include) - set(exclude))) if set(include) - set(exclude) else F.lit(False))
    return rows.where(~F.col("iso").isin(*exclude)) if exclude else rows


def from_folder(spark: SparkSession, folder: str, include: list[str], exclude: tuple[str, ...] = ()) -> DataFrame:
    """from_geojson of one file a code, named `<code>.geojson`; an error names the codes whose file isn't there. Features of excluded codes go, others of a file stay."""
    out_ = {c.strip().upper() for c in exclude}
    wanted = sorted({c.strip().upper() for c in include if c.strip()} - out_)
    paths = {c: f"{folder.rstrip('/')}/{c}.geojson" for c in wanted}
    missing = [c for c, p in paths.items() if not (at := files.hadoop_path(spark, p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)]
    if missing:
        raise FileNotFoundError(f"no polygons of {', '.join(missing)} in {folder}")
    if not wanted:
        return spark.createDataFrame([], f"iso string, name string, shape {SHAPE}, place struct<file:string,place:int>")
    return from_geojson(spark, list(paths.values()), exclude=tuple(out_))


def boxes(rectangles: DataFrame) -> DataFrame:
    """iso, name, shape of rectangles (west, south, east, north)."""
    corner = lambda x, y: F.struct(F.col(x).cast("double").alias("lon"), F.col(y).cast("double").alias("lat"))
    ring = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"))
    return rectangles.select(F.col("iso").cast("string").alias("iso"), "name", F.array(F.array(ring)).alias("shape"))


def _box(shape: Column) -> list[Column]:
    """West, south, east, north."""
    points = F.flatten(F.flatten(shape))
    of = lambda name, way: way(F.transform(points, lambda p: p[name]))
    return [of("lon", F.array_min), of("lat", F.array_min), of("lon", F.array_max), of("lat", F.array_max)]


def _candidates(shapes: DataFrame, res: int) -> DataFrame:
    """iso, name, cell, shape of all cells of a coarse resolution that a shape's bounding box meets."""
    n = 1 << res
    w, s, e, t = _box(F.col("shape"))
    index = lambda v, span, off: F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor((v + off) / span * n))).cast("int")
    rows = shapes.select("iso", "name", "shape", F.explode(F.sequence(index(w, 360.0, 180.0), index(e, 360.0, 180.0))).alias("x"), F.sequence(index(s, 180.0, 90.0), index(t, 180.0, 90.0)).alias("ys"))
    return rows.select("iso", "name", "shape", "x", F.explode("ys").alias("y")).select("iso", "name", quad.make(res, F.col("x"), F.col("y")).alias("cell"), "shape")


#: Edges up to which parts that overlap are united on the way down; with more, only a part that covers a cell alone makes it a whole one there.
UNITED = 4096


def cut_to_cells(rows: DataFrame, margin: float = 0.0, exact: bool = True) -> DataFrame:
    """CLIPPED of rows (iso, name, cell, shape): the shape inside the cell, and the share of the cell that it covers; cells without any go.

    margin: the shape is kept beyond the cell by so much of its size, and cells stay where an edge lies in the cell or on its border."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k, (cell, shape) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)):
                w, s, e, t = bounds(cell)
                own = inner = clipped(_plain(shape or []), w, s, e, t) if not margin else clipped(_plain(shape or []), w - margin * (e - w), s - margin * (t - s), e + margin * (e - w), t + margin * (t - s))
                if margin:
                    inner = clipped(own, w, s, e, t)
                many = not exact and len(inner) > 1 and sum(len(r) for part in inner for r in part) > UNITED
                share = (max(area([part]) for part in inner) if many else area(inner)) / ((e - w) * (t - s))
                if share > 0 or margin and any(min(p[0], q[0]) <= e and max(p[0], q[0]) >= w and min(p[1], q[1]) <= t and max(p[1], q[1]) >= s for part in own for r in part for p, q in zip(r[-1:] + r[:-1], r, strict=True)):
                    out.append((k, share, _named(own)))
            at = pa.array([x[0] for x in out], pa.int64())
            columns = [b.column(c).take(at) for c in range(3)] + [pa.array([x[1] for x in out], pa.float64()), pa.array([x[2] for x in out], b.column(3).type)]
            yield pa.RecordBatch.from_arrays(columns, names=["iso", "name", "cell", "overlap", "shape"])

    return rows.select(F.col("iso").cast("string").alias("iso"), "name", "cell", F.col("shape").cast(SHAPE).alias("shape")).mapInArrow(each, CLIPPED)


def _begun(shapes: DataFrame, res: int, margin: float = 0.0, exact: bool = True) -> DataFrame:
    """CLIPPED in the cells of a coarse resolution: features are cut first, then those of one iso put together in a cell."""
    parts = cut_to_cells(_candidates(shapes, res), margin, False)
    own = parts.groupBy("iso", "cell").agg(F.min("name").alias("name"), F.flatten(F.collect_list("shape")).alias("shape"))
    return cut(cut_to_cells(own.select("iso", "name", "cell", "shape"), margin, exact))


def covering(shapes: DataFrame, res: int, start: int = 2) -> DataFrame:
    """iso, name, cell, overlap of the cells of one resolution, one row for an iso and cell, however many features it has.

    From a coarse start each cell hands its own part of the shape down to its children, so work follows the area and no shape is clipped whole again; cells
    that are covered wholly are expanded without clipping."""
    rows = _begun(shapes, min(start, res), exact=start >= res)
    full = None
    for level in range(min(start, res), res):
        whole = rows.where("overlap >= 1 - 1e-12").select("iso", "name", "cell")
        full = whole if full is None else full.unionByName(whole)
        full = full.select("iso", "name", F.explode(quad.children(F.col("cell"))).alias("cell"))
        rest = rows.where("overlap < 1 - 1e-12").select("iso", "name", F.explode(quad.children(F.col("cell"))).alias("cell"), "shape")
        rows = cut(cut_to_cells(rest, exact=level + 1 == res))
    out = rows.select("iso", "name", "cell", "overlap")
    return out if full is None else out.unionByName(full.withColumn("overlap", F.lit(1.0)))


def cells_of(shapes: DataFrame, res: int, mode: str = "overlap", start: int = 2) -> DataFrame:
    """iso, name, cell by one of four rules: `center` of the cell inside, cell `full`y covered, any `overlap`, or `bbox_overlap` with the bounding box."""
    if mode == "bbox_overlap":
        w, s, e, t = _box(F.col("shape"))
        corner = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
        boxes = shapes.select("iso", "name", F.array(F.array(F.array(corner(w, s), corner(e, s), corner(e, t), corner(w, t)))).alias("shape"))
        return covering(boxes, res, start).select("iso", "name", "cell")
    rows = covering(shapes, res, start)
    if mode == "overlap":
        return rows.select("iso", "name", "cell")
    if mode == "full":
        return rows.where("overlap >= 1 - 1e-9").select("iso", "name", "cell")
    if mode != "center":
        raise ValueError(f"no mode {mode}")
    lat, lon = quad.centre(F.col("cell"))
    found = covered_points(rows.select("iso", "name", "cell", lat.alias("lat"), lon.alias("lon")), index(shapes, res, start=start), own="iso")
    return found.select("iso", "name", "cell")


#: What a cell of the index keeps of a shape beyond its own borders, as a part of its size: points lie well inside of where shapes were cut.
MARGIN = 0.125
INDEX = "iso string, name string, cell long, whole boolean, parts array<array<struct<ax:double,ay:double,bx:double,by:double>>>"


def index(shapes: DataFrame, finest: int = 10, edges: int = 48, start: int = 2) -> DataFrame:
    """INDEX: each iso's area as cells of mixed resolutions that don't overlap: whole ones without geometry, and border cells with the edges of their own part.

    A cell is split while it is crossed by more than `edges` edges, down to `finest`; so no row grows with its shape but those of `finest`."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.struct([(c, pa.float64()) for c in ("ax", "ay", "bx", "by")])))
        for b in batches:
            parts = [[[{"ax": a[0], "ay": a[1], "bx": z[0], "by": z[1]} for ring in part for a, z in zip(ring[-1:] + ring[:-1], ring, strict=True)] for part in _plain(s)] for s in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([False] * b.num_rows), pa.array(parts, kind)], names=["iso", "name", "cell", "whole", "parts"])

    crossed = F.aggregate(F.flatten("shape"), F.lit(0), lambda n, ring: n + F.size(ring))
    rows, out = _begun(shapes, start, MARGIN, exact=False), None
    for level in range(start, finest + 1):
        whole = F.col("overlap") >= 1 - 1e-12
        stays = whole | (crossed <= edges) if level < finest else F.lit(True)
        found = rows.where(whole).select("iso", "name", "cell", F.lit(True).alias("whole"), F.lit(None).cast("array<array<struct<ax:double,ay:double,bx:double,by:double>>>").alias("parts"))
        found = found.unionByName(rows.where(stays & ~whole).select("iso", "name", "cell", "shape").mapInArrow(each, INDEX))
        out = found if out is None else out.unionByName(found)
        if level < finest:
            rows = rows.where(~stays).select("iso", "name", F.explode(quad.children(F.col("cell"))).alias("cell"), "shape")
            rows = cut(cut_to_cells(rows, MARGIN, exact=False))
            if not rows.limit(1).count():
                break
    return out


#: Degrees by which a point may miss a border that it counts as lying on: cut edges are rounded.
ON_BORDER = 1e-9


def covers(parts: Column, x: Column, y: Column) -> Column:
    """Whether the parts (of INDEX) cover a point, borders included; built-in functions only."""
    side = lambda e: (e["bx"] - e["ax"]) * (y - e["ay"]) - (e["by"] - e["ay"]) * (x - e["ax"])
    between = lambda e, axis, v: v.between(F.least(e[f"a{axis}"], e[f"b{axis}"]) - ON_BORDER, F.greatest(e[f"a{axis}"], e[f"b{axis}"]) + ON_BORDER)
    on = lambda e: between(e, "x", x) & between(e, "y", y) & (F.abs(side(e)) <= ON_BORDER * (F.abs(e["bx"] - e["ax"]) + F.abs(e["by"] - e["ay"])))
    crossed = lambda e: ((e["ay"] > y) != (e["by"] > y)) & ((side(e) > 0) == (e["by"] > e["ay"]))
    return F.exists(parts, lambda part: F.exists(part, on) | (F.size(F.filter(part, crossed)) % 2 == 1))


def covered_points(points: DataFrame, areas: DataFrame, finest: int = 10, own: str | None = None) -> DataFrame:
    """Points (lat, lon) with `shape_iso` of each iso whose area covers them, borders included; a point that is there twice comes twice.

    areas: shapes, or their index. A point meets the index by an equi-join on the cells around it, one for each resolution that the index has: whole cells settle it,
    in others it is held against the few edges there. No shape is put on a point's row that is shuffled. own: a column with the only iso that a point asks for."""
    found = areas if "whole" in areas.columns else cut(index(areas, finest))
    levels = [r[0] for r in found.select(quad.res(F.col("cell"))).distinct().collect()]  # 26 at most
    rows = points.select(F.struct(*points.columns).alias("_point"), F.col("lat").alias("_y"), F.col("lon").alias("_x"), *([F.col(own).cast("string").alias("_own")] if own else []))
    cells = F.array(*[quad.cell(F.col("_y"), F.col("_x"), r) for r in levels]).cast("array<long>")
    rows = rows.withColumn("_cell", F.explode(cells)).join(found.withColumnsRenamed({"cell": "_index", "iso": "_iso", "whole": "_whole", "parts": "_parts"}), F.col("_cell") == F.col("_index"))
    rows = rows.where("_own = _iso") if own else rows
    rows = rows.where(F.col("_whole") | covers(F.col("_parts"), F.col("_x"), F.col("_y")))
    return rows.select(*[F.col("_point")[c].alias(c) for c in points.columns], F.col("_iso").alias("shape_iso"))


def shares(cells: DataFrame, shapes: DataFrame, start: int = 2) -> DataFrame:
    """iso, cell, overlap of the cells (iso, cell, of any resolutions) that the iso's area meets in more than a line.

    Shapes are handed down only where an ancestor of a cell asks for them; below a whole cell nothing is clipped."""
    wanted = cut(cells.select(F.col("iso").cast("string").alias("iso"), "cell").distinct())
    most = wanted.agg(F.coalesce(F.max(quad.res(F.col("cell"))), F.lit(start))).first()[0]
    least = wanted.agg(F.coalesce(F.min(quad.res(F.col("cell"))), F.lit(start))).first()[0]
    start = min(start, least)
    up = cut(wanted.select("iso", F.explode(quad.ancestors(F.col("cell"), start)).alias("cell")).distinct())
    at = lambda level: up.where(quad.res(F.col("cell")) == level)
    rows, out = _begun(shapes, start), None
    for level in range(start, most + 1):
        rows = rows.join(at(level), ["iso", "cell"], "left_semi")
        found = rows.select("iso", "cell", "overlap")
        out = found if out is None else out.unionByName(found)
        if level < most:
            down = rows.select("iso", "name", F.explode(quad.children(F.col("cell"))).alias("cell"), "overlap", "shape").join(at(level + 1), ["iso", "cell"], "left_semi")
            whole = F.col("overlap") >= 1 - 1e-12
            kept = down.where(whole).select("iso", "name", "cell", F.lit(1.0).alias("overlap"), F.lit(None).cast(SHAPE).alias("shape"))
            rows = cut(kept.unionByName(cut_to_cells(down.where(~whole).select("iso", "name", "cell", "shape"))))
    return wanted.join(out, ["iso", "cell"]).select("iso", "cell", "overlap")


def met(leaves: DataFrame, shapes: DataFrame) -> DataFrame:
    """Leaves that any of the shapes covers in more than a line."""
    one = shapes.withColumn("iso", F.lit(""))
    return leaves.join(shares(leaves.select(F.lit("").alias("iso"), "cell"), one).select("cell"), "cell", "left_semi")


def quadtree(shapes: DataFrame, levels: list[int], inside_: float = 1e-9, outside: float = 1e-9) -> DataFrame:
    """cell, iso: cells that a shape covers wholly are kept, those it misses go, others are split to the next of the levels (which may skip resolutions); the last
    level keeps what it meets. The least iso has a cell."""
    frontier, leaves = _begun(shapes, levels[0]), None
    for k, res in enumerate(levels):
        last = k == len(levels) - 1
        done = frontier.where(F.col("overlap") > outside) if last else frontier.where(F.col("overlap") >= 1 - inside_)
        leaves = done.select("iso", "cell") if leaves is None else leaves.unionByName(done.select("iso", "cell"))
        if not last:
            rest = frontier.where((F.col("overlap") < 1 - inside_) & (F.col("overlap") > outside)).select("iso", "name", "cell", "shape")
            for _ in range(levels[k + 1] - res):
                rest = rest.select("iso", "name", F.explode(quad.children(F.col("cell"))).alias("cell"), "shape")
            frontier = cut(cut_to_cells(rest))
    return leaves.groupBy("cell").agg(F.min("iso").alias("iso"))


def refined(cells: DataFrame, shapes: DataFrame, least: float) -> DataFrame:
    """iso, cell: a cell's children that the shape of its iso covers by more than `least` (0: meets); a cell without such children stays."""
    kids = cells.select(F.col("iso").cast("string").alias("iso"), F.explode(quad.children(F.col("cell"))).alias("cell"))
    kept = cut(shares(kids, shapes).where(F.col("overlap") > least).select("iso", "cell"))
    parents = kept.select("iso", quad.make(quad.res(F.col("cell")) - 1, F.shiftright(quad.col(F.col("cell")), 1), F.shiftright(quad.row(F.col("cell")), 1)).alias("cell")).distinct()
    return kept.unionByName(cells.select(F.col("iso").cast("string").alias("iso"), "cell").join(parents, ["iso", "cell"], "left_anti"))


def uncovered_share(shapes: DataFrame, leaves: DataFrame, n: int = 4096) -> DataFrame:
    """One row: of n points, spread evenly over the shapes' bounding box by the same rule always, how many lie in a shape, and how many of those in no leaf."""
    w, s, e, t = _box(F.col("shape"))
    box = shapes.select(w.alias("w"), s.alias("s"), e.alias("e"), t.alias("t")).agg(F.min("w").alias("w"), F.min("s").alias("s"), F.max("e").alias("e"), F.max("t").alias("t"))
    spread = shapes.sparkSession.range(n).select("id", ((F.col("id") + 0.5) / n).alias("u"), F.pmod((F.col("id") + 1) * F.lit(0.6180339887498949), F.lit(1.0)).alias("v"))
    points = spread.join(F.broadcast(box)).select("id", (F.col("w") + F.col("u") * (F.col("e") - F.col("w"))).alias("lon"), (F.col("s") + F.col("v") * (F.col("t") - F.col("s"))).alias("lat"))
    hit = cut(covered_points(points, shapes).select("id", "lat", "lon").distinct())
    up = hit.select("id", F.explode(quad.ancestors(quad.cell(F.col("lat"), F.col("lon"), 12), 0)).alias("cell"))
    met = up.join(leaves.select("cell"), "cell", "left_semi").select("id").distinct()
    return hit.agg(F.count(F.lit(1)).alias("inside")).join(F.broadcast(hit.join(met, "id", "left_anti").agg(F.count(F.lit(1)).alias("uncovered")))).withColumn("share", F.when(F.col("inside") > 0, F.col("uncovered") / F.col("inside")).otherwise(0.0))
