"""Vector tiles of a range of zooms at once: features dealt to tiles and parts by shuffles, each part encoded by itself, a tile being its parts one after the other.

A tile is a message whose layers hold features, keys and values (the public vector tile specification, version 2). Only a layer's length and the places of
its values depend on other parts; both are sums over parts, so no task holds a tile, and the one tile of zoom 0 may hold all features."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terracell.functions import quad
from terracell.operators.serving import boundary
from terracell.session import cut

EXTENT = 4096
#: About so many features make a part.
PART = 20_000
TILE = ["z", "x", "y", "layer"]
#: Wire types, field numbers and geometry commands of the format.
VARINT, BYTES = 0, 2
LAYERS, NAME, FEATURES, KEYS, VALUES, LAYER_EXTENT, VERSION = 3, 1, 2, 3, 4, 5, 15
ID, TAGS, TYPE, GEOMETRY = 1, 2, 3, 4
STRING, INT = 1, 4
MOVE, LINE, CLOSE = 1, 2, 7
POINT_TYPE, LINE_TYPE, POLYGON_TYPE = 1, 2, 3


def features_of(points: DataFrame, cells: DataFrame) -> DataFrame:
    """layer, kind, id, lon, lat, ring, texts, numbers: facilities (facility_id or id, lat, lon, others) and cells (cell, layer_name, layer_value).

    lon and lat decide on the tile: a facility's place, a cell's centre. Rows without a place are in no tile."""
    key = "facility_id" if "facility_id" in points.columns else "id"
    text = lambda rows, c: F.col(c).cast("string") if c in rows.columns else F.lit(None).cast("string")
    ring = "array<struct<lon:double,lat:double>>"
    one = points.select(
        F.lit("facility_points").alias("layer"), F.lit(POINT_TYPE).alias("kind"), F.col(key).cast("string").alias("id"), F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"),
        F.array(F.struct(F.col("lon").cast("double").alias("lon"), F.col("lat").cast("double").alias("lat"))).cast(ring).alias("ring"),
        F.create_map(F.lit("facility_id"), F.col(key).cast("string"), F.lit("org_name"), text(points, "org_name"), F.lit("source_name"), text(points, "source_name"), F.lit("layer_name"), F.lit("facilities")).alias("texts"),
        F.create_map(F.lit("resolution"), F.lit(None).cast("long")).alias("numbers"),
    )
    lat, lon = quad.centre(F.col("cell"))
    two = cells.select(
        F.lit("h3_cells").alias("layer"), F.lit(POLYGON_TYPE).alias("kind"), F.concat_ws("-", "layer_name", "cell").alias("id"), lon.alias("lon"), lat.alias("lat"), boundary(F.col("cell")).cast(ring).alias("ring"),
        F.create_map(F.lit("cell"), F.col("cell").cast("string"), F.lit("layer_name"), F.col("layer_name"), F.lit("layer_value"), F.col("layer_value").cast("string")).alias("texts"),
        F.create_map(F.lit("resolution"), quad.res(F.col("cell")).cast("long")).alias("numbers"),
    )
    return one.unionByName(two)


def _north(y: Column, z: Column) -> Column:
    """Latitude of the upper border of a row of tiles."""
    return F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * y / F.pow(F.lit(2.0), z)))))


def placed(features: DataFrame, least: int, most: int) -> DataFrame:
    """The features once for each tile of zooms least to most that holds them (z, x, y; borders count as inside), their rings in the tile's units, from its north-west corner.

    A row's tiles follow from its own place: nothing is shuffled."""
    tile = F.explode(F.sequence(F.lit(least), F.lit(most))).alias("z")
    rows = features.where("lon is not null and lat is not null").select("*", tile).withColumn("n", F.pow(F.lit(2.0), F.col("z").cast("double")))
    rows = rows.withColumn("cx", F.floor((F.col("lon") + 180) / 360 * F.col("n"))).withColumn("cy", F.floor((1 - F.asinh(F.tan(F.radians("lat"))) / 3.141592653589793) / 2 * F.col("n")))
    near = F.array(*[F.struct((F.col("cx") + dx).cast("int").alias("x"), (F.col("cy") + dy).cast("int").alias("y")) for dx in (-1, 0, 1) for dy in (-1, 0, 1)])
    z = F.col("z").cast("double")
    inside = lambda t: (
        (t["x"] >= 0) & (t["y"] >= 0) & (t["x"] < F.col("n")) & (t["y"] < F.col("n"))
        & F.col("lon").between(t["x"] / F.col("n") * 360 - 180, (t["x"] + 1) / F.col("n") * 360 - 180) & F.col("lat").between(_north(t["y"] + 1, z), _north(t["y"].cast("double"), z))
    )
    rows = rows.withColumn("t", F.explode(F.filter(near, inside))).select("*", "t.x", "t.y")
    west, east = F.col("x") / F.col("n") * 360 - 180, (F.col("x") + 1) / F.col("n") * 360 - 180
    north, south = _north(F.col("y").cast("double"), z), _north(F.col("y") + 1, z)
    rows = rows.withColumns({"w": west, "e": east, "u": north, "s": south})
    spot = lambda p: F.struct(F.round((p["lon"] - F.col("w")) / (F.col("e") - F.col("w")) * EXTENT).cast("int").alias("x"), F.round((F.col("u") - p["lat"]) / (F.col("u") - F.col("s")) * EXTENT).cast("int").alias("y"))
    return rows.select("z", "x", "y", "layer", "kind", "id", F.transform("ring", spot).alias("ring"), "texts", "numbers")


def pyramid(features: DataFrame, least: int, most: int, part: int = PART) -> DataFrame:
    """z, x, y, layer, part, features, bytes: parts of all tiles of these zooms that hold features.

    A tile's bytes are those of its parts in order of layer and part. A crowded tile's features are dealt over parts by a number of each row, so equal rows and ids
    don't crowd one; in a part they are in order of id. A layer's first part also holds its length and name."""
    rows = cut(placed(features, least, most).withColumn("_k", F.monotonically_increasing_id()))  # written, so that a row keeps its number
    parts = rows.groupBy(*TILE).agg(F.ceil(F.count(F.lit(1)) / part).alias("parts")).where("parts > 1")  # the crowded tiles
    deal = F.pmod(F.xxhash64("_k"), F.coalesce("parts", F.lit(1)))
    dealt = rows.join(parts, TILE, "left").select(*TILE, deal.cast("int").alias("part"), F.struct("id", "kind", "ring", F.map_filter("texts", lambda _, v: v.isNotNull()).alias("texts"), F.map_filter("numbers", lambda _, v: v.isNotNull()).alias("numbers")).alias("f"))
    grouped = dealt.groupBy(*TILE, "part").agg(F.collect_list("f").alias("fs"))  # about `part` features at most
    known = lambda kind, entry: F.array_sort(F.array_distinct(F.flatten(F.transform("fs", lambda f: getattr(F, entry)(f[kind])))))
    grouped = cut(grouped.select(*TILE, "part", "fs", known("texts", "map_values").alias("strings"), known("numbers", "map_values").alias("ints"), F.array_sort(F.array_union(known("texts", "map_keys"), known("numbers", "map_keys"))).alias("own")))
    # few and small rows from here: one for each part
    sizes = grouped.select(*TILE, "part", (F.size("strings") + F.size("ints")).alias("n"), F.size("own").alias("k"))
    before = Window.partitionBy(*TILE).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*TILE, "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long").alias(f"{c}_before") for c in ("n", "k")], (F.row_number().over(Window.partitionBy(*TILE).orderBy("part")) == 1).alias("first"))
    body = cut(grouped.join(offsets, [*TILE, "part"]).mapInPandas(_bodies, "z int, x int, y int, layer string, part int, first boolean, features long, body binary"))
    totals = body.groupBy(*TILE).agg(F.sum(F.length("body")).alias("total"))
    return body.join(totals, TILE).mapInPandas(_headed, "z int, x int, y int, layer string, part int, features long, bytes binary")


def assembled(parts: DataFrame, most: int = 64 << 20) -> DataFrame:
    """z, x, y, bytes of the tiles of up to so many bytes; larger ones stay in parts."""
    small = parts.groupBy("z", "x", "y").agg(F.sum(F.length("bytes")).alias("total")).where(F.col("total") <= most).drop("total")
    whole = parts.join(small, ["z", "x", "y"]).groupBy("z", "x", "y").agg(F.array_sort(F.collect_list(F.struct("layer", "part", "bytes"))).alias("ps"))
    return whole.select("z", "x", "y", F.aggregate("ps", F.lit(b""), lambda a, p: F.concat(a, p["bytes"])).alias("bytes"))


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return varint(number << 3 | VARINT) + varint(value)
    return varint(number << 3 | BYTES) + varint(len(value)) + value


def geometry(kind: int, ring: list[tuple[int, int]]) -> bytes:
    """Commands of a point, line or ring: steps from point to point, signs in the lowest bit. Rings run clockwise as seen, and don't repeat their first point."""
    if kind == POLYGON_TYPE:
        ring = ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring
        if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) < 0:
            ring = ring[:1] + ring[:0:-1]
    out, at = bytearray(), (0, 0)
    for k, p in enumerate(ring):
        if k == 0:
            out += varint(1 << 3 | MOVE)
        elif k == 1:
            out += varint(len(ring) - 1 << 3 | LINE)
        for d in (p[0] - at[0], p[1] - at[1]):
            out += varint(d << 1 if d >= 0 else (-d << 1) - 1)
        at = p
    return bytes(out) + (varint(1 << 3 | CLOSE) if kind == POLYGON_TYPE else b"")


def _bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features, keys and values of each part; its keys and values follow those of the parts before."""
    for b in batches:
        found = []
        for r in b.itertuples(index=False):
            keys = {k: r.k_before + i for i, k in enumerate(r.own)}
            values: dict[Any, int] = {("s", v): r.n_before + i for i, v in enumerate(r.strings)}
            values |= {("i", int(v)): r.n_before + len(r.strings) + i for i, v in enumerate(r.ints)}
            out = bytearray()
            for f in sorted(r.fs, key=lambda f: (f["id"] is None, f["id"] or "")):
                said = [(k, ("s", v)) for k, v in sorted(dict(f["texts"]).items())] + [(k, ("i", int(v))) for k, v in sorted(dict(f["numbers"]).items())]
                tags = b"".join(varint(keys[k]) + varint(values[v]) for k, v in said)
                ring = [(int(p["x"]), int(p["y"])) for p in f["ring"]]
                out += field(FEATURES, field(TAGS, tags) + field(TYPE, int(f["kind"])) + field(GEOMETRY, geometry(int(f["kind"]), ring)))
            out += b"".join(field(KEYS, k.encode()) for k in r.own)
            out += b"".join(field(VALUES, field(STRING, v.encode())) for v in r.strings) + b"".join(field(VALUES, field(INT, int(v) % (1 << 64))) for v in r.ints)
            found.append((r.z, r.x, r.y, r.layer, r.part, r.first, len(r.fs), bytes(out)))
        yield pd.DataFrame(found, columns=["z", "x", "y", "layer", "part", "first", "features", "body"])


def _headed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The parts, a layer's first one behind the layer's tag, whole length, version, name and extent."""
    for b in batches:
        whole = []
        for r in b.itertuples(index=False):
            own = field(VERSION, 2) + field(NAME, r.layer.encode()) + field(LAYER_EXTENT, EXTENT)
            whole.append(varint(LAYERS << 3 | BYTES) + varint(len(own) + int(r.total)) + own + r.body if r.first else r.body)
        yield b[["z", "x", "y", "layer", "part", "features"]].assign(bytes=whole)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a message; a last one that ends behind the data comes as what there is of it."""
    at = 0

    def number() -> int:
        nonlocal at
        n = shift = 0
        while True:
            byte = data[at]
            at += 1
            n |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return n

    while at < len(data):
        tag = number()
        if tag & 7 == VARINT:
            yield tag >> 3, number()
        elif tag & 7 == BYTES:
            size = number()
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError(f"wire type {tag & 7}")


def numbers(data: bytes) -> list[int]:
    out, n, shift = [], 0, 0
    for byte in data:
        n |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            out.append(n)
            n = shift = 0
    return out


def points(commands: list[int]) -> list[tuple[int, int]]:
    """The points of a geometry's commands."""
    out, x, y, k = [], 0, 0, 0
    while k < len(commands):
        what, times = commands[k] & 7, commands[k] >> 3
        k += 1
        for _ in range(times if what != CLOSE else 0):
            dx, dy = ((n >> 1) ^ -(n & 1) for n in commands[k : k + 2])
            x, y, k = x + dx, y + dy, k + 2
            out.append((x, y))
    return out


def read(parts: DataFrame) -> DataFrame:
    """z, x, y, layer, kind, points of the features that the parts' bytes hold; each part is read by itself."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                body = next(v for n, v in fields(r.bytes)) if r.bytes[0] == LAYERS << 3 | BYTES else r.bytes
                found = [dict(fields(v)) for n, v in fields(body) if n == FEATURES]
                rows = [(r.z, r.x, r.y, r.layer, f[TYPE], [{"x": x, "y": y} for x, y in points(numbers(f[GEOMETRY]))]) for f in found]
                yield pd.DataFrame(rows, columns=["z", "x", "y", "layer", "kind", "points"])

    return parts.mapInPandas(each, "z int, x int, y int, layer string, kind int, points array<struct<x:int,y:int>>")
