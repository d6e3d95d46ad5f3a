"""Vector tiles of a zoom range against the tiles one by one."""

import math

from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.operators import serving, tiles


def plain_tile(data):
    """layer name -> list of (kind, points, properties) of a whole tile's bytes."""
    out = {}
    for number, layer in tiles.fields(data):
        assert number == 3
        name, keys, values, features, size = None, [], [], [], None
        for n, v in tiles.fields(layer):
            if n == 1:
                name = v.decode()
            elif n == 2:
                features.append(dict(tiles.fields(v)))
            elif n == 3:
                keys.append(v.decode())
            elif n == 4:
                kind, value = next(tiles.fields(v))
                values.append(value.decode() if kind == 1 else value)
            elif n == 5:
                size = v
            elif n == 15:
                assert v == 2
        assert size == 4096 and name not in out  # a name once in a tile
        out[name] = []
        for f in features:
            tags = tiles.numbers(f[2])
            said = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2], strict=True)}
            out[name].append((f[3], tiles.points(tiles.numbers(f[4])), said))
    return out


def features(spark):
    spots = [(str(k), f"org {k % 3}", "feed", math.sin(k) * 84, math.cos(k * 7) * 179) for k in range(300)]
    spots += [("edge", None, "feed", 0.0, 0.0), ("east", "é", "feed", 10.0, 180.0), ("pole", "x", "feed", 89.0, 5.0), ("none", "x", "feed", None, 5.0)]
    points = spark.createDataFrame(spots, "id string, org_name string, source_name string, lat double, lon double")
    cells = points.where("lat is not null").select(quad.cell(F.col("lat"), F.col("lon"), 5).alias("cell")).groupBy("cell").count()
    return points, cells.select("cell", F.lit("density").alias("layer_name"), F.col("count").alias("layer_value"))


def test_tiles_equal_one_by_one(spark):
    points, cells = features(spark)
    shown = {(z, x, y): serving.tile(points, cells, z, x, y).collect() for z in range(3) for x in range(2**z) for y in range(2**z)}
    for part in (20_000, 16):  # whole layers, and layers of many parts
        parts = tiles.pyramid(tiles.features_of(points, cells), 0, 3, part).cache()
        assert parts.where("part > 0").isEmpty() == (part > 1000)
        got = {(r.z, r.x, r.y): plain_tile(r.bytes) for r in tiles.assembled(parts).collect()}
        read = tiles.read(parts).groupBy("z", "x", "y", "layer").count().collect()
        assert {(r.z, r.x, r.y, r.layer): r["count"] for r in read} == {(*t, name): len(fs) for t, layers in got.items() for name, fs in layers.items()}
        seen = 0
        for at, rows in shown.items():
            want = {}
            for r in rows:
                want.setdefault(r.layer, {})[r.id] = {(p.x, p.y) for p in r.geometry}
            have, key = got.get(at, {}), {"facility_points": "facility_id", "h3_cells": "cell"}
            assert {n: {f[2][key[n]] for f in fs} for n, fs in have.items()} == {n: set(v) for n, v in want.items()}
            for name, fs in have.items():
                for kind, ring, said in fs:
                    assert set(ring) == want[name][said[key[name]]] and kind == (1 if name == "facility_points" else 3)
                    if kind == 3:
                        assert sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) > 0 and said["resolution"] == 5
                    seen += 1
        assert seen > 600
        parts.unpersist()
    low = tiles.pyramid(tiles.features_of(points, cells), 1, 1)
    assert {(r.x, r.y) for r in tiles.read(low.where("layer = 'facility_points'")).where("exists(points, p -> p.x in (0, 4096) and p.y in (0, 4096))").collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}  # a corner is in four tiles


def test_no_tiles(spark):
    points, cells = features(spark)
    assert tiles.pyramid(tiles.features_of(points.limit(0), cells.limit(0)), 0, 4).isEmpty()
    assert tiles.pyramid(tiles.features_of(points.where("id in ('pole', 'none')"), cells.limit(0)), 0, 4).isEmpty()
