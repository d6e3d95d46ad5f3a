import json

import pytest

from terracell.sources import arrays, files
from terracell.streaming import counts


def test_feeds_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('ORGANIZATION,NODE_NAME,LATITUDE,LONGITUDE,SOURCE,ASOF_DATE\n"A, ""B""","x\ny",1.5,2,s,2026-01-01\n')
    (tmp_path / "b.tsv").write_text("name\torg_id\tlatitude\tlongitude\tupdated\torg_name\tcreated\nn\t7\t1\t2\t2025-01-02T03\tNULL\t\n")
    (tmp_path / "c.csv").write_text("a,b\n1,2\n")
    row = files.feed(spark, str(tmp_path / "a.csv")).first()
    assert (row.ORGANIZATION, row.NODE_NAME) == ('A, "B"', "x\ny")
    row = files.feed(spark, str(tmp_path / "b.tsv")).first()
    assert (row.ORGANIZATION, row.ASOF_DATE) == ("org_7", "2025-01-02")
    with pytest.raises(ValueError, match="missing"):
        files.feed(spark, str(tmp_path / "c.csv"))


def test_geojson(spark, tmp_path):
    feature = {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2]}, "properties": {"ISO_A2": "TW"}}
    (tmp_path / "x.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature]}, indent=1))
    (tmp_path / "y.geojson").write_text("no json")
    rows = files.geojson(spark, f"{tmp_path}/*.geojson").collect()
    assert [json.loads(r.geometry)["coordinates"] for r in rows] == [[1, 2]] and rows[0].properties == {"ISO_A2": "TW"}
    files.write_features(spark.createDataFrame([(1.0, 2.0, "a", None)], "lon double, lat double, name string, note string"), str(tmp_path / "out"), "lon", "lat")
    line = json.loads(spark.read.text(str(tmp_path / "out")).first().value)
    assert line["geometry"]["coordinates"] == [1.0, 2.0] and line["properties"] == {"name": "a"}


def test_graph_files(spark, tmp_path):
    files.write_nodes(spark.createDataFrame([(9, 1.0, 2.0, "hub"), (-4, 3.0, 4.0, None)], "node_id long, lon double, lat double, kind string").repartition(2), str(tmp_path / "nodes"))
    files.write_lines(spark.createDataFrame([("b", [(0.0, 1.0), (2.0, 3.0)], "trunk"), ("a", [(4.0, 5.0), (6.0, 7.0)], "primary")], "edge_id string, line array<struct<lon:double,lat:double>>, road_class string"), str(tmp_path / "edges"))
    nodes, edges = ([json.loads(r.value) for r in spark.read.text(str(tmp_path / k)).collect()] for k in ("nodes", "edges"))
    found = {f["properties"]["node_id"]: (f["geometry"], f["properties"].get("kind")) for f in nodes}
    assert found == {-4: ({"type": "Point", "coordinates": [3.0, 4.0]}, None), 9: ({"type": "Point", "coordinates": [1.0, 2.0]}, "hub")}
    assert {f["properties"]["edge_id"]: f["geometry"]["coordinates"] for f in edges} == {"a": [[4.0, 5.0], [6.0, 7.0]], "b": [[0.0, 1.0], [2.0, 3.0]]}


HARD = {
    'a, "[b': "x,]}{\\",
    "n": [1, [2, 3], {"routes": [9]}],
    "routes": [{"k": 1, "s": 'a,\\",[{'}, [[1, 2], []], "te,xt]", 5, None, {"é": "ü,,,", "in": {"routes": [1, 2]}}, {"long": [{"x": k, "y": "]" * k} for k in range(9)]}],
    "last": {"z": "}"},
}


@pytest.mark.parametrize("size", [5, 13, 64, 100000])
def test_json_arrays_at_every_cut(spark, tmp_path, size):
    """Equal to a plain parse wherever the ranges begin; the array first, in the middle and last, alone, empty, absent, nested alone."""
    last = {k: HARD[k] for k in ("n", "routes")}
    first = {k: HARD[k] for k in ("routes", "last")}
    known = {"mid": HARD, "last": last, "first": first, "alone": {"routes": [1]}, "empty": {"a": 1, "routes": []}, "absent": {"a": {"routes": [1]}}, "none": {"routes": None, "b": 2}}
    for name, value in known.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value, ensure_ascii=False, indent=3 if name == "first" else None))
    (tmp_path / "no.json").write_text("no json")
    (tmp_path / "zero.json").write_text("")
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got, heads = {}, {}
        for r in sorted(arrays.elements(spark, str(tmp_path), "routes").collect(), key=lambda r: r.element):
            got.setdefault(r.file.split("/")[-1][:-5], []).append(json.loads(r.text))
        for r in arrays.header(spark, str(tmp_path), "routes").collect():
            heads[r.file.split("/")[-1][:-5]] = json.loads(r.text)
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
    assert got == {k: v["routes"] for k, v in known.items() if v.get("routes")}
    assert heads == {k: {f: x for f, x in v.items() if f != "routes"} for k, v in known.items() if set(v) - {"routes"}}


def test_publish_once(spark, tmp_path):
    files.publish(spark, {"cells": spark.range(3)}, str(tmp_path), "run-1")
    assert spark.read.parquet(files.latest(spark, str(tmp_path)) + "/cells").count() == 3
    with pytest.raises(FileExistsError):
        files.publish(spark, {"cells": spark.range(3)}, str(tmp_path), "run-1")
    files.publish(spark, {"cells": spark.range(4)}, str(tmp_path), "run-2")
    assert spark.read.parquet(files.latest(spark, str(tmp_path)) + "/cells").count() == 4


def test_stream_equals_table(spark, tmp_path):
    rows = spark.range(200).selectExpr("timestamp_seconds(id * 60) as ts", "cast(id % 80 as double) as lat", "cast(id % 170 as double) as lon", "id % 50 as facility_id")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(frame, name, mode):
        frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start().awaitTermination(60)
        return sorted(map(tuple, spark.table(name).collect()))

    assert run(counts.windowed_cells(stream, 3), "cell_counts", "complete") == sorted(map(tuple, counts.windowed_cells(rows, 3).collect()))
    assert sorted(r[3] for r in run(counts.first_seen(stream), "seen_first", "append")) == list(range(50))
