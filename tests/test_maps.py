"""Polygons, features for maps, and whole runs, on small inputs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terracell import runs
from terracell.functions import quad
from terracell.operators import polygons, serving
from terracell.sources import files
from terracell.streaming import progress


def collection(path, *features):
    path.write_text(json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": {"type": k, "coordinates": c}} for p, k, c in features]}))


TRIANGLE = [[[0, 0], [40, 0], [0, 40], [0, 0]]]
HOLED = [[[0, 0], [40, 0], [40, 40], [0, 40], [0, 0]], [[10, 10], [30, 10], [30, 30], [10, 30], [10, 10]]]


def test_polygons(spark, tmp_path):
    collection(tmp_path / "xx.geojson", ({"iso_a2": "tr", "name": "Triangle"}, "Polygon", TRIANGLE), ({"GID_0": "HOL", "COUNTRY": "Holed"}, "Polygon", HOLED), ({}, "MultiPolygon", [TRIANGLE, [[[100, 50], [110, 50], [110, 60], [100, 50]]]]), ({"iso_a2": "PT"}, "Point", [1, 2]))
    shapes = polygons.from_geojson(spark, str(tmp_path / "*.geojson"))
    assert [(r.iso, r.name) for r in shapes.orderBy("iso", "place").collect()] == [("HO", "Holed"), ("TR", "Triangle"), ("XX", "XX")]
    assert polygons.from_geojson(spark, str(tmp_path / "*.geojson"), ("TR", "HO"), ("HO",)).count() == 1
    size = lambda res: 360.0 / 2**res * 180.0 / 2**res
    got = {r.iso: r.a for r in polygons.covering(shapes, 6).groupBy("iso").agg((F.sum("overlap") * size(6)).alias("a")).collect()}
    assert {k: round(v, 6) for k, v in got.items()} == {"TR": 800.0, "HO": 1200.0, "XX": 850.0}
    full, any_, center = ({(r.iso, r.cell) for r in polygons.cells_of(shapes, 5, m).collect()} for m in ("full", "overlap", "center"))
    assert full < center < any_ and any_ <= {(r.iso, r.cell) for r in polygons.cells_of(shapes, 5, "bbox_overlap").collect()}
    tree = polygons.quadtree(shapes.where("iso = 'HO'"), [2, 4, 6])
    assert tree.agg(F.count(F.lit(1))).first()[0] == tree.select("cell").distinct().count() > 3
    share = polygons.uncovered_share(shapes.where("iso = 'HO'"), tree).first()
    assert share.inside > 2000 and share.uncovered == 0
    points = spark.createDataFrame([(1, 5.0, 5.0), (2, 20.0, 20.0), (3, 0.0, 20.0), (4, 20.0, 10.0), (5, 55.0, 109.0), (6, 39.0, 39.0)], "id int, lat double, lon double")
    found = {(r.id, r.shape_iso) for r in polygons.covered_points(points, shapes).collect()}
    assert found == {(1, "HO"), (1, "TR"), (1, "XX"), (2, "TR"), (2, "XX"), (3, "HO"), (3, "TR"), (3, "XX"), (4, "HO"), (4, "TR"), (4, "XX"), (5, "XX"), (6, "HO")}
    with pytest.raises(ValueError, match="mode"):
        polygons.cells_of(shapes, 5, "other")


def test_inside_like_sampling():
    r, shape = random.Random(2), [[[(0.0, 0.0), (10.0, 1.0), (6.0, 4.0), (9.0, 9.0), (2.0, 7.0), (4.0, 3.0)]]]
    hits = sum(polygons.inside(shape, r.uniform(0, 10), r.uniform(0, 10)) for _ in range(20000)) / 200
    assert abs(hits - polygons.area(shape)) < 1.5
    parts = sum(polygons.area(polygons.clipped(shape, x, y, x + 2.5, y + 2.5)) for x in (0, 2.5, 5, 7.5) for y in (0, 2.5, 5, 7.5))
    assert abs(parts - polygons.area(shape)) < 1e-9


def test_union_area():
    """Against counting, for overlapping, adjoining and holed parts; a part twice counts once."""
    r = random.Random(3)
    for _ in range(20):
        shape = [[[(r.uniform(0, 10), r.uniform(0, 10)) for _ in range(3)]] for _ in range(r.randint(1, 5))]
        shape += [shape[0], [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]]
        hits = sum(polygons.inside(shape, (i + 0.5) / 12, (j + 0.5) / 12) for i in range(120) for j in range(120)) / 144
        assert abs(polygons.area(shape) - hits) < 1.2
    halves = [[[(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)]], [[(2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]]]
    assert abs(polygons.area(halves) - 4) < 1e-12 and polygons.area([]) == 0


def test_features_of_one_code(spark):
    """Features that overlap and adjoin are one area: a row a cell, full cells where two fill one together, points by the index as by the whole shape."""
    r = random.Random(6)
    ring = lambda *c: [[{"lon": float(x), "lat": float(y)} for x, y in c]]
    import math

    star = [(60 + 40 * math.cos(k * math.pi / 40) * (1 if k % 2 else 0.6), 20 + 40 * math.sin(k * math.pi / 40) * (1 if k % 2 else 0.6)) for k in range(80)]
    rows = [("AA", "A", [ring((0, 0), (90, 0), (0, 45))]), ("AA", "A", [ring((90, 0), (90, 45), (0, 45))]), ("AA", "B", [ring((80, 10), (120, 10), (120, 30), (80, 30))]), ("BB", "B", [ring(*star), ring((-90, -45), (-45, -45), (-45, 0), (-90, 0))]), ("CC", "C", None), ("DD", "D", [])]
    shapes = spark.createDataFrame(rows, f"iso string, name string, shape {polygons.SHAPE}")
    cover = polygons.covering(shapes, 5)
    assert cover.groupBy("iso", "cell").count().where("count > 1").count() == 0
    full = {row.cell for row in polygons.cells_of(shapes.where("iso = 'AA'"), 3, "full").collect()}
    assert {(3 << 50) + (4 << 25) + y for y in (4, 5)} <= full
    points = [(r.uniform(-100, 130), r.uniform(-50, 70), {"k": 1}) for _ in range(1500)] + [(90.0, 20.0, {}), (0.0, 0.0, {}), (-45.0, -10.0, {}), (45.0, 22.5, {}), (45.0, 22.5, {}), (None, 3.0, None)]
    frame = spark.createDataFrame([(i, y, x, m, "z") for i, (x, y, m) in enumerate(points)], "id int, lat double, lon double, shape map<string,int>, _cell string")
    for edges, finest in ((4, 6), (1000, 3), (48, 10)):
        table = polygons.index(shapes, finest, edges)
        up = table.select("iso", "cell", F.explode(quad.ancestors(F.col("cell"), 0, own=False)).alias("above"))
        assert up.join(table.select("iso", F.col("cell").alias("above")), ["iso", "above"]).count() == 0  # no cell lies in another of its iso
        got = polygons.covered_points(frame, table).select("id", "shape_iso", "shape").collect()
        parts = {iso: [[[(p["lon"], p["lat"]) for p in c] for c in part] for x in rows if x[0] == iso for part in x[2]] for iso in ("AA", "BB")}
        want = sorted((i, iso) for i, (x, y, _) in enumerate(points) if x is not None for iso, whole in parts.items() if polygons.inside(whole, x, y))
        assert sorted((g.id, g.shape_iso) for g in got) == want and all((g["shape"] or {}) == points[g.id][2] for g in got)
    asked = cover.where("iso = 'BB'").select("iso", "cell").union(spark.sql("select 'BB', 1L << 50").toDF("iso", "cell"))
    found = {(s.cell): s.overlap for s in polygons.shares(asked, shapes).collect()}
    assert {row.cell: round(row.overlap, 9) for row in cover.where("iso = 'BB'").collect()} == {k: round(v, 9) for k, v in found.items() if k >> 50 == 5}


def test_folder(spark, tmp_path):
    collection(tmp_path / "AR.geojson", ({"name": "Argentina"}, "Polygon", TRIANGLE), ({"iso_a2": "CL"}, "Polygon", HOLED))
    collection(tmp_path / "GB.geojson", ({}, "Polygon", HOLED))
    load = lambda *a: [(r.iso, r.name) for r in polygons.from_folder(spark, str(tmp_path), *a).orderBy("iso").collect()]
    assert load(["gb", "AR "]) == [("AR", "Argentina"), ("CL", "CL"), ("GB", "GB")] and load(["AR"], ("CL",)) == [("AR", "Argentina")]
    assert load(["AR"], ("AR",)) == [] and polygons.from_geojson(spark, str(tmp_path / "*.geojson"), ("AR",), ("AR",)).count() == 0
    with pytest.raises(FileNotFoundError, match="JP, ZA"):
        load(["ZA", "GB", "JP"])


def test_features(spark):
    ring = spark.createDataFrame([([{"lon": 179.0, "lat": 0.0}, {"lon": -179.0, "lat": 0.0}, {"lon": -179.0, "lat": 1.0}, {"lon": 179.0, "lat": 1.0}, {"lon": 179.0, "lat": 0.0}],)], "r array<struct<lon:double,lat:double>>")
    assert [p.lon for p in ring.select(serving.unwrapped(F.col("r")).alias("r")).first().r] == [179, 181, 181, 179, 179]
    text = spark.createDataFrame([(" gb, US,gb ,",), ("GBR",), ("",)], "t string").select(serving.country_codes(F.col("t")).alias("c")).collect()
    assert [r.c for r in text] == [["GB", "US"], None, []]
    assert spark.sql("select map('a', 'x', 'b', '7') as m").select(serving.first_int(F.col("m"), "z", "a", "b")).first()[0] == 7
    assert serving.limit_of("cells", None) == 200_000
    for kind, asked in (("places", 50_001), ("catalog", 0)):
        with pytest.raises(ValueError, match="limit"):
            serving.limit_of(kind, asked)
    cells = spark.range(1).select(quad.cell(F.lit(1.0), F.lit(1.0), 4).alias("cell"), F.lit(4).alias("resolution"), F.lit("TW").alias("layer_value"), F.lit(None).cast("string").alias("note"))
    feature = json.loads(serving.layer_cells(cells, "country_mask").first().feature)
    assert feature["geometry"]["coordinates"][0][0] == feature["geometry"]["coordinates"][0][-1] and "note" not in feature["properties"]
    with pytest.raises(ValueError, match="split_threshold"):
        serving.layer_cells(cells, "country_mask", split_threshold=3)
    roads = spark.createDataFrame([("AA", "trunk", "1", [])], "country_code string, transport_class string, id string, line array<double>")
    with pytest.raises(LookupError):
        serving.transport(roads, "zz", "id")


def test_route_files(spark, tmp_path):
    route = lambda a, b, line=True: {"from_idx": a, "to_idx": b, "distance": 1.0, "geometry": {"type": "LineString", "coordinates": [[0, 0], [1, 1]]} if line else None}
    (tmp_path / "x-r7-regions-tw-routes.json").write_text(json.dumps({"routes": [route(0, 0), route(0, 1), route(1, 0, False)]}))
    (tmp_path / "y-routes.json").write_text(json.dumps({"country_code": "ar", "routes": [route(0, 1)]}))
    (tmp_path / "z-routes.json").write_text("no json")
    got = serving.route_files(spark, f"{tmp_path}/*-routes.json")
    assert sorted((r.country_code, r.from_idx, r.to_idx, r.geometry is not None) for r in got.collect()) == [("AR", 0, 1, True), ("TW", 0, 0, True), ("TW", 0, 1, True), ("TW", 1, 0, False)]


FEED = "ORGANIZATION\tNODE_NAME\tLATITUDE\tLONGITUDE\tCITY\tSTATE\tCOUNTRY\tSOURCE\tASOF_DATE\n" + "".join(f"{o}\t{n}\t{a}\t{b}\t{c}\t{s}\tTW\tfixture\t2026-02-28\n" for o, n, a, b, c, s in (("Example Networks", "Chicago 1", 41.8781, -87.6298, "Chicago", "IL"), ("Example Networks", "San Francisco 1", 37.7749, -122.4194, "San Francisco", "CA"), ("EuroNet", "Frankfurt 1", 50.1109, 8.6821, "Frankfurt", "")))


def test_feeds(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(FEED + "EuroNet\tFrankfurt 1\t50.1109\t8.6821\tFrankfurt\t\tTW\tfixture\t2026-02-28\nX\tY\t91\t0\t\t\t\t\t2026-02-28\nX\tY\t 1 \t-200\t\t\t\t\t2026-02-28\n")
    (tmp_path / "b.tsv").write_text("id\tname\torg_id\tcity\tstate\tcountry\tlatitude\tlongitude\tupdated\n19\tCoreSite LA1\t34\tLos Angeles\tCA\tTW\t34.047942\t-118.255564\t2025-09-26 22:42:05.000000 +00:00\n20\tNo org\tNULL\t\t\t\t1\t2\t2025-09-26\n")
    (tmp_path / "c.tsv").write_text("city_name\tstate_province\tcountry\tlatitude\tlongitude\tstandard_city\tstandard_state\tstandard_country\tstandard_latitude\tstandard_longitude\tasof_date\nChangi South\t\tSingapore\t1.3890448\t103.987015\tSingapore\t\tSG\t1.2930335\t103.85582\t2022-09-14\n")
    rows = files.records(spark, {k: str(tmp_path / f"{k}.tsv") for k in "abc"})
    assert rows.where("not valid").count() == 3
    from terracell.operators import ingest

    got = {r.source_facility_name: r for r in ingest.facilities(rows, (4, 7)).collect()}
    assert len(got) == 5 and ingest.organizations(ingest.facilities(rows, (4,))).count() == 4
    assert (got["CoreSite LA1"].org_name, got["CoreSite LA1"].asof_date, got["CoreSite LA1"].source_name, got["CoreSite LA1"].city_label) == ("org_34", "2025-09-26", "b", "Los Angeles")
    assert (got["Changi South"].org_name, got["Changi South"].lat, got["Changi South"].country_label) == ("landing_points", 1.3890448, "SG")
    assert len(got["Frankfurt 1"].facility_id) == 24 and len(got["Frankfurt 1"].record_hash) == 64 and got["Frankfurt 1"].notes is None


def test_whole_run(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(FEED)
    boxes = spark.createDataFrame([("TW", "Taiwan", -130.0, 30.0, 10.0, 55.0)], "iso string, name string, west double, south double, east double, north double")
    config = {"resolutions": [4, 7], "layers": {
        "metro_core": {"resolution": 7, "k": 1, "min_facilities": 1},
        "country_mask": {"resolution": 4},
        "facility_density_adaptive": {"base": 4, "root": 2, "min_output": 4, "floor": 6, "most": 8, "target": 1, "interior": 4},
        "regions": {"resolution": 6},
    }}
    stages = []
    out = runs.run(spark, {"fixture": str(tmp_path / "a.tsv")}, config, str(tmp_path / "out"), boxes, note=stages.append)
    assert out["published"] and out["metrics"]["facilities"] == 3 and out["metrics"]["violations"] == {} and stages[0] == "ingest" and stages[-1] == "publish"
    assert out["metrics"]["cells"]["regions"] == 3 and out["metrics"]["cells"]["metro_core"] == 1
    folder = files.latest(spark, str(tmp_path / "out"))
    assert folder.endswith(out["run_id"]) and spark.read.parquet(f"{folder}/canonical/facilities").count() == 3
    told = progress.events(spark, str(tmp_path / "out")).orderBy("seq").collect()
    assert [(e.stage, e.status) for e in told[:2] + told[-2:]] == [("ingest", "in_progress"), ("ingest", "complete"), ("publish", "complete"), ("pipeline", "complete")]
    assert {e.layer_name for e in told if e.stage == "layer:country_mask"} == {"country_mask"} and len(told) == 2 * len(stages) + 1
    said = runs.status(spark, str(tmp_path / "out"), out["run_id"], told[-1].ts)
    assert said["latest"] and said["published"] and not said["progress"]["active"] and said["adaptive_policy"]["adjacency_health"]["status"] == "ok" and said["metrics"]["facilities"] == 3
    assert runs.active(spark, str(tmp_path / "out"), told[-1].ts).isEmpty()
    with pytest.raises(LookupError):
        runs.status(spark, str(tmp_path / "out"), "run-none", told[-1].ts)
    again = runs.run(spark, {"fixture": str(tmp_path / "a.tsv")}, dict(reversed(config.items())), str(tmp_path / "out"), boxes)
    assert again == {"run_id": out["run_id"], "published": True, "again": True}
    assert [r["run_id"] for r in runs.catalog(spark, str(tmp_path / "out"))] == [out["run_id"]]
    found = runs.metadata(spark, str(tmp_path / "out"), out["run_id"], "facility_density_adaptive")[0]
    assert runs.adjacency_health(found)["status"] == "ok" and found["adjacency_checks"] > 0
    again = runs.run(spark, {"fixture": str(tmp_path / "a.tsv")}, config | {"layers": {k: v for k, v in config["layers"].items()}}, str(tmp_path / "out"), boxes.withColumn("east", F.lit(11.0)), publish=False)
    assert again["run_id"] != out["run_id"]
    report = runs.calibrate(spark, {"fixture": str(tmp_path / "a.tsv")}, config, str(tmp_path / "out"), "TW", boxes)
    assert report["facilities"] == 3 and runs.latest_reports(spark, str(tmp_path / "out")).first().adaptive_leaf_count == report["adaptive_leaf_count"]
    assert runs.calibrate(spark, {"fixture": str(tmp_path / "a.tsv")}, config | {"layers": {}}, str(tmp_path / "out"), "T'W")["facilities"] == 0
    with pytest.raises(KeyError):
        runs.layer("nothing")
    assert runs.layer("terracell.runs:metro_core") is runs.metro_core


def test_run_over_polygons(spark, tmp_path):
    """A triangle and a second feature of the same country: mask, base from the mask, clip, dates and ids of layers, and ids of runs that follow every input."""
    (tmp_path / "a.tsv").write_text(FEED)
    collection(tmp_path / "TW.geojson", ({}, "Polygon", [[[-130, 25], [20, 25], [-60, 60], [-130, 25]]]), ({}, "Polygon", [[[0, 25], [40, 25], [40, 60], [0, 60], [0, 25]]]))
    shapes = polygons.from_folder(spark, str(tmp_path), ["TW"])
    rules = {"base": 2, "root": 2, "min_output": 4, "floor": 6, "most": 8, "target": 1, "interior": 4}
    config = {"resolutions": [7], "layers": {"country_mask": {"resolution": 4}, "facility_density_adaptive": rules, "regions": {"resolution": 6}}}
    feeds = {"fixture": str(tmp_path / "a.tsv")}
    out = runs.run(spark, feeds, config, str(tmp_path / "out"), shapes)
    assert out["metrics"]["violations"] == {} and out["metadata"]["facility_density_adaptive"]["params"]["base"] == 4
    assert out["metadata"]["facility_density_adaptive"]["coverage_domain"] == "country_mask_r4" and out["metadata"]["facility_density_adaptive"]["country_intersection_cells_dropped"] > 0
    folder = files.latest(spark, str(tmp_path / "out"))
    leaves, mask = (spark.read.parquet(f"{folder}/layers/{k}") for k in ("facility_density_adaptive", "country_mask"))
    assert mask.count() == polygons.covering(shapes, 4).count() and {r.asof_date for r in leaves.collect()} == {"2026-02-28"}
    assert {r.layer_id for r in leaves.union(mask).select("layer_id").collect()} == {"facility_density_adaptive:v1", "country_mask:v1"}
    assert polygons.shares(leaves.select(F.lit("TW").alias("iso"), "cell"), shapes).count() == leaves.count()
    assert leaves.count() > 50 and {r.source_layer_version for r in spark.read.parquet(f"{folder}/layers/regions").collect()} == {"v1"}
    assert runs.run(spark, feeds, config, str(tmp_path / "out"), shapes)["again"]
    same = runs.run_id(runs.content_hash(spark, feeds, shapes), "c", "k")
    (tmp_path / "b.tsv").write_text(FEED)
    others = [runs.content_hash(spark, feeds, shapes.limit(1)), runs.content_hash(spark, feeds), runs.content_hash(spark, {"other": feeds["fixture"]}, shapes), runs.content_hash(spark, {"fixture": str(tmp_path / "b.tsv")}, shapes)]
    assert len({same, *(runs.run_id(x, "c", "k") for x in others)}) == 5
    assert runs.code_hash() == runs.code_hash({"layers": {"country_mask": {}}}) != runs.code_hash({"layers": {"json:loads": {}}})
    only = {"resolutions": [7], "layers": {}}
    ids = {runs.run(spark, feeds, only, str(tmp_path / "out"), where=w, publish=False)["run_id"] for w in (None, F.col("lat") > 38, F.col("lat") > 39)}
    assert len(ids) == 3
    with pytest.raises(ValueError, match="need the layer"):
        runs.run(spark, feeds, {"resolutions": [7], "layers": {"regions": {"resolution": 6}}}, str(tmp_path / "out"), publish=False)
