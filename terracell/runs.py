"""Runs: content hashes, layers in the order of a configuration, metrics, publishing once, and what was published."""

from __future__ import annotations

import hashlib
import importlib
import json
import pathlib
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.operators import adaptive, ingest, layers
from terracell.operators import polygons as areas
from terracell.session import cut
from terracell.sources import files
from terracell.streaming import progress


class Done(dict[str, DataFrame]):
    """Layers that a run has, by name, and their metadata; `polygons` are the run's own."""

    def __init__(self, polygons: DataFrame | None = None):
        super().__init__({} if polygons is None else {"polygons": shapes_of(polygons)})
        self.metadata: dict[str, dict] = {}


Layer = Callable[[DataFrame, Done, dict[str, Any]], tuple[DataFrame, dict]]


def shapes_of(polygons: DataFrame) -> DataFrame:
    """iso, name, shape of polygons, or of rectangles (west, south, east, north)."""
    return polygons.select(F.col("iso").cast("string").alias("iso"), "name", "shape") if "shape" in polygons.columns else areas.boxes(polygons)


def _latest(facilities: DataFrame) -> Column:
    """The facilities' last asof_date, as a value."""
    return F.lit(facilities.agg(F.max("asof_date")).first()[0] if "asof_date" in facilities.columns else None).cast("string")


def metro_core(facilities: DataFrame, _: Done, params: dict[str, Any]) -> tuple[DataFrame, dict]:
    cells = cut(layers.metro_core(facilities, params["resolution"], params["k"], params["min_facilities"]))
    first = cells.orderBy(F.desc("layer_value"), "cell").first()
    return cells.drop("layer_id"), {"seed_cell": first.cell if first else None, "params": params}


def country_mask(facilities: DataFrame, done: Done, params: dict[str, Any]) -> tuple[DataFrame, dict]:
    """Of the run's polygons; one resolution, or cells split by what they cover, through all resolutions from base to most or only some (`levels`)."""
    if params.get("mode") == "quadtree":
        cells = areas.quadtree(done["polygons"], params.get("levels") or [*range(params["base"], params["most"] + 1)]).select("cell", quad.res(F.col("cell")).alias("resolution"), F.col("iso").alias("layer_value"))
    else:
        claimed = layers.first_claim(areas.covering(done["polygons"], params["resolution"]))
        cells = claimed.select("cell", F.lit(params["resolution"]).alias("resolution"), F.col("iso").alias("layer_value"))
    return cells.withColumn("asof_date", _latest(facilities)), {"params": params}


def facility_density_adaptive(facilities: DataFrame, done: Done, params: dict[str, Any]) -> tuple[DataFrame, dict]:
    """Over the mask; a mask of one resolution gives the base resolution, whatever the parameters say."""
    mask = done.metadata.get("country_mask", {}).get("params", {})
    if mask.get("mode", "fixed") == "fixed" and mask.get("resolution") is not None:
        params = params | {"base": int(mask["resolution"])}
    rules = adaptive.Rules(**params)
    cells, metadata = adaptive.partition(facilities, done["country_mask"], rules, done.get("polygons"))
    domain = adaptive.domain_of(done["country_mask"], rules.base)
    inside = facilities.withColumn("_base", quad.cell(F.col("lat"), F.col("lon"), rules.base)).join(domain, F.col("_base") == domain.cell, "left_semi")
    return cells.withColumn("asof_date", _latest(inside)), metadata


def regions(_: DataFrame, done: Done, params: dict[str, Any]) -> tuple[DataFrame, dict]:
    """Connected leaves of one resolution that hold facilities, with the region's id, size and representative cell and its place."""
    res, source = params["resolution"], params.get("source_layer", "facility_density_adaptive")
    if source not in done:
        raise ValueError(f"regions need the layer {source} before them")
    if missing := {"cell", "resolution"} - set(done[source].columns):
        raise ValueError(f"{source} has no {', '.join(sorted(missing))}")
    leaves = cut(done[source].where((F.col("resolution") == res) & (F.col("layer_value") > 0)))
    part = cut(layers.regions(leaves.select("cell")))
    points = layers.region_points(leaves.select("cell"))
    lat, lon = quad.centre(F.col("representative"))
    rows = leaves.join(part, "cell").join(points, "component").withColumns({"region_lat": lat, "region_lon": lon})
    version = done.metadata.get(source, {}).get("layer_version")
    found = rows.select("cell", "resolution", "layer_value", F.col("region_id").alias("cluster_id"), F.col("component").alias("cluster_anchor"), F.col("size").alias("cluster_cell_count"), F.col("representative").alias("region_cell"), "region_lat", "region_lon", F.lit(source).alias("source_layer"), F.lit(version).cast("string").alias("source_layer_version"), "asof_date")
    return found, {"params": params, "target_resolution": res, "source_layer": source, "source_layer_version": version}


#: Layers by name; a configuration may name others as module:function.
REGISTRY: dict[str, Layer] = {f.__name__: f for f in (metro_core, country_mask, facility_density_adaptive, regions)}


def layer(name: str) -> Layer:
    if name in REGISTRY:
        return REGISTRY[name]
    module, _, function = name.partition(":")
    if not function:
        raise KeyError(f"no layer {name}")
    return getattr(importlib.import_module(module), function)


def text_of(config: dict[str, Any]) -> str:
    """The same text for equal configurations, whatever the order of their keys."""
    return json.dumps(config, sort_keys=True, indent=2, ensure_ascii=True)


def rows_hash(rows: DataFrame, by: list[str]) -> str:
    """sha256 over a line for each `by`: how many rows it has, and sums of two hashes of them; their order doesn't matter. No row is put together with others."""
    hashes = [F.sum(F.xxhash64(F.lit(k), F.to_json(F.struct(*rows.columns))).cast("decimal(38,0)")).cast("string").alias(f"_h{k}") for k in range(2)]
    total = hashlib.sha256()
    for r in sorted(tuple(map(str, r)) for r in rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), *hashes).collect()):
        total.update(("|".join(r) + "\n").encode())
    return total.hexdigest()


def content_hash(spark: SparkSession, feeds: dict[str, str], polygons: DataFrame | None = None) -> str:
    """Hash of the feeds, each with its name, and of the polygons. Files are read by lines, so they may have any size; the driver gets a line for a file, or iso."""
    total = hashlib.sha256()
    for name in sorted(feeds):
        lines = spark.read.option("recursiveFileLookup", "true").text(feeds[name]).withColumn("_file", F.regexp_extract("_metadata.file_path", r"([^/]+)$", 1))
        total.update(f"{name}|{rows_hash(lines, ['_file'])}\n".encode())
    if polygons is not None:
        total.update(f"polygons|{rows_hash(shapes_of(polygons), ['iso'])}\n".encode())
    return total.hexdigest()


def code_hash(config: dict[str, Any] | None = None) -> str:
    """sha256 over this package's files, by name, and over the modules of layers that the configuration takes from elsewhere."""
    root, total = pathlib.Path(__file__).parent, hashlib.sha256()
    paths = {str(p.relative_to(root)): p for p in root.rglob("*.py")}
    for name in (config or {}).get("layers", {}):
        if ":" in name and (own := importlib.import_module(name.partition(":")[0]).__file__):
            paths[name.partition(":")[0]] = pathlib.Path(own)
    for name in sorted(paths):
        total.update(f"{name}|{hashlib.sha256(paths[name].read_bytes()).hexdigest()}\n".encode())
    return total.hexdigest()


def run_id(inputs: str, config: str, code: str) -> str:
    return f"run-{inputs[:12]}-{config[:12]}-{code[:12]}"


def violations(facilities: DataFrame, found: dict[str, tuple[DataFrame, dict]], config: dict[str, Any]) -> DataFrame:
    """check, violations: rules that each layer, and the facilities, must keep."""
    checks: list[tuple[str, DataFrame]] = [
        ("facility_ids_repeat", facilities.groupBy("facility_id").count().where("count > 1")),
        ("coordinates_out_of_range", facilities.where("not (lat between -90 and 90 and lon between -180 and 180)")),
        *[(f"{c}_missing", facilities.where(F.col(c).isNull())) for c in facilities.columns if c.startswith("cell_r")],
    ]
    for name, (cells, metadata) in found.items():
        checks += [(f"{name}_cells_repeat", cells.groupBy("cell").count().where("count > 1")), (f"{name}_resolution_differs", cells.where(quad.res(F.col("cell")) != F.col("resolution")))]
        if metadata.get("seed_cell") is not None:
            seed = facilities.sparkSession.createDataFrame([(metadata["seed_cell"],)], "cell long")
            checks.append((f"{name}_seed_missing", seed.join(cells, "cell", "left_anti")))
        if name in ("country_mask", "facility_density_adaptive"):
            checks.append((f"{name}_overlap", layers.overlaps(cells.select("cell"))))
        if name == "facility_density_adaptive":
            rules = adaptive.Rules(**metadata["params"])
            checks += [
                (f"{name}_negative", cells.where("layer_value < 0")),
                (f"{name}_resolution_out_of_range", cells.where(~F.col("resolution").between(rules.min_output, rules.most))),
                (f"{name}_occupied_too_coarse", cells.where((F.col("layer_value") > 0) & (F.col("resolution") < rules.floor))),
                (f"{name}_neighbours_too_far", adaptive.adjacency(cells.select("cell")).where(F.col("delta") > rules.delta)),
            ]
        if "cluster_id" in cells.columns:
            sizes = cells.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), F.first("cluster_cell_count").alias("said"), F.count_distinct("region_cell").alias("places"), F.min("cell").alias("least"), F.first("cluster_anchor").alias("anchor"))
            checks.append((f"{name}_regions_differ", sizes.where("n <> said or places <> 1 or least <> anchor")))
    out = None
    for name, rows in checks:
        one = rows.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("check"), "violations")
        out = one if out is None else out.unionByName(one)
    return out


def computed(facilities: DataFrame, config: dict[str, Any], polygons: DataFrame | None = None, note: Callable[[str], None] = lambda stage: None) -> tuple[dict[str, tuple[DataFrame, dict]], dict[str, float]]:
    """The configuration's layers in their order, each with its metadata, and the seconds that each took.

    A layer's rows have layer_id (its name and version) and asof_date."""
    done, found, spent, version = Done(polygons), {}, {}, config.get("version", "v1")
    for key, params in config["layers"].items():
        note(f"layer {key}")
        began = time.time()
        cells, metadata = layer(key)(facilities, done, params)
        more = {"layer_id": F.lit(f"{key}:{version}")} | ({} if "asof_date" in cells.columns else {"asof_date": _latest(facilities)})
        done[key], done.metadata[key] = cut(cells.withColumns(more)), metadata | {"layer_name": key, "layer_version": version}
        found[key] = done[key], done.metadata[key]
        spent[key] = time.time() - began
    return found, spent


def run(spark: SparkSession, feeds: dict[str, str], config: dict[str, Any], root: str, polygons: DataFrame | None = None, code: str | None = None, note: Callable[[str], None] = lambda stage: None, publish: bool = True, where: Column | None = None, beat: float = 60.0) -> dict[str, Any]:
    """Ingests the feeds, computes the configuration's layers in their order, checks them, and publishes everything under root.

    config: resolutions (of the canonical table), layers (name to parameters) and version; polygons: shapes (iso, name, shape) or rectangles.  A run of the
    same inputs (feeds with their names, polygons, `where`), configuration and code (this package's, unless a hash is given) that is published is not done
    again.  `where` restricts the facilities, as a calibration does, whose report has the same counts without being published.  A run that publishes tells its
    progress in events (terracell.streaming.progress): stages as they begin and end, one each `beat` seconds in between, and how it ended."""
    inputs, text, code = content_hash(spark, feeds, polygons), text_of(config | ({} if where is None else {"where": str(where)})), code or code_hash(config)
    name = run_id(inputs, hashlib.sha256(text.encode()).hexdigest(), code)
    folder = files.hadoop_path(spark, f"{root}/runs/{name}")
    if publish and folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return {"run_id": name, "published": True, "again": True}
    log = progress.Log(spark, root, name, beat) if publish else None
    try:
        out = _done(spark, name, feeds, config, root, polygons, _told(log, note), publish, where, {"run_id": name, "inputs_hash": inputs, "config": config, "code_hash": code})
        if log:
            log.event(progress.WHOLE, "complete")
        return out
    except Exception as e:
        if log:
            log.event(progress.WHOLE, "failed", note=type(e).__name__)
        raise
    finally:
        if log:
            log.close()


def _told(log: progress.Log | None, note: Callable[[str], None]) -> Callable[[str], None]:
    """`note`, which also ends the stage before in the log and begins the next; an empty name begins none."""
    stages: list[tuple[str, str | None]] = []

    def told(stage: str) -> None:
        if stage:
            note(stage)
        if log:
            if stages:
                log.event(stages[-1][0], "complete", layer_name=stages[-1][1])
            if stage:
                own = stage.removeprefix("layer ") if stage.startswith("layer ") else None
                stages.append((f"layer:{own}" if own else stage, own))
                log.event(stages[-1][0], "in_progress", layer_name=own)

    return told


def _done(spark: SparkSession, name: str, feeds: dict[str, str], config: dict[str, Any], root: str, polygons: DataFrame | None, note: Callable[[str], None], publish: bool, where: Column | None, manifest: dict[str, Any]) -> dict[str, Any]:
    """The work of run()."""
    note("ingest")
    began = time.time()
    records = cut(files.records(spark, feeds))
    facilities = ingest.facilities(records, tuple(config["resolutions"]))
    facilities = cut(facilities if where is None else facilities.where(where))
    ingested = time.time() - began
    found, spent = computed(facilities, config, polygons, note)
    spent["ingest"] = ingested
    note("checks")
    bad = {r.check: r.violations for r in violations(facilities, found, config).where("violations > 0").collect()}
    counts = {r.source_name: r["count"] for r in facilities.groupBy("source_name").count().collect()}  # a row for each feed
    metrics = {"facilities": sum(counts.values()), "facilities_by_source": counts, "invalid_rows": records.where("not valid").count(), "stage_seconds": spent, "violations": bad, "cells": {k: c.count() for k, (c, _) in found.items()}}
    out = {"run_id": name, "metrics": metrics, "metadata": {k: m for k, (_, m) in found.items()}, "published": False}
    if publish:
        note("publish")
        tables = {"canonical/facilities": facilities, "canonical/organizations": ingest.organizations(facilities)} | {f"layers/{k}": c.orderBy(*(["cluster_anchor", "cell"] if "cluster_anchor" in c.columns else ["resolution", "cell"])) for k, (c, _) in found.items()}
        reports = {"manifest.json": manifest, "metrics.json": metrics, **{f"layers/{k}.json": m for k, (_, m) in found.items()}}
        files.publish(spark, tables, root, name, {k: text_of(v) for k, v in reports.items()})
        out["published"] = True
    note("")
    return out


def calibrate(spark: SparkSession, feeds: dict[str, str], config: dict[str, Any], root: str, country: str, polygons: DataFrame | None = None) -> dict[str, Any]:
    """A run over one country's facilities, as a report: counts and seconds for the runtime estimate. Nothing is published but the report."""
    began = time.time()
    own = polygons.where(F.col("iso").cast("string") == country) if polygons is not None else None
    out = run(spark, feeds, config, root, own, publish=False, where=F.col("country_label") == country)
    found = out["metadata"].get("facility_density_adaptive", {})
    report = {"country": country, "facilities": out["metrics"]["facilities"], "domain_cell_count": out["metrics"]["cells"].get("country_mask", 0), "adaptive_leaf_count": out["metrics"]["cells"].get("facility_density_adaptive", 0)}
    report |= {"smoothing_iterations": found.get("smoothing_iterations", 0), "adjacency_checks": found.get("adjacency_checks", 0), "violations": out["metrics"]["violations"], "runtime_seconds": time.time() - began}
    files.write_text(spark, f"{root}/calibration/{time.strftime('%Y%m%dT%H%M%S')}-{country}/report.json", text_of(report))
    return report


def catalog(spark: SparkSession, root: str, limit: int = 50) -> list[dict[str, Any]]:
    """run_id and time of the published runs, the newest first."""
    folder = files.hadoop_path(spark, f"{root}/runs")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    rows = [{"run_id": s.getPath().getName(), "modified": s.getModificationTime()} for s in fs.listStatus(folder) if s.isDirectory()]
    return sorted(rows, key=lambda r: (-r["modified"], r["run_id"]))[: max(1, min(limit, 200))]


def metadata(spark: SparkSession, root: str, run: str, layer_name: str | None = None) -> list[dict[str, Any]]:
    """Metadata of a run's layers, or of one; an error if it has none."""
    path = f"{root}/runs/{run}/layers/{layer_name or '*'}.json"
    found = [json.loads(r.value) for r in spark.read.text(path, wholetext=True).collect()]  # a few layers
    return sorted(found, key=lambda m: m["layer_name"])


def adjacency_health(found: dict[str, Any] | None) -> dict[str, Any]:
    """From a partition's metadata: whether its neighbours keep the rule; unknown where it doesn't say."""
    checks, bad = ((found or {}).get(k) for k in ("adjacency_checks", "violating_neighbor_pairs"))
    status = "unknown" if checks is None and bad is None else "violations_detected" if bad else "ok"
    return {"status": status, "adjacency_checks": checks, "adjacency_violations": bad, "max_neighbor_delta_observed": (found or {}).get("max_neighbor_delta_observed"), "violation_rate": bad / checks if checks and bad is not None else None}


def _json(spark: SparkSession, path: str) -> Any:
    """The content of one small file, or None where there is none."""
    place = files.hadoop_path(spark, path)
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def status(spark: SparkSession, root: str, run: str, now: Any, stale_s: float = 300.0) -> dict[str, Any]:
    """A run's metrics, the partition's parameters and health, whether `latest` points at it, and its last progress; a run that nothing is known of is an error."""
    folder = f"{root}/runs/{run}"
    last = progress.last_states(progress.events(spark, root).where(F.col("run_id") == run), now, stale_s).first()
    metrics, found = _json(spark, f"{folder}/metrics.json"), _json(spark, f"{folder}/layers/facility_density_adaptive.json")
    if metrics is None and last is None:
        raise LookupError(f"no run {run}")
    pointer = files.hadoop_path(spark, f"{root}/latest")
    is_latest = pointer.getFileSystem(spark._jsc.hadoopConfiguration()).exists(pointer) and files.latest(spark, root) == folder
    policy = {"layer_version": (found or {}).get("layer_version"), "params": (found or {}).get("params"), "adjacency_health": adjacency_health(found)}
    return {"run_id": run, "latest": is_latest, "published": metrics is not None, "metrics": metrics or {}, "adaptive_policy": policy, "progress": last.asDict() if last else None}


def active(spark: SparkSession, root: str, now: Any, stale_s: float = 300.0) -> DataFrame:
    """Runs that haven't ended, the last heard of first, each with whether it is stale."""
    return progress.last_states(progress.events(spark, root), now, stale_s).where("active").orderBy(F.desc("seen"), "run_id")


def latest_reports(spark: SparkSession, root: str) -> DataFrame:
    """Calibration reports, one a row, with their folder's name; the last one in order of name is the latest."""
    return spark.read.text(f"{root}/calibration/*/report.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/report\.json$", 1).alias("folder"), F.from_json("value", "country string, facilities long, domain_cell_count long, adaptive_leaf_count long, smoothing_iterations long, adjacency_checks long, runtime_seconds double").alias("r")).select("folder", "r.*")
