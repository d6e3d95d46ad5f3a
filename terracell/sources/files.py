"""Files: delimited facility feeds, GeoJSON in and out, immutable published runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.operators import ingest
from terracell.sources import arrays

CANONICAL = {"ORGANIZATION", "NODE_NAME", "LATITUDE", "LONGITUDE", "SOURCE", "ASOF_DATE"}
PEERING = {"name", "org_id", "latitude", "longitude", "updated"}
LANDING = {"city_name", "country", "latitude", "longitude", "asof_date"}
FEATURE = "geometry string, properties map<string, string>"


def delimited(spark: SparkSession, path: str) -> DataFrame:
    """A feed as text columns: tabs in .tsv files, else commas; quoted fields may hold line ends."""
    sep = "\t" if path.lower().endswith(".tsv") else ","
    return spark.read.options(header=True, sep=sep, quote='"', escape='"', multiLine=True, encoding="UTF-8").csv(path)


def records(spark: SparkSession, feeds: dict[str, str]) -> DataFrame:
    """Typed records of all feeds (name: path), one after the other."""
    out = None
    for name, path in feeds.items():
        rows = ingest.canonical(feed(spark, path), name)
        out = rows if out is None else out.unionByName(rows)
    return out


def feed(spark: SparkSession, path: str) -> DataFrame:
    """A feed in the canonical columns, by its header: canonical, peering or landing points, in this order; any other header is an error."""
    rows = delimited(spark, path)
    have = set(rows.columns)
    if have >= CANONICAL:
        return rows
    if have >= PEERING:
        return ingest.peering(rows)
    if have >= LANDING:
        return ingest.landing(rows)
    raise ValueError(f"{path}: columns {sorted(CANONICAL - have)} are missing")


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """geometry (JSON), properties (map) of the features of collections; files that are no collection give no rows. Files are read by ranges, so a collection may be of any size."""
    rows = arrays.elements(spark, path, "features").select(F.from_json("text", FEATURE).alias("f"))
    return rows.where("f.geometry is not null").select("f.*")


def write_features(rows: DataFrame, path: str, lon: str, lat: str) -> None:
    """Point features, one JSON object a line, in parts; all other columns that aren't null are properties."""
    others = [c for c in rows.columns if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*others).alias("properties"))
    rows.select(F.to_json(feature).alias("value")).write.text(path)


def hadoop_path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, by the file system that holds it."""
    place = hadoop_path(spark, path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    out.write(bytearray(text.encode()))
    out.close()


def write_lines(rows: DataFrame, path: str, kind: str = "LineString") -> None:
    """A line feature for each row (edge_id, line, others), in order of id, one JSON object a line, in parts."""
    points = F.transform("line", lambda p: F.array(p["lon"], p["lat"]))
    others = [c for c in rows.columns if c != "line"]
    geometry = F.struct(F.lit(kind).alias("type"), points.alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*others).alias("properties"))
    rows.orderBy("edge_id").select(F.to_json(feature).alias("value")).write.text(path)


def write_nodes(rows: DataFrame, path: str) -> None:
    """A point feature for each row (node_id, lon, lat, others), in order of id, one JSON object a line, in parts."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*[c for c in rows.columns if c not in ("lon", "lat")]).alias("properties"))
    rows.orderBy("node_id").select(F.to_json(feature).alias("value")).write.text(path)


def publish(spark: SparkSession, tables: dict[str, DataFrame], root: str, run_id: str, texts: dict[str, str] | None = None) -> str:
    """Writes tables, and small texts by file name, to a staging folder, renames it to root/runs/run_id and then points root/latest at it.

    A published run is never written again: one that is there is an error. The folder is moved by the file system that holds it."""
    jvm = spark._jvm
    place = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    final, staged = place(f"runs/{run_id}"), place(f"staging/{run_id}")
    fs = final.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(final):
        raise FileExistsError(final.toString())
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{staged.toString()}/{name}")
    for name, text in (texts or {}).items():
        write_text(spark, f"{staged.toString()}/{name}", text)
    fs.mkdirs(final.getParent())
    if not fs.rename(staged, final):
        raise OSError(f"{staged.toString()} can't be moved")
    _point(spark, root, run_id)
    return final.toString()


def _point(spark: SparkSession, root: str, run_id: str) -> None:
    """Writes the pointer under a new name and renames it over the old one, so that a reader finds either."""
    import uuid

    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path("latest").toUri(), conf)
    fresh = path(f".latest-{uuid.uuid4().hex}")
    out = path("latest").getFileSystem(conf).create(fresh)
    out.write(bytearray(run_id.encode()))
    out.close()
    context.rename(fresh, path("latest"), _overwrite(spark))


def _overwrite(spark: SparkSession):
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    array = spark.sparkContext._gateway.new_array(rename, 1)
    array[0] = rename.OVERWRITE
    return array


def latest(spark: SparkSession, root: str) -> str:
    return f"{root}/runs/{spark.read.text(f'{root}/latest').first().value}"
