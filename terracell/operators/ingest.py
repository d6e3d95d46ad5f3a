"""Feed adapters, validity, ids and deduplication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terracell.functions import quad
from terracell.functions.text import asof_date, clean, facility_id, in_range, number, org_id, stable_hash


LABELS = {"CITY": "city_label", "STATE": "state_label", "COUNTRY": "country_label"}


def _known(raw: DataFrame, name: str) -> Column:
    """A column of a feed, cleaned, or null where the feed has none."""
    return clean(F.col(name)) if name in raw.columns else F.lit(None).cast("string")


def canonical(raw: DataFrame, source_name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Typed records of a canonical feed; a blank or missing source takes the feed's name, city, state and country may be missing. `valid` is false for rows to be
    dropped; columns to `keep` stay as they are."""
    rows = raw.select(
        *keep,
        clean(F.col("ORGANIZATION")).alias("org_name"),
        clean(F.col("NODE_NAME")).alias("node_name"),
        number(F.col("LATITUDE")).alias("lat"),
        number(F.col("LONGITUDE")).alias("lon"),
        *[_known(raw, c).alias(label) for c, label in LABELS.items()],
        F.coalesce(_known(raw, "SOURCE"), F.lit(source_name)).alias("source_name"),
        clean(F.col("ASOF_DATE")).alias("asof_date"),
    )
    whole = F.col("org_name").isNotNull() & F.col("node_name").isNotNull() & F.col("source_name").isNotNull() & F.col("asof_date").isNotNull()
    return rows.withColumn("valid", whole & in_range(F.col("lat"), F.col("lon")))


def peering(raw: DataFrame) -> DataFrame:
    """Adapter of feeds with name, org_id, latitude, longitude, updated (org_name, created, source, city, state and country if they are there): missing names of
    organizations derive from their id."""
    org = F.coalesce(_known(raw, "org_name"), F.concat(F.lit("org_"), clean(F.col("org_id"))))
    asof = F.coalesce(asof_date(F.col("updated")), asof_date(F.col("created")) if "created" in raw.columns else F.lit(None))
    return raw.select(org.alias("ORGANIZATION"), F.col("name").alias("NODE_NAME"), F.col("latitude").alias("LATITUDE"), F.col("longitude").alias("LONGITUDE"), *[_known(raw, c.lower()).alias(c) for c in LABELS], _known(raw, "source").alias("SOURCE"), asof.alias("ASOF_DATE"))


def landing(raw: DataFrame) -> DataFrame:
    """Adapter of landing points: the place as it was given, standard names where they are there."""
    node = F.coalesce(clean(F.col("city_name")), _known(raw, "standard_city"), F.lit("landing_point"))
    label = lambda own, standard: F.coalesce(_known(raw, standard), _known(raw, own))
    labels = [label("city_name", "standard_city").alias("CITY"), label("state_province", "standard_state").alias("STATE"), label("country", "standard_country").alias("COUNTRY")]
    return raw.select(F.lit("landing_points").alias("ORGANIZATION"), node.alias("NODE_NAME"), F.col("latitude").alias("LATITUDE"), F.col("longitude").alias("LONGITUDE"), *labels, _known(raw, "source").alias("SOURCE"), asof_date(F.col("asof_date")).alias("ASOF_DATE"))


def identified(records: DataFrame) -> DataFrame:
    """With facility_id, org_id and record_hash."""
    fixed = [F.format_string("%.8f", F.col(c)) for c in ("lat", "lon")]
    return records.withColumns({
        "org_id": org_id(F.col("org_name")),
        "facility_id": facility_id(F.col("source_name"), F.col("node_name"), F.col("lat"), F.col("lon"), F.col("asof_date")),
        "record_hash": stable_hash(F.col("org_name"), F.col("node_name"), *fixed, *map(F.col, LABELS.values()), F.col("source_name"), F.col("asof_date")),
    })


def deduplicated(records: DataFrame) -> DataFrame:
    """The record of least hash of each facility, in one aggregation with partial sums."""
    others = [c for c in records.columns if c not in ("facility_id", "record_hash")]
    best = records.groupBy("facility_id").agg(F.min_by(F.struct("record_hash", *others), F.struct("record_hash", *others)).alias("r"))
    return best.select("facility_id", "r.*")


def facilities(records: DataFrame, resolutions: tuple[int, ...]) -> DataFrame:
    """The canonical table of valid records: one row for each facility, its cell at each resolution."""
    rows = deduplicated(identified(records.where("valid").drop("valid")))
    cells = [quad.cell(F.col("lat"), F.col("lon"), r).alias(f"cell_r{r}") for r in sorted(set(resolutions))]
    fixed = [F.lit("deterministic").alias("ingest_timestamp"), "record_hash", F.lit("exact_point").alias("location_confidence"), F.lit(None).cast("string").alias("notes")]
    return rows.select("facility_id", "org_id", "org_name", F.col("node_name").alias("source_facility_name"), "lat", "lon", *LABELS.values(), "source_name", "asof_date", *fixed, *cells)


def organizations(records: DataFrame) -> DataFrame:
    return records.select("org_id", "org_name").distinct()
