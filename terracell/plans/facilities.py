"""Ingest queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.operators import ingest
from terracell.sources.derived import facilities, facility_raw, table

LAT = "((c_nationkey::BIGINT * 37 % 120 - 60) + (c_custkey * 7919 % 2000) / 100.0::DOUBLE - 10)"
LON = "((c_nationkey::BIGINT * 53 % 340 - 170) + (c_custkey * 104729 % 2000) / 100.0::DOUBLE - 10)"
RAW = f"""raw AS (SELECT c_custkey AS row_id, c_mktsegment AS org_name,
 CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE trim(c_name) END AS node_name,
 CASE WHEN c_custkey % 13 = 0 THEN 95.5 ELSE {LAT} END AS lat,
 CASE WHEN c_custkey % 23 = 0 OR c_custkey % 29 = 0 THEN NULL ELSE {LON} END AS lon,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'City ' || (c_custkey % 10) END AS city_label, NULL::VARCHAR AS state_label, c_nationkey::VARCHAR AS country_label,
 CASE WHEN c_custkey % 19 = 0 THEN 'feed' ELSE 'customers' END AS source_name,
 CASE WHEN c_custkey % 2 = 0 THEN '2026-02-28' ELSE '2026-02-27' END AS asof_date FROM customer),
ok AS (SELECT * FROM raw WHERE node_name IS NOT NULL AND lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180)"""
IDS = RAW + """, ids AS (SELECT *, sha256(concat_ws('|', 'org', lower(org_name)))[1:16] AS org_id,
 sha256(concat_ws('|', 'facility', source_name, node_name, printf('%.8f', lat), printf('%.8f', lon), asof_date))[1:24] AS facility_id,
 sha256(concat_ws('|', org_name, node_name, printf('%.8f', lat), printf('%.8f', lon), coalesce(city_label, ''), '', country_label, source_name, asof_date)) AS record_hash FROM ok)"""


def _quad(res: int) -> str:
    n = 1 << res
    return f"({res}::BIGINT * {1 << 50} + least(floor((lon + 180.0) / 360.0 * {n}), {n - 1})::BIGINT * {1 << 25} + least(floor((lat + 90.0) / 180.0 * {n}), {n - 1})::BIGINT)"


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.canonical(facility_raw(spark, sf_dir), "feed", ("row_id",))


def ingest_clean_facilities(spark, sf_dir):
    return records(spark, sf_dir).where("valid").drop("valid")


def ingest_invalid_counts(spark, sf_dir):
    return records(spark, sf_dir).groupBy("source_name").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_invalid"))


def identified(spark, sf_dir):
    return ingest.identified(records(spark, sf_dir).where("valid"))


def facility_ids(spark, sf_dir):
    return identified(spark, sf_dir).select("row_id", "facility_id", "org_id", "record_hash")


def facility_dedup(spark, sf_dir):
    """Some facilities come twice, with another country: another hash of the record."""
    again = facility_raw(spark, sf_dir).where("row_id % 3 = 0").withColumn("COUNTRY", F.lit("elsewhere"))
    rows = identified(spark, sf_dir).union(ingest.identified(ingest.canonical(again, "feed", ("row_id",)).where("valid")))
    return ingest.deduplicated(rows).select("facility_id", "record_hash", "org_id", "node_name", "country_label")


def canonical_facilities(spark, sf_dir):
    return ingest.facilities(records(spark, sf_dir), (4, 7, 4))


def organizations(spark, sf_dir):
    return ingest.organizations(identified(spark, sf_dir))


def peering_adapter(spark, sf_dir):
    raw = table(spark, sf_dir, "supplier").selectExpr("s_name as name", "cast(s_suppkey as string) as org_id", "case when s_suppkey % 3 = 0 then 'NULL' else concat('Org ', s_nationkey) end as org_name", "'1.5' as latitude", "'2.5' as longitude", "case when s_suppkey % 4 = 0 then '' else '2025-09-26 22:42:05' end as updated", "'2024-01-02T00:00' as created")
    return ingest.peering(raw)


def landing_adapter(spark, sf_dir):
    raw = table(spark, sf_dir, "nation").selectExpr("case when n_nationkey % 4 = 0 then ' ' else n_name end as city_name", "case when n_nationkey % 8 = 0 then null else concat('std ', n_name) end as standard_city", "'1.38' as latitude", "'103.9' as longitude", "'2022-09-14 extra' as asof_date", "' SG' as country")
    return ingest.landing(raw)


def source_union(spark, sf_dir):
    return facilities(spark, sf_dir).groupBy("source", "org").agg(F.count(F.lit(1)).alias("n"), F.max("lat").alias("north"))


SQL = {
    "ingest_clean_facilities": f"WITH {RAW} SELECT row_id, org_name, node_name, lat, lon, city_label, state_label, country_label, source_name, asof_date FROM ok",
    "ingest_invalid_counts": f"WITH {RAW} SELECT source_name, count(*) FILTER (WHERE row_id IN (SELECT row_id FROM ok)) AS n_valid, count(*) FILTER (WHERE row_id NOT IN (SELECT row_id FROM ok)) AS n_invalid FROM raw GROUP BY 1",
    "facility_ids": f"WITH {IDS} SELECT row_id, facility_id, org_id, record_hash FROM ids",
    "facility_dedup": f"""WITH {IDS}, both_ AS (SELECT facility_id, record_hash, org_id, node_name, country_label FROM ids
 UNION ALL SELECT facility_id, sha256(concat_ws('|', org_name, node_name, printf('%.8f', lat), printf('%.8f', lon), coalesce(city_label, ''), '', 'elsewhere', source_name, asof_date)), org_id, node_name, 'elsewhere' FROM ids WHERE row_id % 3 = 0)
 SELECT facility_id, record_hash, org_id, node_name, country_label FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY record_hash) AS k FROM both_) WHERE k = 1""",
    "canonical_facilities": f"""WITH {IDS} SELECT facility_id, org_id, org_name, node_name AS source_facility_name, lat, lon, city_label, state_label, country_label, source_name, asof_date, 'deterministic' AS ingest_timestamp,
 record_hash, 'exact_point' AS location_confidence, NULL::VARCHAR AS notes, {_quad(4)} AS cell_r4, {_quad(7)} AS cell_r7 FROM (SELECT *, row_number() OVER (PARTITION BY facility_id ORDER BY record_hash) AS k FROM ids) WHERE k = 1""",
    "organizations": f"WITH {IDS} SELECT DISTINCT org_id, org_name FROM ids",
    "peering_adapter": """SELECT CASE WHEN s_suppkey % 3 = 0 THEN 'org_' || s_suppkey ELSE 'Org ' || s_nationkey END AS ORGANIZATION, s_name AS NODE_NAME, '1.5' AS LATITUDE, '2.5' AS LONGITUDE,
 CASE WHEN s_suppkey % 4 = 0 THEN '2024-01-02' ELSE '2025-09-26' END AS ASOF_DATE, NULL::VARCHAR AS CITY, NULL::VARCHAR AS STATE, NULL::VARCHAR AS COUNTRY, NULL::VARCHAR AS SOURCE FROM supplier""",
    "landing_adapter": """SELECT 'landing_points' AS ORGANIZATION, CASE WHEN n_nationkey % 8 = 0 THEN 'landing_point' WHEN n_nationkey % 4 = 0 THEN 'std ' || n_name ELSE n_name END AS NODE_NAME,
 '1.38' AS LATITUDE, '103.9' AS LONGITUDE, '2022-09-14' AS ASOF_DATE, CASE WHEN n_nationkey % 8 <> 0 THEN 'std ' || n_name END AS CITY, NULL::VARCHAR AS STATE, 'SG' AS COUNTRY, NULL::VARCHAR AS SOURCE FROM nation""",
}
PLACES = f"""places AS (SELECT c_custkey AS id, {LAT} AS lat, {LON} AS lon, c_mktsegment AS org, c_nationkey AS country, 'customers' AS source FROM customer
 UNION ALL SELECT s_suppkey + 1000000000, {LAT.replace("c_nationkey", "s_nationkey").replace("c_custkey", "s_suppkey")}, {LON.replace("c_nationkey", "s_nationkey").replace("c_custkey", "s_suppkey")}, 'SUPPLY', s_nationkey, 'suppliers' FROM supplier)"""
SQL["source_union"] = f"WITH {PLACES} SELECT source, org, count(*) AS n, max(lat) AS north FROM places GROUP BY ALL"
QUERIES = [ingest_clean_facilities, ingest_invalid_counts, facility_ids, facility_dedup, canonical_facilities, organizations, peering_adapter, landing_adapter, source_union]
