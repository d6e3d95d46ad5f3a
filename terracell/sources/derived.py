"""Facilities, polygons and roads derived from the driver's tables, which have no coordinates: integer arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lat(nation: str, key: str):
    return F.expr(f"(cast({nation} as bigint) * 37 % 120 - 60) + ({key} * 7919 % 2000) / 100.0D - 10")


def _lon(nation: str, key: str):
    return F.expr(f"(cast({nation} as bigint) * 53 % 340 - 170) + ({key} * 104729 % 2000) / 100.0D - 10")


def facility_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text columns of a canonical feed, with dirty values by key."""
    rows = table(spark, sf_dir, "customer").withColumns({"lat": _lat("c_nationkey", "c_custkey"), "lon": _lon("c_nationkey", "c_custkey")})
    return rows.selectExpr(
        "c_custkey as row_id",
        "c_mktsegment as ORGANIZATION",
        "case when c_custkey % 17 = 0 then ' NULL ' when c_custkey % 11 = 0 then concat('  ', c_name, '\\t') else c_name end as NODE_NAME",
        "case when c_custkey % 13 = 0 then '95.5' else cast(lat as string) end as LATITUDE",
        "case when c_custkey % 23 = 0 then 'abc' when c_custkey % 29 = 0 then '12d' else cast(lon as string) end as LONGITUDE",
        "case when c_custkey % 5 = 0 then 'NULL' else concat('City ', c_custkey % 10) end as CITY",
        "'' as STATE",
        "concat(' ', c_nationkey, ' ') as COUNTRY",
        "case when c_custkey % 19 = 0 then '' else 'customers' end as SOURCE",
        "case when c_custkey % 2 = 0 then '2026-02-28' else '2026-02-27' end as ASOF_DATE",
    )


def facilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon, org, country (nation key) of customers and suppliers, without dirty values."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), _lat("c_nationkey", "c_custkey").alias("lat"), _lon("c_nationkey", "c_custkey").alias("lon"), F.col("c_mktsegment").alias("org"), F.col("c_nationkey").alias("country"), F.lit("customers").alias("source"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("id"), _lat("s_nationkey", "s_suppkey").alias("lat"), _lon("s_nationkey", "s_suppkey").alias("lon"), F.lit("SUPPLY").alias("org"), F.col("s_nationkey").alias("country"), F.lit("suppliers").alias("source"))
    return c.unionByName(s)


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """iso, name and rectangle (west, south, east, north) of each nation, 20 degrees each way."""
    return table(spark, sf_dir, "nation").selectExpr("n_nationkey as iso", "n_name as name", "(n_nationkey * 53 % 340 - 170) - 10.0D as west", "(n_nationkey * 37 % 120 - 60) - 10.0D as south", "(n_nationkey * 53 % 340 - 170) + 10.0D as east", "(n_nationkey * 37 % 120 - 60) + 10.0D as north")


def road_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr("p_partkey as node_id", "(p_partkey * 7919 % 12000) / 100.0D - 60 as lat", "(p_partkey * 104729 % 34000) / 100.0D - 170 as lon")


def road_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u, v, road_class: chains of keys in blocks of 17, and chords."""
    p = table(spark, sf_dir, "part").selectExpr("p_partkey as k")
    top = p.agg(F.max("k").alias("top"))  # one row
    kind = "element_at(array('motorway', 'trunk', 'primary', 'secondary', 'motorway_link', 'tertiary', 'trunk_link', 'residential'), cast(floor(k / 5) % 8 as int) + 1)"
    chain = p.where("k % 17 <> 0").selectExpr("k as u", "k + 1 as v", f"{kind} as road_class")
    chord = p.where("k % 29 = 0").selectExpr("k as u", "k + 13 as v", f"{kind} as road_class")
    return chain.union(chord).join(F.broadcast(top)).where("v <= top").drop("top")
