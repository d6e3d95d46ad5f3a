"""Serving queries (filters, tiles, routes, run metrics) and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from terracell.functions.geo import tile_bounds
from terracell.operators.serving import LIMITS
from terracell.plans.facilities import PLACES
from terracell.sources.derived import facilities, polygons, table
from terracell.streaming import progress

MOST_REGIONS = 5000
WEST, SOUTH, EAST, NORTH = tile_bounds(2, 1, 1)


def facilities_filter(spark, sf_dir):
    """Equality filters, least ids first: a limited listing."""
    return facilities(spark, sf_dir).where("org = 'BUILDING' and country < 12").select("id", "org", "country").orderBy("id").limit(10_000)


def tile_features(spark, sf_dir):
    inside = F.col("lon").between(WEST, EAST) & F.col("lat").between(SOUTH, NORTH)
    x, y = (F.col("lon") - WEST) / (EAST - WEST) * 4096, (F.col("lat") - SOUTH) / (NORTH - SOUTH) * 4096
    return facilities(spark, sf_dir).where(inside).select("id", F.round(x).cast("int").alias("px"), F.round(y).cast("int").alias("py"))


def places_by_country(spark, sf_dir):
    """The places by country and id, up to the largest listing."""
    return facilities(spark, sf_dir).select("country", "id").orderBy("country", "id").limit(LIMITS["places"][1])


def route_pairs(spark, sf_dir):
    """Ordered pairs of different polygons: all pairs are the result, so regions are few; more than MOST_REGIONS are refused."""
    p = polygons(spark, sf_dir)
    if p.limit(MOST_REGIONS + 1).count() > MOST_REGIONS:
        raise ValueError(f"more than {MOST_REGIONS} regions")
    a, b = p.select(F.col("iso").alias("a"), F.col("west").alias("x"), F.col("south").alias("y")), p.select(F.col("iso").alias("b"), F.col("west").alias("z"), F.col("south").alias("w"))
    return a.join(F.broadcast(b), F.col("a") != F.col("b")).select("a", "b", (F.abs(F.col("x") - F.col("z")) + F.abs(F.col("y") - F.col("w"))).alias("distance"))


def route_dedup(spark, sf_dir):
    rows = route_pairs(spark, sf_dir).withColumn("distance", F.when((F.col("a") + F.col("b")) % 7 == 0, F.lit(None)).otherwise(F.col("distance") + F.col("a")))
    best = rows.withColumn("start", F.col("a")).groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    won = F.min_by(F.struct("start", "distance"), F.struct(F.coalesce("distance", F.lit(1e18)), "start")).alias("won")
    best = best.agg(won, F.count(F.lit(1)).alias("routes"), F.count_if(F.col("distance").isNull()).alias("missing"))
    return best.select("a", "b", F.col("won.start").alias("start"), F.col("won.distance").alias("distance"), "routes", "missing")


def run_metrics(spark, sf_dir):
    return facilities(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("facilities"), F.count_distinct("country").alias("countries"))


def latest_event(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("l")).select("user_id", F.col("l.event_id").alias("event_id"), F.col("l.event_type").alias("event_type"))


STALE_S = 86_400


def run_states(spark, sf_dir):
    """Users stand for runs and their events for progress: each one's last state at the time of the newest event."""
    kind = F.col("event_type")
    e = table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").cast("string").alias("run_id"), F.when(kind == "purchase", progress.WHOLE).otherwise(kind).alias("stage"), F.when(kind == "purchase", "complete").otherwise("in_progress").alias("status"), F.lit(None).cast("double").alias("elapsed_s"), F.lit(None).cast("string").alias("note"), F.lit(None).cast("string").alias("layer_name"), F.col("event_id").alias("seq"))
    newest = F.lit(e.agg(F.unix_micros(F.max("ts"))).first()[0]).cast("long")
    return progress.last_states(e, F.timestamp_micros(newest), STALE_S).select("run_id", "stage", "status", (newest - F.unix_micros("seen")).alias("silent_us"), "active", "stale", "events")


def runtime_estimate(spark, sf_dir):
    """Median seconds for each point of complexity, and its band, of each kind of run (events stand for runs)."""
    e = table(spark, sf_dir, "events").where("value is not null")
    rows = e.select("event_type", (F.col("value") / (F.col("user_id") % 5 + 1)).alias("rate"))
    found = rows.groupBy("event_type").agg(F.median("rate").alias("m"), F.count(F.lit(1)).alias("n"))
    band = F.when(F.col("n") == 1, 0.4).when(F.col("n") < 3, 0.3).otherwise(0.2)
    return found.select("event_type", F.round("m", 6).alias("seconds"), band.alias("band"))


SQL = {
    "facilities_filter": f"WITH {PLACES} SELECT id, org, country FROM places WHERE org = 'BUILDING' AND country < 12 ORDER BY id LIMIT 10000",
    "tile_features": f"WITH {PLACES} SELECT id, round((lon - {WEST!r}::DOUBLE) / {EAST - WEST!r}::DOUBLE * 4096)::INT AS px, round((lat - ({SOUTH!r}::DOUBLE)) / {NORTH - SOUTH!r}::DOUBLE * 4096)::INT AS py FROM places WHERE lon BETWEEN {WEST!r} AND {EAST!r} AND lat BETWEEN {SOUTH!r}::DOUBLE AND {NORTH!r}::DOUBLE",
    "places_by_country": f"WITH {PLACES} SELECT country, id FROM places ORDER BY country, id LIMIT 50000",
    "route_pairs": "SELECT a.n_nationkey AS a, b.n_nationkey AS b, (abs(a.n_nationkey * 53 % 340 - b.n_nationkey * 53 % 340) + abs(a.n_nationkey * 37 % 120 - b.n_nationkey * 37 % 120))::DOUBLE AS distance FROM nation a, nation b WHERE a.n_nationkey <> b.n_nationkey",
    "run_metrics": f"WITH {PLACES} SELECT source, count(*) AS facilities, count(DISTINCT country) AS countries FROM places GROUP BY 1",
    "latest_event": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY 1",
    "run_states": f"""WITH l AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS kind, max(ts) AS seen, count(*) AS events FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events)
 SELECT user_id::VARCHAR AS run_id, CASE WHEN kind = 'purchase' THEN 'pipeline' ELSE kind END AS stage, CASE WHEN kind = 'purchase' THEN 'complete' ELSE 'in_progress' END AS status, epoch_us(now) - epoch_us(seen) AS silent_us, kind <> 'purchase' AS active, kind <> 'purchase' AND epoch_us(now) - epoch_us(seen) > {STALE_S}000000 AS stale, events FROM l, n""",
    "runtime_estimate": "SELECT event_type, round(median(value / (user_id % 5 + 1)), 6) AS seconds, (CASE WHEN count(*) = 1 THEN 0.4 WHEN count(*) < 3 THEN 0.3 ELSE 0.2 END)::DOUBLE AS band FROM events WHERE value IS NOT NULL GROUP BY 1",
}
SQL["route_dedup"] = f"SELECT least(a, b) AS a, greatest(a, b) AS b, arg_min(a, (CASE WHEN (a + b) % 7 = 0 THEN 1e18 ELSE distance + a END, a)) AS start, min(CASE WHEN (a + b) % 7 = 0 THEN NULL ELSE distance + a END) AS distance, count(*) AS routes, count(*) FILTER (WHERE (a + b) % 7 = 0) AS missing FROM ({SQL['route_pairs']}) GROUP BY 1, 2"
QUERIES = [facilities_filter, tile_features, places_by_country, route_pairs, route_dedup, run_metrics, latest_event, run_states, runtime_estimate]
