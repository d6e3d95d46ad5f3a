"""Streaming counterparts of the cell counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.functions import quad


def windowed_cells(points: DataFrame, res: int, time: str = "ts", window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """start, cell, n of a stream of points (lat, lon, time): state goes once a window is `late` behind the newest time. Works on tables as well."""
    rows = points.withWatermark(time, late).withColumn("cell", quad.cell(F.col("lat"), F.col("lon"), res))
    return rows.groupBy(F.window(time, window), "cell").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "cell", "n")


def first_seen(records: DataFrame, key: str = "facility_id", time: str = "ts", late: str = "1 day") -> DataFrame:
    """Records whose key was not seen within the watermark: a stream's deduplication, with bounded state."""
    return records.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
