"""Queries over the driver's tables, one for each implemented operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from terracell.plans import cells, facilities, graphs, maps, network, roads, service, surface

TOPICS = (facilities, cells, roads, network, graphs, service, surface, maps)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for topic in TOPICS for f in topic.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {name: sql for topic in TOPICS for name, sql in topic.SQL.items()}
