"""Text cleaning, guarded numbers and content hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a decimal number looks like in the feeds; casts alone accept suffixes such as 12d.
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def clean(x: Column) -> Column:
    """Without white space at both ends; null for empty texts and NULL in any case."""
    x = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.when(F.upper(x).isin("", "NULL"), F.lit(None)).otherwise(x)


def asof_date(x: Column) -> Column:
    return F.substring(clean(x), 1, 10)


def number(x: Column) -> Column:
    """The number that a text holds, white space of any kind around it or not; null otherwise."""
    x = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def in_range(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def stable_hash(*parts: Column) -> Column:
    """sha256 of the parts joined by bars; nulls count as empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


def org_id(name: Column) -> Column:
    return F.substring(stable_hash(F.lit("org"), F.lower(F.trim(name))), 1, 16)


def facility_id(source: Column, node: Column, lat: Column, lon: Column, asof: Column) -> Column:
    """Coordinates of up to 8 decimals; beyond that the engine's rounding of halves would show."""
    return F.substring(stable_hash(F.lit("facility"), source, node, F.format_string("%.8f", lat), F.format_string("%.8f", lon), asof), 1, 24)
