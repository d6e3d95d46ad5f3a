"""Large JSON files: the elements of one array of the top object, read by ranges of the file, whatever the file's size.

The text is read in pieces between commas, which the text source splits at any byte.  Whether a piece begins inside a string, and how deep, follows from all pieces before it: a
prefix scan, first over the pieces of a range, then over the ranges of a file (a row each).  Since a range's own count depends on the state it begins in, both cases are
counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE = ["file", "range"]
KEY = r'"((?:[^"\\]|\\.)*)"\s*:\s*'


def _depth(parts: Column, odd: int) -> Column:
    """Brackets opened less those closed, in every other part of a text that was split at its quotes."""
    own = F.array_join(F.filter(parts, lambda x, k: k % 2 == odd), "")
    return F.length(F.regexp_replace(own, r"[^\[{]", "")) - F.length(F.regexp_replace(own, r"[^\]}]", ""))


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, file_name, range, at (the order in a range), value, inside (begins in a string), start and end (how deep)."""
    text = spark.read.option("lineSep", ",").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_block_start").alias("range"), F.monotonically_increasing_id().alias("at"), "value")
    parts = F.split(F.regexp_replace("value", r"\\[\s\S]", ""), '"', -1)
    rows = rows.withColumn("parts", parts).select("file", "file_name", "range", "at", "value", (F.size("parts") - 1).alias("quotes"), _depth(F.col("parts"), 0).alias("out"), _depth(F.col("parts"), 1).alias("in"))
    before = Window.partitionBy(*RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    rows = rows.withColumn("odd", odd).withColumn("a", F.when(F.col("odd") == 0, F.col("out")).otherwise(F.col("in"))).withColumn("b", F.when(F.col("odd") == 0, F.col("in")).otherwise(F.col("out")))
    rows = rows.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in ("a", "b")})
    ranges = rows.groupBy(*RANGE).agg(F.sum("quotes").alias("quotes"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("state", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    ranges = ranges.withColumn("base", F.coalesce(F.sum(F.when(F.col("state") == 0, F.col("a")).otherwise(F.col("b"))).over(earlier), F.lit(0))).select(*RANGE, "state", "base")
    rows = rows.join(ranges, RANGE)
    own = lambda a, b: F.when(F.col("state") == 0, F.col(a)).otherwise(F.col(b))
    rows = rows.withColumn("start", F.col("base") + own("a_before", "b_before"))
    return rows.select(*RANGE, "file_name", "at", "value", ((F.col("state") + F.col("odd")) % 2 == 1).alias("inside"), "start", (F.col("start") + own("a", "b")).alias("end"))


def _fields(spark: SparkSession, path: str, field: str) -> DataFrame:
    """Pieces with `name` (the top object's field that they belong to; empty for names with a comma; null outside objects), `opens` (the wanted array begins) and `element` (a number that grows with the elements begun)."""
    rows = _pieces(spark, path)
    if "," in field:
        raise ValueError("a field with a comma in its name can't be asked for")
    head = F.when(~F.col("inside") & (F.col("start") == 0) & F.col("value").rlike(r"^\s*\{"), F.regexp_extract("value", rf"^\s*\{{\s*{KEY}", 1)).when(~F.col("inside") & (F.col("start") == 1), F.regexp_extract("value", rf"^\s*{KEY}", 1))
    array = F.col("value").rlike(rf"^\s*\{{?\s*{KEY}\[")
    rows = rows.withColumn("head", head).withColumn("opens", F.coalesce((F.col("head") == field) & array, F.lit(False)))
    rows = rows.withColumn("begins", (F.col("opens") | (~F.col("inside") & (F.col("start") == 2))).cast("long"))
    upto = Window.partitionBy(*RANGE).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("name", F.last("head", True).over(upto)).withColumn("element", F.sum("begins").over(upto))
    ranges = rows.groupBy(*RANGE).agg(F.max_by("name", "at").alias("last"), F.sum("begins").alias("n"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*RANGE, F.last("last", True).over(earlier).alias("carried"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    rows = rows.join(ranges, RANGE)
    return rows.withColumn("name", F.coalesce("name", "carried")).withColumn("element", F.col("first") + F.col("element"))


def elements(spark: SparkSession, path: str, field: str) -> DataFrame:
    """file (its path), file_name, element (grows with the place in the file), text: the JSON text of each element of the array `field` of each file's top object.

    Files without the field, empty ones and those that are no JSON object give no rows. An element is a row, so elements have to fit in memory, files don't. Bytes are UTF-8;
    keys are compared as written, without unfolding escapes; one with a comma can't be asked for. Of damaged files the elements before the damage come back as they are; what follows has no defined text."""
    rows = _fields(spark, path, field).where(F.col("name") == field)
    value = F.when(F.col("opens"), F.regexp_replace("value", rf"^\s*\{{?\s*{KEY}\[", "")).otherwise(F.col("value"))
    value = F.when(F.col("end") == 1, F.regexp_replace(value, r"\]\s*$", "")).when(F.col("end") <= 0, F.regexp_replace(value, r"\]\s*\}\s*$", "")).otherwise(value)
    rows = rows.where("opens or start >= 2").select("file", "file_name", "element", F.struct("range", "at", value.alias("value")).alias("p"))
    whole = rows.groupBy("file", "file_name", "element").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select("file", "file_name", "element", F.trim(F.array_join("p.value", ",")).alias("text")).where(~F.col("text").rlike(r"^\s*$"))


def header(spark: SparkSession, path: str, field: str) -> DataFrame:
    """file, text: the top object of each file without the array `field`, as JSON text; a row a file whose object has other fields, or none at all."""
    rows = _fields(spark, path, field).where(F.col("name") != field)
    value = F.when(F.col("end") <= 0, F.regexp_replace("value", r"\}\s*$", "")).otherwise(F.col("value"))
    value = F.when((F.col("start") == 0) & ~F.col("inside"), F.regexp_replace(value, r"^\s*\{", "")).otherwise(value)
    whole = rows.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("range", "at", value.alias("value")))).alias("p"))
    return whole.select("file", F.concat(F.lit("{"), F.array_join("p.value", ","), F.lit("}")).alias("text"))
