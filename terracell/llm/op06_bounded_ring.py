"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

Each shard has `virtual` points on the ring of 64-bit hashes; a key (id, size, crc) belongs to the first point clockwise of its own hash.  A shard takes keys,
in ring order, until it holds its bound; keys beyond it continue clockwise to the next point whose shard has room.  With `slack` 0 the
bounds are exactly N // shards, one more for the first N % shards shards, so counts differ by one at most; with slack e they are
ceil((1 + e) * N / shards).

Only counts of ring segments (a fixed number) reach the driver, which lays out which stretch of which segment goes to which shard.  Rows of
equal key (id, size, crc) are counted together before anything is shuffled by key, and expanded again at the end, so repeats are no
hot spot.  Null ids are a key like any other; null texts have size 1 and crc 0; ties are broken by id, size and crc; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import math

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RING_BITS = 12
SEGMENTS = 1 << RING_BITS
#: Copies of one row in one array.
BLOCK = 4096


def ring(shards: int, virtual: int) -> list[tuple[int, int]]:
    """(segment, shard) of all points, in ring order; a point stands at a segment's end. A shard's points don't depend on the others."""
    points = sorted((xxhash.xxh64_intdigest(f"shard {s} point {v}"), s) for s in range(shards) for v in range(virtual))
    return [(h >> (64 - RING_BITS), s) for h, s in points]


def layout(counts: dict[int, int], shards: int, virtual: int, slack: float) -> list[tuple[int, int, int, int, int]]:
    """(segment, from rank, to rank, shard, slot of the first) for counts of keys by segment."""
    points = ring(shards, virtual)
    places, total = [p for p, _ in points], sum(counts.values())
    bound = [total // shards + (s < total % shards) if slack == 0 else math.ceil((1 + slack) * total / shards) for s in range(shards)]
    held, out = [0] * shards, []
    for segment in sorted(counts):
        rank, at = 0, bisect.bisect_left(places, segment)
        while rank < counts[segment]:
            shard = points[at % len(points)][1]
            if n := min(counts[segment] - rank, bound[shard] - held[shard]):
                out.append((segment, rank, rank + n, shard, held[shard]))
                rank, held[shard] = rank + n, held[shard] + n
            at += 1
    return out


def assign(docs: DataFrame, shards: int = 8, virtual: int = 128, slack: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless from 0 within a shard) of every row."""
    spark = docs.sparkSession
    data = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(data) + F.lit(1)).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    keys = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    keys = keys.withColumn("hash", F.xxhash64("doc_id", "size", "text_crc32")).withColumn("segment", F.shiftrightunsigned("hash", 64 - RING_BITS).cast("int"))
    counts = {r[0]: r[1] for r in keys.groupBy("segment").agg(F.sum("copies")).collect()}  # at most SEGMENTS rows
    plan = spark.createDataFrame(layout(counts, shards, virtual, slack), "plan_segment int, low long, high long, shard int, first_slot long")
    order = Window.partitionBy("segment").orderBy("hash", F.col("doc_id").asc_nulls_first(), "size", "text_crc32")
    ranked = keys.withColumn("upto", F.sum("copies").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("rank", F.col("upto") - F.col("copies"))
    # a plan has a row for each segment and a few for borders: at most 2 * SEGMENTS + points
    met = (F.col("segment") == F.col("plan_segment")) & (F.col("rank") < F.col("high")) & (F.col("upto") > F.col("low"))
    parts = ranked.join(F.broadcast(plan), met)
    low, high = F.greatest("rank", "low"), F.least("upto", "high")
    first, last = F.col("first_slot") + low - F.col("low"), F.col("first_slot") + high - F.col("low") - F.lit(1)
    # copies of a row are expanded in blocks, so no array is long
    blocks = parts.withColumns({"to": last}).select("doc_id", "size", "text_crc32", "shard", "to", F.explode(F.sequence(first, last, F.lit(BLOCK).cast("long"))).alias("from"))
    return blocks.select("doc_id", "size", "text_crc32", "shard", F.explode(F.sequence("from", F.least(F.col("to"), F.col("from") + F.lit(BLOCK - 1)))).alias("slot"))
