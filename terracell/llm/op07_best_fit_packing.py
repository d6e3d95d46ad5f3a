"""Variable-capacity best-fit packing of documents into training sequences.

Lengths are counted (a histogram of at most the largest capacity), and best-fit decreasing runs over the histogram: an item goes to the fullest
bin that still holds it; where none does, a bin is opened; at the end each bin shrinks to the smallest permitted size that holds its contents.
Which size is opened for items of which size class is optimised for all classes together: every policy (for each class one of the sizes
that hold it) is tried on the histogram in COARSE steps, those of least total cost after shrinking are tried on the exact one, and the best is
kept; so no list of fewer sizes does better by the same rule, but for what COARSE steps hide.  Equal bins are handled together, so the plan's
size depends on the number of lengths, not of documents.  Documents then find their places by their rank among those of their length.

A document's length is its UTF-8 bytes and one end unit (null text: the end unit alone), or a column given for it; one longer than the largest
capacity is cut into pieces of that size and a rest.  Rows that repeat an id are packed each; pieces of equal length take places in order of
rows; a frequent length is ranked in as many tasks as its count asks for, whatever the ids; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracell.llm.common import utf8, written

CAPACITIES = (2048, 4096, 8192, 16384, 32768)
#: Rows of one length that one task ranks, about.
SALTED = 1_000_000
#: Steps of the histogram on which policies are compared, and how many of the best are then compared on the exact one.
COARSE, FINAL = 256, 4


def sequence_cost(capacity: int) -> float:
    """Of one sequence: linear work, attention's square, and a fixed part."""
    return capacity * (1 + capacity / 131072) + 256


def policies(capacities: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each size class (the least capacity that holds an item), the capacity that is opened: all choices."""
    caps = sorted(capacities)
    return list(itertools.product(*[caps[i:] for i in range(len(caps))]))


def total_cost(bins: np.ndarray, cost=sequence_cost) -> float:
    return float(sum(n * cost(int(cap)) for _, cap, _, n in bins))


def plan(histogram: dict[int, int], capacities: tuple[int, ...] = CAPACITIES, cost=sequence_cost) -> tuple[np.ndarray, np.ndarray]:
    """Stretches (length, from rank, first bin, items in a bin, offset in it, to rank), and bins (first bin, capacity, content, how many), sorted: by the best policy."""
    step = max(1, max(capacities) // COARSE)
    rough: dict[int, int] = {}
    for length, n in histogram.items():
        rough[-(-length // step) * step] = rough.get(-(-length // step) * step, 0) + n
    order = sorted(policies(capacities), key=lambda p: (total_cost(planned(rough, capacities, p)[1], cost), p))
    return min((planned(histogram, capacities, p) for p in order[:FINAL]), key=lambda found: total_cost(found[1], cost))


def planned(histogram: dict[int, int], capacities: tuple[int, ...], policy: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The same by a given policy."""
    caps = sorted(capacities)
    open_: dict[int, list[tuple[int, int, int]]] = {}  # room -> (first bin, bins, capacity)
    rooms: list[int] = []
    stretches, bins = [], 0

    def put(room: int, group: tuple[int, int, int]) -> None:
        if group[1]:
            if room not in open_:
                open_[room] = []
                bisect.insort(rooms, room)
            open_[room].append(group)

    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while count:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                cap = policy[bisect.bisect_left(caps, length)]
                n = -(-count // (cap // length))
                put(cap, (bins, n, cap))
                bins += n
                continue
            room = rooms[at]
            first, n, cap = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = min(room // length, count)
            full = min(n, count // each)
            stretches.append((length, rank, first, each, cap - room, rank + full * each))
            put(room - each * length, (first, full, cap))
            put(room, (first + full, n - full, cap))
            rank, count = rank + full * each, count - full * each
    final = sorted((first, min(c for c in caps if c >= cap - room), cap - room, n) for room, groups in open_.items() for first, n, cap in groups)
    stretches.sort()
    return np.array(stretches, np.int64).reshape(-1, 6), np.array(final, np.int64).reshape(-1, 4)


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """doc_id, piece, n_units, bin, bin_offset, capacity of every piece of every row. length_col: units of each row, without the end unit."""
    spark, most = docs.sparkSession, max(capacities)
    units = F.coalesce(F.col(length_col), F.lit(0)) if length_col else F.octet_length(utf8(text_col))
    items = docs.select(F.col(id_col).cast("long").alias("doc_id"), (units + F.lit(1)).cast("long").alias("units"))
    items = items.withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("units") / most).cast("int") - 1)))
    items = items.select("doc_id", "piece", F.least(F.lit(most).cast("long"), F.col("units") - F.col("piece").cast("long") * most).alias("n_units"))
    items = written(items.withColumn("mark", F.monotonically_increasing_id()), "items")
    histogram = {r[0]: r[1] for r in items.groupBy("n_units").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each length
    stretches, final = plan(histogram, capacities)
    sent = spark.sparkContext.broadcast((stretches, final))
    salted = {length: -(-n // SALTED) for length, n in histogram.items() if n > SALTED}
    salts = spark.createDataFrame(sorted(salted.items()), "salted long, salts long")
    items = items.join(salts, items.n_units == salts.salted, "left").withColumn("salt", F.pmod("mark", F.coalesce("salts", F.lit(1)))).drop("salted", "salts")
    counts = items.groupBy("n_units", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("n_units").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    counts = written(counts.select("n_units", "salt", F.coalesce(before, F.lit(0)).alias("before")), "counts")
    row = F.row_number().over(Window.partitionBy("n_units", "salt").orderBy("mark"))
    ranked = items.withColumn("row", row).join(counts, ["n_units", "salt"])
    ranked = ranked.select("doc_id", "piece", "n_units", (F.col("row") - 1 + F.col("before")).cast("long").alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stretch, bins = sent.value
        keys = (stretch[:, 0] << 44) + stretch[:, 1]
        for b in batches:
            n, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            s = stretch[np.searchsorted(keys, (n << 44) + rank, "right") - 1]
            own = rank - s[:, 1]
            where = s[:, 2] + own // s[:, 3]
            capacity = bins[np.searchsorted(bins[:, 0], where, "right") - 1, 1].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(where), pa.array(s[:, 4] + own % s[:, 3] * n), pa.array(capacity)], names=["doc_id", "piece", "n_units", "bin", "bin_offset", "capacity"])

    return ranked.mapInArrow(place, "doc_id long, piece int, n_units long, bin long, bin_offset long, capacity int")
