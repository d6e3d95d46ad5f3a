"""Near duplicates by circulant MinHash, banding and exact Jaccard verification.

A document's set is its distinct 5-word shingles (A-Z lower-cased, words between ASCII white space; fewer words: all of them as one shingle),
kept as sorted 64-bit hashes.  Its signature needs two permutations of 32-bit values only: the first scatters the shingles, the second is
used 125 times, circularly shifted by 1, 2, ..., 125; each coordinate is the least value.  25 bands of 5 coordinates miss a pair at
similarity 0.85 about once in two million.

1. Documents of equal sets form a class, represented by its least id; all that follows is about classes.
2. In each band bucket every class is paired with the bucket's least id only; these pairs are verified on the full sets.
3. Components of the links so far.  In a bucket of three or more that still holds several components, each class outside the bucket's
   largest component is held against all the bucket's classes of other components, in blocks of bounded size; so every pair that shares a
   bucket and matters for the components is verified.
4. Components again; documents take the component of their class.

Null and empty texts, and texts of white space, have an empty set and are linked with nothing.  Rows of null id are returned with null
component and are not kept.  Rows that repeat an id are linked by their own texts; each of its texts counts as a text of that id.  Other columns are ignored;
an empty table gives an empty result.  Texts of any length are shingled whole; word memories are bounded in words and bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import WordHashes, ascii_words, bloom_bits, list_array, mix32, mix64, utf8, written

WORDS, BANDS, ROWS = 5, 25, 5
PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
SHIFTS = np.arange(1, BANDS * ROWS + 1, dtype=np.uint32)[:, None]
#: Classes of a bucket that are held against each other in one task at most, on either side.
BLOCK = 256
#: Tasks that share a band key's classes.
SALTS = 16
#: Size of the largest Bloom filter (16 MB).
MOST_BITS = 1 << 27


def shingles(data: bytes, hashes: WordHashes) -> np.ndarray:
    """The set of a text: sorted distinct hashes of its shingles."""
    h = hashes.of(ascii_words(data))
    n = len(h) - WORDS + 1
    if len(h) == 0:
        return h
    if n < 1:
        with np.errstate(over="ignore"):
            return mix64(np.array([(h * PLACE[: len(h)]).sum() + np.uint64(len(h))], np.uint64))
    x = np.zeros(n, np.uint64)
    for k in range(WORDS):
        x += h[k : k + n] * PLACE[k]
    return np.unique(mix64(x))


def signature(shingle_set: np.ndarray) -> np.ndarray:
    scattered = (shingle_set >> np.uint64(32)).astype(np.uint32)
    out = np.full(len(SHIFTS), 0xFFFFFFFF, np.uint32)
    for lo in range(0, len(scattered), 512):  # stays in the processor's cache
        np.minimum(out, mix32(scattered[lo : lo + 512] + SHIFTS).min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig.reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, k])
    return key.view(np.int64)


def linked(both: int, a: int, b: int, percent: int) -> bool:
    return 100 * both >= percent * (a + b - both)


def _signed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, fp_hi, fp_lo (of the set), bands (empty for an empty set)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(150_000)
        for b in batches:
            n, fp, bands = [], [], []
            for data in b.column(1).to_pylist():
                s = shingles(data, hashes)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(band_keys(signature(s)) if len(s) else np.zeros(0, np.int64))
            two = np.frombuffer(b"".join(fp), "<i8").reshape(-1, 2)
            lists = list_array(np.array([len(x) for x in bands], np.int64), np.concatenate(bands) if bands else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), lists], names=["doc_id", "n_shingles", "fp_hi", "fp_lo", "bands"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data")).mapInArrow(each, "doc_id long, n_shingles long, fp_hi long, fp_lo long, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """member, grams: the sets, as bytes of sorted 64-bit hashes, of the wanted ids (and of few others).

    Texts are not shuffled: up to MOST_BITS / 8 wanted ids, a Bloom filter of them goes to the tasks that read the texts, which then
    shingle one other text in twenty at most; beyond, the ids are joined."""
    n = wanted.count()
    rows = docs.select(F.col(id_col).cast("long").alias("member"), utf8(text_col).alias("data")).where("member is not null")
    if n <= MOST_BITS // 8:
        size = 1 << max(15, (8 * n - 1).bit_length())
        bits = docs.sparkSession.sparkContext.broadcast(bloom_bits(wanted, "wanted", size))
        places = [F.pmod(F.xxhash64("member", F.lit(k)), F.lit(size)).alias(f"p{k}") for k in range(2)]
        rows = rows.select("member", "data", *places)
    else:
        bits = None
        rows = rows.join(wanted, rows.member == wanted.wanted, "left_semi")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(150_000)
        for b in batches:
            if bits is not None:
                p = np.array([b.column(k).to_numpy() for k in (2, 3)])
                b = b.filter(pa.array(((bits.value[p >> 5] >> (p & 31).astype(np.uint32)) & 1).all(axis=0)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x, hashes).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["member", "grams"])

    return rows.mapInArrow(each, "member long, grams binary")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                keep.append(linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    left, right = sets.select(F.col("member").alias("a"), F.col("grams").alias("x")), sets.select(F.col("member").alias("b"), F.col("grams").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(each, "a long, b long").distinct()


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """member, component (least member reachable) of all members of links (a, b).

    Each round every member takes the least label around it, then its label's label; rounds grow with the logarithm of the widest
    component. Nothing is collected; each round is written to the shared folder."""
    both = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("member")).agg(F.min("b").alias("least")).select("member", F.least("member", "least").alias("component")), name)
    while True:
        near = both.join(labels, both.b == labels.member).groupBy("a").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.member == near.a).select("member", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("member").alias("component"), F.col("component").alias("further"))
        new = written(step.join(jump, "component", "left").select("member", "old", F.least("component", "further").alias("component")), name)
        moved = new.where("old != component").limit(1).count()
        labels = new.select("member", "component")
        if not moved:
            return labels


def _across(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a bucket."""
    placed = buckets.join(labels, buckets.rep == labels.member, "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
    placed = written(placed, "placed")
    counts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("key").agg(F.sum("n").alias("all"), F.max(F.struct("n", "component")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1 and all > 2")
    mixed = mixed.select("key", "all", F.col("most.component").alias("main"), (F.col("all") - F.col("most.n")).alias("others"))
    rows = placed.join(mixed, "key")
    blocks, asking = F.ceil(F.col("all") / BLOCK).cast("int"), F.ceil(F.col("others") / BLOCK).cast("int")
    own = F.xxhash64("rep")
    asks = rows.where("component != main").select("key", "rep", "component", F.lit(True).alias("asks"), F.pmod(own, asking).cast("int").alias("q"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("p"))
    asked = rows.select("key", "rep", "component", F.lit(False).alias("asks"), F.explode(F.sequence(F.lit(0), asking - 1)).alias("q"), F.pmod(own, blocks).cast("int").alias("p"))
    both = asks.unionByName(asked)
    both = both.join(sets, both.rep == sets.member).select("key", "q", "p", "rep", "component", "asks", "grams")

    def each(group: pd.DataFrame) -> pd.DataFrame:
        q, p = group[group.asks], group[~group.asks]
        q_sets, p_sets = [np.frombuffer(x, np.uint64) for x in q.grams], [np.frombuffer(x, np.uint64) for x in p.grams]
        out = []
        if q_sets and p_sets:
            sizes, starts = np.array([len(x) for x in p_sets]), np.cumsum([0] + [len(x) for x in p_sets[:-1]])
            flat = np.concatenate(p_sets)
            p_rep, p_comp = p.rep.to_numpy(), p.component.to_numpy()
            for rep, comp, s in zip(q.rep, q.component, q_sets, strict=True):
                at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
                shared = np.add.reduceat((s[at] == flat).astype(np.int64), starts)
                hit = np.flatnonzero((100 * shared >= percent * (sizes + len(s) - shared)) & (p_comp != comp))
                _, first = np.unique(p_comp[hit], return_index=True)  # one link to each other component is enough
                out += [(rep, p_rep[k]) for k in hit[first]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return both.groupBy("key", "q", "p").applyInPandas(each, "a long, b long").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    signed = written(_signed(docs, id_col, text_col), "signed")
    sized = signed.where("n_shingles > 0 and doc_id is not null")
    classes = sized.groupBy("fp_hi", "fp_lo", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands"))
    classes = written(classes, "classes")
    spread = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("key"))
    shared = spread.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("size")).where("size > 1")
    # a frequent key's classes are dealt over SALTS tasks; only keys of two classes or more are repeated for that
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    buckets = written(spread.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt"), "buckets")
    first = buckets.where("rep != leader").select(F.col("leader").alias("a"), F.col("rep").alias("b")).distinct()
    members = buckets.select(F.col("rep").alias("wanted")).distinct()
    sets = written(_sets(docs, written(members, "wanted"), id_col, text_col), "sets")
    links = written(_confirmed(first, sets, percent), "confirmed")
    labels = components(links)
    more = written(_across(buckets.where("size > 2").select("key", "rep"), labels, sets, percent), "across")
    labels = components(links.union(more).union(labels.select(F.col("member").alias("a"), F.col("component").alias("b"))))
    # documents of a class of one that has no link keep their own id; only the other classes are joined back
    known = classes.join(labels, classes.rep == labels.member, "left").select("fp_hi", "fp_lo", "n_shingles", "rep", "copies", F.coalesce("component", "rep").alias("component"))
    known = known.where("copies > 1 or component != rep").select("fp_hi", "fp_lo", "n_shingles", "component")
    joined = signed.drop("bands").join(known, ["fp_hi", "fp_lo", "n_shingles"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
