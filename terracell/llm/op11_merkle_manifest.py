"""Merkle manifest of a table: leaves, roots by source, one root, and a proof for every row.

A leaf is the sha256 (lower-case hex) of a row's fields; nodes in runs of 16 become the sha256 of their digests until one is left: first the leaves of each
source by doc_id, then the sources' roots by source.  A proof holds the siblings of a leaf's way up.

1. Leaves are hashed where the rows are (built-in functions); only digests are shuffled.  Their places in their source come from one range sort by
   (source, doc_id, leaf) and a small table of counts by source and range.
2. Aligned buckets of 4,096 consecutive nodes go to executors as Arrow batches, where DuckDB runs three level queries, each an ordered string_agg and a sha256.
   Bucket roots are the nodes of the next tier, until each source has one; so a hot source is many buckets, and no task holds more than CHUNK nodes
   and a bucket.
3. The same is done with the sources' roots.  On the way back Spark joins each bucket with the siblings above it (its outer proof, kept once a bucket), and
   DuckDB completes proofs and folds leaves, given ones or others, up to a root.

Null fields count as such in a leaf; the null source and the null id come first.  Rows of one source and id stand by their leaves' digests; equal rows are
leaves of their own, whose order makes no difference to any root.  Empty texts are texts of no bytes.  Rows without an id are never tampered with.  An empty
table gives an empty result.  Other columns than the five are ignored, whatever their names.  A text of any length is hashed in one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terracell.llm.common import id_crc, written

#: Nodes of a run; levels that one bucket holds.
FAN, LEVELS = 16, 3
BUCKET = FAN**LEVELS
#: Nodes that a task gives to DuckDB at once, but for the last bucket's.
CHUNK = 16_384
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def leaf(columns: list[Column]) -> Column:
    """Digest of fields: `-` for null, else its bytes' count, a colon and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, source, leaf, and the leaf of the tampered row where 5 divides the id's crc32 (else null)."""
    rows = docs.select(*FIELDS)
    own = [F.col(c) for c in FIELDS]
    changed = leaf([*own[:-1], F.translate("text", UPPER, LOWER)])
    return rows.select("doc_id", F.col("source").cast("string").alias("source"), leaf(own).alias("leaf"), F.when(id_crc("doc_id") % 5 == 0, changed).alias("tampered"))


def _in_order(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows sorted over all partitions; `at` holds each row's range (the bits above 33) and place in it."""
    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)


def _starts(counts: DataFrame, by: list[str], size: str) -> DataFrame:
    """`before`: the sum of `size` of the earlier ranges; a row for each range (and key), however many rows they hold."""
    return counts.withColumn("before", F.coalesce(F.sum(size).over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def placed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (key: the source's rank, pos: the rank in the source, n: leaves of the source, digest, doc_id, tampered), and the sources (key, n)."""
    rows = _in_order(rows.withColumn("own", F.monotonically_increasing_id()), ["source", "doc_id", "leaf", "own"], "ordered")
    part = F.shiftright("at", 33).alias("part")
    counts = written(rows.groupBy("source", part).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows")), "ranges")
    sources = _in_order(counts.groupBy("source").agg(F.sum("rows").alias("n")), ["source"], "sources")
    ranges = sources.groupBy(part).agg(F.min("at").alias("lowest"), F.count(F.lit(1)).alias("sources"))
    ranked = sources.withColumn("part", part).join(_starts(ranges.withColumn("all", F.lit(0)), ["all"], "sources").drop("all"), "part")
    ranked = written(ranked.select("source", (F.col("at") - F.col("lowest") + F.col("before")).alias("key"), "n"), "ranked")
    ways = _starts(counts, ["source"], "rows").join(ranked.withColumnRenamed("source", "named"), F.col("source").eqNullSafe(F.col("named"))).drop("named")
    ways = written(ways.withColumnsRenamed({"source": "named", "part": "range"}), "ways")
    both = rows.withColumn("part", part).join(ways, F.col("source").eqNullSafe(F.col("named")) & (F.col("part") == F.col("range")))
    nodes = both.select("key", (F.col("at") - F.col("first") + F.col("before")).alias("pos"), "n", F.col("leaf").alias("digest"), "doc_id", "tampered")
    return written(nodes, "nodes"), ranked.select("key", "n")


def _levels() -> Column:
    """Levels that are made of a node's bucket."""
    return F.when(F.col("n") <= 1, 0).when(F.col("n") <= FAN, 1).when(F.col("n") <= FAN**2, 2).otherwise(LEVELS)


def _buckets(rows: DataFrame) -> DataFrame:
    """rows by bucket, each bucket whole in one partition and in order."""
    return rows.repartition("key", "bucket").sortWithinPartitions("key", "bucket", "pos")


def _chunks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Whole buckets, `size` rows of them at least, as long as there are more."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n < size:
            continue
        table = pa.Table.from_batches(held)
        keys, buckets = table["key"].to_numpy(), table["bucket"].to_numpy()
        other = (keys != keys[-1]) | (buckets != buckets[-1])
        if whole := int(other.nonzero()[0][-1]) + 1 if other.any() else 0:
            yield table.slice(0, whole)
        held, n = table.slice(whole).to_batches(), table.num_rows - whole
    if n:
        yield pa.Table.from_batches(held)


def _engine():
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})


def _climb(db) -> None:
    """From level0 (key, bucket, pos, levels, d): run{k}, the digests of each run of 16 in order, and level{k + 1}, their hashes."""
    for k in range(LEVELS):
        db.execute(f"CREATE TABLE run{k} AS SELECT key, bucket, pos // {FAN} AS pos, levels, string_agg(d, '' ORDER BY pos) AS s FROM level{k} WHERE levels > {k} GROUP BY ALL")
        db.execute(f"CREATE TABLE level{k + 1} AS SELECT key, bucket, pos, levels, sha256(s) AS d FROM run{k}")


def ascended(nodes: DataFrame, size: int = CHUNK) -> DataFrame:
    """The next tier: a node (key, pos, n, digest) for each bucket."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            with _engine() as db:
                db.register("chunk", chunk)
                db.execute("CREATE TABLE level0 AS SELECT key, bucket, pos, levels, digest AS d FROM chunk")
                _climb(db)
                tops = " UNION ALL ".join(f"SELECT key, bucket, d FROM level{k} WHERE levels = {k}" for k in range(LEVELS + 1))
                sizes = "SELECT DISTINCT key, bucket, n FROM chunk"
                yield from db.execute(f"SELECT key, bucket AS pos, (n + {BUCKET - 1}) // {BUCKET} AS n, d AS digest FROM ({tops}) JOIN ({sizes}) USING (key, bucket)").to_arrow_table().to_batches()

    rows = nodes.select("key", F.expr(f"pos div {BUCKET}").alias("bucket"), "pos", "n", _levels().cast("int").alias("levels"), "digest")
    return _buckets(rows).mapInArrow(each, "key long, pos long, n long, digest string")


def tower(nodes: DataFrame, name: str) -> list[DataFrame]:
    """All tiers above the nodes; each key's last node has n = 1."""
    tiers = [written(ascended(nodes), name)]
    while tiers[-1].where("n > 1").limit(1).count():
        tiers.append(written(ascended(tiers[-1].where("n > 1")), name))
    return tiers


def tops(tiers: list[DataFrame]) -> DataFrame:
    """key, digest of each key's last node."""
    out = tiers[0].where("n = 1")
    for t in tiers[1:]:
        out = out.union(t.where("n = 1"))
    return out.select("key", "digest")


#: What a node has above it: digests to its left and right, level by level, and the roots.
OUTER = "lefts array<string>, rights array<string>, subroot string, root string"
_OUTER = ["lefts", "rights", "subroot", "root"]


def descended(nodes: DataFrame, outer: DataFrame, last: bool, size: int = CHUNK) -> DataFrame:
    """With last, each row's digest, proof's hash and folded root; else key, pos and OUTER of each node.

    outer: OUTER of the nodes' buckets (key, pos)."""
    schema = "doc_id long, digest string, subroot string, root string, proof_sha256 string, folded_root string" if last else f"key long, pos long, {OUTER}"

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, size):
            with _engine() as db:
                db.register("chunk", chunk)
                db.execute("CREATE TABLE level0 AS SELECT key, bucket, pos, levels, digest AS d, doc_id, tampered FROM chunk WHERE pos >= 0")
                db.execute("CREATE TABLE above AS SELECT key, bucket, lefts, rights, subroot, root FROM chunk WHERE pos < 0")
                _climb(db)
                sides = ", ".join(f"CASE WHEN a.levels > {k} THEN r{k}.s[:{64} * (a.pos // {FAN**k} % {FAN})] ELSE '' END AS left{k}, CASE WHEN a.levels > {k} THEN r{k}.s[{64} * (a.pos // {FAN**k} % {FAN}) + 65:] ELSE '' END AS right{k}" for k in range(LEVELS))
                runs = " ".join(f"LEFT JOIN run{k} r{k} ON r{k}.key = a.key AND r{k}.pos = a.pos // {FAN ** (k + 1)}" for k in range(LEVELS))
                at = f"SELECT a.*, o.lefts, o.rights, o.subroot, o.root, {sides} FROM level0 a JOIN above o ON o.key = a.key AND o.bucket = a.bucket {runs}"
                if last:
                    deepest = db.execute("SELECT coalesce(max(len(lefts)), 0) FROM above").fetchone()[0]
                    folded, up = "coalesce(tampered, d)", [(f"left{k}", f"right{k}", f"levels > {k}") for k in range(LEVELS)] + [(f"lefts[{k}]", f"rights[{k}]", f"len(lefts) >= {k}") for k in range(1, deepest + 1)]
                    steps = f"SELECT *, {folded} AS f FROM ({at})"
                    for left, right, there in up:
                        steps = f"SELECT * REPLACE (CASE WHEN {there} THEN sha256({left} || f || {right}) ELSE f END AS f) FROM ({steps})"
                    whole = " || ".join([f"left{k} || right{k}" for k in range(LEVELS)] + [f"coalesce(lefts[{k}] || rights[{k}], '')" for k in range(1, deepest + 1)])
                    asked = f"SELECT doc_id, d AS digest, subroot, root, sha256({whole}) AS proof_sha256, f AS folded_root FROM ({steps})"
                else:
                    own = [f"list_concat([x for x in [{', '.join(f'CASE WHEN levels > {k} THEN {side}{k} END' for k in range(LEVELS))}] if x IS NOT NULL], {side}s) AS {side}s" for side in ("left", "right")]
                    asked = f"SELECT key, pos, {', '.join(own)}, subroot, root FROM ({at})"
                yield from db.execute(asked).to_arrow_table().to_batches(max_chunksize=4096)

    bucket, none = F.expr(f"pos div {BUCKET}").alias("bucket"), lambda kind, *names: [F.lit(None).cast(kind).alias(c) for c in names]
    kept = ["doc_id", "tampered"] if last else none("long", "doc_id") + none("string", "tampered")
    low = nodes.select("key", bucket, "pos", _levels().cast("int").alias("levels"), "digest", *kept, *none("array<string>", "lefts", "rights"), *none("string", "subroot", "root"))
    high = outer.select("key", F.col("pos").alias("bucket"), F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("levels"), *none("string", "digest"), *none("long", "doc_id"), *none("string", "tampered"), *_OUTER)
    return _buckets(low.unionByName(high)).mapInArrow(each, schema)


def outers(tiers: list[DataFrame], start: DataFrame, name: str) -> DataFrame:
    """OUTER of the nodes of tiers[0], given that of each key's last node (start: key and OUTER)."""
    out = None
    for tier in reversed(tiers):
        here = tier.where("n = 1").select("key", "pos").join(start, "key").select("key", "pos", *_OUTER)
        if out is not None:
            here = here.unionByName(descended(tier.where("n > 1"), out, False))
        out = written(here, name)
    return out


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row."""
    nodes, sources = placed(written(leaves(docs), "leaves"))
    tiers = tower(nodes, "tier")
    subroots = written(tops(tiers).withColumnRenamed("key", "pos").withColumn("key", F.lit(0).cast("long")), "subroots")
    high = subroots.join(F.broadcast(sources.agg(F.count(F.lit(1)).alias("n"))))  # one row
    roofs = tower(high.select("key", "pos", "n", "digest"), "roof")
    empty = F.array().cast("array<string>")
    top = tops(roofs).select("key", empty.alias("lefts"), empty.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    ways = descended(high.select("key", "pos", "n", "digest"), outers(roofs, top, "outer_roof"), False)
    start = ways.drop("key", "subroot").withColumnRenamed("pos", "key").join(subroots.select(F.col("pos").alias("key"), F.col("digest").alias("subroot")), "key")
    out = descended(nodes, outers(tiers, written(start.select("key", *_OUTER), "starts"), "outer"), True)
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
