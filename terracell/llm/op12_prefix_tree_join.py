"""Exact n-gram Jaccard join by prefix trees: each document's class of texts that are linked.

A document's set is its distinct 3-word shingles (A-Z lower-cased, words between ASCII white space; fewer words: all of them as one shingle), kept as sorted
64-bit hashes.  Two documents link at 100 * intersection >= percent * union.

1. Documents of equal sets form a class, represented by its least id; all that follows is about classes.
2. Who can link: two sets that link differ in few shingles, d at most by their sizes.  The hash space is cut into m > d parts, so some part is the same in
   both; a class has one key for each part, made of all its shingles there.  Sizes lie in bands, so that two classes agree on m, and a class has the keys of
   its own band and of the band of the smallest partner it could have.  No pair that links is missed; a passage that many texts share gives no
   key, unless all of a part lies in it.
3. The join: classes that share keys are dealt to blocks with their key's least id.  A block's sets are stored in a prefix tree in one order of its shingles, the
   most common first, so that what they have in common is stored and counted once.  A query goes down the tree; a node passes its overlap on to its
   children, and a subtree is left where overlap and the shingles that could still follow, in the query and below, can't reach what its smallest
   set needs.  First the least id asks, then all it isn't linked with.
4. Components of the links.  In keys of three classes or more that still hold several components, each class outside the largest one asks all classes of the others, in blocks
   of bounded size, by the same tree: so every pair that shares a key and matters for the components is compared.  Components again.

Links are of full sets and exact; the components are those of all pairs.  The work of step 4 is (classes outside) x (classes) of a key whose classes stay
apart; no pairs leave a task but links.

Null and empty texts, and texts of white space, have an empty set and are linked with nothing.  Rows of null id are returned with null component.  Rows that
repeat an id are linked by their own texts; each of its texts counts as a text of that id.  Other columns are ignored; an empty table gives an empty result.
Texts of any length are shingled whole; word memories are bounded in words and bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import WordHashes, ascii_words, bloom_bits, list_array, mix64, utf8, written
from terracell.llm.op10_circulant_minhash import PLACE, components

WORDS = 3
#: Parts beyond those that two sets can differ in, and one: a set of no more empty parts than this needs no keys for them, nor for as many others.
SPARE = 3
#: Classes and shingles in a block's tree, at most (but for a single set that is larger).
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Ids (8 MB) that are broadcast to pick sets; more are joined.
BROADCAST_IDS = 1 << 20
#: Size of the largest Bloom filter (16 MB).
MOST_BITS = 1 << 27


def shingles(data: bytes, hashes: WordHashes) -> np.ndarray:
    """The set of a text: sorted distinct hashes of its shingles."""
    h = hashes.of(ascii_words(data))
    n = len(h) - WORDS + 1
    if len(h) == 0:
        return h
    if n < 1:
        return mix64(np.array([sum(int(x) * int(p) for x, p in zip(h, PLACE, strict=False)) + len(h) & (1 << 64) - 1], np.uint64))
    x = np.zeros(n, np.uint64)
    for k in range(WORDS):
        x += h[k : k + n] * PLACE[k]
    return np.unique(mix64(x))


def needed(a: int | np.ndarray, b: int | np.ndarray, percent: int):
    """The least intersection of sets of sizes a and b that link."""
    return -(-percent * (a + b) // (100 + percent))


class Bands:
    """Bands of sizes, each ending about half as high again as it begins, and how many parts each has."""

    def __init__(self, percent: int):
        self.percent = percent
        self.low = [1]

    def of(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(self.low[-1] + max(1, self.low[-1] // 2))
        return int(np.searchsorted(self.low, n, side="right")) - 1

    def parts(self, band: int) -> int:
        """One more than a set of the band's largest size and any partner no smaller can differ in, and SPARE; 0 if none can link but equal sets."""
        small = self.low[band + 1] - 1
        most = (small + 100 * small // self.percent) * (100 - self.percent) // (100 + self.percent)
        return most + 1 + SPARE if most else 0

    def asked(self, n: int) -> list[int]:
        """Bands of the smaller set of any pair that a set of size n is in."""
        return list(range(self.of(max(1, -(-self.percent * n // 100))), self.of(n) + 1))


def part_keys(s: np.ndarray, bands: Bands) -> np.ndarray:
    """A key for each part that is needed, by bands: equal where the parts hold equal shingles."""
    out = []
    for band in bands.asked(len(s)):
        m = bands.parts(band)
        if not m:
            continue
        part = ((s >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)  # in order, as s is
        sums, filled = np.zeros(m, np.uint64), np.bincount(part, minlength=m) > 0
        sums[filled] = np.add.reduceat(mix64(s ^ np.uint64(0xA0761D6478BD642F)), np.searchsorted(part, np.flatnonzero(filled)))
        keys = mix64(sums ^ mix64(np.arange(m, dtype=np.uint64) + np.uint64(1 + (band << 32))))
        # of the parts that two linked sets share, SPARE + 1 or more, those that are empty are empty in both; so one that isn't is among the first of both sets
        none = int((~filled).sum())
        out.append(keys if none > SPARE else keys[: m - SPARE + none][filled[: m - SPARE + none]])
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


class PrefixTree:
    """Sets in a tree whose edges hold the shingles that its sets share next, in one order: most common first, then by hash.

    Sets are sorted, so a node's sets are a range; nodes are made so that parents come before their children, level by level."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        self.values, codes, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        rank = np.empty(len(counts), np.int64)
        rank[np.argsort(-counts, kind="stable")] = np.arange(len(counts))
        ends = np.cumsum(self.sizes)
        rows = [np.sort(rank[codes[e - n : e]]) for e, n in zip(ends, self.sizes, strict=True)]
        self.order = sorted(range(len(rows)), key=lambda i: rows[i].astype(">u4").tobytes())
        self.rank = rank
        rows = [rows[i] for i in self.order]
        shared = [0]
        for x, y in zip(rows, rows[1:], strict=False):
            k = min(len(x), len(y))
            off = np.flatnonzero(x[:k] != y[:k])
            shared.append(int(off[0]) if len(off) else k)
        # a stack of open nodes [depth, first set]; a node closes where the next set shares less
        nodes, stack = [], [(0, 0)]
        for i, row in enumerate([*rows, np.zeros(0, np.int64)]):
            depth = shared[i] if i < len(rows) else 0
            first = i
            while stack[-1][0] > depth:
                d, first = stack.pop()
                above = max(stack[-1][0], depth)
                nodes.append((above, d, first, i))
                if above > stack[-1][0]:
                    stack.append((above, first))
                    break
            if i < len(rows) and len(row) > stack[-1][0]:
                stack.append((len(row), i))
        nodes.sort(key=lambda x: (x[2], -x[3], x[0]))  # a parent stands before what lies in it
        level, path = [], []
        for above, d, first, last in nodes:
            while path and path[-1][1] <= first:
                path.pop()
            level.append((len(path), path[-1][2] if path else -1))
            path.append((d, last, len(level) - 1))
        by = sorted(range(len(nodes)), key=lambda k: (level[k][0], k))
        place = {k: j for j, k in enumerate(by)}
        self.parent = np.array([place.get(level[k][1], -1) for k in by], np.int64)
        self.level = np.array([level[k][0] for k in by], np.int64)
        self.above, self.depth, self.first, self.last = (np.array([nodes[k][c] for k in by], np.int64) for c in range(4))
        self.tokens = [rows[f][a:d] for a, d, f in zip(self.above, self.depth, self.first, strict=True)]
        self.lengths = np.array([len(t) for t in self.tokens], np.int64)
        self.flat, self.starts = np.concatenate(self.tokens), np.cumsum(self.lengths) - self.lengths
        sizes = self.sizes[self.order]
        self.least = np.array([sizes[f:e].min() for f, e in zip(self.first, self.last, strict=True)], np.int64)
        self.most = np.array([sizes[f:e].max() for f, e in zip(self.first, self.last, strict=True)], np.int64)
        ends_at = {(int(d), i) for d, f, e in zip(self.depth, self.first, self.last, strict=True) for i in range(f, e) if sizes[i] == d}
        self.ends = [[i for i in range(f, e) if (int(d), i) in ends_at] for d, f, e in zip(self.depth, self.first, self.last, strict=True)]
        self.levels = int(self.level.max()) + 1 if len(nodes) else 0

    def linked(self, query: np.ndarray, percent: int) -> list[int]:
        """Places (in the list given) of the sets that link with the query."""
        at = np.minimum(np.searchsorted(self.values, query), len(self.values) - 1)
        own = np.sort(self.rank[at[self.values[at] == query]])  # the query's shingles that the tree has, in its order
        mark = np.zeros(len(self.values), bool)
        mark[own] = True
        n, overlap, alive, out = len(query), np.zeros(len(self.depth), np.int64), np.zeros(len(self.depth), bool), []
        for k in range(self.levels):
            here = np.flatnonzero((self.level == k) & ((self.parent < 0) | alive[self.parent]))
            if not len(here):
                break
            lengths = self.lengths[here]
            begin = np.cumsum(lengths) - lengths
            took = mark[self.flat[np.repeat(self.starts[here] - begin, lengths) + np.arange(lengths.sum())]]
            overlap[here] = np.add.reduceat(took.astype(np.int64), begin) + np.where(self.parent[here] < 0, 0, overlap[self.parent[here]])
            last = np.array([self.tokens[j][-1] for j in here])
            follow = np.minimum(len(own) - np.searchsorted(own, last, side="right"), self.most[here] - self.depth[here])
            alive[here] = overlap[here] + follow >= needed(n, self.least[here], percent)
            for j in here:
                out += [self.order[i] for i in self.ends[j] if overlap[j] >= needed(n, int(self.depth[j]), percent)]
        return out


def _signed(docs: DataFrame, id_col: str, text_col: str, percent: int) -> DataFrame:
    """doc_id, n_shingles, fp_hi, fp_lo (of the set), keys (none for an empty set)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bands = WordHashes(150_000), Bands(percent)
        for b in batches:
            n, fp, keys = [], [], []
            for data in b.column(1).to_pylist():
                s = shingles(data, hashes)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(part_keys(s, bands) if len(s) else np.zeros(0, np.int64))
            two = np.frombuffer(b"".join(fp), "<i8").reshape(-1, 2)
            lists = list_array(np.array([len(x) for x in keys], np.int64), np.concatenate(keys) if keys else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy()), lists], names=["doc_id", "n_shingles", "fp_hi", "fp_lo", "keys"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data")).mapInArrow(each, "doc_id long, n_shingles long, fp_hi long, fp_lo long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """member, grams: the sets, as bytes of sorted 64-bit hashes, of the wanted ids (and of few others).

    Texts are not shuffled: up to MOST_BITS / 8 wanted ids, a Bloom filter of them goes to the tasks that read the texts; beyond, the ids are joined."""
    n = wanted.count()
    rows = docs.select(F.col(id_col).cast("long").alias("member"), utf8(text_col).alias("data")).where("member is not null")
    bits = None
    if n <= MOST_BITS // 8:
        size = 1 << max(15, (8 * n - 1).bit_length())
        bits = docs.sparkSession.sparkContext.broadcast(bloom_bits(wanted, "wanted", size))
        rows = rows.select("member", "data", *[F.pmod(F.xxhash64("member", F.lit(k)), F.lit(size)).alias(f"p{k}") for k in range(2)])
    else:
        rows = rows.join(wanted, rows.member == wanted.wanted, "left_semi")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes(150_000)
        for b in batches:
            if bits is not None:
                p = np.array([b.column(k).to_numpy() for k in (2, 3)])
                b = b.filter(pa.array(((bits.value[p >> 5] >> (p & 31).astype(np.uint32)) & 1).all(axis=0)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(x, hashes).tobytes() for x in b.column(1).to_pylist()], pa.binary())], names=["member", "grams"])

    return rows.mapInArrow(each, "member long, grams binary")


def _blocks(most_classes: str, shingles_: str):
    """How many blocks hold so many classes and shingles."""
    return F.greatest(F.ceil(F.col(most_classes) / BLOCK), F.ceil(F.col(shingles_) / BLOCK_SHINGLES)).cast("int")


def _stars(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) of the classes of each least id's keys, block by block."""
    near = F.least("n", "leader_n") * 100 >= F.greatest("n", "leader_n") * percent
    pairs = written(buckets.where(near & F.expr("rep != leader")).select("leader", "rep", "n").distinct(), "stars")
    sized = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles")).select("leader", _blocks("size", "shingles").alias("blocks"))
    dealt = pairs.join(sized, "leader").select("leader", F.pmod(F.xxhash64("rep", F.lit(7)), "blocks").cast("int").alias("block"), "rep")
    firsts = sized.select("leader", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("leader").alias("rep"))
    members = dealt.union(firsts).join(sets, F.col("rep") == F.col("member")).select("leader", "block", "rep", "grams")

    def each(group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates(["rep", "grams"])
        reps, found = group.rep.to_numpy(), [np.frombuffer(x, np.uint64) for x in group.grams]
        kept = [k for k, s in enumerate(found) if len(s)]
        reps, found = reps[kept], [found[k] for k in kept]
        if len(found) < 2:
            return pd.DataFrame([], columns=["a", "b"], dtype="int64")
        tree, out, alone = PrefixTree(found), [], set(range(len(found)))
        for k in np.flatnonzero(reps == group.leader.iloc[0]):
            for j in tree.linked(found[k], percent):
                alone.discard(j)
                out.append((reps[k], reps[j]))
        for k in sorted(alone):
            out += [(reps[k], reps[j]) for j in tree.linked(found[k], percent)]
        return pd.DataFrame([x for x in out if x[0] != x[1]], columns=["a", "b"], dtype="int64")

    return members.groupBy("leader", "block").applyInPandas(each, "a long, b long").distinct()


def _sized(rows: DataFrame, by: str) -> DataFrame:
    """For each `by`: least component, main (largest) component, components, blocks of all and of those outside the main one, and rows that this sends."""
    marks = [F.bit_xor(F.xxhash64("rep", F.lit(k))).alias(f"mark{k}") for k in range(2)]
    counts = rows.groupBy(by, "component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), *marks)
    sums = [F.min("component").alias("least"), F.max(F.struct("size", "component", "shingles")).alias("most"), F.count(F.lit(1)).alias("kinds"), F.sum("size").alias("all"), F.sum("shingles").alias("all_shingles")]
    out = counts.groupBy(by).agg(*sums, *[F.bit_xor(f"mark{k}").alias(f"mark{k}") for k in range(2)]).withColumn("others", F.col("all") - F.col("most.size")).withColumn("others_shingles", F.col("all_shingles") - F.col("most.shingles"))
    out = out.select(by, "least", F.col("most.component").alias("main"), "kinds", "all", "others", "mark0", "mark1", _blocks("all", "all_shingles").alias("blocks"), _blocks("others", "others_shingles").alias("asking"))
    return out.withColumn("cost", F.col("all") * F.col("asking") + F.col("others") * F.col("blocks"))


def _units(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """unit, whole, rep, component, main, blocks, asking: where classes of different components that share a key meet.

    A unit is a key, or all keys that share components, whichever sends fewer rows; pairs that share many keys mostly meet once so."""
    placed = buckets.join(labels, buckets.rep == labels.member, "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("component"))
    placed = written(placed, "placed")
    keys = _sized(placed, "key").where("kinds > 1").groupBy("mark0", "mark1", "all").agg(F.min_by(F.struct("key", "least", "main", "blocks", "asking", "cost"), "key").alias("one")).select("one.*")  # keys of the same classes: one of them
    keys = written(keys, "keys")
    rows = written(placed.join(keys.select("key", "least"), "key"), "key_rows")
    near = components(rows.where("least != component").select(F.col("least").alias("a"), F.col("component").alias("b")).distinct(), "near")
    near = near.select(F.col("member").alias("least"), F.col("component").alias("family"))
    rows = written(rows.join(near, "least"), "family_rows")
    members = written(rows.groupBy("family", "rep").agg(F.first("component").alias("component"), F.first("n").alias("n")), "family_members")
    single = rows.select("key", "family").distinct().join(keys.select("key", "cost"), "key").groupBy("family").agg(F.sum("cost").alias("by_key"))
    families = _sized(members, "family").join(single, "family").withColumn("whole", F.col("cost") <= F.col("by_key"))
    families = written(families.select("family", "main", "blocks", "asking", "whole"), "families")
    out = ["unit", "whole", "rep", "component", "main", "blocks", "asking"]
    first = members.join(families.where("whole"), "family").withColumnRenamed("family", "unit").select(*out)
    apart = rows.select("key", "family", "rep", "component").join(families.where("not whole").select("family", "whole"), "family").join(keys.select("key", "main", "blocks", "asking"), "key")
    return first.union(apart.withColumnRenamed("key", "unit").select(*out))


def _across(buckets: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between different components of a key."""
    rows = written(_units(buckets, labels), "units")
    own, alone, outside = F.xxhash64("rep"), F.expr("blocks = 1 and asking = 1"), F.expr("component != main")
    asks = rows.where(outside & ~alone).select("unit", "whole", "rep", "component", F.lit(True).alias("asks"), F.lit(False).alias("held"), F.pmod(own, "asking").cast("int").alias("q"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("p"))
    asked = rows.select("unit", "whole", "rep", "component", (alone & outside).alias("asks"), F.lit(True).alias("held"), F.explode(F.sequence(F.lit(0), F.col("asking") - 1)).alias("q"), F.pmod(own, "blocks").cast("int").alias("p"))
    both = asks.unionByName(asked)
    wanted = written(rows.select(F.col("rep").alias("wanted")).distinct(), "across_wanted")
    if wanted.count() <= BROADCAST_IDS:
        sets = sets.join(F.broadcast(wanted), sets.member == wanted.wanted, "left_semi")
    both = both.join(sets, both.rep == sets.member).select("unit", "whole", "q", "p", "rep", "component", "asks", "held", "grams")

    def each(group: pd.DataFrame) -> pd.DataFrame:
        q, p = group[group.asks], group[group.held]
        p_sets = [np.frombuffer(x, np.uint64) for x in p.grams]
        kept = [k for k, s in enumerate(p_sets) if len(s)]
        out = []
        if len(q) and kept:
            tree, reps, comps = PrefixTree([p_sets[k] for k in kept]), p.rep.to_numpy()[kept], p.component.to_numpy()[kept]
            for rep, comp, grams in zip(q.rep, q.component, q.grams, strict=True):
                hit = np.array([k for k in tree.linked(np.frombuffer(grams, np.uint64), percent) if comps[k] != comp], np.int64)
                _, first = np.unique(comps[hit], return_index=True)  # one link to each other component is enough
                out += [(rep, reps[k]) for k in hit[first]]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return both.groupBy("unit", "whole", "q", "p").applyInPandas(each, "a long, b long").distinct()


def _buckets(signed: DataFrame) -> DataFrame:
    """key, rep, n, leader, leader_n, size: the classes of keys that several classes share.

    Keys are counted first; the few that are shared reach the tasks as a Bloom filter, up to MOST_BITS / 8 of them, so that only their rows are shuffled."""
    shared = signed.select("fp_lo", F.explode("keys").alias("key")).groupBy("key").agg(F.min("fp_lo").alias("low"), F.max("fp_lo").alias("high")).where("low != high").select("key")
    shared = written(shared, "shared")
    n = shared.count()
    rows = signed.select("doc_id", "n_shingles", "fp_hi", "fp_lo", "keys")
    if n <= MOST_BITS // 8:
        size = 1 << max(15, (8 * n - 1).bit_length())
        bits = signed.sparkSession.sparkContext.broadcast(bloom_bits(shared, "key", size, hashed=False))

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lists = b.column(4)
                keys, sizes = lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy())
                there = np.ones(len(keys), bool)
                for shift in (0, 32):
                    p = (keys >> shift) & (size - 1)
                    there &= (bits.value[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1
                counts = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[there], minlength=len(sizes))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], list_array(counts, keys[there])], names=b.schema.names).filter(pa.array(counts > 0))

        rows = rows.mapInArrow(each, "doc_id long, n_shingles long, fp_hi long, fp_lo long, keys array<long>")
    rows = rows.select("doc_id", F.col("n_shingles").alias("n"), "fp_hi", "fp_lo", F.explode("keys").alias("key")).join(shared, "key")
    rows = written(rows.groupBy("key", "fp_hi", "fp_lo", "n").agg(F.min("doc_id").alias("rep")).select("key", "rep", "n"), "classes_by_key")
    firsts = rows.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    firsts = written(firsts.select("key", F.col("first.rep").alias("leader"), F.col("first.n").alias("leader_n"), "size"), "firsts")
    return written(rows.join(firsts, "key"), "buckets")  # a hot key's rows are split by the adaptive skew join


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 90) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    signed = written(_signed(docs, id_col, text_col, percent), "signed")
    sized = signed.where("n_shingles > 0 and doc_id is not null")
    classes = sized.groupBy("fp_hi", "fp_lo", "n_shingles").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    classes = written(classes, "classes")
    buckets = _buckets(sized)
    sets = written(_sets(docs, written(buckets.select(F.col("rep").alias("wanted")).distinct(), "wanted"), id_col, text_col), "sets")
    links = written(_stars(buckets, sets, percent), "links_by_star")
    labels = components(links)
    more = written(_across(buckets.where("size > 2").select("key", "rep", "n"), labels, sets, percent), "links_across")
    labels = components(links.union(more).union(labels.select(F.col("member").alias("a"), F.col("component").alias("b"))))
    # documents of a class of one that has no link keep their own id; only the other classes are joined back
    known = classes.join(labels, classes.rep == labels.member, "left").select("fp_hi", "fp_lo", "n_shingles", "rep", "copies", F.coalesce("component", "rep").alias("component"))
    known = known.where("copies > 1 or component != rep").select("fp_hi", "fp_lo", "n_shingles", "component")
    all_ = signed.drop("keys").join(known, ["fp_hi", "fp_lo", "n_shingles"], "left")
    return all_.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
