"""Hashed maximum-entropy language model with a class-factored softmax.

P(word | history) = P(class | history) * P(word | class, classes of the two words before).

* The class model has as many classes as the corpus bears, up to CLASSES, and hashed features of the word before (n-gram), of the two before (n-gram), and of the one before that alone (skip).  Training
  texts are dealt to shards by a hash of id and text, a shard for each SHARD bytes of text.  Shards belong to at most ROUNDS rounds; in a
  round each shard takes stochastic gradient steps from the round's shared weights over its own texts, in order of id, and the shards' rows
  of weights are averaged by how often each shard used them.  So the result is a function of the table, not of partitions or cores.
* The word model inside a class has biases and n-gram and skip features of the classes before.  It covers every word of the training texts: the
  HEAD most frequent ones are clustered into classes by the words before them, and all others, the unknown word included, are one more class.
  That class's features grow with the vocabulary and stay a distributed table, whose weights take STEPS gradient steps (iterative
  scaling) by buckets of words; only the normaliser, a table by two classes, is shared between steps.

All sums of counts are whole numbers, all other sums are taken in a fixed order.  Sizes that don't grow are parameters: HEAD, CLASSES, BITS and
FREQUENT (words whose weights are broadcast, 28 MB at most; the weights of all others are joined by bucket).  What grows: word counts, the
table of words outside the classes, shards and buckets.

Words are keyed by 64-bit hashes.  Null texts count as empty and are one end token.  Rows of null id are held out of nothing: they are
training rows.  Repeated rows count and are returned each (rows that repeat id and text share a shard, streamed through it); ties of frequency go
to the least hash; other columns are ignored; an empty table gives an empty result; without training rows scores rest on the smoothing alone.
Texts are read whole; memory is one arrow batch, the words of 8 MB of it (or of one text), and tables of the sizes above.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import id_crc, kept, mix64, received, send, slices, utf8, written

#: Words in the classes, classes (the last is all other words), words whose weights are broadcast, anchors that tell classes apart.
HEAD, CLASSES, FREQUENT, ANCHORS = 16384, 25, 1 << 17, 64
#: History classes: those of words, and a text's start.
PAST = CLASSES + 1
#: Hashed features: bits of the word before, the skipped word, the pair.
BITS = (12, 12, 14)
FIRST = np.cumsum([0, *[1 << b for b in BITS]])
END_HASH, START_HASH = np.uint64(0x1D5B3C2F9A7E4416), np.uint64(3)
BATCH = 4096
#: Bytes of text in a shard, rounds of averaging, steps of the word model outside the classes, its tokens in a bucket.
SHARD, ROUNDS, STEPS, BUCKET = 16 << 20, 4, 3, 200_000
#: So many lines of a batch are added to a row of weights one by one; what a row has beyond them is summed at once.
SINGLY = 8
#: So many contexts with the class's own shares are added to each word's: words that are met seldom keep near to their class.
PRIOR = 5.0
LOG10 = np.log(10)
ENCODED = "row long, doc_id long, held_out boolean, mark long, n_tokens long, codes binary, rare binary"
RECORDS = "bucket int, hashes binary, contexts binary, counts binary"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    held = F.coalesce(F.pmod(id_crc(id_col), F.lit(5)) == 1, F.lit(False))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"), utf8(text_col).alias("data"))


def distinct_words(data: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of texts (bytes), for each word its place among them, and words of each text.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z in lower case; Arrow splits and tells them apart, so only distinct ones are hashed."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(data.view(pa.string())))
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False), dtype=np.int64)
    real = pc.not_equal(pc.binary_length(words), 0)  # white space at a text's ends leaves empty ones
    n = np.diff(np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False), dtype=np.int64))[np.append(0, ends)])
    kinds = words.filter(real).dictionary_encode()
    names = kinds.dictionary.view(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names)), kinds.indices.to_numpy(), n


def count_words(train: DataFrame) -> DataFrame:
    """hash, n of all words of the training rows (ends not included)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0

        def summed() -> pa.RecordBatch:
            h, n = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.argsort(h)
            h, n = h[order], n[order]
            first = np.flatnonzero(np.append(True, h[1:] != h[:-1])[: len(h)])
            n = np.add.reduceat(n, first) if len(h) else n  # texts without words
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(n)], names=["hash", "n"])

        for b in batches:
            for lo, size in slices(b.column(0)):
                h, place, _ = distinct_words(b.column(0).slice(lo, size))
                waiting.append((h, np.bincount(place, minlength=len(h))))
                held += len(h)
                if held > 1_500_000:
                    yield summed()
                    waiting, held = [], 0
        if waiting:
            yield summed()

    return train.select("data").mapInArrow(each, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


class Numbers:
    """Numbers of words: their place in the list of frequent ones, or `len(list)` for all others."""

    def __init__(self, frequent: np.ndarray):
        order = np.argsort(frequent)
        self.sorted, self.place = frequent[order], order

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
        return np.where(self.sorted[at] == hashes, self.place[at], len(self.sorted))


def packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2 ** 24 by planes, which compress better than one after the other."""
    return (numbers & 0xFFFF).astype("<u2").tobytes() + (numbers >> 16).astype(np.uint8).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    n = len(data) // 3
    return np.frombuffer(data, "<u2", n).astype(np.int64) | (np.frombuffer(data, np.uint8, n, 2 * n).astype(np.int64) << 16)


def encoded(rows: DataFrame, numbers, tag: str) -> DataFrame:
    """ENCODED: each text as numbers of its words and the end, and hashes of those that are not frequent; `mark` orders texts of one id."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = kept(("numbers", tag), lambda: Numbers(received(numbers))), TaskContext.get().partitionId() << 36
        for b in batches:
            for lo, size in slices(b.column(2)):
                part = b.slice(lo, size)
                hashes, place, n = distinct_words(part.column(2))
                number = known.of(hashes)
                ends, codes, rare = np.cumsum(n).tolist(), [], []
                for i, j in zip([0, *ends[:-1]], ends, strict=True):
                    at = place[i:j]
                    own = number[at]
                    codes.append(packed(np.append(own, 0)))
                    rare.append(hashes[at[own == len(known.sorted)]].tobytes())
                out = [pa.array(np.arange(row, row + len(n))), part.column(0), part.column(1), part.column(3), pa.array(n + 1), pa.array(codes, pa.binary()), pa.array(rare, pa.binary())]
                row += len(n)
                yield pa.RecordBatch.from_arrays(out, names=[x.split()[0] for x in ENCODED.split(", ")])

    return rows.withColumn("mark", F.xxhash64("data")).mapInArrow(each, ENCODED)


class Space:
    """What is known of frequent words by number (number 0 ends a text), of all others by hash, and of a text's start."""

    def __init__(self, hashes: np.ndarray, classes: np.ndarray):
        """classes: of the head, the most frequent words."""
        self.size, self.head = len(hashes), len(classes)
        self.hash = np.concatenate([hashes, np.array([0, START_HASH], np.uint64)])
        self.kind = np.full(self.size + 2, CLASSES - 1, np.int64)
        self.kind[: self.head], self.kind[-1] = classes, CLASSES

    def sequence(self, codes: list[bytes], rare: list[bytes]) -> dict[str, np.ndarray]:
        """Of each token of the texts: number, hash, and history classes one and two before; `at` are their places between the starts."""
        start, parts = np.full(2, self.size + 1, np.int64), []
        for c in codes:
            parts += [start, unpacked(c)]
        number = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        hashes = self.hash[number]
        hashes[number == self.size] = np.frombuffer(b"".join(rare), np.uint64)
        kind, at = self.kind[number], np.flatnonzero(number != self.size + 1)
        return {"all": number, "hashes": hashes, "at": at, "number": number[at], "class": kind[at], "one": kind[at - 1], "two": kind[at - 2]}

    @staticmethod
    def features(x: dict[str, np.ndarray]) -> np.ndarray:
        a, b = x["hashes"][x["at"] - 1], x["hashes"][x["at"] - 2]
        found = [mix64(a) >> np.uint64(64 - BITS[0]), mix64(b + np.uint64(1)) >> np.uint64(64 - BITS[1]), mix64(a * np.uint64(3) + b) >> np.uint64(64 - BITS[2])]
        return (np.stack(found).astype(np.int64) + FIRST[:3, None]).T


def groups_of(batches: Iterator[pa.RecordBatch], codes: int, most: int = 250_000) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with up to `most` tokens (or one row); `codes` is the column's place."""
    for b in batches:
        size = pc.binary_length(b.column(codes)).to_numpy() // 3
        lo = held = 0
        for k, s in enumerate(size):
            if held and held + s > most:
                yield b.slice(lo, k - lo)
                lo, held = k, 0
            held += s
        if lo < b.num_rows:
            yield b.slice(lo)


def powers(weights: np.ndarray, features: np.ndarray, room: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """exp of the sums of the features' weights, each row up to a factor of its own; `room`: two arrays to work in, the first one is returned."""
    x, more = (a[: len(features)] for a in room or (np.empty((len(features), weights.shape[1]), weights.dtype) for _ in range(2)))
    weights.take(features[:, 0], 0, out=x, mode="clip")
    for k in (1, 2):
        weights.take(features[:, k], 0, out=more, mode="clip")
        x += more
    if len(x) and not -60 < x.min() <= x.max() < 60:  # else nothing overflows, and no row's sum gets 0
        x -= x.max(axis=1, keepdims=True)
    return np.exp(x, out=x)


def probabilities(weights: np.ndarray, features: np.ndarray, room: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    x = powers(weights, features, room)
    x /= np.einsum("ij->i", x)[:, None]
    return x


def room_for(weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.empty((BATCH, weights.shape[1]), weights.dtype), np.empty((BATCH, weights.shape[1]), weights.dtype)


def sums_by_row(rows: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows (16 bits), the sum of each one's lines of p, and how many; rows[i] belongs to line i % len(p).

    The k-th lines of all rows are added together, as adding up a row at a time costs more than the sums themselves."""
    order = np.argsort(rows, kind="stable")  # of 16 bits: sorted by radix
    rows, line = rows[order], order % len(p)
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    n = np.diff(first, append=len(rows))
    by = np.argsort(-n, kind="stable")
    first, n = first[by], n[by]
    g, longer = p.take(line[first], 0), np.searchsorted(-n, -np.arange(1, SINGLY + 1))
    for k, m in enumerate(longer[:-1], 1):
        g[:m] += p.take(line[first[:m] + k], 0)
    if m := longer[-1]:
        left = n[:m] - SINGLY
        at = np.cumsum(left) - left
        rest = np.repeat(first[:m] + SINGLY - at, left) + np.arange(left.sum())
        g[:m] += np.add.reduceat(p.take(line[rest], 0), at, axis=0)
    return rows[first], g, n


def steps(weights: np.ndarray, squares: np.ndarray, used: np.ndarray, features: np.ndarray, target: np.ndarray, rate: float) -> None:
    """Gradient steps over small batches, each weight at its own pace; `used` counts how often each row took part."""
    room = room_for(weights)
    for lo in range(0, len(target), BATCH):
        f, y = features[lo : lo + BATCH], target[lo : lo + BATCH]
        p = probabilities(weights, f, room)
        p[np.arange(len(y)), y] -= 1
        rows, g, n = sums_by_row(f.T.astype(np.uint16).ravel(), p)
        used[rows] += n
        x = squares.take(rows, 0)
        x += g * g
        squares[rows] = x
        x += np.float32(1e-3)
        g *= np.float32(rate)
        g /= np.sqrt(x, out=x)
        weights[rows] -= g


def summed(rows: DataFrame, many: bool) -> dict[int, np.ndarray]:
    """Sums vectors by block in order of their part, in two rounds so that no task gets them all; a fixed number of blocks reaches the driver."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        total = np.frombuffer(group["values"].iloc[0], np.float32).astype(np.float64)
        for x in group["values"].iloc[1:]:
            total += np.frombuffer(x, np.float32)
        return pd.DataFrame({"block": group["block"].iloc[:1], "part": group["part"].iloc[:1] % 32, "values": [total.astype(np.float32).tobytes()]})

    schema = "block int, part int, values binary"
    if many:
        rows = rows.withColumn("slot", F.col("part") % 32).groupBy("block", "slot").applyInPandas(lambda g: add(g.drop(columns="slot")), schema)
    return {r.block: np.frombuffer(r["values"], np.float32).astype(np.float64) for r in rows.groupBy("block").applyInPandas(add, schema).collect()}


def vectors(first: int, part: int, values: list[np.ndarray]) -> pa.RecordBatch:
    data = [v.astype(np.float32).tobytes() for v in values]
    return pa.RecordBatch.from_arrays([pa.array(range(first, first + len(data)), pa.int32()), pa.array([part] * len(data), pa.int32()), pa.array(data, pa.binary())], names=["block", "part", "values"])


def clusters(after: np.ndarray, classes: int, rounds: int = 15) -> np.ndarray:
    """Class of each head word, by the words before it: spherical k-means, seeded by the words furthest from the seeds so far."""
    x = np.sqrt(after / np.maximum(after.sum(axis=1, keepdims=True), 1))
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    seeds = [0]
    near = x @ x[0]
    frequent = np.arange(len(x)) < max(classes, min(1024, len(x) // 2))
    for _ in range(classes - 1):
        seeds.append(int(np.argmin(np.where(frequent, near, 2.0))))
        near = np.maximum(near, x @ x[seeds[-1]])
    centres = x[seeds]
    own = np.zeros(len(x), np.int64)
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        for k in range(classes):
            if (own == k).any():
                c = x[own == k].sum(axis=0)
                centres[k] = c / max(np.linalg.norm(c), 1e-9)
    return own


class Inside:
    """The word model inside one class: bias, n-gram and skip weights of words, from their counts and the shared normaliser.

    The sum over words of exp(bias + u[one] + v[two]) is a product of matrices, for words of any number."""

    def __init__(self, one: np.ndarray, two: np.ndarray, shares: tuple[np.ndarray, np.ndarray]):
        """one, two: (words, PAST) counts by history class; shares: of the history classes before the class's words."""
        self.n = one.sum(axis=1)
        part = (self.n / (self.n + PRIOR))[:, None]
        self.one, self.two = (one + PRIOR * shares[0]) * part, (two + PRIOR * shares[1]) * part
        self.bias, self.u, self.v = np.log(self.n + 0.5), np.zeros(one.shape), np.zeros(two.shape)

    def total(self) -> np.ndarray:
        return (np.exp(self.bias)[:, None] * np.exp(self.u)).T @ np.exp(self.v)

    def step(self, ratio: np.ndarray) -> None:
        """ratio: (PAST, PAST) seen contexts of the class over its normaliser. Three features act at each word, so each moves by a third of a log-ratio."""
        up, vp = np.exp(self.bias)[:, None] * np.exp(self.u), np.exp(self.v)
        e1, e2 = up * (vp @ ratio.T), vp * (up @ ratio)
        self.bias += np.log((self.n + 1) / (e1.sum(axis=1) + 1)) / 3
        self.u += np.log((self.one + 1e-3) / (e1 + 1e-3)) / 3
        self.v += np.log((self.two + 1e-3) / (e2 + 1e-3)) / 3


def shares_of(joint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the two history classes, from a class's (PAST, PAST) contexts."""
    total = max(joint.sum(), 1.0)
    return joint.sum(axis=1) / total, joint.sum(axis=0) / total


def head_weights(one: np.ndarray, two: np.ndarray, joint: np.ndarray, classes: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """bias (head), u and v (head, PAST), and log-normaliser (PAST, PAST, CLASSES) of the classes of the head. The last class's stays 0."""
    bias, u, v, norm = np.zeros(len(classes)), np.zeros(one.shape), np.zeros(two.shape), np.zeros((PAST, PAST, CLASSES))
    for k in range(CLASSES - 1):
        w = np.flatnonzero(classes == k)
        if not len(w):
            continue
        inside = Inside(one[w], two[w], shares_of(joint[:, :, k]))
        for _ in range(rounds):
            inside.step(joint[:, :, k] / inside.total())
        bias[w], u[w], v[w], norm[:, :, k] = inside.bias, inside.u, inside.v, np.log(inside.total())
    return bias, u, v, norm


def records(rows: DataFrame, space, tag: str, buckets: int, with_docs: bool) -> DataFrame:
    """The tokens outside the head (or, with_docs, those that are not frequent) by bucket of their word: hashes, contexts (one * PAST + two), and their counts or rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, held = kept(("space", tag), lambda: Space(*received(space))), [], 0

        def flush() -> pa.RecordBatch:
            h, c, r = (np.concatenate(x) for x in zip(*waiting, strict=True))
            order = np.lexsort((r, c, h) if with_docs else (c, h))
            h, c, r = h[order], c[order], r[order]
            if not with_docs:  # equal ones are counted
                first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
                h, c, r = h[first], c[first], np.diff(first, append=len(h)).astype(np.int64)
            own = (h % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(own, kind="stable")
            h, c, r, own = h[order], c[order], r[order], own[order]
            cut = [*np.flatnonzero(np.diff(own, prepend=-1)), len(own)]
            spans = list(zip(cut[:-1], cut[1:], strict=True))
            columns = [pa.array([x[i:j].tobytes() for i, j in spans], pa.binary()) for x in (h, c, r if with_docs else r.astype(np.uint32))]
            return pa.RecordBatch.from_arrays([pa.array(own[cut[:-1]], pa.int32()), *columns], names=["bucket", "hashes", "contexts", "counts"])

        for b in groups_of(batches, 1):
            x = known.sequence(b.column(1).to_pylist(), b.column(2).to_pylist())
            k = np.flatnonzero(x["number"] >= (known.size if with_docs else known.head))
            if len(k):
                of = np.repeat(b.column(0).to_numpy(), b.column(3).to_numpy())[k] if with_docs else np.zeros(len(k), np.int64)
                waiting.append((x["hashes"][x["at"][k]], (x["one"][k] * PAST + x["two"][k]).astype(np.uint16), of))
                held += len(k)
            if held > 1_000_000:
                yield flush()
                waiting, held = [], 0
        if held:
            yield flush()

    return rows.select("row", "codes", "rare", "n_tokens").mapInArrow(each, RECORDS)


def word_table(found: DataFrame) -> DataFrame:
    """RECORDS with each word's contexts counted, one row a bucket, in order of hash."""

    def add(group: pa.Table) -> pa.Table:
        h, c, n = (np.frombuffer(b"".join(group.column(name).to_pylist()), t) for name, t in (("hashes", np.uint64), ("contexts", np.uint16), ("counts", np.uint32)))
        order = np.lexsort((c, h))
        h, c, n = h[order], c[order], n[order]
        first = np.flatnonzero(np.append(True, (h[1:] != h[:-1]) | (c[1:] != c[:-1])))
        n = np.add.reduceat(n.astype(np.uint32), first)
        return pa.table({"bucket": pa.array([group.column("bucket")[0].as_py()], pa.int32()), "hashes": pa.array([h[first].tobytes()]), "contexts": pa.array([c[first].tobytes()]), "counts": pa.array([n.astype(np.uint32).tobytes()])})

    return found.groupBy("bucket").applyInArrow(add, RECORDS)


def bucket_words(hashes: bytes, contexts: bytes, counts: bytes, shares: tuple[np.ndarray, np.ndarray], ratios: list[np.ndarray]) -> tuple[np.ndarray, Inside]:
    """Words of a bucket (ascending hashes) and their weights after a step for each ratio."""
    h, c, n = np.frombuffer(hashes, np.uint64), np.frombuffer(contexts, np.uint16).astype(np.int64), np.frombuffer(counts, np.uint32)
    word, inverse = np.unique(h, return_inverse=True)
    one, two = (np.bincount(inverse * PAST + k, n, len(word) * PAST).reshape(-1, PAST) for k in (c // PAST, c % PAST))
    inside = Inside(one, two, shares)
    for ratio in ratios:
        inside.step(ratio)
    return word, inside


def outside_total(words: DataFrame, shares: tuple[np.ndarray, np.ndarray], ratios: list[np.ndarray]) -> np.ndarray:
    """Normaliser (PAST, PAST) of the class of all other words after a step for each ratio; the unknown word is half a count."""
    sent = send(words.sparkSession, (shares, ratios))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = received(sent)
        for b in batches:
            for key, *data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([key % 64], pa.int32()), pa.array([key], pa.int32()), pa.array([bucket_words(*data, *done)[1].total().tobytes()])], names=["block", "part", "values"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x) for x in group.sort_values("part")["values"]], axis=0)
        return pd.DataFrame({"block": group["block"].iloc[:1], "part": [0], "values": [total.tobytes()]})

    schema = "block int, part int, values binary"
    parts = words.mapInArrow(each, schema).groupBy("block").applyInPandas(add, schema).collect()  # 64 at most
    return sum((np.frombuffer(r["values"]).reshape(PAST, PAST) for r in sorted(parts, key=lambda r: r.block)), np.full((PAST, PAST), 0.5))


class Model:
    """Everything that scoring takes from the corpus, but for the words that are not frequent."""

    def __init__(self, space: Space, weights: np.ndarray, bias: np.ndarray, u: np.ndarray, v: np.ndarray, norm: np.ndarray):
        """bias, u, v: of the frequent words; norm: log-normaliser of all classes."""
        self.space, self.weights, self.bias, self.u, self.v, self.norm = space, weights.astype(np.float32), bias, u, v, norm

    def log10(self, x: dict[str, np.ndarray]) -> np.ndarray:
        """Of each token of a sequence; words that are not frequent lack their own bias and weights."""
        features, p, room = self.space.features(x), np.empty(len(x["at"])), room_for(self.weights)
        for lo in range(0, len(p), BATCH):
            s = slice(lo, lo + BATCH)
            e = powers(self.weights, features[s], room)
            p[s] = e[np.arange(len(e)), x["class"][s]] / np.einsum("ij->i", e)
        p = np.log(np.maximum(p, 1e-30))
        pair = x["one"] * PAST + x["two"]
        k = x["number"] < self.space.size
        w = x["number"][k]
        p[k] += self.bias[w] + self.u.ravel()[w * PAST + x["one"][k]] + self.v.ravel()[w * PAST + x["two"][k]]
        return (p - self.norm.ravel()[pair * CLASSES + x["class"]]) / LOG10


def classes_for(tokens: int) -> int:
    """Classes of head words: they grow with the corpus, up to CLASSES - 1."""
    return int(min(CLASSES - 1, max(2, tokens ** (1 / 3) / 6)))


def fit_classes(train: DataFrame, space: tuple, shares: np.ndarray, shards: int, rounds: int, tag: str) -> np.ndarray:
    """Weights of the class model: rounds of shards, as the module's text says. Each history starts from the classes' own shares."""
    spark, block = train.sparkSession, 2048
    weights = np.tile((np.log(np.maximum(shares, 1e-13)) / 3).astype(np.float32), (FIRST[3], 1))
    sent_space = send(spark, space)
    train = train.withColumn("shard", F.pmod(F.xxhash64("doc_id", "mark"), F.lit(shards)).cast("int"))
    for k in range(rounds):
        sent, rate = send(spark, weights), 0.1 / np.sqrt(k + 1)

        def learn(batches: Iterator[pa.RecordBatch], sent=sent, rate=rate) -> Iterator[pa.RecordBatch]:
            known, own = kept(("space", tag), lambda: Space(*received(sent_space))), None

            def out() -> Iterator[pa.RecordBatch]:
                for at, lo in enumerate(range(0, FIRST[3], block)):
                    n = used[lo : lo + block]
                    if n.any():
                        yield vectors(at, own, [np.concatenate([n, (w[lo : lo + block] * n[:, None]).ravel()])])

            for b in groups_of(batches, 1):
                shard = b.column(0).to_numpy()
                cut = [0, *(np.flatnonzero(np.diff(shard)) + 1), len(shard)]
                for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                    if shard[lo] != own:
                        if own is not None:
                            yield from out()
                        own, w = int(shard[lo]), received(sent).copy()
                        squares, used = np.zeros_like(w), np.zeros(len(w), np.float32)
                    x = known.sequence(b.column(1).slice(lo, hi - lo).to_pylist(), b.column(2).slice(lo, hi - lo).to_pylist())
                    steps(w, squares, used, known.features(x), x["class"], rate)
            if own is not None:
                yield from out()

        mine = train.where(F.col("shard") % rounds == k).select("shard", "codes", "rare", "doc_id", "mark")
        mine = mine.repartition(4 * -(-shards // rounds), "shard").sortWithinPartitions("shard", "doc_id", "mark").select("shard", "codes", "rare")
        for at, total in summed(mine.mapInArrow(learn, "block int, part int, values binary"), shards > 32 * rounds).items():
            n = total[: len(total) // (CLASSES + 1)]
            mean = total[len(n) :].reshape(-1, CLASSES) / np.maximum(n, 1)[:, None]
            rows = slice(at * block, at * block + len(n))
            weights[rows] = np.where(n[:, None] > 0, mean, weights[rows])
    return weights


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every whole text."""
    spark, tag = docs.sparkSession, uuid.uuid4().hex
    rows = _rows(docs, id_col, text_col)
    counts = written(count_words(rows.where("not held_out")), "counts")
    sizes = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("words"), F.count(F.lit(1)).alias("kinds")).first()
    seen = rows.where("not held_out").agg(F.count(F.lit(1)).alias("texts"), F.coalesce(F.sum(F.octet_length("data").cast("long")), F.lit(0)).alias("bytes")).first()
    total, kinds = sizes.words + seen.texts, sizes.kinds + (seen.texts > 0)
    top = counts.orderBy(F.desc("n"), "hash").limit(FREQUENT - 1).toArrow()
    hashes, n = top.column(0).to_numpy().astype(np.int64), top.column(1).to_numpy().astype(np.float64)
    order = np.lexsort((hashes, -n))
    hashes, n = np.append(END_HASH, hashes[order].view(np.uint64)), np.append(float(seen.texts), n[order])
    text = written(encoded(rows, send(spark, hashes), tag), "encoded")
    train, head = text.where("not held_out"), min(HEAD, len(hashes))
    plain = send(spark, (hashes, np.zeros(head, np.int64)))
    # tables that each task sends whole are summed in few tasks, so that they stay small against the input
    few = train.coalesce(max(1, -(-seen.bytes // shard), spark.sparkContext.defaultParallelism))
    schema = "block int, part int, values binary"

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, found = kept(("plain", tag), lambda: Space(*received(plain))), np.zeros(head * (ANCHORS + 1))
        for b in groups_of(batches, 0):
            x = known.sequence(b.column(0).to_pylist(), b.column(1).to_pylist())
            k, before = x["number"] < head, np.minimum(x["all"][x["at"] - 1], ANCHORS)
            found += np.bincount(x["number"][k] * (ANCHORS + 1) + before[k], minlength=len(found))
        yield vectors(0, TaskContext.get().partitionId(), [found])

    got = summed(few.select("codes", "rare").mapInArrow(anchored, schema), True)
    after = got[0].reshape(head, ANCHORS + 1) if got else np.zeros((head, ANCHORS + 1))
    classes = clusters(after, min(classes_for(total), head))
    shares = np.bincount(classes, n[:head] + 0.5, CLASSES)
    shares[-1] = total - n[:head].sum() + 0.5
    shards = max(1, round(seen.bytes / shard))
    weights = fit_classes(train, (hashes, classes), shares / shares.sum(), shards, min(ROUNDS, shards), tag)
    space = send(spark, (hashes, classes))

    def tabled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = kept(("space", tag), lambda: Space(*received(space)))
        one, two, joint = np.zeros(head * PAST), np.zeros(head * PAST), np.zeros(PAST * PAST * CLASSES)
        for b in groups_of(batches, 0):
            x = known.sequence(b.column(0).to_pylist(), b.column(1).to_pylist())
            k = x["number"] < head
            one += np.bincount(x["number"][k] * PAST + x["one"][k], minlength=len(one))
            two += np.bincount(x["number"][k] * PAST + x["two"][k], minlength=len(two))
            joint += np.bincount((x["one"] * PAST + x["two"]) * CLASSES + x["class"], minlength=len(joint))
        yield vectors(0, TaskContext.get().partitionId(), [one, two, joint])

    got = summed(few.select("codes", "rare").mapInArrow(tabled, schema), True)
    one, two = (got[k].reshape(head, PAST) if got else np.zeros((head, PAST)) for k in (0, 1))
    joint = got[2].reshape(PAST, PAST, CLASSES) if got else np.zeros((PAST, PAST, CLASSES))
    head_bias, head_u, head_v, norm = head_weights(one, two, joint, classes)
    # the words outside the classes
    buckets = max(64, int(joint[:, :, -1].sum()) // BUCKET)
    words = written(word_table(records(train, space, tag, buckets, False)), "words")
    shares, ratios = shares_of(joint[:, :, -1]), []
    for _ in range(STEPS):
        ratios.append(joint[:, :, -1] / outside_total(words, shares, ratios))
    norm[:, :, -1] = np.log(outside_total(words, shares, ratios))
    done, frequent = send(spark, (shares, ratios)), send(spark, np.sort(hashes[head:]))

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps_done, mine = received(done), received(frequent)
        for b in batches:
            for _, *data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                word, inside = bucket_words(*data, *steps_done)
                k = np.isin(word, mine)
                values = np.concatenate([inside.bias[k, None], inside.u[k], inside.v[k]], axis=1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([word[k].tobytes()]), pa.array([values.tobytes()])], names=["hashes", "values"])

    bias, u, v = (np.concatenate([x, np.zeros((len(hashes) - head, *x.shape[1:]))]).astype(np.float32) for x in (head_bias, head_u, head_v))
    if len(hashes) > head:  # at most FREQUENT words
        place = {int(h): k for k, h in enumerate(hashes)}
        for r in words.mapInArrow(weighed, "hashes binary, values binary").where("length(hashes) > 0").toArrow().to_pylist():  # one job
            at, x = [place[h] for h in np.frombuffer(r["hashes"], np.uint64).tolist()], np.frombuffer(r["values"], np.float32).reshape(-1, 1 + 2 * PAST)
            bias[at], u[at], v[at] = x[:, 0], x[:, 1 : 1 + PAST], x[:, 1 + PAST :]
    model = send(spark, Model(Space(hashes, classes), weights, bias, u, v, norm))
    log_counts, whole = np.append(np.log10(n + 0.5), 0.0), float(np.log10(total + 0.5 * (kinds + 1)))
    sent_counts = send(spark, log_counts)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, logs = kept(("model", tag), lambda: (received(model), received(sent_counts)))
        for b in groups_of(batches, 4):
            x = m.space.sequence(b.column(4).to_pylist(), b.column(5).to_pylist())
            size = b.column(3).to_numpy()
            starts = np.cumsum(size) - size
            common = np.add.reduceat((x["number"] < m.space.size).astype(np.int64), starts)
            base, own = np.add.reduceat(logs[x["number"]] - whole, starts), np.add.reduceat(m.log10(x), starts)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(common), pa.array(base), pa.array(own)], names=["row", "doc_id", "held_out", "n_tokens", "common", "base", "own"])

    found = text.select("row", "doc_id", "held_out", "n_tokens", "codes", "rare").mapInArrow(each, "row long, doc_id long, held_out boolean, n_tokens long, common long, base double, own double")

    def joined(key: tuple, asked: pa.Table, known: pa.Table) -> pa.Table:
        """Sums over the asked tokens of each text: words known, log10 of counts, and what the words' own weights add to the score."""
        h, c, row = (np.frombuffer(b"".join(asked.column(name).to_pylist()), t) for name, t in (("hashes", np.uint64), ("contexts", np.uint16), ("counts", np.int64)))
        c, own, count = c.astype(np.int64), np.full(len(h), np.log(0.5)), np.zeros(len(h))
        if known.num_rows and len(h):
            word, inside = bucket_words(*(known.column(name)[0].as_py() for name in ("hashes", "contexts", "counts")), *received(done))
            at = np.minimum(np.searchsorted(word, h), len(word) - 1)
            k = word[at] == h
            at = at[k]
            own[k], count[k] = inside.bias[at] + inside.u[at, c[k] // PAST] + inside.v[at, c[k] % PAST], inside.n[at]
        order = np.lexsort((own, count, row))  # sums in a fixed order
        row, own, count = row[order], own[order], count[order]
        first = np.flatnonzero(np.diff(row, prepend=-1)) if len(row) else np.zeros(0, np.int64)
        sums = [np.add.reduceat(x, first) if len(first) else x for x in ((count > 0).astype(np.int64), np.log10(count + 0.5), own / LOG10)]
        return pa.table({"row": row[first], "more": sums[0], "logs": sums[1], "extra": sums[2]})

    asked = records(text, space, tag, buckets, True).groupBy("bucket")
    sums = asked.cogroup(words.groupBy("bucket")).applyInArrow(joined, "row long, more long, logs double, extra double")
    sums = sums.groupBy("row").agg(F.sum("more").alias("more"), F.sum("logs").alias("logs"), F.sum("extra").alias("extra"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.join(sums, "row", "left").select("doc_id", "held_out", "n_tokens", (F.col("common") + zero("more")).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"), (F.col("base") + zero("logs")).alias("base_score"), (F.col("own") + zero("extra")).alias("score"))
