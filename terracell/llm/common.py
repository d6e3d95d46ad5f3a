"""Helpers that the operators share: shared folders, arrow loops, word hashing."""

from __future__ import annotations

import gc
import os
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words; what is between is a word.
WORD_SPACE = r"[\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the driver and all executors share (spark.checkpoint.dir).

    Where the session has none, as in tests, a local master gets a temporary folder and any other the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
            base = os.path.join(tempfile.gettempdir(), "terracell-shared")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_llm"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(col: str | Column) -> Column:
    """Bytes of a text; null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")).cast("binary")


def id_crc(col: str) -> Column:
    """crc32 of the id's decimal text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(fn, schema)


def list_array(lengths: np.ndarray, values: np.ndarray) -> pa.ListArray:
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words (the finaliser of MurmurHash3, public domain)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijection of 32-bit words (MurmurHash3's finaliser), in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(13)
    x *= np.uint32(0xC2B2AE35)
    x ^= x >> np.uint32(16)
    return x


#: Bytes (or characters) of words that a word memory holds; longer words than LONG are never remembered by WordHashes.
MEMORY, LONG = 32 << 20, 256


class WordHashes(dict):
    """Maps a word (bytes) to its 64-bit hash, remembering up to `most` words of up to LONG bytes; the hash never depends on the memory."""

    def __init__(self, most: int = 600_000):
        super().__init__()
        self.most, self.held = most, 0

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= LONG:
            if len(self) >= self.most or self.held >= MEMORY:
                self.clear()
                self.held = 0
            self[word] = h
            self.held += len(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class WordCodes(dict):
    """Maps a word to a small code; `learn` gets each new word once, in order of codes. To be cleared once it is full, at `most` words or MEMORY bytes of
    them, so memory is bounded by that and one text."""

    def __init__(self, most: int = 500_000):
        super().__init__()
        self.most, self.held = most, 0
        self.new: list = []

    def __missing__(self, word) -> int:
        c = self[word] = len(self)
        self.held += len(word)
        self.new.append(word)
        return c

    def clear(self) -> None:
        super().clear()
        self.held = 0

    def full(self) -> bool:
        return len(self) >= self.most or self.held >= MEMORY


def ascii_words(data: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, A-Z in lower case (both only touch ASCII bytes)."""
    return data.lower().split()


class ChunkCache:
    """Integer sequences of chunks of text, each worked out once by `work(new chunks)`: a list of sequences, or all their
    integers, where each sequence begins in those and how many it has.

    Arrow finds the distinct chunks of a call, so only those are looked up.  Holds about `most` chunks; when full it keeps those that several calls had, if
    they are less than half, and else starts anew, so memory is bounded and results never depend on it."""

    def __init__(self, work: Callable[[list[str]], list], most: int = 600_000):
        self.work, self.codes = work, WordCodes(most)
        self.clear()

    def clear(self) -> None:
        self.codes.clear()
        self.ids, self.start, self.count = np.zeros(1 << 20, np.int32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.calls = np.zeros(1 << 16, np.int32)
        self.used = self.known = 0

    def _shrink(self) -> None:
        often = np.flatnonzero(self.calls[: self.known] > 1)
        names = list(self.codes)
        names = [names[i] for i in often]
        if 2 * len(names) > self.codes.most or 2 * (held := sum(map(len, names))) > MEMORY:
            return self.clear()
        ids, n = self._spread(often)
        self.clear()
        self.codes.update(zip(names, range(len(names)), strict=True))
        self.codes.held = held
        self._add(ids, np.cumsum(n) - n, n)
        self.calls[: self.known] = 1

    def _add(self, flat: np.ndarray, first: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.known + len(n) > len(self.start):
            self.start, self.count, self.calls = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.count, self.calls))
        self.ids[self.used : self.used + len(flat)] = flat
        self.start[self.known : self.known + len(n)] = self.used + first
        self.count[self.known : self.known + len(n)] = n
        self.used, self.known = self.used + len(flat), self.known + len(n)

    def _learn(self) -> None:
        chunks, self.codes.new = self.codes.new, []
        for lo in range(0, len(chunks), 20_000):
            got = self.work(chunks[lo : lo + 20_000])
            if isinstance(got, tuple):
                flat, first, n = got
            else:
                n = np.fromiter(map(len, got), np.int64, len(got))
                flat, first = np.fromiter((i for x in got for i in x), np.int32, int(n.sum())), np.cumsum(n) - n
            self._add(flat, first, n)

    def _spread(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.count[codes]
        ends = np.cumsum(n)
        return self.ids[np.repeat(self.start[codes] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)], n

    def __call__(self, chunks: list[str]) -> np.ndarray:
        """The sequences of the chunks, one after the other."""
        return self.sequences(chunks)[0]

    def sequences(self, chunks: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same, and how many integers each chunk has."""
        if self.codes.full():
            self._shrink()
        kinds = (chunks if isinstance(chunks, pa.Array) else pa.array(chunks, pa.string())).dictionary_encode()
        codes = np.fromiter(map(self.codes.__getitem__, kinds.dictionary.to_pylist()), np.int64, len(kinds.dictionary))
        if self.codes.new:
            self._learn()
        self.calls[codes] += 1
        return self._spread(codes[kinds.indices.to_numpy()])


def slices(column: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """First row and number of rows of slices of at most `most` bytes of text, or of one row."""
    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi - lo
        lo = hi


def kept(key: tuple, make: Callable):
    """make()'s result, kept in this Python process for the tasks that follow; only the latest such object stays, as executors' memory is small.

    Only for memories that no result depends on.  This package travels by value, so a task has module globals of its own; what lasts is held by sys.modules."""
    held = sys.modules.setdefault("_terracell_kept", types.ModuleType("_terracell_kept")).__dict__.setdefault("held", {})
    if key not in held:
        held.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        held[key] = make()
    return held[key]


def bloom_bits(ids: DataFrame, col: str, bits: int, hashed: bool = True) -> np.ndarray:
    """A Bloom filter of a column of longs (two hashes, or for longs that are hashes their own low and high half), as `bits` / 8 bytes: all that reaches the
    driver, however many ids."""
    two = [F.xxhash64(F.col(col), F.lit(k)) if hashed else F.shiftright(col, 32 * k) for k in range(2)]
    places = F.explode(F.array(*[F.pmod(x, F.lit(bits)) for x in two]))
    words = ids.select(places.alias("place")).groupBy(F.expr("cast(shiftright(place, 5) as int)").alias("word"))
    rows = words.agg(F.expr("bit_or(shiftleft(1L, cast(place & 31 as int)))").alias("mask"))
    out = np.zeros(bits // 32, np.uint32)
    got = rows.toArrow()
    out[got.column(0).to_numpy()] = got.column(1).to_numpy().astype(np.uint32)
    return out


def send(spark: SparkSession, thing):
    """Broadcasts any object of this package, by value."""
    from pyspark import cloudpickle

    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def received(sent):
    from pyspark import cloudpickle

    return cloudpickle.loads(sent.value)


def filtered(docs: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows of docs, with all their columns, for which keep says so."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(keep(b), pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
