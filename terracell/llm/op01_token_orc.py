"""Token ids as ORC: range-sorted files whose integer columns are run-length encoded, with row indexes and Bloom filters on document ids.

Layout, one row per document, ascending by id over all files: ``id``, ``part`` (number of the writing task, ascending as the ids),
``local_start`` (ids of the documents before it in its part), ``n_tokens``, ``tokens`` (array<int>, ORC's integer RLE v2).
Stripes are the unit of parallel reads; stripe statistics, row indexes and Bloom filters on ``id`` prune lookups.

Null texts count as empty; null ids sort first; rows that repeat an id each keep a row of their own, by the first characters of their text and
then as they come, so no id, missing or not, fills a task alone.  Other columns of the input are ignored.  An empty table gives an empty, readable
folder.  Memory: one arrow batch, plus a word memory bounded in words and bytes; texts with very long words are encoded whole.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terracell.llm.common import ChunkCache, kept, list_array, slices

#: A mark between a letter and a blank: the vocabulary's rules part it from both, so the word before needs no place of its own in the memory.
MARK = re.compile(r"([.,;:!?])(?<=[a-z].)(?= )")
#: Texts on which word by word and whole texts must agree.
PROBES = ["The end. It's 12,5% (don't) -- A,B;c!", "x\ty  z\n\nÀé naïve ÉCOLE", "日本語 テスト, ok? ...no", "a.b c: d;e\u00a0f"]
#: Words on which the library with the merges alone must agree with the library as the file sets it up: all letters below U+0100, alone and in words.
LATIN = [c for c in map(chr, range(256)) if c.isalpha()]
LATIN += ["".join(LATIN[k : k + 7]) for k in range(len(LATIN))] + ["the", "There", "nation", "éleçque", "straße", "ciónmente", "ÉCOLE", "naïve", "ourselves"]
#: How byte-level merges write bytes: printable ones of Latin-1 as they are, all others from U+0100 on. The blank stays, it parts words.
BYTE_LETTERS = {b: 256 + k for k, b in enumerate([*range(33), *range(127, 161), 173]) if b != 32}
SCHEMA = "id long, part int, local_start long, n_tokens long, tokens array<int>"


class WordTokenizer:
    """Encodes whole texts with the tokenizers library, word by word.

    The vocabulary's own rules drop white space and never merge across it, so a text's ids are the ids of its blank-separated
    words in turn; words met before are not encoded again.  Whether that holds for the vocabulary at hand is tried on PROBES first; if it doesn't,
    and for texts with a string of an added (special) token, the library encodes whole texts.  All its settings are its own."""

    def __init__(self, path: str, end_id: int | None, most: int = 600_000, longest: int = 64):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end = np.array([] if end_id is None else [end_id], np.int32)
        self.longest, self.cache = longest, ChunkCache(self._plain, most)
        rules = json.loads(self.tokenizer.to_str())
        suffix = rules["model"].get("end_of_word_suffix")
        self.added = [x["content"].lower() for x in rules.get("added_tokens") or []]
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        if suffix:
            self.closing[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self.gap = self._ids(" \0 ")
        self.bare = None
        if rules["model"].get("type") == "BPE":
            bare = rules | {"normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            found = self._latin(LATIN)
            if found is None or [x.tolist() for x in np.split(found[0], np.cumsum(found[1])[:-1])] != [self._ids(x).tolist() for x in LATIN]:
                self.bare = None
        whole = [x.ids for x in self.tokenizer.encode_batch(PROBES, add_special_tokens=False)]
        ids, n = self.encode(PROBES)
        if [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] != [x + self.end.tolist() for x in whole]:
            self.longest = -1

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)

    def _letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and their number for words of letters only: each is one piece, so its last id closes a word. None if that fails."""
        ids = self._ids(" ".join(words))
        ends = np.flatnonzero(self.closing[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else None

    def _latin(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for words of letters below U+0100, by the library with the vocabulary's merges alone: in lower case they are in their normal form and one
        piece each, so only their bytes have to be written as the merges write them."""
        text = " ".join(words)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
        text = text.lower().encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int32)
        ends = np.flatnonzero(self.closing[ids]) + 1
        return (ids, np.diff(ends, prepend=0)) if len(ends) == len(words) else None

    def _parted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """The same for any words, told apart by a sign between them. None if they hold that sign."""
        if len(self.gap) != 1:
            return None
        ids = self._ids(" \0 ".join(words))
        gaps = np.flatnonzero(ids == self.gap[0])
        if len(gaps) != len(words) - 1:
            return None
        return np.delete(ids, gaps), np.diff(gaps, prepend=-1, append=len(ids)) - 1

    def _one_by_one(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        n = np.array([len(x.ids) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x.ids), np.int32, int(n.sum())), n

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of many words from few calls, and where each word's begin and how many they are."""
        flat, start, count, used = [], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), 0
        plain = np.fromiter(map(str.isalpha, words), bool, len(words))
        for of_letters, way in ((True, self._letters), (False, self._parted)):
            places = np.flatnonzero(plain == of_letters)
            step = 500 if of_letters and self.bare else 5000
            for lo in range(0, len(places), step):
                at = places[lo : lo + step]
                part = [words[i] for i in at]
                ids, n = of_letters and self.bare and self._latin(part) or way(part) or self._one_by_one(part)
                start[at], count[at] = used + np.cumsum(n) - n, n
                flat.append(ids)
                used += len(ids)
        return np.concatenate(flat), start, count

    def spaced(self, text: str) -> str | None:
        """The text with a blank wherever its words part; None if it has a string of an added token."""
        lower = text.lower()
        if any(map(lower.__contains__, self.added)):
            return None
        try:  # below U+0100 lower-casing is letter by letter and keeps the normal form, so case need not be remembered
            text.encode("latin-1")
            text = lower
        except UnicodeEncodeError:
            pass
        return MARK.sub(r" \1", text.replace("\n", " "))

    def encode(self, texts: list[str], together: int = 8 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each text has; texts go in groups of about `together` characters."""
        ends, lo, parts, lengths = np.cumsum([len(t) for t in texts], dtype=np.int64), 0, [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + together, "right")))
            ids, n = self._group(texts[lo:hi])
            parts.append(np.insert(ids, np.cumsum(n).repeat(len(self.end)), np.tile(self.end, len(n))))
            lengths.append(n + len(self.end))
            lo = hi
        return np.concatenate(parts), np.concatenate(lengths)

    def _group(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        spaced = [self.spaced(t) if self.longest >= 0 else None for t in texts]
        words = pc.split_pattern(pa.array([x or "" for x in spaced], pa.string()), " ")
        longest = np.maximum.reduceat(pc.utf8_length(words.values).to_numpy(), words.offsets.to_numpy()[:-1])
        alone = [k for k, x in enumerate(spaced) if x is None or longest[k] > self.longest]  # such words get no place in the memory
        if alone:
            for k in alone:
                spaced[k] = ""
            words = pc.split_pattern(pa.array(spaced, pa.string()), " ")
        ids, n = self.cache.sequences(words.values)
        n = np.add.reduceat(n, words.offsets.to_numpy()[:-1])
        if alone:
            parts = np.split(ids, np.cumsum(n)[:-1])
            for k in alone:
                parts[k] = self._ids(texts[k])
                n[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, n


def write(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 1, stripe_bytes: int = 16 << 20, index_rows: int = 1000) -> None:
    """Encodes every text and writes the format described above to path.

    Texts are dealt out by ranges of ids before they are encoded, so each is encoded once, in the task that writes it."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, before, part = kept(("tokens", tokenizer, end_id), lambda: WordTokenizer(tokenizer, end_id)), 0, TaskContext.get().partitionId()
        for b in batches:
            for lo, rows in slices(b.column(1)):
                ids, n = tok.encode(b.column(1).slice(lo, rows).to_pylist())
                starts = before + np.cumsum(n) - n
                before += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(lo, rows), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), list_array(n, ids)],
                    names=["id", "part", "local_start", "n_tokens", "tokens"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumns({"begins": F.substring("text", 1, 32), "row": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("id", "begins", "row").sortWithinPartitions("id", "text").select("id", "text")
    out = rows.mapInArrow(encode, SCHEMA).write.option("orc.bloom.filter.columns", "id").option("orc.bloom.filter.fpp", "0.01")
    out.option("orc.row.index.stride", index_rows).option("orc.stripe.size", stripe_bytes).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a written folder; filters on id reach the stripes."""
    return spark.read.schema(SCHEMA).orc(path)


def with_starts(spark: SparkSession, path: str) -> DataFrame:
    """read(), and ``start``: ids of all documents before it. The driver gets one row for each written part, nothing else."""
    rows = read(spark, path)
    parts = sorted(rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    base, firsts = 0, []
    for p, n in parts:
        firsts.append((p, base))
        base += n
    firsts = spark.createDataFrame(firsts, "first_part int, base long")
    return rows.join(F.broadcast(firsts), rows.part == firsts.first_part).withColumn("start", F.col("base") + F.col("local_start")).drop("first_part", "base")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian unsigned 32-bit integers, of with_starts()."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens = b.column(3)
            ends = tokens.offsets.to_numpy()
            values = np.ascontiguousarray(tokens.values.to_numpy(zero_copy_only=False), "<u4")
            crc = [zlib.crc32(values[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("id", "start", "n_tokens", "tokens").mapInArrow(each, "doc_id long, start long, n_tokens long, ids_crc32 long")
