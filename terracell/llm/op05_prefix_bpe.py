"""Byte-level BPE by prefix dynamic programming.

A sequence of tokens is the encoding of its bytes just if each token, and each pair of neighbours, encodes to itself.  So each prefix
of a piece has one valid last token, found from the valid last tokens of shorter prefixes; the table of them is all that is kept.
Appending bytes extends the table; an edit redoes it from the edit to where it agrees with the old one again.
Pieces are the matches of the tokenizer's pattern.  Null texts count as empty; null ids stay null.  Repeated rows keep a row each; other columns are
ignored; an empty table gives an empty result.  Texts of any length are encoded whole, a piece of n bytes in time linear in n; memories of
pieces, prefixes and chunks are bounded, and long pieces are not remembered.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import ChunkCache, kept, list_array, slices


#: Texts without adjoining blanks, on which matches by chunk and of the whole text must agree.
PROBES = ["The end. It's 12,5% (don't) -- A,B;c!\n", "x\ty z\n\nÀé naïve ÉCOLE 1234567 \n q", "日本語 テスト, ok? ...no \t end \r\n", "a.b c: d;e\u00a0f \U0001f642 !\n"]


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PrefixBPE:
    def __init__(self, ranks: dict[bytes, int], most: int = 600_000):
        self.known: dict[bytes, int] = {}
        self.most = most
        self.ranks, self.longest = ranks, max(map(len, ranks), default=1)
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.own: dict[int, bool] = {}
        self.chains: dict[int, tuple[list, list]] = {}
        self.starts = {b[:k] for b in ranks for k in range(len(b) + 1)}
        self.steps: dict[bytes, tuple[bytes, list]] = {}

    def merges(self, data: bytes) -> list[int]:
        """The defining rule: merge the leftmost pair of least rank until none is left. Only for short strings."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ranks[p] for p in parts]

    def stands(self, token: int) -> bool:
        """Whether the token's bytes encode to it alone."""
        if (got := self.own.get(token)) is None:
            got = self.own[token] = self.merges(self.bytes_of[token]) == [token]
        return got

    def edges(self, token: int) -> tuple[list, list]:
        """The right-most and left-most parts of the token while it is merged: (bytes, rank it arises at, rank it is merged away at)."""
        if (got := self.chains.get(token)) is None:
            data = self.bytes_of[token]
            parts = [(data[i : i + 1], -1, None, None) for i in range(len(data))]
            while len(parts) > 1:
                rank, k = min((self.ranks.get(a[0] + b[0], 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                parts[k : k + 2] = [(parts[k][0] + parts[k + 1][0], rank, parts[k], parts[k + 1])]
            got = ([], [])
            for side, out in ((3, got[0]), (2, got[1])):
                node, gone = parts[0], 1 << 60
                while node is not None:
                    out.append((node[0], node[1], gone))
                    node, gone = node[side], node[1]
            self.chains[token] = got
        return got

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens in turn are the encoding of their bytes: no merge crosses their border.

        One would if parts on both sides of the border exist together and form a token whose turn comes before either is merged
        away inside its own token; of equal ranks the left one has its turn first."""
        if (got := self.pairs.get((left, right))) is None:
            if len(self.pairs) > self.most:
                self.pairs.clear()
            get = self.ranks.get
            got = self.pairs[left, right] = not any(
                born_x <= gone_y and born_y < gone_x and (m := get(x + y)) is not None and m < gone_x and m <= gone_y
                for x, born_x, gone_x in self.edges(left)[0]
                for y, born_y, gone_y in self.edges(right)[1]
            )
        return got

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """last[i] becomes the last token of data[:i + 1], for all i from len(last); what is there stays."""
        ranks = self.ranks
        for end in range(len(last) + 1, len(data) + 1):
            for start in range(max(0, end - self.longest), end):
                token = ranks.get(data[start:end])
                if token is not None and self.stands(token) and (start == 0 or self.fits(last[start - 1], token)):
                    last.append(token)
                    break
            else:
                raise ValueError("a byte has no token")
        return last

    def edited(self, old: bytes, last: list[int], new: bytes, start: int) -> list[int]:
        """The table of new, given that of old, where new[:start] == old[:start] and the rest of new ends as old does.

        Redone from start until as many entries as the longest token has bytes agree: then all that follow do."""
        out, shift, same = last[:start], len(new) - len(old), 0
        common = 0
        while common < min(len(new), len(old)) - start and new[-1 - common] == old[-1 - common]:
            common += 1
        while len(out) < len(new):
            self.extend(new[: len(out) + 1], out)
            k = len(out) - 1 - shift
            same = same + 1 if len(out) > len(new) - common and k >= 0 and last[k] == out[-1] else 0
            if same >= self.longest:
                return out + last[k + 1 :]
        return out

    def tokens(self, last: list[int]) -> list[int]:
        """Walks back from the end of a table."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.bytes_of[out[-1]])
        return out[::-1]

    def step(self, key: bytes) -> tuple[bytes, list]:
        """key: the longest beginning of a token that ends before a byte, and that byte. The longest one that ends with it, and the tokens that do, longest first."""
        state = key
        while state not in self.starts:
            state = state[1:]
        found = [(self.ranks[x], len(x)) for x in (state[i:] for i in range(len(state))) if x in self.ranks and self.stands(self.ranks[x])]
        if len(self.steps) > self.most:
            self.steps.clear()
        self.steps[key] = state, found
        return state, found

    def prefix(self, data: bytes) -> int:
        """The valid last token of data, from the table of all prefixes met so far (of fixed size)."""
        known = self.known
        if len(known) > self.most:
            known.clear()
        at = len(data)
        while at and data[:at] not in known:
            at -= 1
        first = max(0, at - self.longest)
        while data[first:at] not in self.starts:
            first += 1
        state, steps = data[first:at], self.steps
        for end in range(at + 1, len(data) + 1):
            key = state + data[end - 1 : end]
            state, ending = steps.get(key) or self.step(key)
            for token, size in ending:
                if size == end or self.fits(known[data[: end - size]], token):
                    known[data[:end]] = token
                    break
            else:
                raise ValueError("a byte has no token")
        return known[data]

    def piece(self, data: bytes) -> list[int]:
        """Ids of one piece; a piece that is itself in the vocabulary is that token, as in the tiktoken library."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if len(data) > 48:  # long ones share few prefixes
            return self.tokens(self.extend(data, []))
        out = [self.prefix(data)]
        while len(data) > len(self.bytes_of[out[-1]]):
            data = data[: -len(self.bytes_of[out[-1]])]
            out.append(self.known[data])
        return out[::-1]


class TextEncoder:
    """Whole texts; blank-separated chunks met before are not encoded again (memory of fixed size).

    Where a pattern's matches take at most one leading blank and no two blanks adjoin, each blank may start a new chunk.  Whether that holds for the
    pattern at hand is tried on PROBES; if it doesn't, texts are matched whole."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 600_000):
        import regex

        self.bpe, self.find = PrefixBPE(ranks), regex.compile(pattern).findall
        self.pieces: dict[str, list[int]] = {}
        self.cache, self.most = ChunkCache(lambda new: [self.plain(x[:-1] if x.endswith(" ") else " " + x) for x in new], most), most // 2
        self.table = [b""] * (max(ranks.values(), default=0) + 1)
        for b, i in ranks.items():
            self.table[i] = b
        self.bytes, self.decimal = pa.array(self.table, pa.large_binary()), pa.array(map(str, range(len(self.table))), pa.large_string())
        self.by_chunk = all("".join(self.find(p)) == p and self.find(p) == [m for k, c in enumerate(p.split(" ")) for m in self.find(c if k == 0 else " " + c)] for p in PROBES)

    def plain(self, text: str) -> list[int]:
        out: list[int] = []
        for p in self.find(text):
            got = self.pieces.get(p)
            if got is None:
                got = self.bpe.piece(p.encode())
                if len(p) <= 32:
                    if len(self.pieces) >= self.most:
                        self.pieces.clear()
                    self.pieces[p] = got
            out += got
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in turn, and how many each text has."""
        if not texts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        own = [t if self.by_chunk and "  " not in t else None for t in texts]
        chunks = pc.split_pattern(pa.array([x or "" for x in own], pa.string()), " ")
        longest = np.maximum.reduceat(pc.utf8_length(chunks.values).to_numpy(), chunks.offsets.to_numpy()[:-1])
        alone = [k for k, x in enumerate(own) if x is None or longest[k] > 64]
        if alone:
            for k in alone:
                own[k] = ""
            chunks = pc.split_pattern(pa.array(own, pa.string()), " ")
        at, values = chunks.offsets.to_numpy()[:-1], chunks.values
        order = np.arange(len(values))  # a text's first chunk has no blank before it: its key ends with one
        order[at] = len(values) + np.arange(len(at))
        values = pa.concat_arrays([values, pc.binary_join_element_wise(values.take(pa.array(at)), "", " ")])
        ids, n = self.cache.sequences(values.take(pa.array(order)))
        n = np.add.reduceat(n, at)
        if alone:
            parts = np.split(ids, np.cumsum(n)[:-1])
            for k in alone:
                parts[k] = np.array(self.plain(texts[k]), np.int32)
                n[k] = len(parts[k])
            ids = np.concatenate(parts)
        return ids, n

    def joined(self, ids: np.ndarray, n: np.ndarray) -> tuple[list[bytes], list[bytes]]:
        """Of each text: its decimal ids joined by commas, and the decoded bytes."""
        at, ids = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int64()), pa.array(ids)
        decimal = pc.binary_join(pa.LargeListArray.from_arrays(at, self.decimal.take(ids)), pa.scalar(",", pa.large_string()))
        data = pc.binary_join(pa.LargeListArray.from_arrays(at, self.bytes.take(ids)), pa.scalar(b"", pa.large_binary()))
        return decimal.cast(pa.large_binary()).to_pylist(), data.to_pylist()


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of every text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept(("prefix", ranks_path, pattern), lambda: TextEncoder(load_ranks(ranks_path), pattern))
        for b in batches:
            for lo, rows in slices(b.column(1)):
                ids, n = enc.encode_all(b.column(1).slice(lo, rows).to_pylist())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, rows), list_array(n, ids)], names=["id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(each, "id long, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """id and data (binary) of encode()'s rows; null ids give null."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = {i: b for b, i in load_ranks(ranks_path).items()}
        for b in batches:
            data = [None if x is None else b"".join(table[i] for i in x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    return encoded.select("id", "ids").mapInArrow(each, "id long, data binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes and decodes every text in one pass: doc_id, n_tokens, sha256 of the decimal ids and of the decoded bytes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = kept(("prefix", ranks_path, pattern), lambda: TextEncoder(load_ranks(ranks_path), pattern))
        for b in batches:
            lengths, shas, back = [], [], []
            for lo, rows in slices(b.column(1)):
                ids, n = enc.encode_all(b.column(1).slice(lo, rows).to_pylist())
                lengths.append(n)
                for found, texts in zip((shas, back), enc.joined(ids, n), strict=True):
                    found += [hashlib.sha256(x).hexdigest() for x in texts]
            lengths = np.concatenate([np.zeros(0, np.int64), *lengths])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lengths), pa.array(shas, pa.string()), pa.array(back, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(each, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
