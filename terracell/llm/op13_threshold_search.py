"""Ranked lexical search of a set of items over all documents, as a threshold-seeded join.

Terms are runs of ASCII letters and digits and of all other characters than ASCII's, A-Z lower-cased.  A term's weight w and a document's impact for it are
64-bit integers (see `weight` and `impacts`); a document's score for an item is the sum of w * impact over the item's terms, each once.

1. `index`: one pass over the texts keeps each document's length and the counts of the items' terms, as arrays; totals and frequencies come from it.
2. `stored`: for each term its weight, its largest and its k-th largest impact; k documents score at least w * (k-th impact) for an item that has the
   term, so the largest of these over the item's terms is a lower bound of the item's k-th score (its seed).
3. An item's terms are ordered by their largest contribution; where the sum of those from some place on can't reach the seed, that suffix makes no
   candidates by itself.  Tasks take the index in batches and sum contributions of the other terms by (document, item); where that
   sum and the suffix's bound reach the threshold, the pair is a candidate and is scored exactly over all terms.  The threshold of a task is the seed or the
   k-th score that it has found itself, whichever is higher.
4. Each task keeps k candidates of an item at most; two grouped steps take the first k of all.

Results are exact: a document is left out only if its score is below that of k documents.  Items go out in blocks of bounded size, so that what is broadcast
has a bound; each block is one pass over the documents.  Nothing else is sent whole.

Null and empty texts, and texts without a term, are in no result and don't count in N.  Every row is a document, and an item, of its own: repeated ids are
ranked each; null ids come last among equal scores, and an item of null id is an item like others.  Items without terms, or of terms that no document holds, have no rows.
Other columns are ignored, whatever their names.  Texts of any length are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terracell.llm.common import LONG, MEMORY, list_array, received, send, utf8, written

#: Bytes of ASCII that end a term become spaces, A-Z become lower case; all other bytes are parts of terms.
_TABLE = bytes(b if b > 127 or chr(b).isdigit() or "a" <= chr(b) <= "z" else b + 32 if "A" <= chr(b) <= "Z" else 32 for b in range(256))
#: (item, term) pairs that one block of items has, about, and bytes of terms.
BLOCK = 500_000
#: (document, item) sums and (posting, item) pairs that are worked on at once, but for a single document's.
CELLS = 1 << 21
SALTS = 64


def terms(data: bytes) -> list[bytes]:
    return data.translate(_TABLE).split()


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def impacts(tf: np.ndarray, n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """What a term that occurs tf times adds, but for its weight, in documents of n terms."""
    m = 10 + np.array([90 * x * documents // max(1, all_terms) for x in n.tolist()], np.int64)  # python integers: no overflow
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item (a key of the row), item_id, terms (distinct, as bytes)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(terms(x))) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.list_(pa.binary()))], names=["item", "item_id", "terms"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_col).cast("long").alias("item_id"), utf8(text_col).alias("data"))
    return written(rows.mapInArrow(each, "item long, item_id long, terms array<binary>"), "items")


class TermIds(dict):
    """Ids of the items' terms by term; of other words, -1 is remembered for as many as MEMORY allows."""

    def __init__(self, known: dict[bytes, int]):
        super().__init__(known)
        self.known, self.held = known, 0

    def __missing__(self, word: bytes) -> int:
        if len(word) <= LONG:
            if self.held >= MEMORY // 2:
                self.clear()
                self.update(self.known)
                self.held = 0
            self[word] = -1
            self.held += len(word) + 50
        return -1


def index(docs: DataFrame, known: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms of the document), term (ids of the items' terms it holds, ascending), tf; documents without a term are left out."""
    sent = send(docs.sparkSession, known)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = TermIds(received(sent))
        for b in batches:
            n, sizes, term, tf = [], [], [], []
            for data in b.column(1).to_pylist():
                words = terms(data)
                found = np.fromiter(map(ids.__getitem__, words), np.int32, len(words))
                t, c = np.unique(found[found >= 0], return_counts=True)
                n.append(len(words))
                sizes.append(len(t))
                term.append(t)
                tf.append(c)
            if not n:
                continue
            sizes = np.array(sizes, np.int64)
            out = pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), list_array(sizes, np.concatenate(term).astype(np.int32)), list_array(sizes, np.concatenate(tf).astype(np.int32))], names=["doc_id", "n", "term", "tf"])
            yield out.filter(pa.array(np.array(n) > 0))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("data"))
    return written(rows.mapInArrow(each, "doc_id long, n long, term array<int>, tf array<int>"), "postings")


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Row, term id, tf and document length of each posting of a batch."""
    lists, tfs = b.column(2), b.column(3)
    sizes = np.diff(lists.offsets.to_numpy())
    row = np.repeat(np.arange(b.num_rows), sizes)
    return row, lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy().astype(np.int64), b.column(1).to_numpy()[row]


def stored(postings: DataFrame, documents: int, all_terms: int, k: int) -> DataFrame:
    """term, df, most and kth impact (0 where fewer than k documents hold it): a row for each term."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((3, 0), np.int64)  # term, impact, documents: the k largest of each term, and in the first of them the count of all
        for b in batches:
            _, term, tf, n = _arrays(b)
            new = np.stack([term, impacts(tf, n, documents, all_terms), np.ones(len(term), np.int64)])
            both = np.concatenate([held, new], axis=1)
            both = both[:, np.lexsort((-both[1], both[0]))]
            first = np.flatnonzero(np.r_[True, both[0][1:] != both[0][:-1]]) if both.shape[1] else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[first, both.shape[1]])
            counts = np.add.reduceat(both[2], first) if len(first) else both[2]
            place = np.arange(both.shape[1]) - np.repeat(first, sizes)
            both[2] = 0
            both[2][first] = counts
            held = both[:, place < k]
        yield pa.RecordBatch.from_arrays([pa.array(held[0], pa.int64()), pa.array(held[1], pa.int64()), pa.array(held[2], pa.int64())], names=["term", "impact", "docs"])

    top = lambda c: F.slice(F.reverse(F.array_sort(c)), 1, k)
    tops = postings.mapInArrow(each, "term long, impact long, docs long").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    some = tops.groupBy("term", "salt").agg(top(F.collect_list("impact")).alias("impacts"), F.sum("docs").alias("docs"))
    all_ = some.groupBy("term").agg(top(F.flatten(F.collect_list("impacts"))).alias("impacts"), F.sum("docs").alias("df"))
    return all_.select("term", "df", F.col("impacts")[0].alias("most"), F.when(F.size("impacts") >= k, F.element_at("impacts", -1)).otherwise(F.lit(0)).alias("kth"))


class Plan:
    """A block's items: their terms' weights, seeds, and which terms make candidates."""

    def __init__(self, items: list[list[int]], w: np.ndarray, most: np.ndarray, kth: np.ndarray):
        self.size = len(items)
        self.seed, self.rest = np.zeros(self.size, np.int64), np.zeros(self.size, np.int64)
        leading, other = [], []
        for j, t in enumerate(items):
            t = np.array(t, np.int64)
            if not len(t):
                continue
            self.seed[j] = (w[t] * kth[t]).max()
            bound = w[t] * most[t]
            order = np.argsort(-bound, kind="stable")
            suffix = np.cumsum(bound[order][::-1])[::-1]  # the most that the terms from each place on can add
            makes = suffix >= max(1, self.seed[j])
            self.rest[j] = suffix[~makes].max(initial=0)
            leading += [(x, j) for x in t[order[makes]]]
            other += [(x, j) for x in t[order[~makes]]]
        self.leading, self.all = self._by_term(leading, len(w)), self._by_term(leading + other, len(w))
        self.w = w

    @staticmethod
    def _by_term(pairs: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each term's items begin, how many it has, and the items."""
        p = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        counts = np.bincount(p[:, 0], minlength=n)
        return np.cumsum(counts) - counts, counts, p[:, 1]


def _sums(plan: Plan, by: tuple[np.ndarray, ...], row: np.ndarray, term: np.ndarray, part: np.ndarray, rows: int) -> np.ndarray:
    """Sums of part over (row, item); they stay below 2 ** 53, so doubles are exact."""
    first, count, items = by
    n = count[term]
    ends = np.cumsum(n)
    at = np.repeat(first[term] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
    return np.bincount(np.repeat(row, n) * plan.size + items[at], np.repeat(part, n), rows * plan.size).astype(np.int64).reshape(rows, plan.size)


def candidates(postings: DataFrame, plan: Plan, documents: int, all_terms: int, k: int) -> DataFrame:
    """item (its place in the plan), doc_id, score: of each task, the k best candidates of an item."""
    sent = send(postings.sparkSession, plan)

    def best(held: np.ndarray) -> np.ndarray:
        """The first k of each item; held has item, no id, doc_id, score."""
        held = held[:, np.lexsort((held[2], held[1], -held[3], held[0]))]
        first = np.flatnonzero(np.r_[True, held[0][1:] != held[0][:-1]]) if held.shape[1] else np.zeros(0, np.int64)
        return held[:, np.arange(held.shape[1]) - np.repeat(first, np.diff(np.r_[first, held.shape[1]])) < k]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = received(sent)
        held, limit = np.zeros((4, 0), np.int64), np.maximum(plan.seed, 1)
        for b in batches:
            rows, terms_, tfs, lengths = _arrays(b)
            parts = plan.w[terms_] * impacts(tfs, lengths, documents, all_terms)
            cost = np.cumsum(np.bincount(rows, plan.all[1][terms_], b.num_rows) + plan.size) // CELLS
            cuts = np.r_[0, np.flatnonzero(np.diff(cost)) + 1, b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                own = slice(*np.searchsorted(rows, [lo, hi]))
                row, term, part = rows[own] - lo, terms_[own], parts[own]
                some = _sums(plan, plan.leading, row, term, part, hi - lo)
                hit = (some > 0) & (some + plan.rest >= limit)
                if not hit.any():
                    continue
                asked = hit.any(axis=1)
                place, use = np.cumsum(asked) - 1, asked[row]
                exact = _sums(plan, plan.all, place[row[use]], term[use], part[use], int(asked.sum()))
                d, j = np.nonzero(hit[asked] & (exact >= limit))
                docs = np.flatnonzero(asked)[d] + lo
                none = np.asarray(b.column(0).is_null())[docs]
                ids = b.column(0).fill_null(0).to_numpy()[docs]
                held = best(np.concatenate([held, np.stack([j, none.astype(np.int64), ids, exact[d, j]])], axis=1))
                counts = np.bincount(held[0], minlength=plan.size)
                last = np.cumsum(counts) - 1
                full = counts >= k
                limit[full] = np.maximum(limit[full], held[3][last[full]])
        ids = pa.array(held[2], mask=held[1].astype(bool))
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), ids, pa.array(held[3])], names=["place", "doc_id", "score"])

    return postings.mapInArrow(each, "place long, doc_id long, score long")


def _block(docs: DataFrame, items: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """item, item_id, rank, doc_id, score for a block of items (item, item_id, terms)."""
    spark = docs.sparkSession
    rows = items.collect()
    words = sorted({t for r in rows for t in r.terms})
    known = {t: i for i, t in enumerate(words)}
    postings = index(docs, known, id_col, text_col)
    documents, all_terms = postings.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    found = stored(postings, documents, all_terms, k).toArrow()
    w, most, kth = (np.zeros(len(words), np.int64) for _ in range(3))
    t = found.column("term").to_numpy()
    w[t] = [weight(documents, x) for x in found.column("df").to_pylist()]
    most[t], kth[t] = found.column("most").to_numpy(), found.column("kth").to_numpy()
    plan = Plan([[i for x in r.terms if most[i := known[x]]] for r in rows], w, most, kth)
    own = spark.createDataFrame([(j, r.item, r.item_id) for j, r in enumerate(rows)], "place long, item long, item_id long")
    best = candidates(postings, plan, documents, all_terms, k).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("place", "salt").orderBy(*order))).where(F.col("rank") <= k)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(F.broadcast(own), "place").select("item", "item_id", "rank", "doc_id", "score")  # a block's items are bounded


def search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item."""
    asked = item_terms(items, item_id_col, item_text_col)
    size = F.size("terms") + F.coalesce(F.aggregate("terms", F.lit(0), lambda a, x: a + F.octet_length(x)), F.lit(0)) / 16
    total = asked.agg(F.coalesce(F.sum(size + 1), F.lit(0))).first()[0]
    blocks = math.ceil(total / BLOCK)
    out = asked.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    for b in range(blocks):
        found = _block(docs, asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b), k, id_col, text_col)
        out = out.union(found.select("item_id", "rank", "doc_id", "score"))
    return out
