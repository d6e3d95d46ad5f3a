"""Quality classifier: naive Bayes support vectors.

Indicators of word n-grams are scaled by the log-count ratio of the two classes, and a linear hinge-loss model is fitted to the scaled
vectors (of unit length) by dual coordinate descent.  The n-grams are words, shapes of words (letters and digits folded), pairs of shapes, and
runs of a repeated word; a shape or a run has further indicators for making up a 20th, a quarter and half of the text.

It learns from about `most` labelled documents, chosen by a hash of their id, whole texts; a quarter of them is kept out of the fit and calibrates
the score by a logistic curve.  Null texts count as empty; an empty text has only the bias.  Without labels of both classes each score is 0.5.
Rows of null id or label are not learned from; an id of several labels counts with each, an id of several texts with the one of least features.
Repeated rows keep a row each; other columns are ignored; ties have equal scores; an empty table gives an empty result.  Texts of any length are read
whole; the word memory is bounded in words and bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import WordCodes, filtered, id_crc, kept, mix64, received, send, utf8

BITS = 18
SHARES = (0.05, 0.25, 0.5)
FOLD = re.compile(rb"([a-z\x80-\xff]+)|([A-Z]+)|([0-9]+)|(.)\4*", re.S)


def shape(word: bytes) -> bytes:
    """Runs of letters, capitals and digits as a, A and 9; other characters once for a run."""
    return b"".join(b"a" if m[1] else b"A" if m[2] else b"9" if m[3] else m[4] for m in FOLD.finditer(word))


class Features:
    """Indicator numbers of whole texts; words met before are not taken apart again (memory of fixed size)."""

    def __init__(self, most: int = 150_000):
        self.codes = WordCodes(most)
        self._reset()

    def _reset(self) -> None:
        self.codes.clear()
        self.word, self.form, self.known = np.zeros(1 << 16, np.uint64), np.zeros(1 << 16, np.uint64), 0

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        while self.known + len(new) > len(self.word):
            self.word, self.form = np.concatenate([self.word, np.zeros_like(self.word)]), np.concatenate([self.form, np.zeros_like(self.form)])
        self.word[self.known : self.known + len(new)] = [xxhash.xxh3_64_intdigest(w.lower()) for w in new]
        self.form[self.known : self.known + len(new)] = [xxhash.xxh3_64_intdigest(b"\x00" + shape(w)) for w in new]
        self.known += len(new)

    def of(self, data: bytes) -> np.ndarray:
        """Sorted distinct indicator numbers below 2 ** BITS."""
        if self.codes.full():
            self._reset()
        words = data.split()
        if not words:
            return np.zeros(0, np.int64)
        codes = np.fromiter(map(self.codes.__getitem__, words), np.int64, len(words))
        if self.codes.new:
            self._learn()
        form = self.form[codes]
        kinds, counts = np.unique(form, return_counts=True)
        same = codes[1:] == codes[:-1]
        runs = (same[1:] & same[:-1]).sum()
        kinds, counts = np.append(kinds, np.uint64(7)), np.append(counts, runs)
        found = [mix64(self.word[codes]), mix64(form[:-1] * np.uint64(3) + form[1:] * np.uint64(5)), mix64(kinds[counts > 0] + np.uint64(1))]
        for k, share in enumerate(SHARES):
            found.append(mix64(kinds[counts >= max(1, share * len(words))] + np.uint64(2 + k)))
        return np.unique((np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64))


class Classifier:
    """scale: log-count ratios; weights: of the fitted linear model over scaled unit vectors; slope, offset: of the score's curve."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, aside: np.ndarray, passes: int = 15, cost: float = 1.0, seed: int = 7):
        n = np.zeros((2, 1 << BITS))
        for x, y, out in zip(rows, labels, aside, strict=True):
            if not out:
                n[int(y), x] += 1
        n += 1.0
        p = n / n.sum(axis=1, keepdims=True)
        self.scale = np.log(p[1] / p[0])
        self.square = self.scale**2
        train = [k for k in range(len(rows)) if not aside[k]]
        y = np.where(labels == 1, 1.0, -1.0)
        # both classes weigh the same; the vectors have unit length and a bias of 1
        most = {c: cost * len(train) / (2 * max(1, sum(y[k] == c for k in train))) for c in (-1.0, 1.0)}
        vectors = {k: self.scale[rows[k]] / np.sqrt(self.square[rows[k]].sum() + 1e-9) for k in train}
        w, bias, alpha = np.zeros(1 << BITS), 0.0, np.zeros(len(rows))
        norm = {k: float(v @ v) + 1.0 for k, v in vectors.items()}
        rng = np.random.default_rng(seed)
        for _ in range(passes):
            for k in rng.permutation(train):
                x, v = rows[k], vectors[k]
                gradient = y[k] * (float(w[x] @ v) + bias) - 1.0
                new = min(max(alpha[k] - gradient / norm[k], 0.0), most[y[k]])
                if new != alpha[k]:
                    step = (new - alpha[k]) * y[k]
                    w[x] += step * v
                    bias += step
                    alpha[k] = new
        self.table, self.bias = w * self.scale, bias
        margins = np.array([self.margin(rows[k]) for k in range(len(rows)) if aside[k]])
        self.slope, self.offset = logistic(margins, labels[aside])

    def margin(self, x: np.ndarray) -> float:
        return float(self.table[x].sum() / np.sqrt(self.square[x].sum() + 1e-9)) + self.bias

    def score(self, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.offset, -30, 30))))


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of P(1 | margin), by Newton steps on smoothed targets (both classes weighing the same)."""
    up, down = labels.sum(), len(labels) - labels.sum()
    if not up or not down:
        return 2.0, 0.0
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    weight = np.where(labels == 1, 0.5 / up, 0.5 / down)
    x, beta = np.stack([margins, np.ones(len(margins))], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        beta = beta + np.linalg.solve(hessian, x.T @ (weight * (target - p)) - 1e-4 * (beta - [1.0, 0.0]))
    return max(float(beta[0]), 0.1), float(beta[1])


def fit(docs: DataFrame, labels: DataFrame, learn: str = "pmod(crc, 4) != 2", most: int = 4000, id_col: str = "doc_id", label_col: str = "quality", text_col: str = "text") -> Classifier | None:
    """Learns from about `most` of the labelled rows that `learn` (over crc, the id's crc32) admits.

    The sampled labels (bounded) are broadcast to the scan of the documents, so texts are not shuffled."""
    rows = labels.select(F.col(id_col).cast("long").alias("label_id"), F.col(label_col).cast("int").alias("y"), id_crc(id_col).alias("crc"))
    rows = rows.where("label_id is not null and y in (0, 1)").where(learn).select("label_id", "y").distinct()
    total = rows.count()
    if not total:
        return None
    share = min(1 << 20, (most << 20) // total)
    sample = rows.where(F.pmod(F.xxhash64("label_id"), F.lit(1 << 20)) < share)
    mine = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("data")).join(F.broadcast(sample), F.col("id") == F.col("label_id"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([features.of(x).astype(np.int32).tobytes() for x in b.column(2).to_pylist()], pa.binary())], names=["id", "y", "x"])

    once = mine.select("id", "y", "data").mapInArrow(each, "id long, y int, x binary").groupBy("id", "y").agg(F.min("x").alias("x"))
    found = sorted(once.collect())  # the sample's ids, once each
    x, y = [np.frombuffer(r[2], np.int32).astype(np.int64) for r in found], np.array([r[1] for r in found])
    if len(set(y.tolist())) < 2:
        return None
    aside = mix64(np.array([r[0] for r in found]).astype(np.uint64)) % np.uint64(4) == 0
    return Classifier(x, y, aside)


def classify(docs: DataFrame, model: Classifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score of every whole text."""
    import uuid

    sent, tag = send(docs.sparkSession, model), uuid.uuid4().hex  # two tables of 2 ** BITS numbers

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, found = kept(("quality", tag), lambda: (Features(), received(sent)))
        for b in batches:
            scores = [found.score(features.of(x)) if found else 0.5 for lo in range(0, b.num_rows, 500) for x in b.column(1).slice(lo, 500).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("data")).mapInArrow(each, "id long, score double")


def accepted(docs: DataFrame, model: Classifier | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, whose score is `least` or more (all, without a model)."""
    import uuid

    if model is None:
        return docs
    sent, tag, at = send(docs.sparkSession, model), uuid.uuid4().hex, docs.columns.index(text_col)

    def keep(b: pa.RecordBatch) -> list[bool]:
        features, found = kept(("quality", tag), lambda: (Features(), received(sent)))
        return [found.score(features.of((x or "").encode())) >= least for lo in range(0, b.num_rows, 500) for x in b.column(at).slice(lo, 500).to_pylist()]

    return filtered(docs, keep)
