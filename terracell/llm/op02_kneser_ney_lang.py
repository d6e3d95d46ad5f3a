"""Language identification by interpolated Kneser-Ney character models.

Each language's model predicts the letters of a word, and its end, from up to four characters before.  All languages share sorted arrays
of hashed character n-grams, one for each order, with a column of probabilities for each language; longer unseen contexts pay the back-off
weight.  A text's language has the least cross-entropy per character.  Rejection is calibrated on documents kept out of the models: a text is
rejected if it has no letter, or if its cross-entropy lies further above the calibration mean of its language than 1.5 times the furthest of
those documents (deviations shrink with the square root of the length).

The models learn from a sample of labelled rows: of each language about `per_language` documents, chosen by a hash of their id, whole texts.
Letters are the characters of Unicode's categories L*.  Null texts and texts without letters give `und`, score 0 and rejected.  Without labelled
rows every text gives `und`.  Repeated rows keep a row each, and a repeated id of the sample calibrates once; other columns are ignored; ties
go to the first language in order of name; an empty table gives an empty result.  Texts and words of any length are read whole, in blocks of
characters; word memories are bounded in words and bytes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracell.llm.common import MEMORY, WordCodes, filtered, id_crc, kept, mix64, received, send, slices, utf8

ORDER = 5
RUNS = re.compile(r"[^\W\d_]+")
#: Characters that the models score at once.
WINDOWS = 1 << 16
#: Multipliers of a gram's characters, from the last one backwards.
LAG = mix64(np.arange(11, 11 + ORDER, dtype=np.uint64)) | np.uint64(1)
MAX_REJECT_SHARE = 1.5


def letters(text: str) -> list[str]:
    """Runs of letters. RUNS also matches numerals such as a half or Roman eight, which are none."""
    found = RUNS.findall(text)
    return found if all(map(str.isalpha, found)) else [x for run in found for x in "".join(c if c.isalpha() else " " for c in run).split()]


def hashes_of(chars: np.ndarray) -> list[np.ndarray]:
    """chars: rows of the ORDER code points that end at a position. For each order, the grams' hashes."""
    out, total = [], np.zeros(len(chars), np.uint64)
    for n in range(ORDER):
        total = total + (chars[:, ORDER - 1 - n].astype(np.uint64) + np.uint64(1)) * LAG[n]
        out.append(mix64(total ^ np.uint64(n + 1)))
    return out


def contexts_of(chars: np.ndarray) -> list[np.ndarray]:
    """The same for the contexts: each gram without its last character."""
    out, total = [], np.zeros(len(chars), np.uint64)
    for n in range(ORDER):
        out.append(mix64(total ^ np.uint64(n + 101)))
        if n + 1 < ORDER:
            total = total + (chars[:, ORDER - 2 - n].astype(np.uint64) + np.uint64(1)) * LAG[n + 1]
    return out


def windows(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of ORDER code points of the words, a view; where those are that end at a letter or a word's end; and how many each word has."""
    pad = "\x02" * (ORDER - 1)
    text = "".join(f"{pad}{w}\x03" for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    every = np.lib.stride_tricks.sliding_window_view(points, ORDER) if len(points) >= ORDER else np.zeros((0, ORDER), np.uint32)
    n = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    starts = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
    at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return every, at, n


class Model:
    """Probabilities of the grams that any language has seen, and back-off weights of the contexts, as sorted hash arrays by order."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        alphabet = {g[-1] for c in counts.values() for g in c}
        self.base = 1.0 / (len(alphabet) + 1)
        self.keys, self.probs, self.contexts, self.weights = [], [], [], []
        lower = None
        grams = sorted({g for c in counts.values() for g in c})
        for n in range(1, ORDER + 1):
            union = sorted({g[ORDER - n :] for g in grams})
            place = {g: k for k, g in enumerate(union)}
            c = np.zeros((len(union), len(self.langs)))
            for k, lang in enumerate(self.langs):
                if n == ORDER:
                    for g, v in counts[lang].items():
                        c[place[g], k] = v
                else:  # how many different characters come before
                    for g in {g[ORDER - n - 1 :] for g in counts[lang]}:
                        c[place[g[1:]], k] += 1
            chars = np.frombuffer("".join(g.rjust(ORDER, "\x02") for g in union).encode("utf-32-le"), np.uint32).reshape(-1, ORDER)
            key, context = hashes_of(chars)[n - 1], contexts_of(chars)[n - 1]
            known, inverse = np.unique(context, return_inverse=True)
            total, kinds = np.zeros((2, len(known), len(self.langs)))
            np.add.at(total, inverse, c)
            np.add.at(kinds, inverse, c > 0)
            once, twice = (c == 1).sum(axis=0), (c == 2).sum(axis=0)
            discount = np.where(once > 0, once / np.maximum(once + 2 * twice, 1), 0.5).clip(0.1, 0.95)
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            below = self.base if lower is None else lower[1][np.searchsorted(lower[0], hashes_of(chars)[n - 2])]
            p = np.maximum(c - discount, 0) / np.maximum(total[inverse], 1) + weight[inverse] * below
            order = np.argsort(key)
            self.keys.append(key[order])
            self.probs.append(p[order].astype(np.float32))
            self.contexts.append(known)
            self.weights.append(weight.astype(np.float32))
            lower = (self.keys[-1], p[order])

    def costs(self, words: list[str]) -> np.ndarray:
        """Nats that each language's model spends on each word."""
        every, places, n = windows(words)
        word, out = np.repeat(np.arange(len(n)), n), np.zeros((len(n), len(self.langs)))
        for lo in range(0, len(places), WINDOWS):
            chars, own = every[places[lo : lo + WINDOWS]], word[lo : lo + WINDOWS]
            _, first, inverse = np.unique(hashes_of(chars)[-1], return_index=True, return_inverse=True)
            p = self.probabilities(chars[first])[inverse]  # words share most of their windows
            first = np.flatnonzero(np.diff(own, prepend=-1))
            out[own[first]] -= np.add.reduceat(np.log(p), first, axis=0)
        return out

    def probabilities(self, chars: np.ndarray) -> np.ndarray:
        """Of the last character of each window, by language."""
        p = np.full((len(chars), len(self.langs)), self.base)
        for order, (gram, context) in enumerate(zip(hashes_of(chars), contexts_of(chars), strict=True)):
            at = np.minimum(np.searchsorted(self.keys[order], gram), len(self.keys[order]) - 1)
            seen = self.keys[order][at] == gram
            up = np.minimum(np.searchsorted(self.contexts[order], context), len(self.contexts[order]) - 1)
            weight = np.where((self.contexts[order][up] == context)[:, None], self.weights[order][up], 1.0)
            p = np.where(seen[:, None], self.probs[order][at], weight * p)
        return p


class Scorer:
    """Costs of whole texts; words met before are not scored again (memory of fixed size, which keeps words of several texts when it is full)."""

    def __init__(self, model: Model, most: int = 150_000):
        self.model, self.codes = model, WordCodes(most)
        self._reset()

    def _reset(self) -> None:
        self.codes.clear()
        self.cost, self.size, self.known = np.zeros((1 << 16, len(self.model.langs)), np.float32), np.zeros(1 << 16, np.int32), 0
        self.texts = np.zeros(1 << 16, np.int32)

    def _shrink(self) -> None:
        often = np.flatnonzero(self.texts[: self.known] > 1)
        names = list(self.codes)
        names = [names[i] for i in often]
        if 2 * len(names) > self.codes.most or 2 * (held := sum(map(len, names))) > MEMORY:
            return self._reset()
        cost, size = self.cost[often], self.size[often]
        self.codes.clear()
        self.codes.update(zip(names, range(len(names)), strict=True))
        self.codes.held, self.known = held, len(names)
        self.cost[: self.known], self.size[: self.known], self.texts[: self.known] = cost, size, 1
        self.texts[self.known :] = 0

    def _learn(self) -> None:
        new, self.codes.new = self.codes.new, []
        for lo in range(0, len(new), 5_000):
            runs = [letters(w.decode("utf-8", "replace").lower()) for w in new[lo : lo + 5_000]]
            flat, owner = [w for r in runs for w in r], np.repeat(np.arange(len(runs)), [len(r) for r in runs])
            cost, size = np.zeros((len(runs), len(self.model.langs))), np.zeros(len(runs), np.int32)
            np.add.at(cost, owner, self.model.costs(flat))
            np.add.at(size, owner, np.array([len(w) + 1 for w in flat], np.int32))
            while self.known + len(runs) > len(self.size):
                self.cost, self.size, self.texts = (np.concatenate([x, np.zeros_like(x)]) for x in (self.cost, self.size, self.texts))
            self.cost[self.known : self.known + len(runs)], self.size[self.known : self.known + len(runs)] = cost, size
            self.known += len(runs)

    def score(self, data: bytes) -> tuple[np.ndarray, int]:
        """Nats by language, and characters (letters and word ends); 0 characters: no letter."""
        return self.score_all([data])[0]

    def score_all(self, texts: list[bytes]) -> list[tuple[np.ndarray, int]]:
        """The same of many texts, whose new words are scored together."""
        if self.codes.full():
            self._shrink()
        codes, out = [], []
        for data in texts:
            words = data.split()
            codes.append(np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words)))
        if self.codes.new:
            self._learn()
        for own in codes:
            self.texts[own] += 1
            out.append((self.cost[own].sum(axis=0, dtype=np.float64), int(self.size[own].sum())))
        return out


class Identifier:
    """A model with its calibration: temperature of the score, and by language the mean and spread of costs per character."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.model, self.temperature, self.usual = Model(counts), 0.5, {}

    def calibrate(self, rows: list[tuple[str, np.ndarray, int]]) -> None:
        """rows: language, costs, characters of documents that the model hasn't seen."""
        rows = [r for r in rows if r[2] > 0 and r[0] in self.model.langs]
        best = -np.inf
        for t in 2.0 ** np.arange(-8, 1):
            fit = sum(np.log(max(self._posterior(c, t)[self.model.langs.index(lang)], 1e-12)) for lang, c, _ in rows)
            if fit > best:
                best, self.temperature = fit, float(t)
        for k, lang in enumerate(self.model.langs):
            own = [(c[k] / n, n) for name, c, n in rows if name == lang and int(np.argmin(c)) == k]
            if len(own) < 5:
                continue
            cost, n = np.array([x[0] for x in own]), np.array([x[1] for x in own])
            mean = float(np.average(cost, weights=n))
            z = (cost - mean) * np.sqrt(n)
            spread = max(float(np.sqrt((z**2).mean())), 0.5)
            self.usual[lang] = (mean, spread, max(4.0, float((z / spread).max())) * MAX_REJECT_SHARE)

    @staticmethod
    def _posterior(costs: np.ndarray, temperature: float) -> np.ndarray:
        p = np.exp(-(costs - costs.min()) * temperature)
        return p / p.sum()

    def decide(self, costs: np.ndarray, n: int) -> tuple[str, float, float, bool]:
        """Language, score, cross-entropy per character, rejected."""
        if n == 0:
            return "und", 0.0, float("nan"), True
        k = int(np.argmin(costs))
        lang, cross = self.model.langs[k], costs[k] / n
        mean, spread, most = self.usual.get(lang, (0.0, 1.0, np.inf))
        # beside the share that sampling explains, half a nat of difference in style is always allowed
        return lang, float(self._posterior(costs, self.temperature)[k]), float(cross), bool((cross - mean - 0.5) * np.sqrt(n) > most * spread)


def fit(docs: DataFrame, learn: str = "pmod(crc, 5) != 0", per_language: int = 800, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Identifier | None:
    """Learns from about `per_language` documents of each language among the rows that `learn` (over crc, the id's crc32) admits.

    Grams are counted by the executors and summed before they reach the driver; a quarter of the sample calibrates only."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), id_crc(id_col).alias("crc"))
    rows = rows.where("lang is not null and id is not null").where(learn)
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return None
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1 << 20, (per_language << 20) // n))])
    mark = F.pmod(F.xxhash64("id"), F.lit(1 << 20))
    sample = rows.where(mark < F.element_at(share, F.col("lang"))).select("id", "lang", utf8("text").alias("data"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(4)) == 0).alias("aside"))
    pad = "\x02" * (ORDER - 1)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        for b in batches:
            for lang, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.update((lang, w) for w in letters(data.decode("utf-8", "replace").lower()))
        counts: Counter = Counter()
        for (lang, w), n in words.items():
            s = f"{pad}{w}\x03"
            for k in range(len(w) + 1):
                counts[lang, s[k : k + ORDER]] += n
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts]), pa.array([k[1] for k in counts]), pa.array(list(counts.values()), pa.int64())], names=["lang", "gram", "n"])

    found = sample.where("not aside").select("lang", "data").mapInArrow(grams, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    counts: dict[str, dict[str, int]] = {}
    for lang, gram, n in zip(*(c.to_pylist() for c in found.columns), strict=True):
        counts.setdefault(lang, {})[gram] = n
    if not counts:
        return None
    out = Identifier(counts)

    def aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(out.model)
        for b in batches:
            got = [scorer.score(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([c.tolist() for c, _ in got], pa.list_(pa.float64())), pa.array([n for _, n in got], pa.int64())], names=["id", "lang", "costs", "n"])

    id_type = docs.schema[id_col].dataType.simpleString()
    kept_out = sample.where("aside").select("id", "lang", "data").mapInArrow(aside, f"id {id_type}, lang string, costs array<double>, n long")
    kept_out = kept_out.groupBy("id", "lang").agg(F.min(F.struct("n", "costs")).alias("one")).collect()  # ids of the sample, once
    out.calibrate([(r[1], np.array(r.one.costs), r.one.n) for r in kept_out])
    return out


def identify(docs: DataFrame, model: Identifier | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, cross_entropy, rejected of every whole text."""
    import uuid

    sent, tag = send(docs.sparkSession, model), uuid.uuid4().hex  # of fixed size: grams of a bounded sample

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, scorer = kept(("language", tag), lambda: (lambda m: (m, Scorer(m.model, 400_000) if m else None))(received(sent)))
        for b in batches:
            out = [("und", 0.0, float("nan"), True)] * b.num_rows
            if found:
                out = [found.decide(*x) for lo, n in slices(b.column(1)) for x in scorer.score_all(b.column(1).slice(lo, n).to_pylist())]
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.bool_())], names=["id", "lang_pred", "score", "cross_entropy", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), utf8(text_col).alias("data"))
    return rows.mapInArrow(each, "id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def accepted(docs: DataFrame, model: Identifier | None, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are not rejected (all, without a model)."""
    import uuid

    if model is None:
        return docs
    sent, tag, at = send(docs.sparkSession, model), uuid.uuid4().hex, docs.columns.index(text_col)

    def keep(b: pa.RecordBatch) -> list[bool]:
        found, scorer = kept(("language", tag), lambda: (lambda m: (m, Scorer(m.model)))(received(sent)))
        return [not found.decide(*scorer.score((x or "").encode()))[3] for lo in range(0, b.num_rows, 500) for x in b.column(at).slice(lo, 500).to_pylist()]

    return filtered(docs, keep)
