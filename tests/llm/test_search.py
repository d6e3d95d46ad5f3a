"""The search against scoring every document for every item, term by term."""

import collections
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.llm import op13_threshold_search as op

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, k=10):
    found = [(i, collections.Counter(terms(t))) for i, t in docs]
    found = [(i, c) for i, c in found if c]
    n_docs, all_terms = len(found), sum(sum(c.values()) for _, c in found)
    df = collections.Counter(t for _, c in found for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, c in found:
            m = 10 + 90 * sum(c.values()) * n_docs // all_terms
            score = sum(w[t] * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            scores += [(-score, i is None, i or 0)] if score > 0 else []
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def docs():
    r = random.Random(4)
    words = [f"w{i}" for i in range(300)] + ["É", "漢字", "a1b2", "Zürich", "x\u0085y"]
    out = [(3 * i, r.choice([" ", ", ", "_", "\x7f"]).join(r.choice(words[: r.choice([20, 305])]) for _ in range(r.choice([1, 5, 40, 200])))) for i in range(400)]
    copies = [(2000 + i, out[7][1]) for i in range(30)]
    return out + copies + [(5000, None), (5001, ""), (5002, " .,-"), (5003, "W1 " * 30_000), (None, out[7][1]), (None, out[9][1]), (out[9][0], out[9][1]), (5004, "w" * 50_000)]


@pytest.fixture(scope="module")
def items(docs):
    r = random.Random(5)
    out = [(i, docs[r.randrange(400)][1][: r.choice([20, 100, 400])]) for i in range(40)]
    return out + [(50, None), (51, "?!"), (52, "nowhere"), (53, docs[7][1]), (53, docs[7][1]), (None, "w1 w1 W1"), (54, "w" * 50_000)]


def frame(spark, rows, id_col):
    out = spark.createDataFrame(rows, f"{id_col} long, text string").repartition(3)
    for c in ("item", "n", "term", "terms", "tf", "rank", "score", "place", "data", "salt"):
        out = out.withColumn(c, F.lit("x"))
    return out


def found(spark, docs, items, **more):
    return sorted(map(tuple, op.search(frame(spark, docs, "doc_id"), frame(spark, items, "item_id"), **more).collect()), key=str)


def test_all_scores(spark, docs, items):
    assert found(spark, docs, items) == plain(docs, items)
    assert found(spark, docs, items, k=3) == plain(docs, items, 3)


def test_blocks_and_steps(spark, docs, items, monkeypatch):
    monkeypatch.setattr(op, "BLOCK", 700)
    monkeypatch.setattr(op, "CELLS", 100)
    assert found(spark, docs[:120], items[:25]) == plain(docs[:120], items[:25])


def test_empty(spark, docs, items):
    assert found(spark, [], items) == [] and found(spark, docs, []) == []


def test_suffix_never_reaches_the_seed():
    r = np.random.default_rng(3)
    w, most = r.integers(1, 5000, 40), r.integers(1, 10**6, 40)
    kth = most // r.integers(1, 4, 40)
    items = [list(r.permutation(40)[:n]) for n in (1, 2, 5, 20, 40)]
    plan = op.Plan(items, w, most, kth)
    first, count, of = plan.leading
    for j, t in enumerate(items):
        leading = {x for x in t if j in of[first[x] : first[x] + count[x]]}
        assert leading and plan.rest[j] == sum(w[x] * most[x] for x in t if x not in leading) < plan.seed[j]
        assert plan.seed[j] == max(w[x] * kth[x] for x in t)
