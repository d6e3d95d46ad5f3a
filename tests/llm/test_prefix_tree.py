"""The prefix-tree join against all pairs, the tree against plain intersections, and the keys that must not miss a pair."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracell.llm import op12_prefix_tree_join as op


def gram_set(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return frozenset()
    return frozenset({tuple(w)} if len(w) < 3 else {tuple(w[i : i + 3]) for i in range(len(w) - 2)})


def plain(rows, percent=90):
    """(doc_id, set size, least id reachable) by comparing all rows' sets."""
    sets = [(i, gram_set(t)) for i, t in rows]
    known = [(i, s) for i, s in sets if i is not None and s]
    label = {i: i for i, _ in known}
    links = [(a, b) for k, (a, x) in enumerate(known) for b, y in known[:k] if 100 * len(x & y) >= percent * len(x | y)]
    while any(label[a] != label[b] for a, b in links):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return sorted(((i, len(s), label.get(i, i) if i is not None else None) for i, s in sets), key=str)


def edited(r, words, n):
    out = list(words)
    for _ in range(n):
        out[r.randrange(len(out))] = f"e{r.randrange(10**6)}"
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    out, k = [], 0
    passage = [f"p{i}" for i in range(60)]
    for size in (9, 10, 11, 12, 20, 30, 45, 80, 200, 700):
        base = [f"w{r.randrange(4000)}" for _ in range(size + 2)]
        for n in range(12):  # edits up to and past the limit, at both ends and inside
            out.append((k := k + r.randint(1, 3), " ".join(edited(r, base, n % 6) + [f"t{i}" for i in range(n % 4)])))
        chain = base
        for _ in range(4):  # each is close to the one before only
            chain = edited(r, chain, max(1, size // 60))
            out.append((k := k + 1, " ".join(chain)))
    for _ in range(30):
        out.append((k := k + 1, " ".join(passage + [f"w{r.randrange(4000)}" for _ in range(r.randint(5, 80))])))
    odd = [None, "", " \t\n", "a", "A", "a b", "A  B", "a b c", "b a", "É é", "x " * 500, "x x x", " ".join(f"v{i}" for i in range(20_000)), " ".join(f"v{i}" for i in range(20_001))]
    out += [(k := k + 1, t) for t in odd] + [(None, "no id here at all"), (out[3][0], out[20][1]), (out[5][0], out[5][1])]
    r.shuffle(out)
    return out


def test_all_pairs(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for c in ("rep", "key", "leader", "n", "size", "member", "component", "grams", "salt", "data"):
        docs = docs.withColumn(c, F.lit("x"))
    got = sorted(map(tuple, op.joined(docs).collect()), key=str)
    assert got == plain(rows)


def test_small_blocks(spark, rows, monkeypatch):
    """Groups of more classes than a block: the same classes (the helpers run in this process here)."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    many = [(i, " ".join(edited(r, base, 1 + i % 7))) for i in range(70)]
    docs = spark.createDataFrame(many, "doc_id long, text string")
    monkeypatch.setattr(op, "BLOCK", 5)
    assert sorted(map(tuple, op.joined(docs).collect()), key=str) == plain(many)


def test_empty(spark):
    assert op.joined(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_no_pair_is_missed_by_its_keys():
    r = np.random.default_rng(1)
    for percent in (80, 90):
        bands = op.Bands(percent)
        for size in [*range(1, 60), 150, 999, 5000]:
            a = np.unique(r.integers(0, 2**64, size, np.uint64))
            for b_size in {size, 100 * size // percent}:
                both = op.needed(len(a), b_size, percent)
                b = np.unique(np.concatenate([r.permutation(a)[:both], r.integers(0, 2**64, b_size - both, np.uint64)]))
                if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    assert np.intersect1d(op.part_keys(a, bands), op.part_keys(b, bands)).size, (size, b_size)


def test_tree_against_intersections():
    r = np.random.default_rng(2)
    for _ in range(40):
        base = r.integers(0, 1000, 60)
        sets = []
        for _ in range(r.integers(1, 40)):
            s = np.unique(np.concatenate([base[r.random(60) < 0.97], r.integers(0, 1000, r.integers(0, 4))])).astype(np.uint64)
            sets.append(s[: r.integers(1, len(s) + 1)] if r.random() < 0.3 else s)
        sets += sets[:2]
        tree = op.PrefixTree(sets)
        assert tree.lengths.sum() <= sum(map(len, sets)) and (len(sets) < 8 or tree.lengths.sum() < sum(map(len, sets)))
        for percent in (50, 90):
            for q in [*sets[:5], np.unique(r.integers(0, 2000, 50)).astype(np.uint64)]:
                want = {k for k, s in enumerate(sets) if 100 * len(np.intersect1d(q, s)) >= percent * len(np.union1d(q, s))}
                assert sorted(tree.linked(q, percent)) == sorted(want)
