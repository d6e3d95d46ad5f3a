"""The manifest against a plain model with hashlib, on sizes around the fan and the bucket, and on odd rows."""

import hashlib
import zlib

import pytest

from terracell.llm import op11_merkle_manifest as op

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def field(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, text) -> str:
    return sha("".join(map(field, (row[0], row[3], row[2], row[4], text))))


def climbed(digests):
    """Root, and for each place its ways up: (left, right) of each level."""
    ways, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for i in range(len(digests)):
            run = at[i] // 16 * 16
            ways[i].append(("".join(level[run : at[i]]), "".join(level[at[i] + 1 : run + 16])))
            at[i] //= 16
        level = [sha("".join(level[k : k + 16])) for k in range(0, len(level), 16)]
    return level[0], ways


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda x: x[:3])
        trees[s] = climbed([x[2] for x in by[s]])
    root, high = climbed([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, high, strict=True):
        for (_, _, digest, r), ways in zip(by[s], trees[s][1], strict=True):
            f = digest
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                f = leaf(r, None if r[1] is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in ways + up:
                f = sha(left + f + right)
            out.append((r[0], digest, trees[s][0], root, sha("".join(a + b for a, b in ways + up)), f, f == root))
    return sorted(out, key=str)


def found(spark, rows):
    got = op.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted((tuple(r) for r in got), key=str)


def test_odd_rows(spark):
    rows = [(1, "Aa", "en", "b", 2), (2, None, None, None, None), (None, "X", "en", None, 1), (None, "X", "en", None, 1), (3, "", "en", "", 0), (3, "other", "en", "", 5), (3, "other", "en", "", 5), (5, "É" * 9, "fr", "é", 9), (9, "Z" * 100_000, "x", "z", 1)]
    rows += [(k, f"Text {k}", "en", f"s{k % 20}", k) for k in range(10, 60)]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:1]) == plain(rows[:1])
    assert found(spark, []) == []


@pytest.mark.parametrize("n", [16, 17, 257, 4096, 4097, 9000])
def test_sizes(spark, n):
    """One source of n leaves beside two small ones: runs that are full, that have one node, and more tiers than one."""
    rows = [(7 * k, f"Row {k}", "en", "hot", k) for k in range(n)] + [(-k, "Cold", None, f"c{k % 2}", k) for k in range(1, 4)]
    assert found(spark, rows) == plain(rows)


def test_clashing_columns_and_small_chunks(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [(k, f"Row {k % 7}", "en", f"s{k % 3}", k) for k in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for c in ("key", "pos", "n", "digest", "bucket", "part", "at", "leaf", "root", "own"):
        docs = docs.withColumn(c, F.lit("x"))
    assert sorted((tuple(r) for r in op.manifest(docs).collect()), key=str) == plain(rows)


def test_many_sources(spark):
    """More sources than a bucket holds: the upper tree has tiers of its own."""
    rows = [(k, f"T{k}", "en", f"s{k % 4200}", k) for k in range(6000)]
    assert found(spark, rows) == plain(rows)
