"""Operators against their SQL, and against plain models where SQL has none."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from terracell import catalogue
from terracell.functions import quad
from terracell.functions.text import clean, number
from terracell.operators import layers, roads
from terracell.operators.components import components
from terracell.session import cut

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def plain(v):
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else repr(v) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_sql(spark, name):
    df, con = catalogue.queries()[name](spark, SF), duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cur = con.execute(catalogue.oracle_sql()[name])
    names, cols = [d[0] for d in cur.description], sorted(df.columns)
    assert sorted(names) == cols
    want = sorted(plain([r[names.index(c)] for c in cols]) for r in cur.fetchall())
    assert sorted(plain([r[c] for c in cols]) for r in df.collect()) == want


def test_clean_and_number(spark):
    rows = [(" a  ", "a"), ("", None), (" null ", None), (None, None), ("\tNULLs", "NULLs")]
    assert [r[0] for r in spark.createDataFrame(rows, "x string, y string").select(clean(F.col("x"))).collect()] == [y for _, y in rows]
    got = spark.createDataFrame([(x,) for x in ("1.5", "12d", "abc", " -3e2 ", "", None)], "x string").select(number(F.col("x"))).collect()
    assert [r[0] for r in got] == [1.5, None, None, -300.0, None, None]


def sequential(edges, protected=()):
    """Merges one node at a time, the least first: ends and classes only."""
    live = [(min(u, v), max(u, v), c) for u, v, c in edges if u != v]
    while True:
        near = {}
        for k, (u, v, _) in enumerate(live):
            near.setdefault(u, []).append(k)
            near.setdefault(v, []).append(k)
        for node in sorted(near):
            if node in protected or len(near[node]) != 2:
                continue
            a, b = (live[k] for k in near[node])
            x, y = (e[0] if e[1] == node else e[1] for e in (a, b))
            if a[2] != b[2] or x == y:
                continue
            live = [e for k, e in enumerate(live) if k not in near[node]] + [(min(x, y), max(x, y), a[2])]
            break
        else:
            return sorted(live)


def test_contract(spark):
    case = [(1, 2, "motorway"), (2, 3, "motorway"), (3, 4, "motorway"), (3, 5, "trunk")]
    schema = "u long, v long, road_class string"
    got = roads.contract(spark.createDataFrame(case, schema)).select("u", "v", "road_class").collect()
    assert sorted(map(tuple, got)) == sequential(case) == [(1, 3, "motorway"), (3, 4, "motorway"), (3, 5, "trunk")]
    r = random.Random(5)
    for size in (4, 8, 14):
        edges = [(k, k % size + 1, "a") for k in range(1, size + 1)] + [(r.randint(1, size), r.randint(20, 30), r.choice("ab")) for _ in range(size // 4)] + [(r.randint(20, 30), r.randint(20, 30), "a") for _ in range(8)]
        got = roads.contract(spark.createDataFrame(edges, schema)).select("u", "v", "road_class").collect()
        assert sorted(map(tuple, got)) == sequential(edges)


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101)], "u long, v long")
    assert {(r.node, r.component) for r in components(edges).collect()} == {(k, 0) for k in range(41)} | {(100, 100), (101, 100)}


def test_smooth_is_smooth_and_covers(spark):
    deep = spark.range(1).select(quad.cell(F.lit(10.0), F.lit(20.0), 7).alias("cell"))
    start = spark.range(1).select(F.explode(F.array(*[quad.make(1, F.lit(x), F.lit(y)) for x in (0, 1) for y in (0, 1)])).alias("cell"))
    frontier, leaves = start, None
    for res in range(1, 7):
        up = deep.select(quad.parent(F.col("cell"), res, 7).alias("cell"))
        rest, hit = frontier.join(up, "cell", "left_anti"), frontier.join(up, "cell", "left_semi")
        leaves = rest if leaves is None else leaves.union(rest)
        frontier = hit.select(F.explode(quad.children(F.col("cell"))).alias("cell"))
    smooth = layers.smooth(leaves.union(frontier))
    cells = [(r.res, r.x, r.y) for r in smooth.select(quad.res(F.col("cell")).alias("res"), quad.col(F.col("cell")).alias("x"), quad.row(F.col("cell")).alias("y")).collect()]
    assert sum(4.0**-r for r, _, _ in cells) == 1.0
    known = set(cells)
    for r, x, y in cells:
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                a, b = (x + dx) % (1 << r), y + dy
                if 0 <= b < 1 << r:
                    covering = [q for q in range(r + 1) if (q, a >> (r - q), b >> (r - q)) in known]
                    assert all(r - q <= 1 for q in covering)


def test_cut_keeps_no_guess_of_its_size(spark):
    rows = spark.range(4).toDF("k")
    for _ in range(6):  # a join's guess is the product of its sides; kept over rounds, its digits double each time
        rows = cut(rows.join(rows.toDF("k"), "k"))
    assert sorted(r.k for r in rows.collect()) == [0, 1, 2, 3] and rows.schema == spark.range(1).toDF("k").schema
    assert int(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < 1 << 64


def test_components_end_in_few_rounds(spark, monkeypatch):
    ids, rounds = list(range(400)), []
    random.Random(3).shuffle(ids)

    def counted(df):
        rounds.append(1)
        assert len(rounds) <= 12
        return cut(df)

    monkeypatch.setattr("terracell.operators.components.cut", counted)
    paths = [(ids[k], ids[k + 1]) for k in range(399) if k % 50 < 49]
    got = {r.node: r.component for r in components(spark.createDataFrame(paths, "u long, v long")).collect()}
    assert got == {ids[k]: min(ids[k // 50 * 50 : k // 50 * 50 + 50]) for k in range(400)}
