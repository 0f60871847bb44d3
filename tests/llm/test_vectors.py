"""Near-duplicate vectors against all pairs."""

import collections

import compare
import numpy as np

from voxframe.llm import vectors as V
from voxframe.llm.common import cut
from voxframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, node string, tree int"


def brute(rows):
    good = [i for i, r in enumerate(rows) if r[1] and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    root, links = list(range(len(rows))), collections.Counter()

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in good:
        for j in good:
            if j < i and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], dtype=np.float32).astype(float), np.array(rows[j][1], dtype=np.float32).astype(float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    root[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted([(r[0], links[i], least.get(top(i)), r[0] is not None and r[0] == least.get(top(i))) for i, r in enumerate(rows)], key=str)


def some_rows(n, seed=4):
    random = np.random.default_rng(seed)
    base = random.standard_normal((n // 4, 32))
    rows = []
    for i in range(n):
        v = base[i % len(base)] + random.standard_normal(32) * random.choice([0, 0.05, 0.15, 0.2, 0.3])
        rows.append((i, [float(x) for x in v.astype(np.float32)], [0, 0, 1, 2, None][i % len(base) % 5], "x", 1))
    nan, inf = float("nan"), float("inf")
    rows += [(9001, None, 0, "x", 1), (9002, [0.0] * 32, 0, "x", 1), (9003, [nan] * 32, 0, "x", 1), (9004, [inf] * 32, 0, "x", 1)]
    rows += [(9005, [None] + [1.0] * 31, 0, "x", 1), (9006, [1.0] * 31, 0, "x", 1), (9007, [], 0, "x", 1), (None, rows[0][1], 0, "x", 1)]
    rows += [(3, rows[3][1], rows[3][2], "x", 1), (9008, [2 * x for x in rows[3][1]], rows[3][2], "x", 1)]
    return rows


def test_cases(spark, monkeypatch):
    rows = some_rows(400)
    df = spark.createDataFrame(rows, SCHEMA)
    want = brute(rows)
    assert sum(r[1] for r in want) > 300
    for leaf, fit, tile, pairs in ((1000, 16, 8192, 1 << 20), (20, 4, 8192, 1 << 20), (20, 4, 7, 1 << 20), (1000, 16, 30, 50)):
        for name, value in (("LEAF_ROWS", leaf), ("FIT_LEAF", fit), ("TILE", tile), ("PAIRS", pairs)):
            monkeypatch.setattr(V, name, value)
        got = sorted(map(tuple, V.near_duplicates(df).collect()), key=str)
        assert got == want
    assert V.near_duplicates(df.limit(0)).collect() == []


def test_links_of_deep_trees(spark, monkeypatch):
    """Small leaves, spill and five trees lose hardly a link, and none is counted twice."""
    rows = [(r[0], r[1], 0, "x", 1) for r in some_rows(1200)[:1200]]
    want = {r[0]: r[1] for r in brute(rows)}
    monkeypatch.setattr(V, "LEAF_ROWS", 40)
    got = {r.vec_id: r.n_links for r in V.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] <= n for i, n in want.items())
    assert sum(got.values()) >= 0.999 * sum(want.values())


def test_a_crowded_group_gives_no_pairs(spark, monkeypatch):
    """Near, but unequal vectors: all are links of each other; rows that leave the leaves grow with the vectors."""
    random = np.random.default_rng(7)
    centre = random.standard_normal(32)
    rows = [(i, (centre + 0.02 * random.standard_normal(32)).tolist(), 0, "x", 1) for i in range(1500)]
    monkeypatch.setattr(V, "LEAF_ROWS", 100)
    df = spark.createDataFrame(rows, SCHEMA)
    made = []
    monkeypatch.setattr(V, "cut", lambda d: made.append(cut(d)) or made[-1])
    got = V.near_duplicates(df).collect()
    assert all((r.n_links, r.component_id) == (1499, 0) for r in got)
    given = [d for d in made if d.columns == ["a", "b", "n"]]
    assert len(given) == 1 and given[0].count() <= 2 * 1500 * 60
    assert given[0].where("b IS NOT NULL").count() <= 1500 * V.TREES


def test_earlier_leaves():
    random = np.random.default_rng(2)
    lists = [np.unique(random.integers(0, 300, 12)) for _ in range(80)]
    bits = V.earlier_leaves(lists, 150)
    for i in range(80):
        for j in range(i):
            assert bool((bits[i] & bits[j]).any()) == bool([x for x in set(lists[i]) & set(lists[j]) if x < 150])


def test_query(spark):
    got = compare.spark_rows(QUERIES["op4_embeddings"](spark, SF))
    assert compare.difference(got, compare.sql_rows(compare.connect(SF), ORACLES["op4_embeddings"])) is None
