"""Hard negatives against all pairs."""

import math
import random

import compare
import numpy as np

from voxframe.llm import negatives as N
from voxframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, n int, a long, score double"


def brute(rows, every=50, positives=5, negatives=3):
    good = []
    for at, (vec_id, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        moved = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        good.append((vec_id, moved, [math.floor(256 * float(np.float32(x))) for x in v], at))
    out = []
    order = lambda r: (-r[0], r[1][0] is None, r[1][0] or 0, r[1][3])
    for a in good:
        if a[0] is None or a[0] % every:
            continue
        scored = [(sum(x * y for x, y in zip(a[2], b[2])), b) for b in good if b is not a]
        for p, b in sorted([s for s in scored if s[1][1] == a[1]], key=order)[:positives]:
            fits = [s for s in scored if s[1][1] != a[1] and 50 * p <= 100 * s[0] <= 95 * p]
            for rank, (n, c) in enumerate(sorted(fits, key=order)[:negatives], 1):
                out.append((a[0], b[0], rank, c[0], p, n))
    return sorted(out, key=repr)


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, 2, 3.0) for r in rows], SCHEMA)
    sizes = {"anchor_block": 3, "candidate_block": 50, **more}
    got = N.mine(df, **sizes)
    found = sorted([tuple(r) for r in got.select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()], key=repr)
    assert found == brute(rows)
    return found


def made(n, dims=19, labels=4, seed=1):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(3)]
    return [(i, [c + rng.gauss(0, 0.6) for c in rng.choice(centres)], 0 if rng.random() < 0.4 else rng.randrange(labels))
            for i in range(n)]


def test_against_all_pairs(spark):
    assert check(spark, made(500))
    assert check(spark, made(300, dims=8, seed=2), candidate_block=1000, anchor_block=100)


def test_cases(spark):
    rows = made(260, dims=5, seed=3)
    rows += [(1000, None, 1), (1050, [1.0, None, 0.0, 0.0, 0.0], 1), (1100, [1.0] * 5, None), (1150, [float("nan")] * 5, 1),
             (1200, [float("inf")] * 5, 1), (None, [0.5] * 5, 0), (None, [0.5] * 5, 1), (1250, [0.0] * 5, 0), (1300, [], 0),
             (1350, [2.0, 1.0], 0), (1400, [1000.0, -1000.0, 3.0, 0.0, 0.001], 0), (1401, [-1000.0, 1000.0, 3.0, 0.0, 0.0], 0)]
    assert check(spark, rows)


def test_ties_and_repeated_rows(spark):
    rng = random.Random(4)
    few = [[1.0, 0.0, 0.0], [0.75, 0.25, 0.0], [0.5, 0.5, 0.5], [0.0, 0.0, 0.0]]
    rows = [(i, rng.choice(few), rng.randrange(3)) for i in range(200)]
    rows += [(50, [1.0, 0.0, 0.0], 1)] * 4  # an anchor that repeats
    assert check(spark, rows)


def test_empty_table(spark):
    assert N.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert N.mine(spark.createDataFrame([(1, [1.0], 1, 1, 1, 1.0)], SCHEMA)).count() == 0


def test_scores_are_inner_products():
    rng = np.random.default_rng(6)
    for low, high in ((-5, 5), (0, 200), (-300, -1), (-(1 << 24), 1 << 24), (0, 1)):
        a, b = rng.integers(low, high, (7, 21)), rng.integers(low, high, (1100, 21))
        (_, one), (_, two) = N.pack(a), N.pack(b)
        assert (N.unpack(two)[:, :21] == b).all()
        assert (N.scores(N.subset_sums(N.unpack(one)), two) == b @ a.T).all()


def test_query_equals_sql(spark):
    got = compare.spark_rows(QUERIES["op13_negatives"](spark, SF))
    want = compare.sql_rows(compare.connect(SF), ORACLES["op13_negatives"])
    assert got[1] and compare.difference(got, want) is None
