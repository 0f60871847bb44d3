"""Shards and mixes against brute force."""

import collections
import zlib

import compare
import pytest

from voxframe.llm import mixing, sharding
from voxframe.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, size string, shard string, key string, target string"


def brute_shards(rows, shards=24, tolerance=0.02):
    """rows: (k1, k2, size); the shard of each by the middle of its unit."""
    total = sum(r[2] for r in rows)
    limit = int(tolerance * total / shards)
    groups = collections.Counter()
    for k1, _, size in rows:
        groups[k1] += size
    unit = lambda r: (r[0], r[1] if groups[r[0]] > limit else None)
    sizes = collections.Counter()
    for r in rows:
        sizes[unit(r)] += r[2]
    before, where = 0, {}
    for u in sorted(sizes, key=lambda u: (u[0], -1 if u[1] is None else u[1])):
        where[u] = sum(2 * -(-total * j // shards) <= 2 * before + sizes[u] for j in range(1, shards))
        before += sizes[u]
    return [where[unit(r)] for r in rows]


def check_shards(df, shards=24):
    rows = sharding.sized(df).select("doc_id", "k1", "k2", "size").collect()
    want = collections.Counter(zip([(r.doc_id, r.size) for r in rows], brute_shards([tuple(r[1:]) for r in rows], shards)))
    got = sharding.digest(df, shards).collect()
    assert collections.Counter(((r.doc_id, r.size), r.shard) for r in got) == want
    for s in range(shards):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    return got


def test_shards_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = check_shards(docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert sorted(r.doc_id for r in got) == sorted(texts)
    for r in got:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 8, zlib.crc32(data), "bytes", None)


def test_hot_group_is_split_and_small_groups_stay_together(spark):
    rows = [(i, "same text " * 20, "s", None, None, None, None) for i in range(600)]
    rows += [(1000 + i, f"other text {i // 2} ", "s", None, None, None, None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = check_shards(df)
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert max(sizes.values()) - min(sizes.values()) < 0.05 * sum(sizes.values()) / 24
    shard = {r.doc_id: r.shard for r in got}
    assert all(shard[1000 + i] == shard[1001 + i] for i in range(0, 3000, 2))


def test_rows_that_repeat_are_split_too(spark):
    """Half of all rows are one row; they, and texts that are large on their own, fall between shards like any other."""
    rows = [(7, "the same row " * 40, "s", None, None, None, None)] * 3000
    rows += [(1000 + i, f"row number {i} " * 36, "s", None, None, None, None) for i in range(3000)]
    got = sharding.digest(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 0.05 * sum(sizes.values()) / 24
    for s in range(24):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))


def test_shards_edge_cases(spark):
    rows = [(None, None), (None, None), (3, ""), (3, ""), (3, "é"), (None, "x" * 100_000), (4, "a"), (5, "a")]
    df = spark.createDataFrame([(*r, None, "1", "2", "3", "4") for r in rows], SCHEMA)
    got = check_shards(df)
    assert sorted((r.size, r.text_crc32 is None) for r in got) == sorted((len((t or "").encode()) + 8, t is None) for _, t in rows)
    check_shards(df, 1)
    assert sharding.digest(df.limit(0)).collect() == []


def test_mix_equals_sql(spark):
    got = compare.spark_rows(QUERIES["op5_mixing"](spark, SF))
    want = compare.sql_rows(compare.connect(SF), ORACLES["op5_mixing"])
    for rows in (got[1], want[1]):
        for i, r in enumerate(rows):
            rows[i] = tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert compare.difference(got, want) is None


def test_targets(spark):
    sizes = {"a": 10, "b": 1000, "c": 500, None: 300}
    rows = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    weight, open_, left, want = dict(zip(["a", "b", "c", None], [3, 1, 2, 3])), set(sizes), 1.5 * sum(sizes.values()), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            want[s] = 2 * sizes[s]
            left -= want[s]
        open_ -= over
    want |= {s: level * weight[s] for s in open_}
    assert got == pytest.approx(want)


def test_mix_edge_cases(spark):
    rows = [(i, f"w{i} " * (1 + i % 50), ["x", "y", None][i % 3], "1", "2", "3", "4") for i in range(900)]
    rows += [(None, "again and again", "x", None, None, None, None)] * 5 + [(1, None, "x", None, None, None, None), (2, " ", "z", None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.digest(df).collect()
    assert len(got) == len(rows)
    taken, targets = collections.Counter(), {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source_size, r.target] += r.taken
        targets[r.source_size, r.target] = r.target
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 60
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.digest(df.repartition(7)).collect()), key=str)
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in got)
    assert mixing.digest(df.limit(0)).collect() == []
    assert mixing.mixed_documents(df.where("text IS NULL")).collect() == []
