import random

import pytest
from pyspark.sql import functions as F

from voxframe.functions.audio import context_frames
from voxframe.operators import order, rows
from voxframe.operators.grid import sweep_grid


def numbers(spark, n, **extra):
    ids = list(range(n))
    random.Random(3).shuffle(ids)
    return spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)


@pytest.fixture()
def five(spark):
    return spark.createDataFrame([(i, " " if i == 1 else "t") for i in range(5)], "pos long, text string")


def test_caps(five):
    ok = rows.has_text(F.col("text"))
    got = lambda df: sorted(r.pos for r in df.collect())
    assert got(rows.cap_then_filter(five, 3, ok)) == [0, 2]
    assert got(rows.filter_then_cap(five, 3, ok)) == [0, 2, 3]
    assert got(rows.filter_then_cap(five, 0, ok)) == [0, 2, 3, 4]
    assert rows.filter_then_cap(five, 3, ok).columns == five.columns
    assert got(rows.filter_then_cap(five, 99, ok)) == [0, 2, 3, 4]
    assert got(rows.filter_then_cap(five, 3, F.lit(False))) == []


def test_cap_with_ties_and_nulls(spark):
    df = spark.createDataFrame([(None, "d"), (0, "a"), (1, "b"), (1, "b"), (5, "c"), (-7, "e")], "pos long, text string")
    got = lambda n: sorted(((r.pos, r.text) for r in rows.filter_then_cap(df, n, F.lit(True)).collect()), key=str)
    assert got(2) == [(-7, "e"), (0, "a")]
    assert got(3) == got(4) == [(-7, "e"), (0, "a"), (1, "b"), (1, "b")]
    assert len(got(5)) == 5 and len(got(0)) == 6


def test_valid_rows(spark):
    df = spark.createDataFrame(
        [(1, "a", ([1.0],)), (2, "a", None), (3, "a", (None,)), (4, " ", ([1.0],)), (5, None, ([1.0],)), (6, "b", ([],))],
        "id int, text string, audio struct<array: array<float>>",
    )
    assert [r.id for r in rows.valid_rows(df).collect()] == [1, 6]
    assert [r.id for r in rows.valid_text_rows(df).collect()] == [1, 2, 3, 6]


def test_duration_limit(spark):
    df = spark.createDataFrame([(29.0,), (29.01,)], ["duration"])
    assert [r[0] for r in rows.within_duration(df).collect()] == [29.0]


@pytest.mark.parametrize("block", [1, 3, 7, 1 << 20])
def test_positions_for_any_block_size(spark, block):
    df = numbers(spark, 50).where("id % 4 <> 1")
    got = {r.id: r.pos for r in order.with_position(df, "id", block=block).collect()}
    assert got == {i: n for n, i in enumerate(i for i in range(50) if i % 4 != 1)}


def test_positions_of_sparse_ids(spark):
    rng = random.Random(4)
    ids = sorted({rng.randrange(-(2**63), 2**63) for _ in range(200)} | {-(2**63), 2**63 - 1})
    df = spark.createDataFrame([(i,) for i in reversed(ids)], "id long").repartition(4)
    got = {r.id: r.pos for r in order.with_position(df, "id", block=10).collect()}
    assert got == {i: n for n, i in enumerate(ids)}
    assert order.with_position(df.where("id is null"), "id").count() == 0


@pytest.mark.parametrize("ids", [
    list(range(3000)), [n * 10**12 - 10**15 for n in range(3000)], [2**60, *range(-1500, 1499)],
    [*range(1000), *(10**9 + 7 * n for n in range(1000)), *(10**15 + n * n for n in range(1000))],
], ids=["dense", "sparse", "outlier", "clusters"])
def test_positions_of_any_ids(spark, ids):
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
    got = {r.id: r.pos for r in order.with_position(df, "id", block=100).collect()}
    assert got == {i: n for n, i in enumerate(sorted(ids))}


@pytest.mark.parametrize("block", [1, 2, 4, 100, 1 << 10, 1 << 20, 1 << 40])
def test_windows_over_blocks_are_bounded(block):
    """From level to level, for the two ends of all 64-bit keys."""
    low, high = -(2**63) // block, (2**63 - 1) // block
    for width in order.level_widths(block):
        assert width <= order.WINDOW
        low, high = low // width, high // width
    assert high - low < order.WINDOW
    assert order.level_widths(1 << 20) == [1 << 22]


def test_positions_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(order, "WINDOW", 8)
    rng = random.Random(9)
    ids = sorted({rng.randrange(-(2**63), 2**63) for _ in range(60)} | set(range(-20, 40)))
    df = spark.createDataFrame([(i, i % 2) for i in ids], "id long, run long")
    assert len(order.level_widths(1 << 50)) == 4
    got = {r.id: r.pos for r in order.with_position(df, "id", block=1 << 50).collect()}
    assert got == {i: n for n, i in enumerate(ids)}
    got = {r.id: r.n for r in order.number_within(df, ["run"], "id", "n", 1 << 50).collect()}
    assert all(got[i] == sum(j % 2 == i % 2 for j in ids if j <= i) for i in ids)


def test_rows_without_an_order_have_no_position(spark):
    df = spark.createDataFrame([(i if i % 3 else None, f"t{i}") for i in range(30)], "id long, text string")
    got = order.with_position(df, "id", block=4).collect()
    ids = [i for i in range(30) if i % 3]
    assert len(got) == 30
    assert all(r.pos == (None if r.id is None else ids.index(r.id)) for r in got)
    alone = order.with_position(df.select("id"), "id", block=4).collect()
    assert sorted(map(str, alone)) == sorted(str(r).replace(f", text='{r.text}'", "") for r in got)


def test_positions_need_two_scans(spark, tmp_path):
    spark.range(100).selectExpr("id", "uuid() AS text").write.parquet(f"{tmp_path}/t")
    placed = order.with_position(spark.read.parquet(f"{tmp_path}/t"), "id")
    assert len(placed.collect()) == 100
    plan = placed._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan parquet") == 2 and plan.count("ReadSchema: struct<id:bigint>") == 1
    sorts = [line for line in plan.splitlines() if "Sort [" in line and "__block" in line]
    assert sorts and not any("text" in line for line in sorts)


@pytest.mark.parametrize("block", [2, 5, 1000])
def test_running_totals_of_a_hot_group(spark, block):
    # one run holds most rows; NULL is a group of its own
    data = [(i, None if i % 10 == 3 else "hot" if i % 10 else "cold", float(i)) for i in range(80)]
    df = spark.createDataFrame(data, "id long, run string, x double")
    got = order.running_totals(df, "id", {"total": F.col("x"), "n": F.lit(1).cast("long")}, ["run"], block)
    want, state = {}, {}
    for i, run, x in data:
        t, n = state.get(run, (0.0, 0))
        state[run] = want[i] = (t + x, n + 1)
    assert {r.id: (r.total, r.n) for r in got.collect()} == want


def test_bounded_shuffle(spark):
    df = order.with_position(numbers(spark, 40), "id")
    got = order.shuffle_bounded(df, 8, 42, "pos", "id").collect()
    assert sorted(r.shuffle_pos for r in got) == list(range(40))
    assert all(r.shuffle_pos // 8 == r.pos // 8 for r in got)
    assert any(r.shuffle_pos != r.pos for r in got)
    again = order.shuffle_bounded(df.repartition(3), 8, 42, "pos", "id").collect()
    assert {(r.id, r.shuffle_pos) for r in again} == {(r.id, r.shuffle_pos) for r in got}
    other = order.shuffle_bounded(df, 8, 43, "pos", "id").collect()
    assert {(r.id, r.shuffle_pos) for r in other} != {(r.id, r.shuffle_pos) for r in got}


@pytest.mark.parametrize("block", [1, 20, 1 << 20])
def test_filtered_shuffle_keeps_the_order(spark, block):
    df = order.with_position(numbers(spark, 60), "id")
    whole = {r.id: r.shuffle_pos for r in order.shuffle_bounded(df, 8, 42, "pos", "id").collect()}
    left = order.shuffle_filtered(df.where("id % 3 > 0"), 8, 42, "pos", "id", block=block).collect()
    got = [r.id for r in sorted(left, key=lambda r: r.shuffle_pos)]
    assert got == [i for i in sorted(whole, key=whole.get) if i % 3]
    assert sorted(r.shuffle_pos for r in left) == list(range(40))


def test_epochs(spark):
    got = order.repeat_epochs(numbers(spark, 30), 3, 7, "id").collect()
    by_epoch = {e: [r.id for r in sorted((r for r in got if r.epoch == e), key=lambda r: r.epoch_pos)] for e in range(3)}
    assert all(sorted(ids) == list(range(30)) for ids in by_epoch.values())
    assert by_epoch[0] != by_epoch[1] != by_epoch[2]
    assert all(sorted(r.epoch_pos for r in got if r.epoch == e) == list(range(30)) for e in range(3))


def test_batches_and_steps(spark):
    df = order.with_position(numbers(spark, 10), "id")
    got = order.assign_batches(df, 4).groupBy("batch").count().orderBy("batch").collect()
    assert [r["count"] for r in got] == [4, 4, 2]
    # 3 micro-batches an epoch, 2 per step: the second step spans two epochs
    plan = order.step_plan(df, batch=4, accum=2, epochs=2).groupBy("step", "epoch").count().orderBy("step", "epoch")
    assert [tuple(r) for r in plan.collect()] == [(0, 0, 8), (1, 0, 2), (1, 1, 4), (2, 1, 6)]
    assert order.step_plan(df, 4, 2, 2, max_steps=2).count() == 14
    assert order.steps_per_epoch(df, 4, 2).first()[0] == 2
    assert order.steps_per_epoch(df, 4, 4, floor_rows=True).first()[0] == 2


def test_resume_equals_one_run(spark):
    df = numbers(spark, 9).withColumnRenamed("id", "pos")
    ids = lambda d: sorted(r.pos for r in d.collect())
    assert ids(order.resume_from(df, 3, 5)) == [3, 4]
    assert ids(order.resume_from(df, 0, 3)) + ids(order.resume_from(df, 3)) == list(range(9))


def test_context_frames(spark):
    df = spark.createDataFrame([(0.0,), (0.05,), (29.0,), (40.0,)], ["d"])
    assert [r[0] for r in df.select(context_frames(F.col("d"))).collect()] == [1, 2, 1450, 1500]


def test_context_jitter_bounds(spark):
    df = spark.range(3000).select("id", (F.col("id") % 40 / 20.0 + 0.01).alias("d"))
    got = df.select(
        context_frames(F.col("d")).alias("n"), context_frames(F.col("d"), F.col("id"), 5).alias("j")
    ).collect()
    assert all(abs(r.j - r.n) <= min(64, r.n // 3) and 1 <= r.j <= 1500 for r in got)
    assert {r.j - r.n for r in got if r.n == 6} <= {-2, -1, 0, 1, 2}
    assert len({r.j - r.n for r in got}) > 20


def test_grid(spark):
    got = sweep_grid(spark.range(2), alpha=[0.5, 0.7], temperature=[1.0, 2.0]).collect()
    assert len({tuple(r) for r in got}) == 8


def test_flags_and_sources(spark):
    df = spark.createDataFrame(
        [(1, "a", True, None), (2, "b", False, False), (3, None, None, None), (4, "a", None, True)],
        "id int, source string, noisy boolean, multiple_speakers boolean")
    assert sorted(r.id for r in rows.quality_filter(df).collect()) == [2, 3]
    skipped = spark.createDataFrame([("a", "x"), ("a", "y"), (None, "z")], "source string, reason string")
    assert sorted(r.id for r in rows.skip_sources(df, skipped).collect()) == [2, 3]
