import pytest
from pyspark.sql import functions as F

from voxframe.operators import runs

# Published curve of one run and the start of a failed one
CURVE = [(0, 0.581), (500, 0.583), (1500, 0.563), (3500, 0.542), (6500, 0.527), (10000, 0.522), (13500, 0.536), (15000, 0.563)]


@pytest.fixture()
def curve(spark):
    rows = [("a", s, w) for s, w in CURVE] + [("a", 15100, None), ("b", 10, None)]
    return spark.createDataFrame(rows, "run string, step long, eval_wer double")


def test_curve(curve):
    best = {r.run: (r.best_step, r.best) for r in runs.best_step(curve).collect()}
    assert best == {"a": (10000, 0.522), "b": (None, None)}
    assert {r.run: r.last for r in runs.last_metric(curve).collect()} == {"a": 0.563, "b": None}
    row = runs.final_vs_best(curve).where("run = 'a'").first()
    assert row.regression == pytest.approx(0.041)
    assert (0.581 - row.best) / 0.581 == pytest.approx(0.1015, abs=1e-4)


def test_zero_is_not_missing(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, 0.0)], "run string, step long, eval_wer double")
    assert runs.last_metric(df).first().last == 0.0
    assert runs.best_step(df).first().best_step == 2


def test_best_step_takes_the_earliest(spark):
    df = spark.createDataFrame([("a", 3, 0.5), ("a", 2, 0.5)], "run string, step long, eval_wer double")
    assert runs.best_step(df).first().best_step == 2


def test_running_mean(spark):
    df = spark.createDataFrame([("a", s, float(s)) for s in range(1, 11)] + [("b", 1, 5.0)], "run string, step long, loss double")
    got = {(r.run, r.report_step): r["mean"] for r in runs.running_mean(df, 4).collect()}
    assert got == {("a", 4): 2.5, ("a", 8): 6.5}
    gaps = df.where("run = 'a' AND step % 3 <> 0")  # 1 2 4 5 | 7 8 10
    assert [(r.report_step, r["mean"]) for r in runs.running_mean(gaps, 4).collect()] == [(5, 3.0)]


@pytest.mark.parametrize("block", [1, 2, 1 << 20])
def test_throughput(spark, block):
    df = spark.createDataFrame(
        [("a", s, 10.0 * (s - 1), s != 2) for s in range(1, 8)], "run string, step long, seconds double, ok boolean"
    )
    got = runs.throughput(df, 3, valid=F.col("ok"), block=block).orderBy("batch").collect()
    assert [(r.next_pos, r.rows_done) for r in got] == [(3, 2), (6, 5), (7, 6)]
    assert got[1].s_per_row == pytest.approx(10.0) and got[1].rows_per_min == pytest.approx(6.0)
    still = runs.throughput(df.where("step = 1"), 3).first()
    assert (still.rows_done, still.rows_per_min) == (1, 0.0)


def files(spark, *rows):
    return spark.createDataFrame([(*r, 10) for r in rows], "run string, dir string, file_name string, size long")


def test_is_complete(spark):
    df = files(spark, ("a", "x", "config.json"), ("a", "x", "model.safetensors"), ("a", "x", "other"),
               ("a", "y", "config.json"), ("a", "y", "model.safetensors"), ("a", "y", "tokenizer.json"))
    got = {r.dir: (r.complete, r.missing) for r in runs.is_complete(df, ["run", "dir"]).collect()}
    assert got == {"x": (False, ["tokenizer.json"]), "y": (True, [])}
    empty = files(spark, ("a", "z", None))
    assert runs.is_complete(empty, ["run", "dir"]).first().missing == runs.REQUIRED_FILES


def test_snapshots(spark):
    df = files(spark, *[("a", d, "f") for d in ("checkpoint-250", "checkpoint-1000", "checkpoint-x", "checkpoint-9-old")],
               ("b", "final", "f"))
    assert {r.run: r.snapshot for r in runs.latest_snapshot(df).collect()} == {"a": "checkpoint-1000", "b": None}
    chosen = lambda name: F.when(F.col("run") == "b", F.lit(name))
    got = lambda name: {r.run: r.snapshot for r in runs.latest_snapshot(df, chosen(name)).collect()}
    assert got("final") == {"a": "checkpoint-1000", "b": "final"}
    assert got("gone") == {"a": "checkpoint-1000", "b": None}


def test_retain_latest(spark):
    df = files(spark, *[("a", f"checkpoint-{n}", f) for n in (250, 500, 750) for f in "xy"], ("b", "checkpoint-5", "x"), ("b", "final", "x"))
    got = {(r.run, r.dir): r.keep for r in runs.retain_latest(df, 2).collect()}
    assert got == {("a", "checkpoint-250"): False, ("a", "checkpoint-500"): True, ("a", "checkpoint-750"): True, ("b", "checkpoint-5"): True}
    keep_one = runs.retain_latest(df, 1).where("keep").collect()
    assert {(r.run, r.dir) for r in keep_one} == {("a", "checkpoint-750"), ("b", "checkpoint-5")}


def test_state_or_name(spark):
    df = spark.createDataFrame(
        [("step-2500", None, None), ("step-9", 7, 1), ("step-9", 8, None), ("final", None, None)],
        "dir string, state_step long, state_epoch long",
    )
    got = runs.state_or_name(df, 1000, prefix="step").collect()
    assert [(r.step, r.epoch) for r in got] == [(2500, 2), (7, 1), (8, 0), (0, 0)]
    assert runs.state_or_name(df, 0, prefix="step").first().epoch == 0


def test_artifact_size(spark):
    df = files(spark, ("a", "x", "1"), ("a", "x", "2"), ("a", "y", "1"))
    assert {r.dir: (r.files, r.bytes) for r in runs.artifact_size(df, ["dir"]).collect()} == {"x": (2, 20), "y": (1, 10)}
    assert runs.artifact_size(df).first().bytes == 30
