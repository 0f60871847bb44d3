"""Several sources, generated labels and side-by-side scores: hand cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxframe.functions import arrays as A
from voxframe.functions.text import normalise_text, repetition_score
from voxframe.operators import combining, metrics, pseudo, runs, scores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_harmonise_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "uuid int, sentence string")
    b = spark.createDataFrame([(2, "y", True)], "id int, text string, noisy boolean")
    got = combining.harmonise([(a, {"uuid": "id", "sentence": "text"}), (b, {})]).collect()
    assert sorted(tuple(r) for r in got if r.noisy) == [(2, "y", True)] and len(got) == 2


def mixed(weights, rows):
    """Places by sorting all rows: (r - 1/2) / weight, until the first source runs out."""
    names, places = list(weights), []
    for n, s in enumerate(names):
        keys = sorted(k for k, source in rows if source == s)
        places.append([((2 * r + 1) * math.lcm(*weights.values()) // weights[s], n, k) for r, k in enumerate(keys)])
    if not all(places):
        return []
    return [k for at in [sorted(sum(places, []))] for v, n, k in at if (v, n) <= min(p[-1][:2] for p in places)]


@pytest.mark.parametrize("weights, counts", [
    ({"A": 7, "B": 3}, {"A": 20, "B": 20, "C": 4}), ({"A": 7, "B": 3}, {"A": 40, "B": 2}), ({"A": 1, "B": 1, "C": 2}, {"A": 9, "B": 5, "C": 30}),
    ({"A": 1, "B": 1}, {"A": 3}), ({"A": 1, "B": 5}, {}),
])
def test_interleave(spark, weights, counts):
    rows = [(i * 10 + ord(s), s) for s, n in counts.items() for i in range(n)]
    df = spark.createDataFrame([*rows, (1, None)], "k long, source string")
    got = sorted((r.place, r.k) for r in combining.interleave(df, weights, "k").collect())
    assert got == list(enumerate(mixed(weights, rows)))


def test_interleave_begins_with_the_heavier_source(spark):
    df = spark.createDataFrame([(i, s) for s in "AB" for i in range(9)], "k long, source string")
    got = combining.interleave(df, {"A": 7, "B": 3}, "k").orderBy("place").limit(4).collect()
    assert [r.source for r in got] == ["A", "B", "A", "A"]


def test_supervised_label_wins(spark):
    given = spark.createDataFrame([(1, "right"), (1, "zright")], "k int, text string")
    made = spark.createDataFrame([(1, "a guess"), (2, "b"), (2, "a"), (None, "n")], "k int, text string")
    got = {r.k: (r.text, r.supervised) for r in combining.merge_labelled(given, made, "k").collect()}
    assert got == {1: ("right", True), 2: ("a", False), None: ("n", False)}


def test_seeded_interleave(spark):
    df = spark.createDataFrame([("A" if i % 3 else "B", i) for i in range(60)], "source string, k long")
    plain = {r.k: r for r in combining.interleave(df, {"A": 2, "B": 1}, "k").collect()}
    runs_ = [sorted((r.place, r.source, r.k) for r in combining.interleave(df.repartition(n), {"A": 2, "B": 1}, "k", seed=s).collect()) for n, s in ((1, 5), (4, 5), (2, 6))]
    assert runs_[0] == runs_[1] != runs_[2]
    assert [r[1] for r in runs_[0]] == [r.source for r in sorted(plain.values(), key=lambda r: r.place)]
    assert [r[0] for r in runs_[0]] == list(range(len(plain)))
    firsts = [r[2] for r in runs_[0] if r[1] == "A"]
    assert firsts != sorted(firsts) and len(set(firsts)) == len(firsts)


def test_overlap_shuffles_keys_only(spark, tmp_path):
    for name in ("a", "b"):
        spark.createDataFrame([(i, f"text {i} of {name}" if i % 2 else f"same {i}!") for i in range(30)], "id long, text string").write.parquet(f"{tmp_path}/{name}")
    df, used = (spark.read.parquet(f"{tmp_path}/{n}") for n in "ab")
    new = combining.only_new_rows(df, used.select(F.upper("text").alias("text")))
    assert sorted(r.id for r in new.collect()) == list(range(1, 30, 2))
    plan = new._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_new_and_overlapping_rows(spark):
    df = spark.createDataFrame([(1, "Hello,  World!"), (2, "other"), (3, None), (4, "")], "id int, text string")
    used = spark.createDataFrame([("hello world",), ("hello world",), (None,)], "text string")
    assert sorted(r.id for r in combining.only_new_rows(df, used).collect()) == [2, 3, 4]
    assert [r.id for r in combining.overlap_rows(df, used).collect()] == [1]
    assert combining.overlap_rows(df, used.limit(0)).collect() == []


def test_source_profile(spark):
    df = spark.createDataFrame([("a", 1800.0), ("a", None), (None, 3600.0)], "source string, duration double")
    got = {r.source: tuple(r)[1:] for r in combining.source_profile(df).collect()}
    assert got == {"a": (2, 0.5, 1800.0), None: (1, 1.0, 3600.0)}


@pytest.mark.parametrize("text, n, want", [
    ("a b a b a b", 2, 0.6), ("a b", 3, 0.0), ("", 2, 0.0), (" a  a\na ", 1, pytest.approx(2 / 3)), (None, 2, None)])
def test_repetition_score(spark, text, n, want):
    assert one(spark, repetition_score(F.lit(text).cast("string"), n)) == want


def test_repetition_of_a_long_text(spark):
    words = " ".join(f"w{i % 700}" for i in range(20_000))
    assert one(spark, repetition_score(F.lit(words), 3)) == pytest.approx(1 - 700 / 19_998)


def test_normalise_text(spark):
    assert one(spark, normalise_text(F.lit("  Don’t «STOP» -\n now! "))) == "dont stop now"


def test_wer_normalised(spark):
    pairs = [("m", "The cat.", "the cat"), ("m", "a b", "a x"), ("m", "!!", "!!"), ("m", " ", "x"), ("n", "a", None)]
    df = spark.createDataFrame(pairs, "model string, ref string, hyp string")
    got = {r.model: tuple(r)[1:] for r in metrics.wer_normalised(df).collect()}
    assert got == {"m": (3, 3 / 5, 1 / 4), "n": (1, 1.0, 1.0)}


def test_pseudo_label_filter(spark):
    rows = [(1, "a good long line", 2.0), (2, "x [BLANK_AUDIO]", 1.0), (3, "hm", 30.0), (4, "a b c " * 9, 5.0), (5, " ", 1.0),
            (6, None, 1.0), (7, "no length", None), (8, "zero", 0.0)]
    df = spark.createDataFrame(rows, "id int, text string, duration double")
    assert sorted(r.id for r in pseudo.pseudo_label_filter(df).collect()) == [1, 7, 8]


def test_pseudo_label_keeps_given_labels_and_reruns(spark, tmp_path):
    clips = spark.createDataFrame([(1, "given", 1.0), (2, None, 1.0), (3, " ", 90.0)], "id int, text string, duration double")
    for _ in range(2):
        out = pseudo.pseudo_label(clips, lambda df: df.withColumn("text", F.lit("made up")), str(tmp_path / "labels"), "id")
        assert sorted(tuple(r) for r in out.collect()) == [(1, "given", True), (2, "made up", False)]


def test_regression_alarm(spark):
    log = spark.createDataFrame([(0, 1, None), (0, 500, 6.06), (0, 900, 0.1), (1, 500, 0.58), (2, 1, None)], "run int, step int, eval_wer double")
    start = spark.createDataFrame([(0, 0.581), (1, 0.581), (2, 0.581)], "run int, wer double")
    assert [tuple(r) for r in runs.regression_alarm(log, start).collect()] == [(0, 0.581, 6.06)]


def test_divergence_and_mass(spark):
    p, q = F.array(F.lit(0.0), F.lit(math.log(3))), F.array(F.lit(1.0), F.lit(1.0), F.lit(9.0))
    mean = [0.375, 0.625]
    want = sum(x * math.log(x / m) for side in ([0.25, 0.75], [0.5, 0.5]) for x, m in zip(side, mean)) / 2
    assert one(spark, A.js_divergence(p, q)) == pytest.approx(want)
    assert one(spark, A.js_divergence(q, p)) == pytest.approx(want)
    apart = F.array(F.lit(0.0), F.lit(5000.0)), F.array(F.lit(5000.0), F.lit(0.0))
    assert one(spark, A.js_divergence(*apart)) == pytest.approx(math.log(2))
    df = spark.range(1).select(p.alias("teacher"), q.alias("student"))
    got = scores.top_k_mass(df, 1).first()
    assert (got.kept, got.outside) == pytest.approx((0.75, 0.5))


def plain_js(p, q):
    """Divergence to the mean, term by term."""
    norm = lambda x: x - x.max() - np.log(np.exp(x - x.max()).sum())
    a, b = norm(p), norm(q)
    mean = np.log((np.exp(a) + np.exp(b)) / 2)
    return ((np.exp(a) * (a - mean)).sum() + (np.exp(b) * (b - mean)).sum()) / 2


def test_divergence_and_mass_at_vocabulary_width(spark):
    rng = np.random.default_rng(3)
    p, q = rng.normal(0, 3, (2, 51_865))
    ids = rng.choice(51_865, 100, replace=False)
    df = spark.createDataFrame([(p.tolist(), q.tolist(), ids.tolist())], "p array<double>, q array<double>, ids array<int>")
    got = df.select(
        A.js_divergence(F.col("p"), F.col("q")).alias("js"), A.js_divergence(F.col("p"), F.col("q"), F.lit(2.0)).alias("js2"),
        A.top_mass(F.col("p"), F.col("ids")).alias("mass"), A.log_probability_at(F.col("p"), F.col("ids")).alias("at"),
    ).first()
    log_p = p - p.max() - np.log(np.exp(p - p.max()).sum())
    assert got.js == pytest.approx(plain_js(p, q), abs=1e-12) and got.js2 == pytest.approx(plain_js(p / 2, q / 2), abs=1e-12)
    assert got.mass == pytest.approx(np.exp(log_p[ids]).sum(), abs=1e-12) and np.allclose(got["at"], log_p[ids], atol=1e-12)


def test_divergence_mass_and_gather_of_odd_rows(spark):
    nan = float("nan")
    rows_ = [(None, [1.0], [0]), ([1.0], None, None), ([], [], []), ([1.0, nan], [1.0, 2.0], [0]), ([1.0, None], [1.0, 2.0], [1]), ([0.0, 0.0], [0.0, 0.0], [0, 5, -1])]
    df = spark.createDataFrame(rows_, "p array<double>, q array<double>, ids array<int>").coalesce(1)
    got = df.select(A.js_divergence(F.col("p"), F.col("q")), A.top_mass(F.col("p"), F.col("ids")), A.log_probability_at(F.col("p"), F.col("ids"))).collect()
    assert [None if r[0] is None else str(r[0]) for r in got] == [None, None, "0.0", "nan", "nan", "0.0"]
    assert [None if r[1] is None else str(r[1]) for r in got] == [None, None, "0.0", "nan", "nan", "0.5"]
    assert got[2][2] == [] and got[5][2] == [pytest.approx(-math.log(2)), None, None]


def test_gather_needs_only_kept_ids(spark):
    top = spark.createDataFrame([(0, 0, 1, 2, 9.0), (0, 0, 2, 0, 8.0), (0, 1, 1, 7, 1.0)], "example_pos long, tok_pos int, rank int, token_id int, logit double")
    student = spark.createDataFrame([(0, 0, [1.0, 2.0, 3.0]), (0, 1, [1.0, 2.0, 3.0]), (1, 0, [1.0])], "example_pos long, tok_pos int, student array<double>")
    norm = math.log(sum(math.exp(x) for x in (1, 2, 3)))
    got = {(r.tok_pos, r.token_id): r.log_q for r in scores.gather_top(top, scores.kept_log_probabilities(top, student)).collect()}
    assert got == {(0, 2): pytest.approx(3 - norm), (0, 0): pytest.approx(1 - norm)}


def test_argmax_passes_over_missing_scores(spark):
    nan = float("nan")
    rows_ = [[1.0, nan, 3.0], [nan, None], [None, 2.0, 2.0], [], None, [nan, -5.0], [float("-inf"), nan]]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(rows_)], "i int, x array<double>")
    got = {r.i: (r.label, r.top) for r in df.select("i", A.argmax_label(F.col("x")).alias("label"), A.top_k_wide(F.col("x"), 1).alias("top")).collect()}
    assert {i: g[0] for i, g in got.items()} == {0: 2, 1: None, 2: 1, 3: None, 4: None, 5: 1, 6: 0}
    assert all((t[0].token_id if t else None) == label for label, t in got.values())


def test_loss_balance(spark):
    df = spark.createDataFrame([(0.5, 2.0, 1.0, 1.5), (0.5, 0.0, 0.0, 0.0)], "alpha double, ce double, kl double, loss double")
    got = scores.loss_balance(df).collect()
    assert (got[0].kl_to_ce, got[0].kl_share) == pytest.approx((0.5, 1 / 3))
    assert (got[1].kl_to_ce, got[1].kl_share) == (None, None)
