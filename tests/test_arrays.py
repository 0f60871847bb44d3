import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from voxframe.functions import arrays as A
from voxframe.operators import scores

LN3 = math.log(3.0)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_softmax(spark):
    assert one(spark, A.softmax(F.col("a")), a=[0.0, LN3]) == pytest.approx([0.25, 0.75])
    assert one(spark, A.softmax(F.col("a")), a=[1000.0, 1000.0]) == pytest.approx([0.5, 0.5])
    assert one(spark, A.log_softmax(F.col("a"), 2.0), a=[0.0, 2 * LN3]) == pytest.approx([math.log(0.25), math.log(0.75)])


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.floats(-50, 50), min_size=1, max_size=20), st.floats(0.5, 4))
def test_softmax_sums_to_one(spark, xs, t):
    assert sum(one(spark, A.softmax(F.col("a"), t), a=xs)) == pytest.approx(1.0)


def test_top_k_order_and_ties(spark):
    top = one(spark, A.top_k(F.col("a"), 3), a=[1.0, 5.0, 5.0, 2.0])
    assert [(e.token_id, e.logit) for e in top] == [(1, 5.0), (2, 5.0), (3, 2.0)]


def test_kl_by_hand(spark):
    p, q = [0.0, LN3], [0.0, 0.0]
    assert one(spark, A.kl_full(F.col("p"), F.col("q")), p=p, q=q) == pytest.approx(0.130812, abs=1e-6)
    top1 = A.kl_top_k(A.top_k(F.col("p"), 1), F.col("q"))
    assert one(spark, top1, p=p, q=q) == pytest.approx(math.log(2))
    # a probability of zero adds nothing
    assert one(spark, A.kl_full(F.col("p"), F.col("q")), p=[0.0, -1e6], q=q) == pytest.approx(math.log(2))
    assert one(spark, A.kl_full(F.col("p"), F.col("q")), p=[0.0, -math.inf], q=q) == pytest.approx(math.log(2))


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.integers(1, 12).flatmap(
        lambda n: st.tuples(*[st.lists(st.floats(-20, 20), min_size=n, max_size=n)] * 2)
    ),
    st.sampled_from([1.0, 2.0]),
)
def test_kl_properties(spark, pq, t):
    p, q = pq
    full = one(spark, A.kl_full(F.col("p"), F.col("q"), t), p=p, q=q)
    every = one(spark, A.kl_top_k(A.top_k(F.col("p"), len(p)), F.col("q"), t), p=p, q=q)
    assert full >= -1e-9
    assert every == pytest.approx(full, abs=1e-9)


def test_losses_by_hand(spark):
    df = spark.createDataFrame(
        [([0.0, LN3], [0.0, 0.0], 1), ([9.0, 1.0], [4.0, 2.0], -100)], ["teacher", "student", "label_id"]
    )
    for k, kl in ((None, 0.130812), (1, math.log(2)), (2, 0.130812)):
        row = scores.combined_loss(scores.loss_terms(df, k, [1.0]), [0.5]).first()
        assert (row.positions, row.ce) == (1, pytest.approx(math.log(2)))
        assert row.kl == pytest.approx(kl, abs=1e-6)
        assert row.loss == pytest.approx(0.5 * math.log(2) + 0.5 * kl, abs=1e-6)
    masked = scores.loss_terms(df.where("label_id = -100"), 1, [1.0, 2.0]).collect()
    assert [(r.positions, r.ce, r.kl) for r in masked] == [(0, None, None)] * 2


def test_stored_losses_equal_live_ones(spark):
    data = [([float((i * 7 + t * 3) % 11) / 2 for i in range(8)], [float((i * 5 + t) % 7) for i in range(8)], t % 8 if t % 4 else -100)
            for t in range(12)]
    df = spark.createDataFrame(data, "teacher array<double>, student array<double>, label_id int")
    live = scores.loss_terms(df, 3, [1.0, 2.0]).orderBy("temperature").collect()
    kept = scores.stored_loss_terms(scores.top_k_per_position(df, 3), [1.0, 2.0]).orderBy("temperature").collect()
    for a, b in zip(live, kept):
        assert tuple(a) == pytest.approx(tuple(b))
    # an id the student does not have is left out
    extra = spark.createDataFrame([([0.0, LN3, 9.0], [0.0, 0.0], 1)], df.schema)
    row = scores.stored_loss_terms(scores.top_k_per_position(extra, 3), [1.0]).first()
    assert row.kl == pytest.approx(0.130812, abs=1e-6)


def test_vocab_align(spark):
    a, b = A.align_vocab(F.col("a"), F.col("b"))
    df = spark.createDataFrame([([1, 2, 3, 4], [5, 6, 7])], ["a", "b"]).select(a.alias("a"), b.alias("b"))
    assert df.first() == ([1, 2, 3], [5, 6, 7])


def test_masked_mean_and_mean_or_nan(spark):
    df = spark.createDataFrame([(2.0, True), (4.0, True), (100.0, False)], ["x", "m"])
    assert df.agg(scores.masked_mean(F.col("x"), F.col("m"))).first()[0] == 3.0
    assert df.where("not m").agg(scores.masked_mean(F.col("x"), F.col("m"))).first()[0] is None
    assert math.isnan(df.where("x < 0").agg(scores.mean_or_nan(F.col("x"))).first()[0])


def test_vector_mse_counts_all_layers(spark):
    x = A.vector_mse(F.col("a"), F.col("b"))
    assert one(spark, x, a=[[0.0, 0.0], [1.0, 1.0]], b=[[0.0, 2.0], [1.0, 1.0]]) == pytest.approx(1.0)


def test_fixed_lengths(spark):
    fixed = A.pad_or_trim(F.col("a"), 3)
    assert one(spark, fixed, a=[1.0]) == [1, 0, 0]
    assert one(spark, fixed, a=[1.0, 2.0, 3.0, 4.0]) == [1, 2, 3]
    by_row = A.pad_or_trim(F.col("a"), F.col("n"), F.struct(F.lit(0).cast("long").alias("id")))
    df = spark.createDataFrame([([(7,)], 2), ([(7,), (8,)], 1)], "a array<struct<id: long>>, n int")
    assert [[e.id for e in r[0]] for r in df.select(by_row).collect()] == [[7, 0], [7]]
    f = A.truncate_context(F.col("f"), F.col("n"))
    wide = [[float(i) for i in range(6)]] * 2
    assert one(spark, f, f=wide, n=2) == [[0.0, 1.0, 2.0, 3.0]] * 2
    assert one(spark, f, f=wide, n=1500) == wide


def test_labels(spark):
    assert one(spark, A.shift_right(F.col("a"), 9), a=[1, 2]) == [9, 1]
    assert one(spark, A.shift_right(F.col("a"), 9), a=[3, -100]) == [9, 3]
    assert one(spark, A.shift_right(F.col("a"), 9), a=[-100, 3]) == [9, 0]
    assert one(spark, A.pad_mask(F.col("a"), 0), a=[5, 0]) == [5, -100]
    assert one(spark, A.gather(F.col("a"), F.array(F.lit(2), F.lit(0))), a=[1, 2, 3]) == [3, 1]


def test_row_form_equals_array_form(spark):
    df = spark.createDataFrame([(0, t, [float((t * 7 + i * 5) % 11) for i in range(9)]) for t in range(6)],
                               "example_pos long, tok_pos int, teacher array<double>")
    array = scores.explode_top(scores.top_k_per_position(df, 4))
    long = df.select("example_pos", "tok_pos", F.posexplode("teacher").alias("token_id", "logit"))
    cols = ["example_pos", "tok_pos", "rank", "token_id", "logit"]
    assert sorted(map(tuple, array.select(cols).collect())) == sorted(
        map(tuple, scores.top_k_long(long, 4).select(cols).collect())
    )


def test_wide_top_k_equals_top_k(spark):
    rows = [(i, [float((i * 13 + j * j) % 17) for j in range(i * 5 % 40)]) for i in range(40)] + [(99, None)]
    rows += [(100, [3.0, math.nan, 2.0, None, 2.0]), (101, [None, math.nan]), (102, [-math.inf, 1.0, math.inf])]
    df = spark.createDataFrame(rows, "id long, x array<double>").repartition(3)
    for k in (1, 4, 50):
        both = df.select("id", A.top_k(F.col("x"), k).alias("a"), A.top_k_wide(F.col("x"), k).alias("b"))
        assert all(r.a == r.b for r in both.collect())
    wide = scores.top_k_per_position(df, 3, "x")
    assert "ArrowEvalPython" in wide._jdf.queryExecution().executedPlan().toString()
    assert wide.count() == 44
    kept = {r.id: [(e.token_id, e.logit) for e in r.top] for r in wide.where("id >= 100").collect()}
    assert kept == {100: [(0, 3.0), (2, 2.0), (4, 2.0)], 101: [], 102: [(2, math.inf), (1, 1.0), (0, -math.inf)]}


@pytest.mark.parametrize("k", [None, 100])
def test_position_losses_at_vocabulary_width(spark, k):
    score = lambda seed: F.transform(F.sequence(F.lit(1), F.lit(51_866)), lambda i: F.sin(i * F.col("id") * seed) * 8)
    df = spark.range(1, 5).select(score(0.37).alias("t"), F.slice(score(0.91), 1, 51_865).alias("s"), F.col("id").cast("int").alias("y"))
    t, s = A.align_vocab(F.col("t"), F.col("s"))
    kl = lambda temp: A.kl_full(t, s, temp) if k is None else A.kl_top_k(A.top_k(t, k), s, temp)
    both = df.select(A.position_losses(F.col("s"), F.col("y"), [1.0, 2.0], F.col("t"), k).alias("l"),
                     A.cross_entropy(s, F.col("y")).alias("ce"), kl(1.0).alias("a"), kl(2.0).alias("b"))
    for r in both.collect():
        assert (r.l.ce, *r.l.kl) == pytest.approx((r.ce, r.a, r.b), rel=1e-9)


def test_position_losses_of_missing_scores(spark):
    rows = [([1.0, None], [1.0, 2.0]), ([1.0, 2.0], [1.0, math.nan]), (None, [1.0, 2.0]), ([1.0], None), ([math.nan], [0.0])]
    df = spark.createDataFrame(rows, "t array<double>, s array<double>").withColumn("y", F.lit(0)).coalesce(1)
    full, best = (
        [r.l for r in df.select(A.position_losses(F.col("s"), F.col("y"), [1.0], F.col("t"), k).alias("l")).collect()]
        for k in (None, 1)
    )
    assert math.isnan(full[0].kl[0]) and best[0].kl == [pytest.approx(1.313262, abs=1e-6)]
    assert math.isnan(full[1].ce) and math.isnan(best[1].kl[0])
    assert full[2].kl is best[2].kl is None and full[2].ce == pytest.approx(1.313262, abs=1e-6)
    assert tuple(full[3]) == (None, None) and best[4].kl is None and best[4].ce == 0.0


def test_packed_positions(spark):
    df = spark.createDataFrame([(1, 1, "b"), (0, 0, "c"), (1, 0, "a")], "example_pos long, tok_pos int, v string")
    got = {r.example_pos: [(p.tok_pos, p.v) for p in r.positions] for r in scores.pack_positions(df).collect()}
    assert got == {0: [(0, "c")], 1: [(0, "a"), (1, "b")]}


def test_a_label_outside_of_the_scores_is_not_counted(spark):
    rows = [([1.0, 2.0], [1.0, 3.0], 1), ([1.0, 2.0], [1.0, 3.0], 7), ([1.0, 2.0], [1.0, 3.0], -1), ([1.0, 2.0], [1.0, 3.0], None)]
    df = spark.createDataFrame(rows, "teacher array<double>, student array<double>, label_id int")
    alone = scores.loss_terms(df.limit(1), None, [1.0, 2.0]).collect()
    assert scores.loss_terms(df, None, [1.0, 2.0]).collect() == alone and alone[0].positions == 1
