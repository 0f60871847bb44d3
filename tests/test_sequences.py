import pytest
from pyspark.sql import functions as F

from voxframe.operators import sequences as S


def by_id(df, column):
    return {r.id: r[column] for r in df.collect()}


def test_vocab_encode_decode(spark):
    df = spark.createDataFrame([(1, "b a b"), (2, " "), (3, None), (4, "c a zz")], "id long, text string")
    vocab = S.build_vocab(df, 7)
    assert [(r.token, r.n, r.token_id) for r in vocab.orderBy("token_id").collect()] == [("a", 2, 4), ("b", 2, 5), ("c", 1, 6)]
    coded = S.encode_text(df, vocab, ["id"], vocab_size=7)
    assert by_id(coded, "labels") == {1: [5, 4, 5], 2: [], 3: [], 4: [6, 4, 1]}
    assert by_id(S.encode_text(df, vocab, ["id"], max_len=2), "labels")[1] == [5, 4]
    wrapped = S.encode_text(df, vocab, ["id"], wrap=True)
    assert by_id(wrapped.where("id <> 3"), "labels") == {1: [2, 5, 4, 5, 3], 2: [2, 3], 4: [2, 6, 4, 1, 3]}
    assert by_id(S.decode_ids(wrapped, vocab, ["id"]), "decoded") == {1: "b a b", 2: "", 3: "", 4: "c a <unk>"}
    ignored = coded.withColumn("labels", F.concat("labels", F.array(F.lit(-100))))
    assert by_id(S.decode_ids(ignored, vocab, ["id"]), "decoded")[1] == "b a b"


@pytest.mark.parametrize("wrap", [False, True])
def test_both_sizes_of_a_vocabulary_give_the_same(spark, wrap):
    texts = ["b a b", " ", None, "c a zz", "", "zz zz b", "a " * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    vocab = S.build_vocab(df, 8)
    for max_len in (1, 2, 5, 448):
        small = S.encode_text(df, vocab, ["id"], max_len=max_len, wrap=wrap, vocab_size=8)
        large = S.encode_text(df, vocab, ["id"], max_len=max_len, wrap=wrap, vocab_size=10**6)
        assert by_id(small, "labels") == by_id(large, "labels")
        assert small.schema["labels"].dataType.elementType == large.schema["labels"].dataType.elementType
    odd = F.when(F.col("id") == 1, None).otherwise(F.concat("labels", F.array(F.lit(-100), F.lit(None).cast("int"), F.lit(99))))
    marked = small.withColumn("labels", odd)
    assert by_id(S.decode_ids(marked, vocab, ["id"], vocab_size=8), "decoded") == by_id(
        S.decode_ids(marked, vocab, ["id"], vocab_size=10**6), "decoded")


def test_only_a_bounded_vocabulary_is_sent_to_all_tasks(spark):
    df = spark.createDataFrame([(1, "a b")], "id long, text string")
    vocab = spark.createDataFrame([("a", 4), ("b", 5)], "token string, token_id int")
    plan = lambda size: S.encode_text(df, vocab, ["id"], vocab_size=size)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(1000) and "Generate" not in plan(1000) and "Join" in plan(10**6)
    with pytest.raises(ValueError, match="more than 1"):
        S.encode_text(df, vocab, ["id"], vocab_size=1)


def test_encoding_moves_no_text(spark, tmp_path):
    spark.createDataFrame([(i, "a b c") for i in range(20)], "id long, text string").write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    coded = S.encode_text(df, S.build_vocab(df, 9), ["id"], vocab_size=9)
    text = coded._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and text.count("FileScan") == 1


def batches(spark, *rows):
    return spark.createDataFrame(list(rows), "id long, batch long, labels array<int>")


def test_pad_and_common_start(spark):
    df = batches(spark, (1, 0, [7, 1, 2]), (2, 0, [7, 3]), (3, 1, [7, 1]), (4, 1, [8, 2]), (5, 2, []), (6, 2, [7]))
    padded = S.pad_to_batch_max(df)
    assert by_id(padded, "labels") == {1: [7, 1, 2], 2: [7, 3, -100], 3: [7, 1], 4: [8, 2], 5: [-100], 6: [7]}
    assert by_id(S.drop_common_start(padded, 7), "labels") == {
        1: [1, 2], 2: [3, -100], 3: [7, 1], 4: [8, 2], 5: [-100], 6: [7]
    }


def test_attention_mask(spark):
    df = batches(spark, (1, 0, [5, 0, 6, 0]))
    assert df.select(S.attention_mask(F.col("labels"))).first()[0] == [1, 0, 1, 0]
