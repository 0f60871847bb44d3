"""Clip, score, pair, run and file views over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.functions.text import has_text, wer_text
from voxframe.operators.order import number_within
from voxframe.session import whole_div

STUDENT_VOCAB = 63
SUBSTITUTE = "<unk>"  # a word no text of the tables contains


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clips(spark: SparkSession, sf_dir: str, wide: bool = False) -> DataFrame:
    """Clips from documents; some texts are blank and some have no audio.

    `wide` spreads them over all tasks, for work on every word.
    """
    docs = table(spark, sf_dir, "documents")
    return (docs.repartition("doc_id") if wide else docs).select(
        F.col("doc_id").alias("clip_id"),
        F.col("doc_id").alias("pos"),
        F.when(F.col("doc_id") % 17 == 0, "  ").otherwise(F.col("text")).alias("text"),
        "lang",
        "source",
        (F.col("n_chars").cast("double") / 15.0).alias("duration"),
        F.when(
            F.col("doc_id") % 13 != 0,
            F.struct(
                F.array(F.col("n_chars").cast("float")).alias("array"),
                F.lit(16_000).alias("sampling_rate"),
            ),
        ).alias("audio"),
    )


def waves(spark: SparkSession, sf_dir: str, rate: int = 16_000) -> DataFrame:
    """One sample per character of the whole text."""
    sample = lambda c: ((F.ascii(c) % 64 - 32) / F.lit(32.0)).cast("float")
    return table(spark, sf_dir, "documents").repartition("doc_id").select(
        F.col("doc_id").alias("clip_id"),
        F.struct(
            F.transform(F.split("text", ""), sample).alias("array"),
            F.lit(rate).alias("sampling_rate"),
        ).alias("audio"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token positions with teacher scores (64) and student scores (63).

    The student's scores at a position are those of the next vector.
    """
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 10).alias("teacher"),
    )
    n = vectors.select(F.count(F.lit(1))).scalar()
    student = vectors.select(
        F.pmod(F.col("vec_id") - 1, n).alias("vec_id"),
        F.slice("teacher", 1, STUDENT_VOCAB).alias("student"),
    )
    return vectors.join(student, "vec_id").select(
        whole_div(F.col("vec_id"), 10).alias("example_pos"),
        (F.col("vec_id") % 10).cast("int").alias("tok_pos"),
        "teacher",
        "student",
        F.when(F.col("vec_id") % 10 >= 8, -100).otherwise(F.col("label")).alias("label_id"),
    )


def teacher_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The teacher's half of `scores`."""
    return table(spark, sf_dir, "embeddings").select(
        whole_div(F.col("vec_id"), 10).alias("example_pos"),
        (F.col("vec_id") % 10).cast("int").alias("tok_pos"),
        F.transform(F.col("embedding").cast("array<double>"), lambda v: v * 10).alias("teacher"),
        F.when(F.col("vec_id") % 10 >= 8, -100).otherwise(F.col("label")).alias("label_id"),
    )


def hypotheses(refs: DataFrame, text: str = "text") -> DataFrame:
    """Outputs of models 1 to 3 for every reference, as spoilt copies of the whole text.

    Word i (from 1): models 1 and 3 drop some words and replace others, model 2
    replaces some and adds a word after others. The new word is not part of
    any text, so the number of changes is also the edit distance.
    """
    words = F.split(wer_text(F.col(text)), " ")

    def dropped(drop: int, replace: int):
        # NULL entries are left out when the words are joined again
        return F.transform(
            "words",
            lambda w, i: F.when((i + 1) % drop != 0, F.when((i + 1) % replace == 0, SUBSTITUTE).otherwise(w)),
        )

    def added(replace: int, after: int):
        def change(w, i):
            word = F.when((i + 1) % replace == 0, SUBSTITUTE).otherwise(w)
            return F.when((i + 1) % after == 0, F.concat(word, F.lit(f" {SUBSTITUTE}"))).otherwise(word)

        return F.transform("words", change)

    changed = (
        F.when(F.col("text_blank"), F.array().cast("array<string>"))
        .when(F.col("model") == 1, dropped(6, 8))
        .when(F.col("model") == 2, added(7, 13))
        .otherwise(dropped(9, 5))
    )
    return (
        refs.withColumns({"words": words, "text_blank": ~has_text(F.col(text))})
        .withColumn("model", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
        .withColumn("hyp", F.array_join(changed, " "))
        .drop("words", "text_blank")
    )


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, clip_id, ref, hyp, ms): every clip once per model, whole texts."""
    docs = clips(spark, sf_dir, wide=True).select("clip_id", "text", "duration")
    return hypotheses(docs).select(
        "model",
        "clip_id",
        F.col("text").alias("ref"),
        "hyp",
        (F.col("duration") * F.col("model")).alias("seconds"),
    )


def runs(spark: SparkSession, sf_dir: str, block: int = 1 << 20) -> DataFrame:
    """Training log of six runs, one per cell of the default sweep; run 5 failed."""
    run = (F.col("user_id") % 6).cast("int")
    rows = table(spark, sf_dir, "events").select(
        "event_id",
        run.alias("run"),
        F.element_at(F.array(F.lit(0.5), F.lit(0.7), F.lit(0.9)), (whole_div(run, 2) + 1).cast("int")).alias("alpha"),
        F.when(run % 2 == 0, 1.0).otherwise(2.0).alias("temperature"),
        F.col("value").alias("loss"),
        F.when((F.col("event_type") == "purchase") & (run != 5), F.col("value") / 100).alias("eval_wer"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"),
        "event_type",
    )
    return number_within(rows, ["run"], "event_id", "step", block)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot folders of the six runs."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 6).cast("int").alias("run"),
        F.when(kind == "error", "checkpoint-x")
        .otherwise(F.concat(F.lit("checkpoint-"), (whole_div(F.col("event_id"), 40) * 250).cast("string")))
        .alias("dir"),
        F.when(kind == "click", "config.json")
        .when(kind == "view", "model.safetensors")
        .when(kind == "purchase", "tokenizer.json")
        .when(kind == "signup", "optimizer.pt")
        .otherwise("tmp")
        .alias("file_name"),
        F.floor(F.col("value") * 1000).alias("size"),
        "event_id",
    )
