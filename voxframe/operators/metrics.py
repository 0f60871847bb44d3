"""Word error rate, per model and sample size, and its comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.text import has_text, normalise_text, word_alignment, word_changes
from voxframe.operators.rows import drop_empty_reference


def zip_pairs(refs: DataFrame, hyps: DataFrame, on: Sequence[str]) -> DataFrame:
    """References and hypotheses of the same row."""
    return refs.join(hyps, list(on))


def word_edits(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Add `edits` (substitutions, deletions and insertions) and `ref_words`.

    Rows with a blank reference are dropped first, a NULL hypothesis counts as
    empty. The texts are dropped as soon as they have been read.
    """
    aligned = drop_empty_reference(df, ref).withColumn(
        "__a", word_alignment(F.col(ref), F.coalesce(F.col(hyp), F.lit("")))
    )
    return aligned.withColumns(
        {"edits": F.col("__a.edits"), "ref_words": F.col("__a.ref_words")}
    ).drop("__a", ref, hyp)


def split_edits(df: DataFrame, ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    """Add `changes`, struct<substitutions, deletions, insertions>, and `ref_words`; rows as in `word_edits`.

    Their sum is the `edits` of `word_edits`; which of several best alignments counts is stated in `edit_counts`.
    """
    found = drop_empty_reference(df, ref).withColumn("__a", word_changes(F.col(ref), F.coalesce(F.col(hyp), F.lit(""))))
    kinds = [F.col(f"__a.{c}").alias(c) for c in ("substitutions", "deletions", "insertions")]
    return found.withColumns({"changes": F.struct(*kinds), "ref_words": F.col("__a.ref_words")}).drop("__a", ref, hyp)


def wer(edits: str = "edits", ref_words: str = "ref_words", empty_value: float | None = None) -> Column:
    """All edits by all reference words, not the mean of the rows; may exceed 1."""
    value = F.try_divide(F.sum(edits), F.sum(ref_words))
    return value if empty_value is None else F.coalesce(value, F.lit(empty_value))


def wer_corpus(df: DataFrame, empty_value: float | None = None) -> DataFrame:
    """One row; without any pair WER is NULL, or `empty_value`."""
    return word_edits(df).agg(
        F.count(F.lit(1)).alias("samples"),
        F.coalesce(F.sum("edits"), F.lit(0)).alias("edits"),
        F.coalesce(F.sum("ref_words"), F.lit(0)).alias("ref_words"),
        wer(empty_value=empty_value).alias("wer"),
    )


def wer_by_model(df: DataFrame, seconds: str | None = None, model: str = "model") -> DataFrame:
    """WER, sample count and, with a `seconds` column, the time spent per model.

    Partial sums are taken before the shuffle, so one model may hold any share
    of the rows.
    """
    extra = [F.sum(seconds).alias("elapsed_s")] if seconds else []
    return (
        word_edits(df)
        .groupBy(model)
        .agg(
            F.count(F.lit(1)).alias("samples"),
            F.sum("edits").alias("edits"),
            F.sum("ref_words").alias("ref_words"),
            wer().alias("wer"),
            *extra,
        )
    )


def wer_normalised(df: DataFrame, ref: str = "ref", hyp: str = "hyp", model: str = "model") -> DataFrame:
    """WER per model of the texts as they are and normalised, side by side.

    Rows with a blank reference are left out; one that is blank only once it is normalised
    counts on the raw side alone.
    """
    said = F.coalesce(F.col(hyp), F.lit(""))
    plain = drop_empty_reference(df, ref).select(
        model, F.col(ref).alias("__ref"), said.alias("__hyp"),
        normalise_text(F.col(ref)).alias("__nref"), normalise_text(said).alias("__nhyp"),
    )
    aligned = plain.select(
        model, word_alignment(F.col("__ref"), F.col("__hyp")).alias("raw"), has_text(F.col("__nref")).alias("some"),
        word_alignment(F.col("__nref"), F.col("__nhyp")).alias("norm"),
    )
    counted = lambda c: F.when(F.col("some"), F.col(c))
    return aligned.groupBy(model).agg(
        F.count(F.lit(1)).alias("samples"),
        F.try_divide(F.sum("raw.edits"), F.sum("raw.ref_words")).alias("wer_raw"),
        F.try_divide(F.sum(counted("norm.edits")), F.sum(counted("norm.ref_words"))).alias("wer_normalised"),
    )


def wer_at_n(df: DataFrame, sizes: Sequence[int], pos: str = "pos", model: str = "model") -> DataFrame:
    """WER on the first n rows of each model for several n; 0 means all rows.

    `pos` counts the rows of a model from 0. Every pair that some n needs is aligned
    once, then counted for each n it belongs to.
    """
    if 0 not in sizes:
        df = df.where(F.col(pos) < max(sizes))
    counted = word_edits(df).withColumn("n", F.explode(F.array(*[F.lit(n) for n in sizes])))
    return (
        counted.where((F.col("n") == 0) | (F.col(pos) < F.col("n")))
        .groupBy(model, "n")
        .agg(F.count(F.lit(1)).alias("samples"), wer().alias("wer"))
    )


def vs_baseline(results: DataFrame, baseline: DataFrame, on: str = "model") -> DataFrame:
    """WER before and after, with the relative reduction; one row per model."""
    before = baseline.select(on, F.col("wer").alias("wer_before"))
    after = results.select(on, F.col("wer").alias("wer_after"))
    gain = F.try_divide(F.col("wer_before") - F.col("wer_after"), F.col("wer_before"))
    return before.join(after, on).withColumn("relative_reduction", gain)


def rank_runs(results: DataFrame, ties: Sequence[str] = ()) -> DataFrame:
    """Rank by WER, best first, failed runs (NULL) last in the order of `ties`.

    Takes one row per run, as left by an aggregation: the window over all of
    them holds as many rows as the sweep has cells.
    """
    by_wer = Window.orderBy(F.col("wer").asc_nulls_last(), *ties)
    return results.withColumn("rank", F.row_number().over(by_wer)).withColumn(
        "is_best", (F.col("rank") == 1) & F.col("wer").isNotNull()
    )
