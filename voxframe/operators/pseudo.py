"""Generated labels: which of them to keep, and the chain that makes a training table of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.text import has_text, repetition_score
from voxframe.operators.combining import merge_labelled

BLANK_AUDIO = "[BLANK_AUDIO]"  # fixed value: what a model writes for silence
MAX_REPEATED = 0.5
MIN_CHARS_PER_SECOND = 1.0


def pseudo_label_filter(
    df: DataFrame, text: str = "text", duration: str = "duration", words: int = 3,
    max_repeated: float = MAX_REPEATED, min_chars_per_second: float = MIN_CHARS_PER_SECOND,
) -> DataFrame:
    """Drop doubtful outputs: blank, marked as silence, caught in a loop, or too short for their audio.

    A clip whose length is NULL or zero is not judged by its length.
    """
    c = F.col(text)
    dense = F.coalesce(F.try_divide(F.length(c), F.col(duration)) >= min_chars_per_second, F.lit(True))
    return df.where(
        has_text(c) & ~c.contains(BLANK_AUDIO) & dense & (repetition_score(c, words) <= max_repeated)
    )


def write_pseudo_labels(df: DataFrame, path: str) -> None:
    """Generated labels as a data set, a rerun in place of the last one."""
    df.write.mode("overwrite").parquet(path)


def pseudo_label(
    clips: DataFrame, predict: Callable[[DataFrame], DataFrame], path: str, key: str,
    text: str = "text", duration: str = "duration",
) -> DataFrame:
    """(key, text, supervised): labels of clips, generated by `predict` where they are blank.

    `predict` fills the text column. The generated labels that pass the filter are stored
    at `path`, read back, and merged with the given ones.
    """
    blank = ~has_text(F.col(text))
    generated = pseudo_label_filter(predict(clips.where(blank)), text, duration)
    write_pseudo_labels(generated.select(key, text), path)
    return merge_labelled(clips.where(~blank), clips.sparkSession.read.parquet(path), key, text)
