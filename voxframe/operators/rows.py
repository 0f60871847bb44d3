"""Row filters and caps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxframe.functions.audio import MAX_CLIP_SECONDS
from voxframe.functions.text import has_text
from voxframe.operators.order import running_totals


def is_valid(text: str = "text", audio: str = "audio") -> Column:
    """Text that is not blank and audio samples that are present."""
    return has_text(F.col(text)) & F.col(f"{audio}.array").isNotNull()


def valid_rows(df: DataFrame, text: str = "text", audio: str = "audio") -> DataFrame:
    return df.where(is_valid(text, audio))


def valid_text_rows(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(has_text(F.col(text)))


def drop_empty_reference(df: DataFrame, ref: str = "ref") -> DataFrame:
    return df.where(has_text(F.col(ref)))


def quality_filter(df: DataFrame, flags: tuple[str, ...] = ("noisy", "multiple_speakers")) -> DataFrame:
    """Drop rows with a raised flag; a flag that is NULL is not raised."""
    for flag in flags:
        df = df.where(~F.coalesce(F.col(flag), F.lit(False)))
    return df


def skip_sources(df: DataFrame, skipped: DataFrame, source: str = "source") -> DataFrame:
    """Drop the rows of the sources listed in `skipped` (source, reason); a NULL source is never listed."""
    return df.join(skipped.select(source).distinct(), source, "left_anti")


def within_duration(
    df: DataFrame, seconds: float = MAX_CLIP_SECONDS, duration: str = "duration"
) -> DataFrame:
    """Drop clips longer than the limit; the limit itself is kept."""
    return df.where(F.col(duration) <= seconds)


def project_prepared(df: DataFrame, keep: list[str]) -> DataFrame:
    """Only the prepared columns, so the scan reads no others."""
    return df.select(*keep)


def cap_then_filter(df: DataFrame, n: int, keep: Column, pos: str = "pos") -> DataFrame:
    """First n positions, then the filter: fewer than n rows may remain.

    The cap is a range on the position, so no optimiser rule can move the
    filter in front of it.
    """
    return df.where(F.col(pos) < n).where(keep)


def filter_then_cap(df: DataFrame, n: int, keep: Column, pos: str = "pos") -> DataFrame:
    """The filter, then the first n rows left in the order of `pos`, an integer; 0 means all.

    The n-th place is found on counts of the positions alone, in blocks; the rows are then
    cut by a range and none is moved. Rows that share the n-th position are all kept, rows
    without a position only if n is 0.
    """
    kept = df.where(keep)
    if not n:
        return kept
    held = kept.where(F.col(pos).isNotNull()).groupBy(pos).agg(F.count(F.lit(1)).alias("__rows"))
    upto = running_totals(held, pos, {"__upto": F.col("__rows")})
    last = upto.where(F.col("__upto") - F.col("__rows") < n).agg(F.max(pos)).scalar()
    return kept.where(F.col(pos) <= last)
