"""Several clip sources in one table: joined, mixed, merged, and compared by text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from math import lcm

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.functions.text import normalise_text
from voxframe.operators.order import number_within, shuffle_full
from voxframe.session import stored, whole_div

_TEXT, _KEYS = "__text", ["__k1", "__k2"]


def harmonise(sources: Sequence[tuple[DataFrame, Mapping[str, str]]]) -> DataFrame:
    """One table of sources that name their columns differently.

    Each source comes with its renames (old to new). A column that a source lacks is NULL.
    """
    renamed = [df.withColumnsRenamed(dict(names)) for df, names in sources]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), renamed)


def interleave(
    df: DataFrame, weights: Mapping[str, int], order: str, source: str = "source", name: str = "place",
    seed: int | None = None,
) -> DataFrame:
    """Rows of the sources mixed by weight until the first source runs out, with their place from 0.

    The r-th row of a source stands at (r - 1/2) / weight, equal places in the order of
    `weights`; whole numbers throughout, so no tie hangs on rounding. How many rows of every other source stand
    before a row follows from its own place, so nothing is sorted over all rows.
    `order` numbers the rows of a source and may repeat only between sources. Rows of sources
    without a weight are left out; a weighted source without rows has run out from the start.
    With a `seed` each source is taken in a seeded order of `order` instead; the shares stay as they are.
    """
    whole = lcm(*weights.values())
    steps = [whole // w for w in weights.values()]
    numbers = F.create_map(*[F.lit(x) for n, s in enumerate(weights) for x in (s, n)])
    strides = F.array(*[F.lit(s).cast("long") for s in steps])
    listed = df.where(F.col(source).isin(*weights)).withColumn("__n", numbers[F.col(source)])
    ends = listed.groupBy("__n").agg(((F.count(F.lit(1)) * 2 - 1) * strides[F.col("__n")]).alias("v"))
    last = ends.agg(F.when(F.count(F.lit(1)) == len(weights), F.min(F.struct("v", "__n")))).scalar()
    at = ((F.col("__r") * 2 - 1) * strides[F.col("__n")]).alias("v")
    if seed is None:
        numbered = number_within(listed, [source], order, "__r")
    else:
        numbered = shuffle_full(listed, seed, order, [source], "__r").withColumn("__r", F.col("__r") + 1)
    mixed = numbered.withColumn("__at", F.struct(at, "__n"))

    def before(n: int, step: int):
        reach = F.col("__at.v") - F.when(F.col("__n") > n, 0).otherwise(1)
        return F.when(F.col("__n") == n, F.col("__r") - 1).otherwise(whole_div(whole_div(reach, step) + 1, 2))

    place = reduce(lambda a, b: a + b, [before(n, s) for n, s in enumerate(steps)])
    return mixed.where(F.col("__at") <= last).withColumn(name, place).drop("__r", "__n", "__at")


def merge_labelled(labelled: DataFrame, generated: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, text, supervised): one row per key, where a supervised label wins over a generated one.

    Among several of one kind the smallest text stays. NULL keys are one key.
    """
    def ranked(df: DataFrame, kind: int) -> DataFrame:
        return df.select(key, F.struct(F.lit(kind).alias("kind"), F.col(text).alias("text")).alias("best"))

    best = ranked(labelled, 0).unionByName(ranked(generated, 1)).groupBy(key).agg(F.min("best").alias("best"))
    return best.select(key, F.col("best.text").alias(text), (F.col("best.kind") == 0).alias("supervised"))


def _keyed(df: DataFrame, text: str) -> DataFrame:
    """The rows with the normalised text and 128 bits of it."""
    plain = normalise_text(F.col(text))
    return df.withColumns({_TEXT: plain, **{k: F.xxhash64(F.lit(n), plain) for n, k in enumerate(_KEYS)}})


def _shared_texts(df: DataFrame, used: DataFrame, text: str) -> DataFrame:
    """Keys and normalised texts of `used` whose keys occur in `df` too; stored, so its true size is known.

    Only keys are shuffled to find those that both sides have; texts are then moved for these alone.
    """
    keys = lambda rows: _keyed(rows, text).where(F.col(_TEXT).isNotNull()).select(*_KEYS).distinct()
    hits = stored(keys(df).join(keys(used), _KEYS, "left_semi"), "hits")
    texts = _keyed(used, text).where(F.col(_TEXT).isNotNull()).select(*_KEYS, _TEXT)
    return stored(texts.join(hits, _KEYS, "left_semi").distinct(), "shared-texts")


def _by_text(df: DataFrame, used: DataFrame, text: str, how: str) -> DataFrame:
    shared = _shared_texts(df, used, text)
    return _keyed(df, text).join(shared, [*_KEYS, _TEXT], how).drop(*_KEYS, _TEXT)


def only_new_rows(df: DataFrame, used: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose normalised text is not among `used`; a NULL text is new. Whole texts are compared, not hashes alone.

    The keys of both sides are joined when the function is called; the rows are then compared with the few texts
    whose keys met, and move only if those are too many to be sent to all tasks.
    """
    return _by_text(df, used, text, "left_anti")


def overlap_rows(df: DataFrame, used: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose normalised text is among `used`, found in the two steps of `only_new_rows`."""
    return _by_text(df, used, text, "left_semi")


def source_profile(df: DataFrame, source: str = "source", duration: str = "duration") -> DataFrame:
    """Clips, hours and mean clip length of each source; NULL durations count as clips only."""
    return df.groupBy(source).agg(
        F.count(F.lit(1)).alias("clips"), (F.sum(duration) / 3600).alias("hours"), F.avg(duration).alias("mean_seconds")
    )
