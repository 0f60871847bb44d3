"""Text predicates, word splitting and names of snapshots and runs."""

from __future__ import annotations

import re
from math import isqrt

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from voxframe.functions.arrays import let

# The characters Python's str methods take for white space. Written
# out, since a plain class is much faster than Java's Unicode mode.
_SPACES = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WS = f"[{_SPACES}]"


def has_text(c: Column) -> Column:
    """Neither NULL nor only white space; never NULL itself."""
    return F.coalesce(c.rlike(f"[^{_SPACES}]"), F.lit(False))


def tokens(c: Column) -> Column:
    """Words between runs of white space."""
    return F.array_remove(F.split(c, f"{_WS}+"), "")


def wer_text(c: Column) -> Column:
    """Text as the word error rate reads it.

    Runs of two or more white space characters become one space and both ends
    are stripped. Words are then what stands between spaces, so a lone line
    break stays inside its word.
    """
    joined = F.regexp_replace(c, f"{_WS}{{2,}}", " ")
    return F.regexp_replace(joined, f"^{_WS}+|{_WS}+$", "")


def normalise_text(c: Column) -> Column:
    """Lower case, without punctuation and symbols, words one space apart."""
    bare = F.regexp_replace(F.lower(c), r"[\p{P}\p{S}]", "")
    return F.regexp_replace(F.regexp_replace(bare, f"{_WS}+", " "), "^ | $", "")


def repetition_score(c: Column, n: int = 3) -> Column:
    """Share of a text's n-word sequences that repeat an earlier one; 0 with fewer than n words, NULL for NULL."""
    def score(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(words) - n + 1)
        grams = F.transform(starts, lambda i: F.array_join(F.slice(words, i, F.lit(n)), " "))
        repeated = let(grams, lambda g: 1 - F.size(F.array_distinct(g)) / F.size(g))
        return F.when(F.size(words) >= n, repeated).otherwise(0.0)

    return F.when(c.isNotNull(), let(tokens(c), score))


TABLE_BITS = 1 << 25  # 4 MB for each of the two bits of a step


def edit_distance(ref: list[str], hyp: list[str]) -> int:
    """Least number of word substitutions, deletions and insertions.

    Bit-parallel form (Myers 1999, Hyyro 2003): a column of the distance
    table is held as two bit vectors, the vertical steps up and down, and
    one hypothesis word advances the whole column by a few integer operations.
    """
    start, end = 0, min(len(ref), len(hyp))
    while start < end and ref[start] == hyp[start]:
        start += 1
    tail = 0
    while tail < end - start and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    ref, hyp = ref[start : len(ref) - tail], hyp[start : len(hyp) - tail]
    if not ref or not hyp:
        return len(ref) + len(hyp)
    places: dict[str, int] = {}
    for i, w in enumerate(ref):
        places[w] = places.get(w, 0) | 1 << i
    bottom = len(ref) - 1
    full = (1 << len(ref)) - 1
    up, down, distance = full, 0, len(ref)
    for w in hyp:
        match = places.get(w, 0)
        level = ((((match & up) + up) ^ up) | match | down) & full
        rise = down | ((level | up) ^ full)
        fall = up & level
        distance += (rise >> bottom) - (fall >> bottom)
        rise = rise << 1 | 1
        up = (fall << 1 | ((level | rise) ^ full)) & full
        down = rise & level
    return distance


def edit_counts(ref: list[str], hyp: list[str]) -> tuple[int, int, int]:
    """Substitutions, deletions and insertions of one alignment with the fewest edits.

    Equal words at both ends are paired. From the end of what is left, equal words are paired, and among
    steps that keep the fewest edits a substitution goes before a deletion, a deletion before an insertion.
    Two bits tell each step of the way back: whether the value is that of the neighbour on the diagonal, and
    whether it is one above its neighbour in the column. The forward pass of `edit_distance` has both for a whole
    column and keeps them, for tables up to TABLE_BITS. Of a larger table it keeps one column in every sqrt(n), and
    the way back computes the columns between two of them once more, so memory is 2 sqrt(n) columns of bits.
    """
    start, end = 0, min(len(ref), len(hyp))
    while start < end and ref[start] == hyp[start]:
        start += 1
    tail = 0
    while tail < end - start and ref[-1 - tail] == hyp[-1 - tail]:
        tail += 1
    ref, hyp = ref[start : len(ref) - tail], hyp[start : len(hyp) - tail]
    if not ref or not hyp:
        return 0, len(ref), len(hyp)
    places: dict[str, int] = {}
    for i, w in enumerate(ref):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(ref)) - 1

    def columns(up: int, down: int, words: list[str], keep: bool) -> tuple[int, int, list[int], list[int]]:
        same, above = [], []
        for w in words:
            match = places.get(w, 0)
            level = ((((match & up) + up) ^ up) | match | down) & full
            rise = (down | ((level | up) ^ full)) << 1 | 1
            up = ((up & level) << 1 | ((level | rise) ^ full)) & full
            down = rise & level
            if keep:
                same.append(level)
                above.append(up)
        return up, down, same, above

    whole = len(ref) * len(hyp) <= TABLE_BITS
    span = len(hyp) if whole else isqrt(len(hyp)) + 1
    kept = [(full, 0)]
    for first in range(0, len(hyp) - span, span):
        kept.append(columns(*kept[-1], hyp[first : first + span], False)[:2])

    i, j = len(ref), len(hyp)
    substitutions = deletions = insertions = 0
    while i and j:
        first = (j - 1) // span * span
        _, _, same, above = columns(*kept[first // span], hyp[first:j], True)
        while j > first and i:
            if ref[i - 1] == hyp[j - 1]:
                i, j = i - 1, j - 1
            elif not same[j - first - 1] >> (i - 1) & 1:
                substitutions, i, j = substitutions + 1, i - 1, j - 1
            elif above[j - first - 1] >> (i - 1) & 1:
                deletions, i = deletions + 1, i - 1
            else:
                insertions, j = insertions + 1, j - 1
    return substitutions, deletions + i, insertions + j


def wer_words(text: str) -> list[str]:
    """Words as the word error rate reads them.

    Runs of two or more white space characters become one space and both ends
    are stripped. Words are then what stands between spaces, so a lone line
    break stays inside its word.
    """
    return re.sub(r"\s{2,}", " ", text).strip().split(" ")


@F.pandas_udf(StructType([StructField("edits", LongType()), StructField("ref_words", LongType())]))
def _align(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    edits, words = [], []
    for r, h in zip(ref, hyp):
        a, b = wer_words(r), wer_words(h) if h.strip() else []
        edits.append(edit_distance(a, b))
        words.append(len(a))
    return pd.DataFrame({"edits": edits, "ref_words": words})


_COUNTS = ["substitutions", "deletions", "insertions", "ref_words"]


@F.arrow_udf(StructType([StructField(c, LongType()) for c in _COUNTS]))
def _counted(ref: pa.Array, hyp: pa.Array) -> pa.Array:
    out = []
    for r, h in zip(ref.to_pylist(), hyp.to_pylist()):
        a, b = wer_words(r), wer_words(h) if h.strip() else []
        out.append((*edit_counts(a, b), len(a)))
    columns = zip(*out) if out else [()] * len(_COUNTS)
    return pa.StructArray.from_arrays([pa.array(c, type=pa.int64()) for c in columns], _COUNTS)


def word_changes(ref: Column, hyp: Column) -> Column:
    """struct<substitutions, deletions, insertions, ref_words> by the alignment of `edit_counts`; inputs as for `word_alignment`."""
    return _counted(ref, hyp)


def word_alignment(ref: Column, hyp: Column) -> Column:
    """struct<edits, ref_words> of two texts, of any length and any number of words.

    Neither may be NULL and the reference may not be blank. Spark's `levenshtein` compares characters and fills
    the whole table, which is quadratic in time for long texts, and words would
    have to be renamed to characters first; this takes 1/64 of the steps.
    """
    return _align(ref, hyp)


def step_number(name: Column, prefix: str = "checkpoint") -> Column:
    """N of `<prefix>-N`, NULL for any other name."""
    return F.nullif(F.regexp_extract(name, rf"^{prefix}-(\d+)$", 1), F.lit("")).cast("long")


def run_label(path: Column, is_local: Column) -> Column:
    """Last two parts of a local path, any other id unchanged."""
    tail = F.nullif(F.regexp_extract(path, r"([^/]+/[^/]+)/?$", 1), F.lit(""))
    return F.when(is_local, F.coalesce(tail, path)).otherwise(path)


def seeded_key(seed: int | Column, key: Column) -> Column:
    """32 hex digits that depend on seed and key only: the same in every run."""
    seed = seed if isinstance(seed, Column) else F.lit(seed)
    return F.md5(F.concat_ws("-", seed.cast("string"), key.cast("string")))
