"""Vocabulary, encoding and decoding of texts, label batches."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.arrays import IGNORE
from voxframe.functions.text import tokens
from voxframe.session import BROADCAST_ROWS

# Ids below FIRST_WORD are special
PAD, UNKNOWN, START, END = 0, 1, 2, 3
FIRST_WORD = 4
VOCAB_SIZE = 51_865
MAX_LABELS = 448


def build_vocab(df: DataFrame, size: int = VOCAB_SIZE, text: str = "text") -> DataFrame:
    """(token, n, token_id) of the most frequent words; ids by (count, word).

    At most `size - FIRST_WORD` rows, so the numbering window is bounded.
    """
    counts = (
        df.select(F.explode(tokens(F.col(text))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    rank = [F.col("n").desc(), F.col("token")]
    top = counts.orderBy(*rank).limit(size - FIRST_WORD)
    number = F.row_number().over(Window.orderBy(*rank))
    return top.withColumn("token_id", number + (FIRST_WORD - 1))


def _dictionary(vocab: DataFrame, vocab_size: int) -> tuple[pa.Array, pa.Array] | None:
    """Tokens and ids of a vocabulary whose stated size may be sent to all tasks; None above that.

    Rows in the order of (id, token): the first one counts where a token or an id is listed twice. More rows than stated are an error.
    """
    if vocab_size > BROADCAST_ROWS:
        return None
    held = vocab.select("token", F.col("token_id").cast("int").alias("token_id")).limit(vocab_size + 1).toArrow()
    if held.num_rows > vocab_size:
        raise ValueError(f"the vocabulary holds more than {vocab_size} entries")
    held = held.sort_by([("token_id", "ascending"), ("token", "ascending")])
    whole = lambda c: pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], type=c.type)
    return whole(held.column("token")), whole(held.column("token_id"))


def _lists(values: pa.Array, like: pa.Array, counts: np.ndarray | None = None) -> pa.Array:
    """`values` in lists as long as those of `like`, or of the given lengths; NULL stays NULL."""
    if counts is None:
        counts = pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(counts)])
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), values, mask=like.is_null())


def encode_text(
    df: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    max_len: int = MAX_LABELS,
    vocab_size: int = VOCAB_SIZE,
    wrap: bool = False,
) -> DataFrame:
    """(keys, labels): one id per word, unknown words as one id, cut to `max_len`; none for a NULL text.

    Words past the cut cannot reach the result, so they are left out first. `wrap` sets the start and end
    ids around the words, inside the same limit. A vocabulary of at most BROADCAST_ROWS stated entries is read
    when the function is called and goes to every task as a dictionary: the texts are read once, in Arrow
    batches, and nothing is shuffled. A larger one is joined word by word, and `keys` must tell the texts apart.
    """
    words = F.slice(tokens(F.col(text)), 1, max_len)
    held = _dictionary(vocab, vocab_size)
    if held is None:
        return _encoded_by_word(df.select(*keys, words.alias("__words")), vocab, keys, max_len, wrap)
    known, ids = held

    @F.arrow_udf("array<int>")
    def look_up(lists: pa.Array) -> pa.Array:
        found = pc.take(ids, pc.index_in(pc.list_flatten(lists), value_set=known))
        return _lists(pc.fill_null(found, UNKNOWN), lists)

    labels = look_up(words)
    if wrap:
        labels = F.slice(F.concat(F.array(F.lit(START)), labels, F.array(F.lit(END))), 1, max_len)
    return df.select(*keys, F.coalesce(labels, F.array().cast("array<int>")).alias("labels"))


def _encoded_by_word(df: DataFrame, vocab: DataFrame, keys: Sequence[str], max_len: int, wrap: bool) -> DataFrame:
    words = F.col("__words")
    if wrap:  # NULL marks an edge, and the place tells which one
        edge = F.array(F.lit(None).cast("string"))
        words = F.slice(F.concat(edge, words, edge), 1, max_len)
    ids = vocab.select(F.col("token").alias("__word"), F.col("token_id").alias("__id"))
    edge_id = F.when(F.col("__i") == 0, START).otherwise(END)
    word_id = F.coalesce("__id", F.lit(UNKNOWN))
    entry = F.struct("__i", F.when(F.col("__word").isNull(), edge_id).otherwise(word_id).alias("id"))
    return (
        df.select(*keys, F.posexplode_outer(words).alias("__i", "__word"))
        .join(ids, "__word", "left")
        .groupBy(*keys)
        .agg(F.collect_list(F.when(F.col("__i").isNotNull(), entry)).alias("__entries"))
        .select(*keys, F.transform(F.array_sort("__entries"), lambda e: e["id"]).alias("labels"))
    )


def decode_ids(
    df: DataFrame,
    vocab: DataFrame,
    keys: Sequence[str],
    labels: str = "labels",
    special: Sequence[int] = (PAD, START, END),
    vocab_size: int = VOCAB_SIZE,
) -> DataFrame:
    """(keys, decoded): words joined by spaces; ignored, special and NULL ids left out, '' without labels.

    The vocabulary is used as in `encode_text`.
    """
    held = _dictionary(vocab, vocab_size)
    if held is None:
        return _decoded_by_id(df, vocab, keys, labels, special)
    known, ids = held
    hidden = pa.array([IGNORE, *special], type=pa.int32())

    @F.arrow_udf("string")
    def spell(lists: pa.Array) -> pa.Array:
        flat = pc.list_flatten(lists)
        shown = pc.and_(flat.is_valid(), pc.invert(pc.is_in(flat, value_set=hidden)))
        upto = np.concatenate([[0], np.cumsum(shown.to_numpy(zero_copy_only=False))])
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
        words = pc.take(known, pc.index_in(flat.filter(shown), value_set=ids))
        return pc.binary_join(_lists(pc.fill_null(words, "<unk>"), lists, np.diff(upto[ends])), " ")

    decoded = spell(F.col(labels).cast("array<int>"))
    return df.select(*keys, F.coalesce(decoded, F.lit("")).alias("decoded"))


def _decoded_by_id(
    df: DataFrame, vocab: DataFrame, keys: Sequence[str], labels: str, special: Sequence[int]
) -> DataFrame:
    ids = F.transform(F.col(labels), lambda v: F.when(v == IGNORE, PAD).otherwise(v))
    words = vocab.select(F.col("token_id").alias("__id"), F.col("token").alias("__word"))
    shown = F.col("__i").isNotNull() & ~F.col("__id").isin(PAD, *special)
    entry = F.struct("__i", F.coalesce("__word", F.lit("<unk>")).alias("word"))
    return (
        df.select(*keys, F.posexplode_outer(ids).alias("__i", "__id"))
        .join(words, "__id", "left")
        .groupBy(*keys)
        .agg(F.collect_list(F.when(shown, entry)).alias("__entries"))
        .select(
            *keys,
            F.array_join(F.transform(F.array_sort("__entries"), lambda e: e["word"]), " ").alias(
                "decoded"
            ),
        )
    )


def _batch(batch: str | Sequence[str]) -> list[str]:
    return [batch] if isinstance(batch, str) else list(batch)


def pad_to_batch_max(
    df: DataFrame, labels: str = "labels", batch: str | Sequence[str] = "batch", fill: int = IGNORE
) -> DataFrame:
    """Pad each sequence to the longest of its batch."""
    longest = F.max(F.size(labels)).over(Window.partitionBy(*_batch(batch)))
    padded = F.concat(F.col(labels), F.array_repeat(F.lit(fill), longest - F.size(labels)))
    return df.withColumn(labels, padded)


def drop_common_start(
    df: DataFrame, start_id: int = START, labels: str = "labels", batch: str | Sequence[str] = "batch"
) -> DataFrame:
    """Remove the first label where every row of the batch begins with the start id."""
    first = F.coalesce(F.try_element_at(F.col(labels), F.lit(1)) == start_id, F.lit(False))
    shared = F.bool_and(first).over(Window.partitionBy(*_batch(batch)))
    rest = F.slice(F.col(labels), F.lit(2), F.greatest(F.size(labels) - 1, F.lit(0)))
    return df.withColumn(labels, F.when(shared, rest).otherwise(F.col(labels)))


def attention_mask(labels: Column, pad_id: int = PAD) -> Column:
    """1 at labels, 0 at padding."""
    return F.transform(labels, lambda v: F.when(v == pad_id, 0).otherwise(1))
