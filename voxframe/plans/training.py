"""The training table: from raw clips to padded label batches in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxframe.operators import order, rows, sequences
from voxframe.session import stored


def training_batches(
    clips: DataFrame,
    vocab: DataFrame,
    key: str,
    seed: int,
    buffer: int = 500,
    batch: int = 16,
    vocab_size: int = sequences.VOCAB_SIZE,
    max_len: int = sequences.MAX_LABELS,
) -> DataFrame:
    """(key, batch, in_batch, labels) in the seeded order of one epoch.

    All rows are put in order first, the invalid ones leave next and batches
    count only what is left, as a stream does it. `key` is a unique integer.
    Only keys are ordered and numbered. Positions and validity are stored once,
    so the texts are read for the check and for encoding, and are not shuffled.
    """
    flags = clips.select(key, rows.is_valid().alias("__ok"))
    placed = order.number_within(flags, [], key, "__pos")
    kept = stored(placed, "positions").where("__ok").withColumn("__pos", F.col("__pos") - 1)
    numbered = order.shuffle_filtered(kept, buffer, seed, "__pos", key, "__place")
    # encoding leaves the rows partitioned by key, so only the numbers move to them
    coded = sequences.encode_text(
        rows.valid_rows(clips).select(key, "text"),
        vocab,
        [key],
        max_len=max_len,
        vocab_size=vocab_size,
        wrap=True,
    )
    batches = order.assign_batches(
        coded.join(numbered.select(key, "__place"), key), batch, "__place"
    )
    return sequences.drop_common_start(sequences.pad_to_batch_max(batches)).select(
        key, "batch", "in_batch", "labels"
    )
