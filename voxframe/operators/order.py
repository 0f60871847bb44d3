"""Positions, running totals, shuffles, batches and step plans.

No window here spans a whole table or a whole run. Rows are cut into blocks of
bounded size along the ordering column; each block is summed, the block
sums give every block its starting value (in the same way, where there may be many),
and the running value is computed inside the blocks. A run that holds a third of all rows is spread over as many
tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.text import seeded_key
from voxframe.session import whole_div

BLOCK = 1 << 20
# Rows of a window over blocks, at most
WINDOW = 1 << 22
_BLOCK, _HEAD, _FINE = "__block", "__head", "__fine"
_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def blocked_totals(
    df: DataFrame,
    block: Column,
    order: Sequence[str],
    totals: dict[str, Column],
    partition: Sequence[str] = (),
    levels: Sequence[int] = (),
) -> DataFrame:
    """Running sums in the order (block, *order), within `partition`.

    `block` must not decrease along `order` and must bound the rows that share
    a value of it. Every block gets one extra first row that carries the sums
    of the blocks before it, so no join is needed and NULL keys stay. Those sums are found in one
    window for each `partition`; where there may be too many blocks for that, `levels` gives the
    widths by which blocks are grouped once more, and the groups again.
    """
    keys = list(partition)
    amounts = {f"__amount_{name}": col for name, col in totals.items()}
    rows = df.withColumns({_BLOCK: block, **amounts})
    sums = rows.groupBy(*keys, _BLOCK).agg(*[F.sum(a).alias(a) for a in amounts])
    heads = _sums_before(sums, keys, list(amounts), list(levels)).withColumn(_HEAD, F.lit(True))
    inside = (
        Window.partitionBy(*keys, _BLOCK)
        .orderBy(F.col(_HEAD).desc(), *order)
        .rowsBetween(*_UP_TO)
    )
    return (
        rows.withColumn(_HEAD, F.lit(False))
        .unionByName(heads, allowMissingColumns=True)
        .withColumns({name: F.sum(f"__amount_{name}").over(inside) for name in totals})
        .where(~F.col(_HEAD))
        .drop(_BLOCK, _HEAD, *amounts)
    )


def _sums_before(sums: DataFrame, keys: list[str], amounts: list[str], levels: list[int]) -> DataFrame:
    """(keys, block, amounts): for every block the sums of all blocks before it; no window spans more than a level's width."""
    if not levels:
        earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(*_BEFORE)
        return sums.select(*keys, _BLOCK, *[F.sum(a).over(earlier).alias(a) for a in amounts])
    fine = sums.withColumn(_FINE, F.col(_BLOCK)).withColumn(_BLOCK, whole_div(F.col(_BLOCK), levels[0]))
    coarse = fine.groupBy(*keys, _BLOCK).agg(*[F.sum(a).alias(a) for a in amounts])
    heads = _sums_before(coarse, keys, amounts, levels[1:]).withColumn(_HEAD, F.lit(True))
    earlier = Window.partitionBy(*keys, _BLOCK).orderBy(F.col(_HEAD).desc(), _FINE).rowsBetween(*_BEFORE)
    return (
        fine.withColumn(_HEAD, F.lit(False))
        .unionByName(heads, allowMissingColumns=True)
        .withColumns({a: F.sum(a).over(earlier) for a in amounts})
        .where(~F.col(_HEAD))
        .select(*keys, F.col(_FINE).alias(_BLOCK), *amounts)
    )


def level_widths(block: int) -> list[int]:
    """Widths for `blocked_totals` that keep every window near WINDOW rows for any 64-bit key cut into blocks of `block` values."""
    bits, step = 65 - block.bit_length(), WINDOW.bit_length() - 1
    return [WINDOW] * max(0, -(-(bits - step) // step))


def running_totals(
    df: DataFrame,
    order: str,
    totals: dict[str, Column],
    partition: Sequence[str] = (),
    block: int = BLOCK,
) -> DataFrame:
    """Running sums along `order`, an integer column unique within `partition`.

    A block is `block` consecutive values, so it holds at most so many rows for dense, sparse and clustered
    ids alike. Nothing is counted or sampled beforehand: one scan of the rows, one of the narrow columns.
    """
    return blocked_totals(df, whole_div(F.col(order), block), [order], totals, partition, level_widths(block))


def number_within(
    df: DataFrame, partition: Sequence[str], order: str, name: str, block: int = BLOCK
) -> DataFrame:
    """Row number from 1 within each group."""
    one = F.lit(1).cast("long")
    return running_totals(df, order, {name: one}, partition, block)


def with_position(
    df: DataFrame, order: str, name: str = "pos", block: int = BLOCK
) -> DataFrame:
    """Stream position from 0 over all rows, the invalid ones included; a row without `order` has none.

    Only the ordering column is numbered, the rows themselves (texts, samples) join their position by it, so no
    sort holds more than keys. The keys are dealt by block once; block counts and numbers inside the blocks both come
    from that one exchange, and the counts of the blocks before are added by a join on the block.
    """
    # a block that can't be NULL, or the join would filter one reader of the exchange and not the other
    cell = F.coalesce(whole_div(F.col(order), block), F.lit(0).cast("long"))
    keys = df.select(order).where(F.col(order).isNotNull()).withColumn(_BLOCK, cell)
    within = F.row_number().over(Window.partitionBy(_BLOCK).orderBy(order))
    placed = keys.repartition(_BLOCK).withColumn(name, within)
    sizes = placed.groupBy(_BLOCK).agg(F.max(name).alias("__before"))  # of the same columns, so the exchange is reused
    starts = _sums_before(sizes, [], ["__before"], level_widths(block))
    at = (F.col(name) - 1 + F.coalesce("__before", F.lit(0))).alias(name)
    numbered = placed.join(starts, _BLOCK).select(order, at)
    if df.columns != [order]:
        return df.join(numbered, order, "left")
    return numbered.unionByName(df.where(F.col(order).isNull()).withColumn(name, F.lit(None).cast("long")))


def shuffle_bounded(
    df: DataFrame, buffer: int, seed: int, pos: str = "pos", key: str = "pos", name: str = "shuffle_pos"
) -> DataFrame:
    """Seeded reordering in which no row leaves its buffer of `buffer` positions."""
    block = whole_div(F.col(pos), buffer)
    within = Window.partitionBy(block).orderBy(seeded_key(seed, F.col(key)), key)
    return df.withColumn(name, block * buffer + F.row_number().over(within) - 1)


def shuffle_filtered(
    df: DataFrame, buffer: int, seed: int, pos: str = "pos", key: str = "pos",
    name: str = "shuffle_pos", block: int = BLOCK,
) -> DataFrame:
    """The order of `shuffle_bounded` for rows left by a filter, numbered from 0."""
    whole_buffers = buffer * max(1, block // buffer)
    keyed = df.withColumns(
        {"__buffer": whole_div(F.col(pos), buffer), "__key": seeded_key(seed, F.col(key))}
    )
    counted = blocked_totals(
        keyed,
        whole_div(F.col(pos), whole_buffers),
        ["__buffer", "__key", key],
        {name: F.lit(1).cast("long")},
    )
    return counted.withColumn(name, F.col(name) - 1).drop("__buffer", "__key")


def shuffle_full(
    df: DataFrame, seed: int | Column, key: str, partition: Sequence[str] = (), name: str = "shuffle_pos",
    digits: int = 4,
) -> DataFrame:
    """Seeded permutation of all rows of each `partition`.

    The first `digits` of the key's hash cut the rows into 16^digits even blocks (65,536),
    so neither the order nor the numbering passes through one task.
    """
    keyed = df.withColumn("__key", seeded_key(seed, F.col(key)))
    block = F.conv(F.substring("__key", 1, digits), 16, 10).cast("long")
    counted = blocked_totals(
        keyed, block, ["__key", key], {name: F.lit(1).cast("long")}, partition
    )
    return counted.withColumn(name, F.col(name) - 1).drop("__key")


def repeat_epochs(df: DataFrame, epochs: int, seed: int, key: str) -> DataFrame:
    """The data `epochs` times, each pass in its own seeded order."""
    copies = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return shuffle_full(copies, F.lit(seed) + F.col("epoch"), key, ["epoch"], "epoch_pos")


def assign_batches(df: DataFrame, size: int, pos: str = "pos") -> DataFrame:
    """Batch number and place in the batch; the last batch may be short."""
    return df.withColumns(
        {
            "batch": whole_div(F.col(pos), size),
            "in_batch": F.pmod(F.col(pos), F.lit(size)).cast("int"),
        }
    )


def step_plan(
    df: DataFrame, batch: int, accum: int, epochs: int, max_steps: int = 0, pos: str = "pos"
) -> DataFrame:
    """Row to (epoch, micro_batch, step), all from 0.

    Accumulation runs on across epochs, as an optimiser sees it. Rows of step
    `max_steps` and later are not used; 0 means no end.
    """
    per_epoch = df.select(whole_div(F.max(pos) + batch, batch)).scalar()
    if max_steps > 0:  # what the first epoch does not use, no later one does
        df = df.where(F.col(pos) < max_steps * accum * batch)
    plan = df.withColumn(
        "epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    ).withColumn("micro_batch", F.col("epoch") * per_epoch + whole_div(F.col(pos), batch))
    plan = plan.withColumn("step", whole_div(F.col("micro_batch"), accum))
    return plan.where(F.col("step") < max_steps) if max_steps > 0 else plan


def steps_per_epoch(df: DataFrame, batch: int, accum: int, floor_rows: bool = False) -> DataFrame:
    """One row: optimiser steps in an epoch.

    `floor_rows` gives rows div accum, which ignores the batch size.
    """
    n = F.count(F.lit(1))
    steps = whole_div(n, accum) if floor_rows else whole_div(n + (batch * accum - 1), batch * accum)
    return df.agg(steps.alias("steps_per_epoch"))


def resume_from(df: DataFrame, next_pos: int, stop_at: int | None = None, pos: str = "pos") -> DataFrame:
    """Positions in [next_pos, stop_at): a rerun does the same work again."""
    rest = df.where(F.col(pos) >= next_pos)
    return rest if stop_at is None else rest.where(F.col(pos) < stop_at)
