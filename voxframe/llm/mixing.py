"""Mixing sources to target weights by weighted fair queueing.

The documents of a source stand in a seeded order. A document's virtual finish
time is the words of its source up to its end, divided by the source's target;
a second pass over the source goes on from the first. Taking documents in the
order of finish times serves all sources in proportion, and the mix ends where
the words taken reach the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.llm.common import WORD, cut
from voxframe.operators.order import blocked_totals

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
PASSES = 2
SEED = 17
LEVEL = 256
SLICES = 1 << 16


def words_in(text: str = "text") -> Column:
    """Number of words; a NULL text has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(rows: DataFrame, weights: tuple = WEIGHTS, budget: float = BUDGET, passes: int = PASSES) -> DataFrame:
    """(source, source_size, target), one row for each source.

    Sources in order of code points, NULL last, weigh `weights` in turn and share
    `budget` times all sizes; a target stops at `passes` times its source and the
    excess goes to the others by weight. With the sources sorted by the level at
    which they fill, the final level is the largest of those that hold if all
    sources before are full. The windows hold one row for each source.
    """
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    weighed = sums.withColumn("w", weight).withColumn("cap", F.col("source_size") * F.lit(float(passes)))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    full = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("w").over(by_level.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(budget) - full
    levels = weighed.withColumn("level", left / open_weight)
    level = F.max("level").over(everything)
    return levels.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"))


def finish_times(rows: DataFrame, targets: DataFrame, passes: int = PASSES) -> DataFrame:
    """`rows` (size, source, key) with source_size, target and `finish`, an array with a time for each pass.

    The running sums of a source are taken in 4,096 blocks of the seeded key, so a
    source with any share of the rows is spread over many tasks. Without a target
    (a source of no words) times are NULL.
    """
    block = F.conv(F.substring("key", 1, 3), 16, 10).cast("int")
    run = blocked_totals(rows, block, ["key"], {"upto": F.col("size")}, ["source"])
    sides = targets.withColumnRenamed("source", "__source")
    both = run.join(sides, F.col("source").eqNullSafe(F.col("__source"))).drop("__source")
    times = [F.try_divide((F.col("upto") + n * F.col("source_size")).cast("double"), F.col("target")) for n in range(passes)]
    return both.withColumn("finish", F.array(*times)).drop("upto")


def last_time(timed: DataFrame, budget: float = BUDGET, passes: int = PASSES) -> float | None:
    """The latest finish time up to which no more than the budget is taken; equal times go together.

    Words are summed by time and by slices of the time first; the running sum
    goes over the times of a slice, and over the slices in groups of LEVEL.
    """
    sizes = (
        timed.select("size", F.explode("finish").alias("t")).where("t IS NOT NULL AND size > 0")
        .groupBy("t").agg(F.sum("size").alias("size"))
    )
    run = blocked_totals(sizes, F.floor(F.col("t") * SLICES), ["t"], {"upto": F.col("size")}, levels=[LEVEL])
    total = timed.agg(F.sum("size")).first()[0] or 0
    return run.where(F.col("upto") <= budget * total).agg(F.max("t")).first()[0]


def mix(
    docs: DataFrame, keep: list[str], weights: tuple = WEIGHTS, budget: float = BUDGET, passes: int = PASSES, seed: int = SEED,
    doc_id: str = "doc_id", text: str = "text", source: str = "source",
) -> DataFrame:
    """(kept, size, source_size, target, copies), one row for each document: `kept` is a struct
    of the columns `keep`, so their names can't clash; copies is 0 to `passes`.

    The order hangs on seed, id and text alone, so reruns agree; rows equal in all
    of them are interchangeable. NULL ids and sources are values like any other,
    a NULL text has no words, and a document without words is never taken. In an
    empty table, or one without words, nothing is taken.
    """
    key = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(doc_id).cast("string"), F.md5(F.col(text))))
    kept = F.struct(*[F.col(c) for c in keep]).alias("kept")
    rows = cut(docs.select(kept, F.col(source).alias("source"), words_in(text).alias("size"), key.alias("key")))
    targets = cut(source_targets(rows, weights, budget, passes))
    timed = cut(finish_times(rows, targets, passes))
    end = last_time(timed, budget, passes)
    inside = F.filter("finish", lambda t: (t <= F.lit(end)) & (F.col("size") > 0))
    copies = F.size(inside) if end is not None else F.lit(0)
    return timed.withColumn("copies", copies).drop("finish", "key", "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The given columns of the documents taken, each as often as it is taken."""
    taken = mix(docs, docs.columns, **options).where("copies > 0")
    each = taken.select("kept", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return each.select("kept.*")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of every document."""
    found = mix(docs, ["doc_id"])
    return found.select(
        "kept.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies"
    )
