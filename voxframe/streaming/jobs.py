"""Preparation, scoring and shuffling of unbounded clip tables.

Output of a micro-batch goes to a folder named after the batch id, so a batch that is
replayed after a failure leaves one copy: scores add only positions that are not stored yet,
other output overwrites the folder.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxframe.operators.order import resume_from, shuffle_bounded, shuffle_full, with_position
from voxframe.operators.rows import valid_rows
from voxframe.operators.scores import top_k_per_position
from voxframe.session import stored
from voxframe.sources.logs import PROGRESS_SCHEMA, read_progress, write_progress
from voxframe.sources.scores import POSITIONS_PER_FOLDER, has_files, read_teacher_scores, stored_form, unscored

CARRY_SCHEMA = "begin LONG, drained BOOLEAN"


def prepare(clips: DataFrame, keep: list[str]) -> DataFrame:
    """Validity filter and projection; the same code for batch and stream."""
    return valid_rows(clips).select(*keep)


def run_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write everything that is there, then end. A rerun adds only what is new."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


class _Scoring:
    """What a batch of either scoring job does: score what is not stored yet, keep the k best, write log and progress."""

    def __init__(self, score: Callable[[DataFrame], DataFrame], k: int, path: str, settings: dict):
        self.score, self.k, self.path, self.settings = score, k, path, settings
        self.begun, self.rows_of_run = time.monotonic(), 0

    def run(self, due: DataFrame, number: int, before: dict | None) -> dict:
        spark, batch_begun, before = due.sparkSession, time.monotonic(), before or {}
        folder, target = f"{self.path}/scores", f"{self.path}/scores/batch_id={number}"
        low, high = due.agg(F.min("example_pos"), F.max("example_pos")).first()
        todo = valid_rows(due)
        if high is not None and has_files(spark, folder):
            todo = unscored(todo, read_teacher_scores(spark, folder, low, high + 1))
        stored_form(top_k_per_position(self.score(todo), self.k)).write.mode("append").parquet(target)
        done = spark.read.parquet(target).select(F.count_distinct("example_pos")).first()[0]
        row = {
            "teacher_model": self.settings.get("teacher_model"),
            "top_k": self.k,
            "batch_size": self.settings.get("batch_size"),
            "next_idx": max(before.get("next_idx") or 0, 0 if high is None else high + 1),
            "examples_processed": (before.get("examples_processed") or 0) + done,
            "complete": False,
            "split": self.settings.get("split"),
        }
        progress = spark.createDataFrame([row], PROGRESS_SCHEMA)
        now = time.monotonic()
        self.rows_of_run += done
        elapsed = (now - self.begun) / 60
        line = progress.select(
            "examples_processed",
            F.col("next_idx").alias("example_idx"),
            F.lit(done).alias("examples"),
            (F.unix_micros(F.current_timestamp()) / 1e6).alias("seconds"),
            F.lit((now - batch_begun) / done if done else None).cast("double").alias("s_per_example"),
            F.lit(elapsed).alias("elapsed_min"),
            F.lit(self.rows_of_run / elapsed if elapsed > 0 else None).cast("double").alias("throughput_ex_per_min"),
        )
        line.coalesce(1).write.mode("overwrite").json(f"{self.path}/log/batch_id={number}")
        write_progress(progress, f"{self.path}/progress", number)
        return row


def score_stream(
    stream: DataFrame, score: Callable[[DataFrame], DataFrame], k: int, path: str, checkpoint: str, settings: dict
) -> StreamingQuery:
    """Per micro-batch: score, keep the k best, write them, the log and the progress.

    `score` turns valid rows into (example_pos, tok_pos, label_id, teacher), all rows of an
    example in one task. The totals of log and progress go on from those of the batch before, so they do
    not restart with the job, and a replayed batch arrives at the same numbers. Positions
    that are stored already, by a batch cut off or with another checkpoint, are not scored again; the look-up
    reads the positions of the batch's range only. A batch is as large as the source's trigger makes it. To
    end at a position, or to go through a table in parts, use `score_table`. The log's times are those of this run.
    """
    scoring = _Scoring(score, k, path, settings)

    def write(batch: DataFrame, batch_id: int) -> None:
        due = batch.where(F.col("example_pos").isNotNull())
        scoring.run(due, batch_id, read_progress(batch.sparkSession, f"{path}/progress", batch_id))

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_table(
    clips: DataFrame, score: Callable[[DataFrame], DataFrame], k: int, path: str, settings: dict, stop_at: int | None = None,
    part: int = POSITIONS_PER_FOLDER,
) -> bool:
    """Score a table in parts of `part` positions from where the last run ended; True if no position is left.

    Ends at `stop_at` (exclusive) without a trace: the next run goes on from there, and rows added to the
    table meanwhile are found by their position. After each part its scores, log line and progress are stored.
    A run that was killed inside a part scores only those of its positions that are not stored. Each part reads
    the rows of its own positions; a table written in the order of positions is pruned to them.
    Rows without a position are left out, and parts without rows are passed over.
    """
    spark, scoring = clips.sparkSession, _Scoring(score, k, path, settings)
    last = read_progress(spark, f"{path}/progress") or {}
    number, begin = last.get("batch_id", -1) + 1, last.get("next_idx") or 0
    while (first := resume_from(clips, begin, stop_at, "example_pos").select(F.min("example_pos")).first()[0]) is not None:
        end = first + part if stop_at is None else min(first + part, stop_at)
        last = scoring.run(resume_from(clips, first, end, "example_pos"), number, last)
        number, begin = number + 1, last["next_idx"]
    return stop_at is None or resume_from(clips, begin, None, "example_pos").isEmpty()


def mark_complete(spark: SparkSession, path: str) -> None:
    """End the job: the newest progress row again, marked complete."""
    last = read_progress(spark, f"{path}/progress")
    if last is None:
        raise ValueError(f"no progress below {path}")
    batch_id = last.pop("batch_id")
    row = spark.createDataFrame([{**last, "complete": True}], PROGRESS_SCHEMA)
    write_progress(row, f"{path}/progress", batch_id + 1)


def shuffle_stream(
    stream: DataFrame, seed: int, key: str, path: str, checkpoint: str, buffer: int | None = None
) -> StreamingQuery:
    """Seeded order of the rows below `path`, each with its `shuffle_pos`.

    Without `buffer` a micro-batch is the buffer, whatever its size. With it every `buffer` rows are one, however
    the triggers cut the stream: rows of a buffer that is not full yet are carried over to the next
    micro-batch, in a folder named after the batch, and `drain_shuffle` writes the last ones. The order is then
    that of `order.shuffle_bounded` over all rows. Rows must arrive in the order of `key`, a unique integer. A
    replayed batch starts from what the batch before it carried, so it writes the same rows again.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        if buffer is None:
            shuffle_full(batch, seed, key).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        else:
            _write_buffers(batch, batch_id, seed, key, path, buffer, False)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _write_buffers(batch: DataFrame, batch_id: int, seed: int, key: str, path: str, buffer: int, last: bool) -> None:
    """Write the full buffers of what was carried and what is new (all of it if `last`), and carry the rest."""
    spark = batch.sparkSession
    begin, rows = 0, batch
    if batch_id and (state := spark.read.schema(CARRY_SCHEMA).json(f"{path}/state/batch_id={batch_id - 1}").first()):
        begin = state.begin
        rows = spark.read.schema(batch.schema).parquet(f"{path}/carried/batch_id={batch_id - 1}").unionByName(batch)
    placed = stored(with_position(rows, key, "__place").withColumn("__place", F.col("__place") + begin), "shuffle")
    reached = placed.agg(F.max("__place")).first()[0]
    end = begin if reached is None else reached + 1
    full = end if last else end // buffer * buffer
    out = shuffle_bounded(placed.where(F.col("__place") < full), buffer, seed, "__place", key)
    out.drop("__place").write.mode("overwrite").parquet(f"{path}/rows/batch_id={batch_id}")
    placed.where(F.col("__place") >= full).drop("__place").write.mode("overwrite").parquet(f"{path}/carried/batch_id={batch_id}")
    spark.createDataFrame([(full, last)], CARRY_SCHEMA).coalesce(1).write.mode("overwrite").json(f"{path}/state/batch_id={batch_id}")


def drain_shuffle(spark: SparkSession, seed: int, key: str, path: str, buffer: int) -> None:
    """At the end of a stream: write the rows that wait in the last, partly filled buffer. A second call changes nothing.

    Call it once the stream has ended for good; rows that come later would start a buffer of their own.
    """
    newest = spark.read.schema(f"{CARRY_SCHEMA}, batch_id LONG").json(f"{path}/state").orderBy(F.col("batch_id").desc()).first()
    if newest is None or newest.drained:
        return
    carried = spark.read.parquet(f"{path}/carried/batch_id={newest.batch_id}")
    _write_buffers(carried.limit(0), newest.batch_id + 1, seed, key, path, buffer, True)
