"""Run logs, snapshots and output files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxframe.functions.text import step_number
from voxframe.operators.order import BLOCK, number_within, running_totals
from voxframe.session import whole_div

# The files a finished model folder holds
REQUIRED_FILES = ["config.json", "model.safetensors", "tokenizer.json"]


def throughput(
    df: DataFrame, batch: int, run: str = "run", step: str = "step", seconds: str = "seconds",
    valid: Column | None = None, block: int = BLOCK,
) -> DataFrame:
    """Progress line after every batch of a run.

    Rows done so far, seconds per row and rows per minute. Rows are summed per
    batch first; the running totals then go over batches in bounded blocks.
    `step` counts the rows of the run from 1 and `seconds` is the clock.
    """
    valid = F.lit(True) if valid is None else valid
    per_batch = (
        df.withColumn("batch", whole_div(F.col(step) - 1, batch))
        .groupBy(run, "batch")
        .agg(
            F.count_if(valid).alias("rows"),
            F.max(step).alias("next_pos"),
            F.max(seconds).alias("until"),
        )
    )
    start = df.groupBy(run).agg(F.min(seconds).alias("since"))
    done = running_totals(per_batch, "batch", {"rows_done": F.col("rows")}, [run], block)
    elapsed = F.col("until") - F.col("since")
    return done.join(start, run).select(
        run,
        "batch",
        "next_pos",
        "rows_done",
        F.try_divide(elapsed, F.col("rows_done")).alias("s_per_row"),
        F.coalesce(F.try_divide(F.col("rows_done") * 60.0, elapsed), F.lit(0.0)).alias(
            "rows_per_min"
        ),
    )


def last_metric(df: DataFrame, metric: str = "eval_wer", run: str = "run", step: str = "step") -> DataFrame:
    """Last logged value of a metric per run; NULL where it was never logged."""
    logged = F.when(F.col(metric).isNotNull(), F.col(step))
    return df.groupBy(run).agg(F.max_by(metric, logged).alias("last"))


def best_step(df: DataFrame, metric: str = "eval_wer", run: str = "run", step: str = "step") -> DataFrame:
    """Step with the smallest value per run, the earliest on ties."""
    key = F.when(F.col(metric).isNotNull(), F.struct(metric, step))
    best = df.groupBy(run).agg(F.min(key).alias("__b"))
    return best.select(
        run, F.col(f"__b.{step}").alias("best_step"), F.col(f"__b.{metric}").alias("best")
    )


def final_vs_best(df: DataFrame, metric: str = "eval_wer", run: str = "run", step: str = "step") -> DataFrame:
    """How far the last value lies above the best one, in one aggregation."""
    logged = F.when(F.col(metric).isNotNull(), F.col(step))
    return (
        df.groupBy(run)
        .agg(F.max_by(metric, logged).alias("last"), F.min(metric).alias("best"))
        .withColumn("regression", F.col("last") - F.col("best"))
    )


def running_mean(df: DataFrame, n: int, value: str = "loss", run: str = "run", step: str = "step") -> DataFrame:
    """Mean of the last n values, reported at every n-th row of a run.

    Rows count in the order of `step`, which may have gaps and is unique in a run. A
    report covers exactly the n rows since the one before, so a grouped mean replaces
    a sliding window and is combined before the shuffle.
    """
    rows = number_within(df.select(run, step, value), [run], step, "__row")
    return (
        rows.groupBy(run, whole_div(F.col("__row") + (n - 1), n).alias("__report"))
        .agg(F.max(step).alias("report_step"), F.avg(value).alias("mean"), F.count(F.lit(1)).alias("__n"))
        .where(F.col("__n") == n)
        .drop("__report", "__n")
    )


def is_complete(df: DataFrame, keys: Sequence[str], required: Sequence[str] = REQUIRED_FILES,
                file_name: str = "file_name") -> DataFrame:
    """Whether each folder holds every required file, and which ones are missing.

    One flag per required file is all the state a folder needs, however many
    files it has.
    """
    holds = lambda f: F.coalesce(F.bool_or(F.col(file_name) == f), F.lit(False))
    seen = [holds(f).alias(f"__f{i}") for i, f in enumerate(required)]
    missing = F.array_compact(
        F.array(*[F.when(~F.col(f"__f{i}"), F.lit(f)) for i, f in enumerate(required)])
    )
    return (
        df.groupBy(*keys)
        .agg(*seen)
        .select(*keys, missing.alias("missing"))
        .withColumn("complete", F.size("missing") == 0)
    )


def artifact_size(df: DataFrame, keys: Sequence[str] = (), size: str = "size") -> DataFrame:
    """Files and bytes per artifact, or over all."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("files"), F.sum(size).alias("bytes"))


def retain_latest(df: DataFrame, n: int, run: str = "run", name: str = "dir",
                  prefix: str = "checkpoint") -> DataFrame:
    """Snapshots with a `keep` flag for the n newest of each run; nothing is deleted.

    The n-th newest step of a run decides. It comes from a row number limited
    to n, which Spark applies in every task before the shuffle, and one row per
    run goes back to the listing.
    """
    snaps = (
        df.select(run, name, step_number(F.col(name), prefix).alias("step"))
        .where(F.col("step").isNotNull())
        .distinct()
    )
    newest = Window.partitionBy(run).orderBy(F.col("step").desc())
    cutoff = (
        snaps.withColumn("__rank", F.row_number().over(newest))
        .where(F.col("__rank") <= n)
        .groupBy(run)
        .agg(F.min("step").alias("__from"))
    )
    return snaps.join(cutoff, run).select(
        run, name, "step", (F.col("step") >= F.col("__from")).alias("keep")
    )


def latest_snapshot(df: DataFrame, explicit: Column | None = None, run: str = "run",
                    name: str = "dir", prefix: str = "checkpoint") -> DataFrame:
    """Folder with the highest step per run, NULL if there is none.

    An explicit choice (a column of the run) wins; if that folder does not
    exist the run starts afresh, so the result is NULL too.
    """
    wanted = F.lit(None).cast("string") if explicit is None else explicit
    found = df.groupBy(run).agg(
        F.max_by(name, step_number(F.col(name), prefix)).alias("__latest"),
        F.coalesce(F.bool_or(F.col(name) == wanted), F.lit(False)).alias("__exists"),
    )
    chosen = F.when(wanted.isNull(), F.col("__latest")).when(F.col("__exists"), wanted)
    return found.select(run, chosen.alias("snapshot"))


def state_or_name(df: DataFrame, steps_per_epoch: int, name: str = "dir", state_step: str = "state_step",
                  state_epoch: str = "state_epoch", prefix: str = "checkpoint") -> DataFrame:
    """Step and epoch from the saved state, else from the folder's name.

    A state without an epoch counts as epoch 0; without a state the epoch is
    the step divided by the steps per epoch.
    """
    saved = F.col(state_step).isNotNull()
    from_name = F.coalesce(step_number(F.col(name), prefix), F.lit(0).cast("long"))
    epoch = whole_div(from_name, steps_per_epoch) if steps_per_epoch > 0 else F.lit(0).cast("long")
    return df.withColumns(
        {
            "step": F.when(saved, F.col(state_step)).otherwise(from_name),
            "epoch": F.when(saved, F.coalesce(F.col(state_epoch), F.lit(0))).otherwise(epoch),
        }
    )


def regression_alarm(log: DataFrame, baseline: DataFrame, run: str = "run", metric: str = "eval_wer", step: str = "step") -> DataFrame:
    """(run, wer_start, first_wer): runs whose first evaluation is worse than the start given in `baseline` (run, wer)."""
    first = log.where(F.col(metric).isNotNull()).groupBy(run).agg(F.min_by(metric, step).alias("first_wer"))
    start = baseline.select(run, F.col("wer").alias("wer_start"))
    return start.join(first, run).where("first_wer > wer_start")
