"""Stored teacher scores.

Table: one row per token position, (example_pos, tok_pos, label_id,
top array<struct<token_id int, logit float>>), in folders of consecutive
positions. The position is a column of the row, never part of a file name.
Ids need INT: they run past the range of SHORT.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.session import whole_div

POSITIONS_PER_FOLDER = 1 << 20
POSITIONS_PER_FILE = 1 << 10
FOLDER = "pos_block"


def stored_form(df: DataFrame) -> DataFrame:
    top = F.transform(
        "top",
        lambda e: F.struct(
            e["token_id"].cast("int").alias("token_id"), e["logit"].cast("float").alias("logit")
        ),
    )
    return df.withColumn("top", top)


def write_teacher_scores(
    df: DataFrame, path: str, mode: str = "overwrite", per_folder: int = POSITIONS_PER_FOLDER,
    per_file: int = POSITIONS_PER_FILE,
) -> None:
    """Write the top entries, one folder per block of positions.

    Slices of `per_file` positions are moved to one task each, so a folder has at most
    per_folder div per_file files however many tasks made the rows, and a large folder is
    still written by many. A later read of a position range opens only its folders.
    """
    rows = stored_form(df).withColumn(FOLDER, whole_div(F.col("example_pos"), per_folder))
    rows = rows.repartition(FOLDER, whole_div(F.col("example_pos"), per_file))
    rows.write.mode(mode).partitionBy(FOLDER).parquet(path)


def read_teacher_scores(
    spark: SparkSession, path: str, first: int | None = None, stop: int | None = None,
    per_folder: int = POSITIONS_PER_FOLDER,
) -> DataFrame:
    """Stored scores, all or of the positions [first, stop).

    Reads what `write_teacher_scores` and what the scoring stream wrote: folders of
    positions are pruned where there are some, other folder columns are left out.
    """
    df = spark.read.parquet(path)
    folders = FOLDER in df.columns
    if first is not None:
        df = df.where(F.col("example_pos") >= first)
        df = df.where(F.col(FOLDER) >= first // per_folder) if folders else df
    if stop is not None:
        df = df.where(F.col("example_pos") < stop)
        df = df.where(F.col(FOLDER) <= (stop - 1) // per_folder) if folders else df
    return df.select("example_pos", "tok_pos", "label_id", "top")


def write_bucketed(
    df: DataFrame, table: str, buckets: int, key: str = "example_pos", mode: str = "overwrite"
) -> None:
    """Save as a table bucketed and sorted by position.

    One shuffle here replaces one in every later join: scores and examples
    bucketed alike meet bucket by bucket, for each student and each epoch.
    """
    rows = df.repartition(buckets, key)
    rows.write.mode(mode).bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def unscored(examples: DataFrame, scores: DataFrame, pos: str = "example_pos") -> DataFrame:
    """Examples without a stored score: what an interrupted batch job has left."""
    return examples.join(scores.select(pos).distinct(), pos, "left_anti")


def absent(error: AnalysisException) -> bool:
    """Whether the path is not there, or holds no file yet; any other fault is one."""
    return error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def has_files(spark: SparkSession, path: str) -> bool:
    """Whether there is a table at the path, with or without rows; only its schema is read."""
    try:
        spark.read.parquet(path)
        return True
    except AnalysisException as error:
        if not absent(error):
            raise
        return False


def has_scores(spark: SparkSession, path: str) -> bool:
    try:
        return not spark.read.parquet(path).isEmpty()
    except AnalysisException as error:
        if not absent(error):
            raise
        return False


def choose_score_source(
    spark: SparkSession, configured: str | None, default: str, live: Callable[[], DataFrame]
) -> tuple[str, DataFrame]:
    """('stored', scores) or ('live', scores); both have the stored schema.

    A configured path is used as it is and must exist; without one the default
    path counts if it holds scores, else the scores are computed.
    """
    if configured:
        return "stored", read_teacher_scores(spark, configured)
    if has_scores(spark, default):
        return "stored", read_teacher_scores(spark, default)
    return "live", stored_form(live())
