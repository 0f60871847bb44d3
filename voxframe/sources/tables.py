"""Clip tables: splits, file order, streams."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# Schemas of the clip tables
AUDIO = "audio STRUCT<array: ARRAY<FLOAT>, sampling_rate: INT>"
CLIP_SCHEMA = f"uuid STRING, {AUDIO}, orig_text STRING, text STRING, split STRING"
CROWD_SCHEMA = (
    f"uuid STRING, {AUDIO}, orig_sentence STRING, sentence STRING, noisy BOOLEAN, "
    "multiple_speakers BOOLEAN"
)


def read_split(
    spark: SparkSession, path: str, split: str, column: str = "split", schema: StructType | str | None = None,
    config: str | None = None,
) -> DataFrame:
    """One named split; with `column` as a partition column only its files are read.

    `config` names one of several tables below `path`, each in a folder of its own.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path if config is None else f"{path}/{config}").where(F.col(column) == split)


def read_optional_split(
    spark: SparkSession, path: str, split: str | None, column: str = "split", config: str | None = None
) -> DataFrame | None:
    """The split, or None with a warning: evaluation is then left out.

    Where `column` is a partition column, partition values tell whether the split is there, and an absent one
    reads no data file; otherwise the column alone is read until a row is found.
    """
    if split is None:
        return None
    df = read_split(spark, path, split, column, config=config)
    if df.select(column).isEmpty():
        warnings.warn(f"split '{split}' not found in {path}; going on without it", stacklevel=2)
        return None
    return df


def read_in_file_order(spark: SparkSession, path: str, name: str = "pos") -> DataFrame:
    """Rows with their position in the files, taken in name order.

    The position is the row's index in its file plus the rows of the files
    before, so nothing is sorted and no row moves. Only the per-file counts
    (one row each) meet in one task.
    """
    df = spark.read.parquet(path)
    located = df.select(
        "*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row")
    )
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        located.groupBy("__file")
        .agg((F.max("__row") + 1).alias("n"))
        .select("__file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    )
    return (
        located.join(starts, "__file")
        .withColumn(name, F.col("__start") + F.col("__row"))
        .drop("__file", "__row", "__start")
    )


def read_stream_source(
    spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None,
    glob: str | None = None,
) -> DataFrame:
    """The same table as an unbounded stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)
