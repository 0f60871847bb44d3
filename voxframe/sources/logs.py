"""Run logs, progress and result tables."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxframe.sources.scores import absent

# Columns of the progress rows
PROGRESS_SCHEMA = (
    "teacher_model STRING, top_k INT, batch_size INT, next_idx LONG, examples_processed LONG, "
    "complete BOOLEAN, split STRING"
)


def parse_log_line(line: Column) -> Column:
    """The numeric values of a JSON object with an open set of keys, as a map.

    A key with another value (text, list) is left out, the others stay. A line that is no JSON
    object gives NULL.
    """
    values = F.transform_values(F.from_json(line, "MAP<STRING, STRING>"), lambda _, v: v.try_cast("double"))
    return F.map_filter(values, lambda _, v: v.isNotNull())


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """(path, step, epoch, metrics) of JSON lines; no rows if the log is absent."""
    try:
        lines = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("path"), parse_log_line(F.col("value")).alias("m")
        )
    except AnalysisException as error:
        if not absent(error):
            raise
        return spark.createDataFrame([], "path STRING, step LONG, epoch DOUBLE, metrics MAP<STRING, DOUBLE>")
    return lines.select(
        "path",
        F.try_element_at("m", F.lit("step")).cast("long").alias("step"),
        F.try_element_at("m", F.lit("epoch")).alias("epoch"),
        F.map_filter("m", lambda k, _: ~k.isin("step", "epoch")).alias("metrics"),
    )


def append_log(df: DataFrame, path: str) -> None:
    """Append one flat JSON row per event (step, epoch and the metrics)."""
    line = F.map_concat(
        F.create_map(F.lit("step"), F.col("step").cast("double"), F.lit("epoch"), F.col("epoch").cast("double")),
        F.coalesce(F.col("metrics"), F.create_map().cast("map<string,double>")),
    )
    df.select(F.to_json(line).alias("value")).write.mode("append").text(path)


def write_results(df: DataFrame, path: str) -> None:
    """All result rows as JSON, those of failed runs with an explicit null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_progress(row: DataFrame, path: str, batch_id: int) -> None:
    """Progress after one batch, in a folder of its own: writing it again changes nothing."""
    row.coalesce(1).write.mode("overwrite").json(f"{path}/batch_id={batch_id}")


def read_progress(spark: SparkSession, path: str, before: int | None = None) -> dict | None:
    """The newest progress row, or the newest below batch `before`; None if there is none.

    The row of the batch just before is looked up by its folder, so a long job
    does not list all its batches again for every new one.
    """
    if before is not None:
        try:
            rows = spark.read.schema(PROGRESS_SCHEMA).json(f"{path}/batch_id={before - 1}")
            if row := rows.withColumn("batch_id", F.lit(before - 1)).first():
                return row.asDict()
        except AnalysisException as error:
            if not absent(error):
                raise
    try:
        rows = spark.read.schema(PROGRESS_SCHEMA + ", batch_id LONG").json(path)
    except AnalysisException as error:
        if not absent(error):
            raise
        return None
    if before is not None:
        rows = rows.where(F.col("batch_id") < before)
    newest = rows.orderBy(F.col("batch_id").desc()).limit(1).collect()
    return newest[0].asDict() if newest else None
