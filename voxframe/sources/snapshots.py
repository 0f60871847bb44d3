"""Listing of snapshot folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """(run, dir, file_name, size) of the files two levels below `path`.

    Only the listing is read: the file contents are not among the columns.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "length")
    )
    parts = F.split("path", "/")
    return files.select(
        F.element_at(parts, -3).alias("run"),
        F.element_at(parts, -2).alias("dir"),
        F.element_at(parts, -1).alias("file_name"),
        F.col("length").alias("size"),
    )
