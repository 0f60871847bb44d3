"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A side may be broadcast only when its row count is known not to exceed this.
# At roughly 100 bytes a row that is 20 MB per executor.
BROADCAST_ROWS = 200_000


def build_session(app: str = "voxframe", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the operators expect; `master` only for local runs."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below `spark.checkpoint.dir`.

    Without that setting it lies in the warehouse, which executors share too.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a narrow result that several steps read, and go on from the copy.

    Ends the lineage: the steps before are not run again by what follows, nor
    after the loss of an executor.
    """
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def whole_div(a: Column, n: int | Column) -> Column:
    """Integer division that stays in integers, so it is exact for any position."""
    return F.call_function("div", a, n if isinstance(n, Column) else F.lit(n))


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint for a side known to hold at most `max_rows` rows.

    Above the limit the side is left as it is and the join shuffles.
    """
    return F.broadcast(df) if max_rows <= BROADCAST_ROWS else df
