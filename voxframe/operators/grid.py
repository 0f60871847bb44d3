"""Parameter grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The default sweep
ALPHAS = [0.5, 0.7, 0.9]
TEMPERATURES = [1.0, 2.0]


def sweep_grid(df: DataFrame, **params: Sequence[float]) -> DataFrame:
    """Every row once per combination of the parameter values, without a join."""
    for name, values in params.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
    return df
