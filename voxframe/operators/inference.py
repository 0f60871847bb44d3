"""User functions over rows and batches, and the audio feature job."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from voxframe.functions.arrays import pad_or_trim
from voxframe.functions.audio import FRAMES, SAMPLE_RATE, log_mel, mel_filters, resample, sinc_phases


def map_rows(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: StructType | str,
    read: list[str] | None = None,
) -> DataFrame:
    """Apply a user function to Arrow batches of rows; only `read` is sent to it."""

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return (df.select(*read) if read else df).mapInPandas(apply, schema)


def batch_predict(
    df: DataFrame, make_model: Callable[[], Callable], inputs: list[str], output: str,
    return_type: DataType, batch_size: int, input_shapes: list | None = None,
) -> DataFrame:
    """Score rows with a model that each Python worker loads once."""
    predict = predict_batch_udf(
        make_model, return_type=return_type, batch_size=batch_size, input_tensor_shapes=input_shapes
    )
    return df.withColumn(output, predict(*[F.col(c) for c in inputs]))


def clip_features(
    df: DataFrame, key: str, audio: str = "audio", n_mels: int = 80, precision: str = "float"
) -> DataFrame:
    """Log-mel frames of every clip, at 16 kHz.

    (key, duration, n_frames, features, fill): `features` is bins by frames up
    to the last frame that touches the clip, `fill` the value of the silent
    frames after it; `fixed_frames` gives the fixed length. A clip at another
    rate is resampled first; one without samples or rate has NULL features. Clips are independent, so the job is one map
    without a shuffle; Arrow batches are cut by size as well as by rows.
    """

    def apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters, kernels = mel_filters(n_mels), {}
        for batch in batches:
            rows = []
            for row_key, samples, rate in zip(batch["k"], batch["a"], batch["r"]):
                if samples is None or rate is None or rate != rate:
                    rows.append((row_key, None, None, None, None))
                    continue
                if rate not in kernels:
                    kernels[rate] = sinc_phases(int(rate))
                wave = resample(samples, int(rate), kernels[rate])
                mel, fill = log_mel(wave, filters)
                rows.append((row_key, len(wave) / SAMPLE_RATE, mel.shape[1], list(mel), fill))
            yield pd.DataFrame(rows, columns=[key, "duration", "n_frames", "features", "fill"])

    key_type = df.schema[key].dataType.simpleString()
    schema = (
        f"{key} {key_type}, duration double, n_frames int, "
        f"features array<array<{precision}>>, fill {precision}"
    )
    return df.select(
        F.col(key).alias("k"), F.col(f"{audio}.array").alias("a"),
        F.col(f"{audio}.sampling_rate").alias("r"),
    ).mapInPandas(apply, schema)


def fixed_frames(df: DataFrame, n: int = FRAMES) -> DataFrame:
    """Features of exactly n frames, silence after the clip."""
    return df.withColumn(
        "features", F.transform("features", lambda row: pad_or_trim(row, n, F.col("fill")))
    )
