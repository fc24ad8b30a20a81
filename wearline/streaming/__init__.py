"""The fold of cycles as a stream: an extra beside the batch engine, for the one incremental notion it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def running_extremes(stream: DataFrame, unit: str, time: str, features: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Per unit and time window, the mergeable statistics that scalers fit from: counts, sums and extremes.

    Late rows are taken in until the watermark passes; merging windows gives the same parameters as
    one batch aggregation.
    """
    columns: list[Column] = [F.count("*").alias("n")]
    for f in features:
        columns += [F.min(f).alias(f"{f}_min"), F.max(f).alias(f"{f}_max"), F.sum(f).alias(f"{f}_sum"), F.sum(F.col(f) * F.col(f)).alias(f"{f}_sum_sq")]
    return stream.withWatermark(time, late).groupBy(F.window(time, window), unit).agg(*columns)


def merged_extremes(windows: DataFrame, features: list[str]) -> DataFrame:
    """One row: minimum, maximum, mean and sample std of each feature over all windows."""
    out = []
    n = F.sum("n").cast("double")
    for f in features:
        s, q = F.sum(f"{f}_sum"), F.sum(f"{f}_sum_sq")
        out += [F.min(f"{f}_min").alias(f"{f}_min"), F.max(f"{f}_max").alias(f"{f}_max"), (s / n).alias(f"{f}_mean"), F.sqrt(F.greatest(q - s * s / n, F.lit(0.0)) / F.greatest(n - 1, F.lit(1.0))).alias(f"{f}_std")]
    return windows.agg(*out)
