"""Running sufficient statistics of ratings over a stream of judged battles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_statistics(battles: DataFrame, time: str | None = None, delay: str = "1 hour", window: str | None = None) -> DataFrame:
    """Points per pair of models from a streaming (or batch) table of model_a, model_b and pref.

    State is one row per pair, and per window where one is asked for; the watermark drops windows that are over. Feed the
    rows of any trigger to operators.ratings.solve().
    """
    kept = battles.where("pref is not null")
    keys = ["model_a", "model_b"]
    if window:
        kept = kept.withWatermark(time, delay)
        keys = [F.window(time, window).alias("window"), *keys]
    return kept.groupBy(*keys).agg(F.sum(1 - F.col("pref")).alias("points_a"), F.sum("pref").alias("points_b"), F.count("*").alias("battles"))
