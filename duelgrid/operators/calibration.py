"""Temperature calibration against human labels."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.plans.cache import written

LEAST_PAIRS = 10
#: Distinct score differences that one process takes; more are summed in Spark, at each step of the search.
MOST_BINS = 100_000
STEPS = 100


def agreement_histogram(df: DataFrame, delta: str = "delta", label: str = "y") -> DataFrame:
    """(z, n): z is the score difference, positive where it agrees with the label (1: A preferred); ties left out."""
    kept = df.where(F.col(delta).isNotNull() & F.col(label).isNotNull() & (F.col(label) != 0.5))
    return kept.groupBy(((2 * F.col(label) - 1) * F.col(delta)).alias("z")).agg(F.count("*").alias("n"))


def highest(slope: Callable[[float], float], bounds: tuple[float, float] = (-10.0, 10.0)) -> float:
    """Where within bounds a concave function is highest: bisection on its slope."""
    low, high = bounds
    if slope(low) <= 0:
        return low
    if slope(high) >= 0:
        return high
    for _ in range(STEPS):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if slope(middle) > 0 else (low, middle)
    return (low + high) / 2


def best_temperature(z: np.ndarray, n: np.ndarray, bounds: tuple[float, float] = (-10.0, 10.0)) -> float:
    """The T within bounds that maximises sum(n log sigmoid(T z))."""
    if not n.sum():
        raise ValueError("no row without a tie to calibrate on")
    return highest(lambda t: float((n * z / (1 + np.exp(np.clip(t * z, -700, 700)))).sum()), bounds)


def calibrate_temperature(df: DataFrame, default: float | None = None, delta: str = "delta", label: str = "y", least: int = LEAST_PAIRS, most: int = MOST_BINS) -> float:
    """The calibrated temperature; `default`, where given, if fewer than `least` rows are without a tie."""
    bins = agreement_histogram(df, delta, label)
    found = bins.limit(most + 1).toArrow()
    z, n = (found.column(c).to_numpy().astype(float) for c in ("z", "n"))
    if default is not None and n.sum() < least:
        return default
    if len(z) <= most:
        return best_temperature(z, n)
    bins = written(df.sparkSession, "bins", lambda: bins)

    def slope(t: float) -> float:
        exponent = F.greatest(F.lit(-700.0), F.least(F.lit(700.0), t * F.col("z")))
        return bins.agg(F.sum(F.col("n") * F.col("z") / (1 + F.exp(exponent))).alias("s")).head().s

    return highest(slope)
