"""Bradley-Terry strengths of any number of models: Newton steps by conjugate gradients, over pairs here or in Spark.

The solver keeps one number a model, as does whoever gets the ratings, and asks for products over the pairs. Pairs that are few
are arrays; others stay a table, and each product is one job with partial sums in its tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RIDGE, TOLERANCE = 1e-10, 1e-9
#: Newton steps, products of one of them, and how much of a step's residual may be left at first and at last.
STEPS, PRODUCTS, LOOSE, TIGHT = 200, 200, 0.1, 1e-3

#: (left, right, left's points, right's points) of some pairs.
Arrays = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


class Pairs(Protocol):
    n: int

    def total(self, of: Callable[[Arrays], dict[str, np.ndarray]], how: str = "sum") -> dict[str, np.ndarray]:
        """The sums (or least values) over all pairs of what `of` gives for some: vectors with one number a model."""


def _scattered(n: int, i: np.ndarray, j: np.ndarray, at_i: np.ndarray, at_j: np.ndarray) -> np.ndarray:
    return np.bincount(i, at_i, n) + np.bincount(j, at_j, n)


class LocalPairs:
    def __init__(self, n: int, pairs: Arrays):
        self.n, self.pairs = n, pairs

    def total(self, of, how="sum"):
        return of(self.pairs)


class SparkPairs:
    """Pairs (i, j, x, y) of a written table."""

    def __init__(self, n: int, table: DataFrame):
        self.n, self.table = n, table

    def total(self, of, how="sum"):
        n, empty = self.n, 0.0 if how == "sum" else np.inf

        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for batch in source:
                i, j, x, y = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                for k, v in of((i, j, x, y)).items():
                    held[k] = v if k not in held else held[k] + v if how == "sum" else np.minimum(held[k], v)
            for k, v in held.items():
                at = np.flatnonzero(v != empty)
                for a in range(0, len(at), 50_000):
                    part = at[a : a + 50_000]
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(part)), pa.array(part), pa.array(v[part].astype(float))], names=["name", "k", "v"])

        parts = self.table.select("i", "j", "x", "y").mapInArrow(run, "name string, k long, v double")
        whole = parts.groupBy("name", "k").agg((F.sum("v") if how == "sum" else F.min("v")).alias("v")).toArrow()
        out: dict[str, np.ndarray] = {}
        names = np.array(whole.column("name").to_pylist())
        k, v = whole.column("k").to_numpy(), whole.column("v").to_numpy()
        for name in np.unique(names) if len(names) else ():
            out[str(name)] = np.full(n, empty)
            out[str(name)][k[names == name]] = v[names == name]
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def connected(pairs: Pairs) -> np.ndarray:
    """The least model that games connect each model with."""
    label = np.arange(pairs.n)
    while True:
        now, n = label, pairs.n

        def least(p: Arrays, now: np.ndarray = now, n: int = n) -> dict[str, np.ndarray]:
            i, j, x, y = p
            played = (x + y) > 0
            out = np.full(n, np.inf)
            np.minimum.at(out, now[i[played]], now[j[played]])
            np.minimum.at(out, now[j[played]], now[i[played]])
            return {"low": out}

        low = pairs.total(least, "min").get("low", np.full(n, np.inf))
        label = np.where(low < label, low, label).astype(np.int64)
        while not np.array_equal(label, label[label]):
            label = label[label]
        label = label[now]
        if np.array_equal(label, now):
            return label


def strengths(pairs: Pairs) -> np.ndarray:
    """The most likely strengths, each connected set of models around zero; a small ridge keeps separable games finite."""
    n = pairs.n
    theta = np.zeros(n)
    for _ in range(STEPS):

        def slopes(p: Arrays, theta: np.ndarray = theta) -> dict[str, np.ndarray]:
            i, j, x, y = p
            win = _sigmoid(theta[i] - theta[j])
            gain, weight = x - (x + y) * win, (x + y) * win * (1 - win)
            return {"slope": _scattered(n, i, j, gain, -gain), "weight": _scattered(n, i, j, weight, weight)}

        found = pairs.total(slopes)
        slope = found.get("slope", np.zeros(n)) - RIDGE * theta
        scale = found.get("weight", np.zeros(n)) + RIDGE
        step, left = np.zeros(n), slope.copy()
        ahead = direction = left / scale
        size = float(left @ ahead)
        enough = size * max(TIGHT, min(LOOSE, np.sqrt(np.abs(slope).max(initial=0)))) ** 2
        for _ in range(PRODUCTS):
            if size <= enough or size < 1e-24:
                break

            def curved(p: Arrays, theta: np.ndarray = theta, v: np.ndarray = direction) -> dict[str, np.ndarray]:
                i, j, x, y = p
                win = _sigmoid(theta[i] - theta[j])
                pull = (x + y) * win * (1 - win) * (v[i] - v[j])
                return {"product": _scattered(n, i, j, pull, -pull)}

            product = pairs.total(curved).get("product", np.zeros(n)) + RIDGE * direction
            length = size / float(direction @ product)
            step += length * direction
            left -= length * product
            ahead = left / scale
            size, before = float(left @ ahead), size
            direction = ahead + size / before * direction
        step *= min(1.0, 2.0 / max(1e-300, np.abs(step).max(initial=0)))  # far from the solution a full step may overshoot
        theta = theta + step
        if np.abs(step).max(initial=0) < TOLERANCE:
            break
    label = connected(pairs)
    count = np.bincount(label, minlength=n)
    return theta - (np.bincount(label, theta, n) / np.maximum(count, 1))[label]


def indexed(spark: SparkSession, points: DataFrame, models: list[str]) -> DataFrame:
    """(i, j, x, y) of points (model_a, model_b, points_a, points_b) with the places of models; a model's games with itself are left out."""
    places = spark.createDataFrame(pa.table({"model": pa.array(models, pa.string()), "k": pa.array(range(len(models)), pa.int64())}))
    side = lambda s, k: places.select(F.col("model").alias(s), F.col("k").alias(k))
    found = points.where("model_a <> model_b").join(side("model_a", "i"), "model_a").join(side("model_b", "j"), "model_b")
    return found.select("i", "j", F.col("points_a").cast("double").alias("x"), F.col("points_b").cast("double").alias("y"))
