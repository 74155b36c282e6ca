"""Bradley-Terry ratings: Spark reduces battles to one row per pair of models, a solver does the rest.

Few models take dense Newton steps, more of them sparse ones over arrays of pairs, and pairs that are too many for one process
stay in Spark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.operators.sparse import LocalPairs, SparkPairs, indexed, strengths
from duelgrid.plans.cache import written
from duelgrid.session import share_package

SCALE, BASE, INITIAL = 400.0, 10.0, 1000.0
#: A ridge that keeps separable data finite, and the most Newton steps.
RIDGE, STEPS, TOLERANCE = 1e-10, 1000, 1e-10
#: Models that a dense solve takes, and pairs that one process takes; more of either go another way to the same result.
DENSE_MODELS, LOCAL_PAIRS = 1000, 1_000_000
#: Blocks over which a bootstrap draws first, and cells of a block that it draws for at once.
BLOCKS, CHUNK = 256, 4096
POINTS = "model_a string, model_b string, x array<double>, y array<double>"
RATED = "b long, model string, rating double"


def sufficient_statistics(battles: DataFrame, pref: str = "pref") -> DataFrame:
    """Per ordered pair, a's and b's points; soft and hard preferences alike, unparseable ones left out."""
    kept = battles.where(F.col(pref).isNotNull())
    return kept.groupBy("model_a", "model_b").agg(
        F.sum(1 - F.col(pref)).alias("points_a"), F.sum(pref).alias("points_b"), F.count("*").alias("battles")
    )


def cells(battles: DataFrame, pref: str = "pref") -> DataFrame:
    """How often each (model_a, model_b, pref) occurs, unparseable battles left out."""
    kept = battles.where(F.col(pref).isNotNull())
    return kept.groupBy("model_a", "model_b", F.col(pref).alias("pref")).agg(F.count("*").alias("battles"))


def solve(pairs: Iterable[tuple[str, str, float, float]]) -> dict[str, float]:
    """Ratings from (model_a, model_b, points_a, points_b), each connected set of models around INITIAL."""
    pairs = list(pairs)
    models = sorted({m for a, b, _, _ in pairs for m in (a, b)})
    if not models:
        return {}
    theta = (_dense if len(models) <= DENSE_MODELS else _sparse)(models, [p for p in pairs if p[0] != p[1]])
    return dict(zip(models, (SCALE / np.log(BASE) * theta + INITIAL).tolist()))


def _sparse(models: list[str], pairs: list[tuple[str, str, float, float]]) -> np.ndarray:
    at = {m: k for k, m in enumerate(models)}
    i, j = (np.array([at[p[k]] for p in pairs], np.int64) for k in (0, 1))
    x, y = (np.array([p[k] for p in pairs], float) for k in (2, 3))
    return strengths(LocalPairs(len(models), (i, j, x, y)))


def _dense(models: list[str], pairs: list[tuple[str, str, float, float]]) -> np.ndarray:
    at = {m: k for k, m in enumerate(models)}
    points = np.zeros((len(models), len(models)))
    for a, b, x, y in pairs:
        points[at[a], at[b]] += x
        points[at[b], at[a]] += y
    games, won = points + points.T, points.sum(1)
    theta = np.zeros(len(models))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(theta[:, None] - theta[None, :], -500, 500)))
        slope = won - (games * p).sum(1) - RIDGE * theta
        weight = games * p * (1 - p)
        hessian = np.diag(weight.sum(1) + RIDGE) - weight
        step = np.linalg.pinv(hessian, rcond=1e-12, hermitian=True) @ slope if len(models) < 200 else np.linalg.lstsq(hessian, slope)[0]
        step *= min(1.0, 2.0 / max(1e-300, np.abs(step).max()))  # far from the solution a full step may overshoot
        theta += step
        if np.abs(step).max() < TOLERANCE:
            break
    # the likelihood fixes a connected set up to a shift: centre each
    label = np.arange(len(models))
    linked = games > 0
    for _ in models:
        low = np.minimum(label, np.where(linked, label[None, :], len(models)).min(1))
        if (low == label).all():
            break
        label = low
    for k in np.unique(label):
        theta[label == k] -= theta[label == k].mean()
    return theta


def fit_bradley_terry(
    battles: DataFrame, pref: str = "pref", baseline: str | None = None, baseline_rating: float = INITIAL, most: int = LOCAL_PAIRS
) -> dict[str, float]:
    """model -> rating; empty without a parseable battle. An absent baseline is ignored.

    Up to `most` pairs of models are solved in this process; more stay in Spark, whatever their number.
    """
    return anchored(rated(sufficient_statistics(battles, pref), most), baseline, baseline_rating)


def rated(points: DataFrame, most: int = LOCAL_PAIRS) -> dict[str, float]:
    """model -> rating of points (model_a, model_b, points_a, points_b)."""
    points = points.select("model_a", "model_b", "points_a", "points_b")
    found = points.limit(most + 1).toArrow()
    if found.num_rows <= most:
        return solve(zip(*(found.column(c).to_pylist() for c in found.column_names)))
    spark = points.sparkSession
    share_package(spark)
    points = written(spark, "points", lambda: points)
    sides = points.select(F.explode(F.array("model_a", "model_b")).alias("model")).where("model is not null").distinct()
    models = sides.orderBy("model").toArrow().column("model").to_pylist()
    pairs = written(spark, "pairs", lambda: indexed(spark, points, models))
    theta = strengths(SparkPairs(len(models), pairs))
    return dict(zip(models, (SCALE / np.log(BASE) * theta + INITIAL).tolist()))


def anchored(ratings: dict[str, float], baseline: str | None, rating: float = INITIAL) -> dict[str, float]:
    shift = rating - ratings[baseline] if baseline in ratings else 0.0
    return {m: r + shift for m, r in ratings.items()}


def ratings_frame(spark: SparkSession, ratings: dict[str, float]) -> DataFrame:
    return spark.createDataFrame(sorted(ratings.items()), "model string, rating double")


def _drawn(source: Iterator[pa.RecordBatch], drawn: np.ndarray, sizes: np.ndarray, seed: int) -> Iterator[pa.RecordBatch]:
    """A row for each pair and chunk of cells: the points of both sides in every round. Rows come sorted by block and cell.

    A chunk takes its share of what is left of a block's draws, which is binomial, and deals it over its cells; all rounds
    are drawn at once. Generators are seeded by (seed, block, chunk).
    """
    rounds = len(drawn)
    block, at, left, weight = -1, 0, None, 0
    held: list[tuple[str, str, float, int]] = []

    def chunk() -> pa.RecordBatch | None:
        nonlocal at, left, weight
        if not held:
            return None
        a, b, pref, n = zip(*held)
        pref, n = np.array(pref, float), np.array(n, np.int64)
        rng = np.random.default_rng([seed, block, at])
        share = int(n.sum())
        mine = left if share >= weight else rng.binomial(left, share / weight)
        counts = rng.multinomial(mine, n / share)
        at, left, weight = at + 1, left - mine, weight - share
        starts = np.array([k for k in range(len(a)) if not k or (a[k], b[k]) != (a[k - 1], b[k - 1])])
        x, y = (np.add.reduceat(counts * p, starts, axis=1) for p in (1 - pref, pref))
        some = np.flatnonzero((x + y).any(0))
        held.clear()
        if not len(some):
            return None
        offsets = pa.array(np.arange(0, len(some) * rounds + 1, rounds), pa.int32())
        listed = [pa.ListArray.from_arrays(offsets, pa.array(v[:, some].T.ravel())) for v in (x, y)]
        names = [pa.array([s[starts[k]] for k in some], pa.string()) for s in (a, b)]
        return pa.RecordBatch.from_arrays([*names, *listed], names=["model_a", "model_b", "x", "y"])

    for batch in source:
        for k, a, b, pref, n in zip(*(batch.column(c).to_pylist() for c in ("block", "model_a", "model_b", "pref", "battles"))):
            if k != block or len(held) == CHUNK:
                if made := chunk():
                    yield made
            if k != block:
                block, at, left, weight = k, 0, drawn[:, k], int(sizes[k])
            held.append((a, b, pref, n))
    if made := chunk():
        yield made


def bootstrap_points(battles: DataFrame, rounds: int = 20, seed: int = 0, pref: str = "pref") -> DataFrame:
    """(b, model_a, model_b, points_a, points_b) of each round: battles resampled with replacement.

    Battles collapse to cells of equal (model_a, model_b, pref), and cells to blocks by a hash. Drawing all battles anew is a
    multinomial draw over the blocks, whose number is fixed, and one over the cells of each block inside tasks, some
    thousand cells at a time. A task that runs again draws the same, in any partitioning and at any size.
    """
    spark = battles.sparkSession
    share_package(spark)
    block = F.pmod(F.xxhash64("model_a", "model_b", "pref"), F.lit(BLOCKS)).cast("int")
    counted = cells(battles, pref).withColumn("block", block)
    counted = written(spark, "cells", lambda: counted)
    sizes = np.zeros(BLOCKS, np.int64)
    for r in counted.groupBy("block").agg(F.sum("battles").alias("n")).collect():  # at most BLOCKS rows
        sizes[r.block] = r.n
    shares = sizes / max(1, sizes.sum())
    drawn = np.array([np.random.default_rng([seed, b]).multinomial(sizes.sum(), shares) for b in range(rounds)]) if sizes.any() else np.zeros((rounds, BLOCKS), np.int64)
    dealt = counted.repartition("block").sortWithinPartitions("block", "model_a", "model_b", "pref")
    parts = dealt.mapInArrow(lambda it: _drawn(it, drawn, sizes, seed), POINTS)
    each = parts.select("model_a", "model_b", F.posexplode(F.arrays_zip("x", "y")).alias("b", "p"))
    # a pair's sums come from few blocks; rounding makes them the same in whatever order those arrive
    sums = (F.round(F.sum(f"p.{c}"), 9).alias(n) for c, n in (("x", "points_a"), ("y", "points_b")))
    return each.groupBy(F.col("b").cast("long").alias("b"), "model_a", "model_b").agg(*sums)


def bootstrap(battles: DataFrame, rounds: int = 20, seed: int = 0, pref: str = "pref", baseline: str | None = None, most: int = LOCAL_PAIRS) -> DataFrame:
    """(b, model, rating): battles resampled with replacement, refitted each time.

    A round is fitted in a task; where it has more than `most` pairs of models, rounds are fitted one after the other in Spark.
    """
    spark = battles.sparkSession
    points = written(spark, "rounds", lambda: bootstrap_points(battles, rounds, seed, pref))
    largest = points.groupBy("b").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).head().n or 0
    if largest > most:
        found = [(b, m, r) for b in range(rounds) for m, r in anchored(rated(points.where(F.col("b") == b), most), baseline).items()]
        return spark.createDataFrame(found, RATED)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["model_a", "model_b"])
        found = anchored(solve(zip(rows["model_a"], rows["model_b"], rows["points_a"], rows["points_b"])), baseline)
        return pd.DataFrame({"b": int(rows["b"].iloc[0]), "model": list(found), "rating": list(found.values())})

    return points.groupBy("b").applyInPandas(fit, RATED)


def leaderboard(samples: DataFrame, counts: DataFrame | None = None, evaluated: str | None = None) -> DataFrame:
    """Mean, population deviation and presence per model, best first; battles where counts (model, battles) are given."""
    out = samples.groupBy("model").agg(F.avg("rating").alias("mean"), F.stddev_pop("rating").alias("std"), F.count("*").alias("rounds"))
    if counts is not None:
        out = out.join(counts, "model", "left")
    if evaluated:
        out = out.withColumn("evaluated", F.col("model") == evaluated)
    return out.orderBy(F.desc("mean"), "model")


def mean_absolute_error(ratings: DataFrame, human: DataFrame, evaluated: str | None = None) -> DataFrame:
    """(mae, models) over the models that both rate (columns model, rating), the evaluated one left out."""
    both = ratings.select("model", F.col("rating").alias("r")).join(human.select("model", F.col("rating").alias("h")), "model")
    if evaluated:
        both = both.where(F.col("model") != evaluated)
    return both.agg(F.avg(F.abs(F.col("r") - F.col("h"))).alias("mae"), F.count("*").alias("models"))
