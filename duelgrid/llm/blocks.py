"""Vectors as blocks: some thousand rows of whole numbers in one value, and every block of one table against every block of another.

Neither side passes through the driver and nothing is broadcast: blocks of the asking side are dealt to a fixed number of
lanes, each of which holds its share of the other side.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.common import materialize, partition_id, small_batches

SCHEMA = "block long, rows long, width long, ids array<long>, labels array<long>, wholes binary"
#: Up to this sum of products of absolute values, sums of float64 products of whole numbers are exact.
EXACT = 2.0**53


class Block(NamedTuple):
    number: int
    ids: np.ndarray
    labels: np.ndarray
    #: A row of whole numbers for each vector, as float64, which holds those of any double exactly.
    wholes: np.ndarray


def usable(batch: pa.RecordBatch, scale: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """vec_ids, labels and rows of floor(scale * x) of the vectors that take part; scale is a power of two."""
    ids, labels, rows = [], [], []
    for i, label, v in zip(batch.column("vec_id").to_pylist(), batch.column("label").to_pylist(), batch.column("embedding"), strict=True):
        values = v.values
        if i is None or label is None or values is None or values.null_count:
            continue
        x = values.to_numpy(zero_copy_only=False).astype(np.float64)
        if np.isfinite(x).all():
            with np.errstate(over="ignore"):
                scaled = np.floor(scale * x)
            ids.append(i)
            labels.append(label)
            rows.append(np.clip(scaled, -np.finfo(float).max, np.finfo(float).max))
    return np.array(ids, np.int64), np.array(labels, np.int64), rows


def in_blocks(vectors: DataFrame, scale: int, most_rows: int, most_bytes: int, name: str) -> DataFrame:
    """The rows of vectors (vec_id, label, embedding) that take part, written as blocks of at most so many rows and bytes."""
    small_batches(vectors.sparkSession)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = partition_id() << 32, [], 0

        def block() -> pa.RecordBatch:
            ids, labels, rows = zip(*held)
            width = max(map(len, rows))
            wholes = np.zeros((len(rows), width))
            for k, r in enumerate(rows):
                wholes[k, : len(r)] = r
            numbers = [pa.array([n], pa.int64()) for n in (at, len(rows), width)]
            listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(np.array(x, np.int64))) for x in (ids, labels)]
            return pa.RecordBatch.from_arrays(
                [*numbers, *listed, pa.array([wholes.tobytes()], pa.binary())],
                names=["block", "rows", "width", "ids", "labels", "wholes"],
            )

        for batch in source:
            for i, label, row in zip(*usable(batch, scale)):
                if held and (len(held) >= most_rows or size + 8 * len(row) > most_bytes):
                    yield block()
                    at, held, size = at + 1, [], 0
                held.append((i, label, row))
                size += 8 * len(row)
        if held:
            yield block()

    return materialize(vectors.select("vec_id", "label", "embedding").mapInArrow(run, SCHEMA), name)


def every_pair(asking: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each row of asking beside each block, as columns q_... and v_..., all rows of a block next to each other.

    A lane holds its share of the blocks, and each asking row goes to every lane: an equi-join whose number of copies is
    the number of lanes, not of blocks. A lane's blocks stream past its asking rows, which Spark keeps on disk where they are many.
    """
    lanes = max(1, int(asking.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = asking.select(*(F.col(c).alias(f"q_{c}") for c in asking.columns)).withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    held = blocks.select(*(F.col(c).alias(f"v_{c}") for c in blocks.columns)).withColumn("lane", F.pmod(F.xxhash64("v_block"), F.lit(lanes)).cast("int"))
    return held.hint("shuffle_merge").join(asked, "lane")


def block_at(batch: pa.RecordBatch, row: int, side: str) -> Block:
    at = lambda c: batch.column(f"{side}_{c}")[row]
    ids, labels = (at(c).values.to_numpy() for c in ("ids", "labels"))
    wholes = np.frombuffer(at("wholes").as_py(), np.float64).reshape(at("rows").as_py(), at("width").as_py())
    return Block(at("block").as_py(), ids, labels, wholes)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of rows of whole numbers, shorter rows padded with zeros, as int64; one that a long cannot hold
    becomes the nearest that it can."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    with np.errstate(over="ignore"):
        bound = float(np.abs(a).max(0, initial=0) @ np.abs(b).max(0, initial=0))
    if bound < EXACT:
        return (a @ b.T).astype(np.int64)
    left, right = ([[int(x) for x in row] for row in m.tolist()] for m in (a, b))
    exact = [[max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(p, q)))) for q in right] for p in left]
    return np.array(exact, np.int64).reshape(len(left), len(right))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids, in that order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], np.invert(scores[at])))[:k]]
