"""Exact top-k inner products over a bit-sliced index of quantised attributes."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelgrid.llm.blocks import Block, block_at, every_pair, in_blocks
from duelgrid.llm.common import table

SCALE, TOP, EVERY = 1024, 10, 100
#: Bits of an attribute in the index and of a query's weights; rows of one index, queries of a block, and bytes of either.
SLICES, WEIGHT_BITS, BLOCK_ROWS, BLOCK_QUERIES, BLOCK_BYTES = 5, 5, 1 << 14, 512, 16 << 20
#: Queries whose best rows a task holds before it hands them on.
HELD = 50_000
#: Whole numbers from which on a vector is kept out of the index, and scores up to which the index's bounds are exact.
LARGE, EXACT = 2.0**40, 2**50

SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), q AS (
  SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN v c ON q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


class BitSliced:
    """Rows of integers, each attribute cut to its upper SLICES bits and stored as one bitmap per bit."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, self.n = ids, rows, len(ids)
        self.low = rows.min(0)
        span = int((rows.max(0) - self.low).max(initial=0))
        self.shift = max(0, span.bit_length() - SLICES)
        codes = (rows - self.low) >> self.shift
        words = -(-self.n // 64)
        self.words = words
        self.slices = np.zeros((rows.shape[1], SLICES, words), np.uint64)
        for b in range(SLICES):
            packed = np.packbits(((codes >> b) & 1).astype(np.uint8).T, axis=1, bitorder="little")
            padded = np.zeros((rows.shape[1], words * 8), np.uint8)
            padded[:, : packed.shape[1]] = packed
            self.slices[:, b] = padded.view(np.uint64)
        self.all = self._bitmap(np.ones(self.n, np.uint8))
        self.most = np.abs(rows).max(0)

    def _bitmap(self, flags: np.ndarray) -> np.ndarray:
        out = np.zeros(self.words * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        out[: len(packed)] = packed
        return out.view(np.uint64)

    def sums(self, weights: np.ndarray) -> list[np.ndarray]:
        """The slices of sum(|w| * code), code being complemented where w is negative: bitmap addition, bit by bit."""
        total: list[np.ndarray] = []
        # columns of bitmaps by their power of two, taken three at a time: sum stays, carry moves up
        columns: list[list[np.ndarray]] = []
        for j in np.flatnonzero(weights).tolist():
            w = int(weights[j])
            for k in range(abs(w).bit_length()):
                if abs(w) >> k & 1:
                    for b in range(SLICES):
                        while len(columns) <= k + b:
                            columns.append([])
                        bits = self.slices[j, b]
                        columns[k + b].append(bits if w > 0 else bits ^ self.all)
        k = 0
        while k < len(columns):
            column = columns[k]
            while len(column) > 1:
                if k + 1 == len(columns):
                    columns.append([])
                a, b = column.pop(), column.pop()
                half = a ^ b
                if column:
                    c = column.pop(0)
                    column.append(half ^ c)
                    columns[k + 1].append((a & b) | (half & c))
                else:
                    column.append(half)
                    columns[k + 1].append(a & b)
            total.append(column[0] if column else np.zeros(self.words, np.uint64))
            k += 1
        return total

    def kth(self, slices: list[np.ndarray], among: np.ndarray, k: int) -> int:
        """The k-th largest sum among the given rows (the least one, if there are fewer): from the top slice downward."""
        value, left = 0, min(k, int(np.bitwise_count(among).sum()))
        for b in range(len(slices) - 1, -1, -1):
            ones = among & slices[b]
            n = int(np.bitwise_count(ones).sum())
            if n >= left:
                among, value = ones, value | 1 << b
            else:
                among, left = among & ~slices[b], left - n
        return value

    def at_least(self, slices: list[np.ndarray], among: np.ndarray, value: int) -> np.ndarray:
        """Positions of the given rows whose sum is at least value."""
        if value.bit_length() > len(slices):
            return np.zeros(0, np.int64)
        equal, above = among, np.zeros(self.words, np.uint64)
        for b in range(len(slices) - 1, -1, -1):
            if value >> b & 1:
                equal = equal & slices[b]
            else:
                above |= equal & slices[b]
                equal = equal & ~slices[b]
        return np.flatnonzero(np.unpackbits((above | equal).view(np.uint8), bitorder="little")[: self.n])

    def top(self, query_id: int, query: np.ndarray, k: int, least: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) that hold the k best rows other than the query's own; those under `least` may be missing.

        A sum, scaled back, misses a row's score by at most `error`: half a step of each attribute times its weight, and
        what the weights lose to rounding. All rows that may reach the k-th one are scored exactly.
        """
        if not self.n:
            return self.ids, np.zeros(0, np.int64)
        cut = max(0, int(np.abs(query).max(initial=0)).bit_length() - WEIGHT_BITS)
        weights = np.sign(query) * ((np.abs(query) + ((1 << cut) >> 1)) >> cut)
        lost = query - (weights << cut)
        own = np.flatnonzero(self.ids == query_id)
        among = self.all
        if len(own):
            flags = np.ones(self.n, np.uint8)
            flags[own] = 0
            among = self._bitmap(flags)
        slices = self.sums(weights)
        top_code = (1 << SLICES) - 1
        # score = base + 2**(cut + shift) * sum, within error
        half = ((1 << self.shift) - 1) / 2
        negative = int(np.abs(weights[weights < 0]).sum())
        scaled = weights.astype(object) << cut
        base = float((scaled * (self.low + half)).sum()) - float((negative * top_code) << (cut + self.shift))
        error = float((np.abs(scaled) * half).sum() + (np.abs(lost).astype(object) * self.most).sum())
        unit = 1 << (cut + self.shift)
        bound = self.kth(slices, among, k) - 2 * error / unit
        if least is not None:
            bound = max(bound, (least - base - error) / unit)
        at = self.at_least(slices, among, max(0, int(np.floor(bound))))
        scores = self.rows[at] @ query
        return self.ids[at], scores


class Index:
    """A block's bit-sliced index, and the rows whose components are too large for it."""

    def __init__(self, block: Block):
        large = np.abs(block.wholes).max(1, initial=0) >= LARGE
        self.number, self.large = block.number, [(i, whole_numbers(r)) for i, r in zip(block.ids[large].tolist(), block.wholes[large])]
        self.sliced = BitSliced(block.ids[~large], block.wholes[~large].astype(np.int64)) if not large.all() else None

    def best(self, query_id: int, query: np.ndarray, k: int, least: int | None) -> list[tuple[int, int]]:
        """(-score, id) of rows that hold the k best ones other than the query's own; those under `least` may be missing."""
        found: list[tuple[int, int]] = []
        exact = whole_numbers(query)
        sliced = self.sliced
        if sliced is not None:
            width = max(len(query), sliced.rows.shape[1])
            if sum(abs(q) * int(m) for q, m in zip(exact, sliced.most)) < EXACT and np.abs(query).max(initial=0) < LARGE:
                fitted = np.pad(query.astype(np.int64), (0, width - len(query)))[: sliced.rows.shape[1]]
                ids, scores = sliced.top(query_id, fitted, k, least)
                found += zip((-scores).tolist(), ids.tolist())
            else:  # 64-bit sums or the bounds of the index may not hold
                found += [(-exact_score(exact, r.tolist()), i) for i, r in zip(sliced.ids.tolist(), sliced.rows)]
        found += [(-exact_score(exact, r), i) for i, r in self.large]
        return [x for x in found if x[1] != query_id]


def whole_numbers(row: np.ndarray) -> list[int]:
    return [int(x) for x in row.tolist()]


def exact_score(a: list[int], b: list[int]) -> int:
    """The inner product in whole numbers of any size; one that a long cannot hold becomes the nearest that it can."""
    return max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a, b))))


def _search(source: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of each query among the blocks that a task sees; all queries of a block come one after the other."""
    index: Index | None = None
    best: dict[int, list[tuple[int, int]]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        rows = [(q, i, -s) for q, found in best.items() for s, i in found]
        for n in range(0, len(rows), 20_000):
            columns = zip(*rows[n : n + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])
        best.clear()

    for batch in source:
        for row in range(batch.num_rows):
            if index is None or index.number != batch.column("v_block")[row].as_py():
                index = Index(block_at(batch, row, "v"))
            asked = block_at(batch, row, "q")
            for query_id, query in zip(asked.ids.tolist(), asked.wholes):
                before = best.get(query_id, [])
                least = -before[k - 1][0] if len(before) >= k else None
                best[query_id] = heapq.nsmallest(k, [*before, *index.best(query_id, query, k, least)])
            if len(best) > HELD:
                yield from out()
    yield from out()


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP, rows: int = BLOCK_ROWS, asked: int = BLOCK_QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query (vec_id, embedding) its k best vectors (vec_id, embedding).

    Scores are integer inner products of floor(1024 * x); ties go to the smaller vec_id; a query's own id is no candidate.
    Vectors and queries are written as blocks of `rows` and `asked` rows; each block of vectors is indexed once, in one task,
    and all blocks of queries stream past it. Neither passes through the driver. Partial answers, k rows per query and task,
    meet by query.

    Null vectors, vectors that hold null or non-finite components, and rows without an id take no part. Shorter vectors
    count as padded with zeros. Repeated rows are candidates each. Of query rows with one id, the one whose whole numbers
    come first counts. A score that a long cannot hold becomes the nearest that it can. Other columns are not read. Empty
    tables give no rows.
    """
    typed = lambda df: df.selectExpr("cast(vec_id as long) vec_id", "0L label", "embedding")
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE))
    chosen = typed(queries).where("vec_id is not null and embedding is not null").where(usable)
    chosen = chosen.groupBy("vec_id").agg(F.min_by("embedding", whole).alias("embedding")).selectExpr("vec_id", "0L label", "embedding")
    told = in_blocks(chosen, SCALE, asked, BLOCK_BYTES, "asked")
    blocks = in_blocks(typed(vectors), SCALE, rows, BLOCK_BYTES, "vectors")
    parts = every_pair(told, blocks).mapInArrow(lambda it: _search(it, k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return parts.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best vectors of `embeddings` for each of its vectors whose id is divisible by 100: query_id, rank, vec_id, score."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
