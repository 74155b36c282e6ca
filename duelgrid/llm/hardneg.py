"""Hard negatives by a secondary sort: packed (anchor, descending score, id) keys, streamed past open windows of positives."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelgrid.llm.blocks import Block, best, block_at, every_pair, in_blocks, inner_products
from duelgrid.llm.common import materialize, table

SCALE, EVERY, NOISE, LABELS = 256, 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: A negative's score lies between these percentages of its positive's, both included.
LOW, HIGH = 50, 95
#: Rows and bytes of a block of vectors, and of one of anchors; results of so many anchors that a task holds before it hands them on.
ROWS, ANCHORS, BYTES = 8192, 512, 4 << 20
HELD = 50_000
KEY_BYTES = 25

SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT p.anchor_id, p.positive_id, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


class Limits(NamedTuple):
    positives: int = POSITIVES
    negatives: int = NEGATIVES
    low: int = LOW
    high: int = HIGH

    def window(self, positive: int) -> tuple[int, int]:
        """The least and the greatest score of a positive's negatives; the greatest is below the least where there can be none."""
        return -(-self.low * positive // 100), self.high * positive // 100


def packed(anchors: np.ndarray, scores: np.ndarray, negative: np.ndarray, ids: np.ndarray) -> pa.Array:
    """Keys whose order as bytes is by anchor, descending score, positives before negatives, and id."""
    key = np.zeros((len(anchors), KEY_BYTES), np.uint8)
    ordered = lambda x: (x.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
    key[:, :8], key[:, 8:16], key[:, 16], key[:, 17:] = ordered(anchors), ordered(np.invert(scores)), negative, ordered(ids)
    return pa.array([k.tobytes() for k in key], pa.binary())


def unpacked(keys: list[bytes]) -> tuple[list[int], list[int], list[int], list[int]]:
    """Anchors, scores, whether a row is a negative, and ids of packed keys."""
    key = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, KEY_BYTES)
    plain = lambda x: (np.ascontiguousarray(x).view(">u8").astype(np.uint64)[:, 0] ^ np.uint64(1 << 63)).view(np.int64)
    return plain(key[:, :8]).tolist(), np.invert(plain(key[:, 8:16])).tolist(), key[:, 16].tolist(), plain(key[:, 17:]).tolist()


class _Held:
    """The best (score, id) rows of each (anchor, window) that a task has seen."""

    def __init__(self, most: int):
        self.most, self.of = most, {}

    def add(self, key: tuple[int, int], scores: np.ndarray, ids: np.ndarray) -> None:
        if key in self.of:
            s, i = self.of[key]
            scores, ids = np.concatenate([s, scores]), np.concatenate([i, ids])
        at = best(scores, ids, self.most)
        self.of[key] = scores[at], ids[at]

    def out(self, negative: int) -> Iterator[pa.RecordBatch]:
        """Each (anchor, score, id) that is held. Windows that overlap hold the same rows: those of one come once for each time the row stands in it."""
        by_anchor: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for (anchor, _), found in self.of.items():
            by_anchor.setdefault(anchor, []).append(found)
        anchors, scores, ids = [], [], []
        for anchor, windows in by_anchor.items():
            most: dict[tuple[int, int], int] = {}
            for s, i in windows:
                count: dict[tuple[int, int], int] = {}
                for x in zip(s.tolist(), i.tolist()):
                    count[x] = count.get(x, 0) + 1
                for x, n in count.items():
                    most[x] = max(n, most.get(x, 0))
            for (s, i), n in most.items():
                anchors += [anchor] * n
                scores += [s] * n
                ids += [i] * n
        for k in range(0, len(anchors), 10_000):
            a, s, i = (np.array(x[k : k + 10_000], np.int64) for x in (anchors, scores, ids))
            yield pa.RecordBatch.from_arrays(
                [pa.array(a), pa.array(s), pa.array(i), packed(a, s, np.full(len(a), negative, np.uint8), i)], names=["anchor", "score", "id", "key"]
            )
        self.of = {}


FOUND = "anchor long, score long, id long, key binary"


def _positives(asked: Block, block: Block, held: _Held) -> None:
    scores = inner_products(asked.wholes, block.wholes)
    for k, (anchor, label) in enumerate(zip(asked.ids.tolist(), asked.labels.tolist())):
        at = np.flatnonzero((block.labels == label) & (block.ids != anchor))
        if len(at):
            held.add((anchor, 0), scores[k, at], block.ids[at])


def _negatives(asked: Block, windows: list[list[int]], block: Block, held: _Held, limits: Limits) -> None:
    scores = inner_products(asked.wholes, block.wholes)
    for k, (anchor, label) in enumerate(zip(asked.ids.tolist(), asked.labels.tolist())):
        other = (block.labels != label) & (block.ids != anchor)
        for positive in windows[k]:
            low, high = limits.window(positive)
            if low <= high:
                at = np.flatnonzero(other & (scores[k] >= low) & (scores[k] <= high))
                if len(at):
                    held.add((anchor, positive), scores[k, at], block.ids[at])


def _mined(source: Iterator[pa.RecordBatch], limits: Limits) -> Iterator[pa.RecordBatch]:
    """The rows of sorted keys: a positive opens a window, a negative is put out for every open window that it falls into.

    Scores come down, so a window is over once a score lies below it or it has its negatives. All that is held is an
    anchor's open windows.
    """
    anchor_now, open_ = None, []
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    for batch in source:
        out = []
        for anchor, score, negative, i in zip(*unpacked(batch.column("key").to_pylist())):
            if anchor != anchor_now:
                anchor_now, open_ = anchor, []
            if not negative:
                low, high = limits.window(score)
                if low <= high:
                    open_.append([low, high, score, i, 0])
                continue
            left = []
            for w in open_:
                low, high, positive_score, positive, n = w
                if score < low:
                    continue
                if score <= high:
                    w[4] = n = n + 1
                    out.append((anchor, positive, n, i, positive_score, score))
                if n < limits.negatives:
                    left.append(w)
            open_ = left
        columns = zip(*out) if out else [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def hard_negatives(vectors: DataFrame, anchors: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of anchors (vec_id, label,
    embedding) among vectors (the same columns).

    Scores are integer inner products of floor(256 * x), higher ones first, ties to the smaller vec_id. An anchor's
    positives are its first vectors of the same label, its own vec_id apart. A positive's negatives are the first vectors
    of another label whose score is from `low` to `high` per cent of the positive's.

    Both tables become blocks, and each block of anchors meets each block of vectors. The first pass finds the
    positives; with them the windows are known, and the second pass keeps what may be among the first of a window, so
    that a few rows an anchor and task are shuffled and never an anchor's pairs. Those rows meet by anchor, sorted by
    packed keys of (anchor, descending score, id), and stream past the windows that positives open.

    Rows without an id, a label or a vector, and vectors that hold null or non-finite components take no part. Shorter
    vectors count as padded with zeros. Repeated rows count each, as positives and as negatives; of anchors with one id
    the one whose label, then vector, comes first counts. A positive of a negative score has no negatives, one of score
    zero those of score zero. A score that a long cannot hold becomes the nearest that it can. Other columns are not
    read. Empty tables, and anchors without a positive or a negative, give no rows.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    typed = lambda df: df.selectExpr("cast(vec_id as long) vec_id", "cast(label as long) label", "embedding")
    one = F.min(F.struct("label", "embedding")).alias("row")
    chosen = typed(anchors).where("vec_id is not null and label is not null and embedding is not null").where(finite).groupBy("vec_id").agg(one)
    chosen = materialize(chosen.select("vec_id", "row.label", "row.embedding"), "anchors")
    blocks = in_blocks(typed(vectors), SCALE, ROWS, BYTES, "vectors")
    asked = in_blocks(chosen, SCALE, ANCHORS, BYTES, "asked")

    def first(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(limits.positives)
        for batch in source:
            for row in range(batch.num_rows):
                _positives(block_at(batch, row, "q"), block_at(batch, row, "v"), held)
                if len(held.of) > HELD:
                    yield from held.out(0)
        yield from held.out(0)

    place = F.row_number().over(Window.partitionBy("anchor").orderBy(F.desc("score"), "id"))
    met = every_pair(asked, blocks).mapInArrow(first, FOUND)
    positives = materialize(met.withColumn("place", place).where(F.col("place") <= limits.positives).drop("place"), "positives")
    windows = positives.groupBy("anchor").agg(F.collect_set("score").alias("windows"))
    told = asked.select("block", F.posexplode("ids").alias("place", "anchor")).join(windows, "anchor", "left")
    ordered = F.array_sort(F.collect_list(F.struct("place", F.coalesce("windows", F.array().cast("array<bigint>")).alias("windows"))))
    told = told.groupBy("block").agg(F.transform(ordered, lambda x: x["windows"]).alias("windows"))

    def second(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(limits.negatives)
        for batch in source:
            for row in range(batch.num_rows):
                _negatives(block_at(batch, row, "q"), batch.column("q_windows")[row].as_py(), block_at(batch, row, "v"), held, limits)
                if len(held.of) > HELD:
                    yield from held.out(1)
        yield from held.out(1)

    negatives = every_pair(asked.join(told, "block"), blocks).mapInArrow(second, FOUND)
    dealt = positives.select("anchor", "key").unionAll(negatives.select("anchor", "key")).repartition("anchor").sortWithinPartitions("key")
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return dealt.select("key").mapInArrow(lambda it: _mined(it, limits), schema)


def with_label_noise(vectors: DataFrame, every: int = NOISE, labels: int = LABELS) -> DataFrame:
    """vec_id, label and embedding, the label of each vec_id divisible by `every` moved to the next of `labels`."""
    moved = F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return vectors.select("vec_id", moved.alias("label"), "embedding")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three hard negatives for each of the five positives of every vector of `embeddings` whose id is divisible by 50.

    Per anchor, positive and negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.
    """
    vectors = with_label_noise(table(spark, sf_dir, "embeddings"))
    return hard_negatives(vectors, vectors.where(F.col("vec_id") % EVERY == 0))
