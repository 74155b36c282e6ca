"""Quality scores: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from duelgrid.llm.common import crc_mod, hashed_sample, materialize, small_batches, table, texts_of

#: The classifier is fitted on about so many labelled documents (all, if there are fewer).
SAMPLE = 6000
#: Buckets of words and of word shapes, dimensions of a vector, non-zero entries of an index vector, words to each side.
WORDS, SHAPES, DIMENSIONS, NONZERO, REACH = 8192, 4096, 64, 4, 2
HIDDEN, EPOCHS, RATE, DECAY, BATCH = 32, 60, 3e-3, 1e-4, 128
#: Words that a worker remembers, the longest of them, and words of a text whose vectors are added at once.
MEMO, MEMO_WORD, ADDED = 500_000, 64, 1 << 16
EXTRA = 4


def index_vectors(rows: int, seed: int) -> np.ndarray:
    """A sparse random vector of +1 and -1 entries for each row."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, DIMENSIONS), np.float32)
    at = rng.integers(0, DIMENSIONS, (rows, NONZERO))
    np.add.at(out, (np.arange(rows)[:, None], at), rng.choice([-1.0, 1.0], (rows, NONZERO)))
    return out


def shape_of(word: str) -> str:
    """Runs of capitals, small letters and digits as one character each; other characters as they are, runs as one."""
    out: list[str] = []
    for c in word:
        k = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


class Reader:
    """Bucket numbers of a document's words and of their shapes."""

    def __init__(self):
        self.memo: dict[str, int] = {}

    def _learn(self, word: str) -> int:
        w = zlib.crc32(word.lower().strip(".,;:!?").encode()) % WORDS
        code = w * SHAPES + zlib.crc32(shape_of(word).encode()) % SHAPES
        if len(word) <= MEMO_WORD:
            self.memo[word] = code
        return code

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self.memo) > MEMO:
            self.memo = {}
        memo, words, lines = self.memo, text.split(), [x for x in text.split("\n") if x]
        codes = np.array([memo[w] if w in memo else self._learn(w) for w in words], np.int64)
        n = max(1, len(words))
        extra = np.array([
            np.log1p(len(words)), len(set(words)) / n,
            np.count_nonzero(codes[1:] == codes[:-1]) / n, 1 - len(set(lines)) / max(1, len(lines)),
        ])
        return codes // SHAPES, codes % SHAPES, extra


def _mean(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    total = np.zeros(table.shape[1])
    for k in range(0, len(rows), ADDED):
        total += table[rows[k : k + ADDED]].sum(0, dtype=np.float64)
    return total / len(rows)


def _product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w, added up in one order whatever the number of rows, so that equal rows give equal results in any batch."""
    out = np.zeros((len(x), w.shape[1]))
    for column, weights in zip(x.T, w, strict=True):
        out += column[:, None] * weights
    return out


class Pool:
    """A document's features: its mean word vector, its mean shape vector, its length and how much it repeats."""

    def __init__(self, words: np.ndarray):
        self.words, self.shapes, self.reader = words, index_vectors(SHAPES, 2), Reader()

    def features(self, text: str) -> np.ndarray:
        words, shapes, extra = self.reader.read(text)
        out = np.zeros(2 * DIMENSIONS + EXTRA, np.float32)
        if len(words):
            out[:DIMENSIONS] = _mean(self.words, words)
            out[DIMENSIONS : 2 * DIMENSIONS] = _mean(self.shapes, shapes)
        out[2 * DIMENSIONS :] = extra
        return out


def word_vectors(sample: DataFrame) -> np.ndarray:
    """Each word bucket's sum of the index vectors around its occurrences in sample (text), at unit length.

    The sums are of whole numbers, so they are the same in whatever order parts arrive.
    """

    def gather(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, reader = index_vectors(WORDS, 1), Reader()
        total, seen = np.zeros((WORDS, DIMENSIONS)), np.zeros(WORDS, bool)
        for batch in source:
            for t in texts_of(batch):
                ids = reader.read(t)[0]
                for k in range(0, len(ids), ADDED):
                    # a part with what lies within reach on either side
                    first, last = max(0, k - REACH), k + ADDED + REACH
                    part = ids[first:last]
                    near = np.zeros((len(part), DIMENSIONS), np.float32)
                    for d in range(1, REACH + 1):
                        near[d:] += index[part[:-d]]
                        near[:-d] += index[part[d:]]
                    mine = slice(k - first, k - first + ADDED)
                    np.add.at(total, part[mine], near[mine])
                seen[ids] = True
        for k in np.array_split(np.flatnonzero(seen), 16):
            vectors = pa.array([v.tobytes() for v in total[k]], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), vectors], names=["word", "vector"])

    def add(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in source:
            for word, v in zip(batch.column("word").to_pylist(), batch.column("vector").to_pylist(), strict=True):
                sums[word] = sums.get(word, 0) + np.frombuffer(v)
        vectors = pa.array([v.tobytes() for v in sums.values()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), vectors], names=["word", "vector"])

    schema = "word int, vector binary"
    out = np.zeros((WORDS, DIMENSIONS), np.float32)
    for r in sample.select("text").mapInArrow(gather, schema).repartition("word").mapInArrow(add, schema).collect():
        v = np.frombuffer(r.vector)
        out[r.word] = v / (np.linalg.norm(v) or 1.0)
    return out


class Network:
    """Two layers in numpy, trained by Adam on cross-entropy; the temperature is fitted on rows kept apart."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 5):
        self.mean, self.spread = (x.mean(0), x.std(0) + 1e-6) if len(x) else (0.0, 1.0)
        rng = np.random.default_rng(seed)
        n = 2 * DIMENSIONS + EXTRA
        self.p = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.temperature = 1.0
        order = rng.permutation(len(x))
        held, used = order[: len(x) // 5], order[len(x) // 5 :]
        if len(used):
            self._fit((x[used] - self.mean) / self.spread, y[used], rng)
        if len(held):
            self._calibrate(self.logits(x[held]), y[held])

    def _fit(self, x: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> None:
        m, v, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(x))
            for k in range(0, len(x), BATCH):
                at = order[k : k + BATCH]
                w1, b1, w2, b2 = self.p
                h = np.tanh(x[at] @ w1 + b1)
                error = (1 / (1 + np.exp(-(h @ w2 + b2))) - y[at]) / len(at)
                back = error[:, None] * w2 * (1 - h * h)
                slopes = [x[at].T @ back + DECAY * w1, back.sum(0), h.T @ error + DECAY * w2, error.sum(keepdims=True)]
                t += 1
                for p, g, mm, vv in zip(self.p, slopes, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    p -= RATE * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.p
        return _product(np.tanh(_product((x - self.mean) / self.spread, w1) + b1), w2[:, None])[:, 0] + b2

    def _calibrate(self, z: np.ndarray, y: np.ndarray) -> None:
        """The temperature of least cross-entropy: golden-section search over its logarithm."""

        def loss(log_t: float) -> float:
            s = z / np.exp(log_t)
            return float(np.mean(np.logaddexp(0, s) - y * s))

        low, high, g = -3.0, 3.0, (5**0.5 - 1) / 2
        for _ in range(50):
            a, b = high - g * (high - low), low + g * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -500, 500)))


def fit(labelled: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors and network from about `most` rows (doc_id, text, quality) with a label, chosen by a hash.

    Rows that repeat all three are taken once. A null text is an empty one.
    """
    small_batches(labelled.sparkSession)
    usable = labelled.where("quality in (0, 1)")
    chosen = hashed_sample(usable.select("doc_id", "text", F.col("quality").cast("int").alias("quality")), most)
    sample = materialize(chosen.select("text", "quality"), "sample")
    words = word_vectors(sample)
    shared = sample.sparkSession.sparkContext.broadcast(words)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool = Pool(shared.value)
        for batch in source:
            rows = pa.array([pool.features(t).tobytes() for t in texts_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([rows, batch.column("quality")], names=["x", "quality"])

    rows = sample.mapInArrow(run, "x binary, quality int").collect()  # the sample's bound is this one's
    rows.sort(key=lambda r: (bytes(r.x), r.quality))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(-1, 2 * DIMENSIONS + EXTRA)
    return words, Network(x, np.array([r.quality for r in rows], float))


def with_quality(docs: DataFrame, words: np.ndarray, network: Network, score: str = "score") -> DataFrame:
    """docs with one more column, the probability of quality 1; other columns pass through, one of this name is replaced.

    Null and empty texts are texts without words and get a score too. Each whole text is scored by itself, so repeated
    rows get equal scores. Without any labelled row the network is untrained and scores mean nothing.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.drop(score)
    schema = StructType([*kept.schema, StructField(score, DoubleType())])
    arrow, shared = to_arrow_schema(schema), spark.sparkContext.broadcast((words, network))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = shared.value
        pool = Pool(vectors)
        for batch in source:
            if batch.num_rows:
                p = net.probability(np.array([pool.features(t) for t in texts_of(batch)]))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], names=[f.name for f in arrow])

    return kept.mapInArrow(run, schema)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns labels of documents whose crc32 of doc_id, modulo 3, is not 1; a null doc_id is not held out.

    A doc_id whose label rows disagree teaches nothing; label rows that repeat count once. A score of exactly one half
    predicts 1. Per document: doc_id, held_out, score and predicted.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
    labels = labels.where("quality = most").drop("most")
    words, network = fit(docs.where(~held_out).join(labels, "doc_id"))
    out = with_quality(docs.select("doc_id", "text", held_out.alias("held_out")), words, network)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
