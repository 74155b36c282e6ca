"""Hidden Markov language model: corpus-wide Baum-Welch over word classes, scored by the scaled forward recursion."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from duelgrid.llm.common import crc_mod, joined, materialize, partition_id, small_batches, table
from duelgrid.llm.markov import TOGETHER, Hmm, expectation, log10_likelihoods
from duelgrid.llm.terms import HEAD_TERMS, ascii_words, count_words, head, words_and_ends

STATES = 8
#: Frequent tokens that are symbols of their own; the others fall into classes by their last two bytes.
OWN_SYMBOLS, CLASSES = 1500, 64
#: Baum-Welch goes on over all training documents until a round gains less log likelihood a token (natural logarithm).
LEAST_GAIN = 1e-3
SMOOTHING = 0.5
END = b""
ROWS = (
    "row long, doc_id long, held_out boolean, n_tokens long, known long, base double, hidden double, term binary, freq long"
)


def tokens_of(text: str) -> list[bytes]:
    """The words and one end, which no word equals."""
    return [*ascii_words(text), END]


class Symbols:
    """Tokens to symbols: own ones first, then classes."""

    def __init__(self, own: list[bytes]):
        self.own = {t: k for k, t in enumerate(own)}
        self.size = len(own) + CLASSES
        self._class: dict[bytes, int] = {}
        self._own = pa.array(own, pa.large_binary())
        # classes by the last two bytes, by the only one, and of no bytes
        tails = [*(bytes(t) for t in product(range(256), repeat=2)), *(bytes([k]) for k in range(256)), b""]
        self._of_tail = np.array([len(own) + zlib.crc32(t) % CLASSES for t in tails], np.int64)

    def __getstate__(self):
        return list(self.own)

    def __setstate__(self, own):
        self.__init__(own)

    def class_of(self, token: bytes) -> int:
        tail = token[-2:]
        found = self._class.get(tail)
        if found is None:
            found = self._class[tail] = len(self.own) + zlib.crc32(tail) % CLASSES
        return found

    def encode(self, tokens: list[bytes]) -> np.ndarray:
        return self.encode_column(pa.array(tokens, pa.large_binary()))

    def encode_column(self, tokens: pa.Array) -> np.ndarray:
        out = pc.index_in(tokens, value_set=self._own).fill_null(-1).to_numpy().astype(np.int64)
        others = np.flatnonzero(out < 0)
        if len(others):
            found = tokens.take(pa.array(others))
            offsets = np.frombuffer(found.buffers()[1], np.int64)[: len(others) + 1]
            # two bytes before all, so that every tail has two
            raw = np.concatenate([np.zeros(2, np.int64), np.frombuffer(found.buffers()[2] or b"", np.uint8)])
            sizes, ends = np.diff(offsets), offsets[1:] + 2
            last, both = raw.take(ends - 1), raw.take(ends - 2) * 256
            out[others] = self._of_tail.take(np.where(sizes > 1, both + last, np.where(sizes == 1, 65_536 + last, 65_792)))
        return out


def initial(counts: np.ndarray) -> Hmm:
    """States that emit the symbols' frequencies, each set apart by a fixed pattern."""
    rng = np.random.default_rng(7)
    emit = (counts[:, None] + 0.1) * rng.gamma(2.0, 0.5, (len(counts), STATES))
    move = np.full((STATES, STATES), 0.2 / STATES) + np.eye(STATES) * 0.8
    even = np.full(STATES, 1 / STATES)
    return Hmm(even, move, emit / emit.sum(0))


def maximised(counts: Hmm, prior: np.ndarray) -> Hmm:
    """The M-step, with a little of the symbols' frequencies in every state, so that nothing has probability zero."""
    share = (prior + 0.1) / (prior + 0.1).sum()
    emit = counts.emit + 20.0 * share[:, None]
    move = counts.move + 1.0
    start = counts.start + 1.0
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def _collected(parts: DataFrame, size: int) -> tuple[Hmm, float, float]:
    """Sum the partitions' expected counts cell by cell, log likelihoods and tokens; the model's size bounds what comes back."""
    cells = parts.groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    flat = np.zeros(STATES + STATES * STATES + size * STATES + 2)
    flat[cells.column("cell").to_numpy()] = cells.column("value").to_numpy()
    a, b = STATES, STATES + STATES * STATES
    return Hmm(flat[:a], flat[a:b].reshape(STATES, STATES), flat[b:-2].reshape(size, STATES)), flat[-2], flat[-1]


def encoded(docs: DataFrame, symbols: Symbols) -> DataFrame:
    """The symbols of docs (text), two bytes each, written once for all rounds."""
    shared = docs.sparkSession.sparkContext.broadcast(symbols)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in joined(source):
            tokens, sizes = words_and_ends(batch.column("text"))
            raw, ends = shared.value.encode_column(tokens).astype("<u2").tobytes(), (2 * np.cumsum(sizes)).tolist()
            coded = [raw[a:b] for a, b in zip([0, *ends], ends)]
            yield pa.RecordBatch.from_arrays([pa.array(coded, pa.binary())], names=["coded"])

    return materialize(docs.select("text").mapInArrow(run, "coded binary"), "encoded")


def _together(source: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Sequences of several batches, up to what the recursions take at once."""
    held: list[np.ndarray] = []
    size = 0
    for batch in source:
        held += [np.frombuffer(x, "<u2") for x in batch.column("coded").to_pylist()]
        size = sum(map(len, held))
        if size >= TOGETHER:
            yield held
            held = []
    if held:
        yield held


def baum_welch(docs: DataFrame, symbols: Symbols, model: Hmm, prior: np.ndarray, least_gain: float = LEAST_GAIN) -> Hmm:
    """Baum-Welch over all of docs (text), until a round gains less than `least_gain` a token.

    Each task sums its expected counts, Spark adds up the tasks' sums. A round that does not end it gains at least that
    much of a log likelihood that has a bound, so it ends.
    """
    spark = docs.sparkSession
    coded, size, before = encoded(docs, symbols), symbols.size, -np.inf
    while True:
        shared = spark.sparkContext.broadcast(model)

        def run(source: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            total = np.zeros(STATES + STATES * STATES + size * STATES + 2)
            for part in _together(source):
                got, log = expectation(shared.value, part)
                total += np.concatenate([*(x.ravel() for x in got), [log, sum(map(len, part))]])
            cells = np.flatnonzero(total)
            for k in range(0, len(cells), 20_000):
                at = cells[k : k + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "value"])

        counts, log, tokens = _collected(coded.mapInArrow(run, "cell long, value double"), size)
        model = maximised(counts, prior)
        shared.unpersist()
        now = log / max(tokens, 1)
        if now - before < least_gain:
            return model
        before = now


class Counts(NamedTuple):
    """What scores need of the frequent tokens, by their place in `head`; the place after the last stands for all others."""

    head: dict[bytes, int]
    #: Symbols (those of rare tokens come from their class), log10 of (count + 0.5) and the same for those that are none of their own.
    symbols: np.ndarray
    base: np.ndarray
    inside: np.ndarray
    #: What base scores and scores subtract, the latter by symbol.
    total: float
    classes: np.ndarray


def counts_of(symbols: Symbols, counted: dict[bytes, int], tokens: int, distinct: int, classes: np.ndarray) -> Counts:
    """Of frequent tokens' counts, all tokens and different ones, and tokens and different ones of each class."""
    base = np.array([*(np.log10(c + SMOOTHING) for c in counted.values()), 0.0])
    of = np.array([*(k if (k := symbols.own.get(t)) is not None else symbols.class_of(t) for t in counted), 0], np.int64)
    own = np.array([*(t in symbols.own for t in counted), True])
    share = np.concatenate([np.zeros(len(symbols.own)), np.log10(classes[:, 0] + SMOOTHING * (classes[:, 1] + 1))])
    head = {t: k for k, t in enumerate(counted)}
    return Counts(head, of, base, np.where(own, 0.0, base), float(np.log10(tokens + SMOOTHING * (distinct + 1))), share)


def _documents(source: Iterator[pa.RecordBatch], shared, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of rare tokens; a document's first row carries its scores but for the rare tokens' counts."""
    symbols, model, counts = shared.value
    places, idle = pa.array(list(counts.head), pa.large_binary()), list(counts.head)[:4096] or [None]
    row = partition_id() << 40
    for batch in joined(source):
        tokens, sizes = words_and_ends(batch.column("text"))
        at = pc.index_in(tokens, value_set=places).fill_null(len(places)).to_numpy().astype(np.int64)
        coded = counts.symbols.take(at)
        others = np.flatnonzero(at == len(places))
        rare = tokens.take(pa.array(others)).to_numpy(zero_copy_only=False).tolist()
        coded[others] = [symbols.class_of(t) for t in rare]
        owner = np.repeat(np.arange(len(sizes)), sizes)
        sums = lambda values: np.bincount(owner, values, len(sizes))
        base = sums(counts.base.take(at)) - counts.total * sizes
        sequences = np.split(coded, np.cumsum(sizes)[:-1])
        hidden = log10_likelihoods(model, sequences) + sums(counts.inside.take(at) - counts.classes.take(coded))
        of_rare = np.bincount(owner[others], minlength=len(sizes))
        terms, freqs, rows, last = [], [], np.zeros(len(sizes), np.int64), 0
        for k, n in enumerate(of_rare.tolist()):
            found = Counter(rare[last : last + n]) if n else {idle[(row + k) % len(idle)]: 0}
            terms += found.keys()
            freqs += found.values()
            rows[k], last = len(found), last + n
        first = np.cumsum(rows) - rows
        later = np.ones(len(terms), bool)
        later[first] = False
        document = np.repeat(np.arange(len(sizes)), rows)
        once = pa.array(document, mask=later)
        values = [batch.column("doc_id"), batch.column("held_out"), sizes, sizes - of_rare, base, hidden]
        columns = [pa.array(row + document), *(pa.array(v).take(once) if isinstance(v, np.ndarray) else v.take(once) for v in values)]
        columns += [pa.array(terms, pa.binary()), pa.array(freqs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, schema=schema)
        row += len(sizes)


def score(docs: DataFrame, train: DataFrame, most: int = HEAD_TERMS) -> DataFrame:
    """Score docs (doc_id, text, held_out) by a model of train (text).

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score: the model's log10 probability of
    the text. Hidden states emit symbols. A frequent token is a symbol; any other one is its class's symbol, times its
    share in the class by add-half counts, half a count being left for what was never seen.

    Counts and Baum-Welch cover all of train. Null and empty texts are one end token. A null doc_id stays null. Repeated
    rows are scored each by itself. Other columns are not read. An empty train table gives uniform scores, an empty
    docs table gives no rows. `most` bounds the frequent tokens that are broadcast; results are the same for any value.
    """
    spark = docs.sparkSession
    small_batches(spark)
    terms = count_words(train)
    whole = terms.agg(F.sum("n").alias("n"), F.count("*").alias("v")).head()
    n, v = whole.n or 0, whole.v
    own = [(bytes(r.term), r.n) for r in terms.orderBy(F.desc("n"), "term").limit(OWN_SYMBOLS).collect()]
    symbols = Symbols([t for t, _ in own])
    by_class = F.pmod(F.crc32(F.substring("term", -2, 2)), F.lit(CLASSES)).cast("int")
    tail = terms.join(F.broadcast(spark.createDataFrame([(bytearray(t),) for t, _ in own], "term binary")), "term", "left_anti")
    classes = np.zeros((CLASSES, 2))
    for r in tail.groupBy(by_class.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        classes[r.c] = r.n, r.v
    prior = np.concatenate([[float(c) for _, c in own], classes[:, 0]])

    model = baum_welch(train, symbols, initial(prior), prior)

    frequent = head(terms, most).toArrow().to_pydict()
    # tokens that are symbols of their own are always among these, so that no count of theirs is added again by the join
    counted = dict(zip(frequent["term"], frequent["n"], strict=True)) | dict(own)
    counts = counts_of(symbols, counted, n, v, classes)
    shared = spark.sparkContext.broadcast((symbols, model, counts))
    arrow = to_arrow_schema(StructType.fromDDL(ROWS))
    scored = docs.select("doc_id", "text", "held_out").mapInArrow(lambda it: _documents(it, shared, arrow), ROWS)
    log = F.log10(F.coalesce("n", F.lit(0)) + SMOOTHING) * F.col("freq")
    joined = scored.join(terms, "term", "left").withColumn("log", log)
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        (F.max("known") + F.sum(F.when(F.col("n") > 0, F.col("freq")).otherwise(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.max("base") + F.sum("log")).alias("base_score"), (F.max("hidden") + F.sum("log")).alias("score"),
    )
    return out.drop("row")


def op10_hmm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32 of doc_id, modulo 5, is not 1; a null doc_id is learnt from."""
    docs = table(spark, sf_dir, "documents").selectExpr("cast(doc_id as long) doc_id", "text")
    docs = docs.withColumn("held_out", F.coalesce(crc_mod(F.col("doc_id"), 5) == 1, F.lit(False)))
    return score(docs, docs.where("not held_out"))
