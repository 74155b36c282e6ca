"""Corpus-wide term counts, and sums over each document's terms through them.

Few terms make up most of a corpus and most terms are rare. The counts come from partial counts per task. A document's
sum takes the frequent terms, a bounded number, from a broadcast dictionary, and only its rare terms are shuffled to
meet their values. Rare terms have, by construction, no hot key.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.common import joined, materialize, small_batches, texts_of

#: Frequent terms that are broadcast, at most, and distinct terms that a task counts before it hands them on.
HEAD_TERMS = 200_000
FLUSH_TERMS = 150_000
#: Bytes of texts whose words are counted together.
COUNTED_BYTES = 16 << 20

#: The terms of a text, with repeats, as bytes.
Extract = Callable[[str], list[bytes]]


def ascii_words(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode().lower().split()


def words_and_ends(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """For a column of texts, one after the other: ascii_words() and an empty string, which no word equals; and their number by text."""
    empty, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    lower = pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), empty))
    split = pc.ascii_split_whitespace(pc.binary_join_element_wise(lower, space, empty))
    words, offsets = split.flatten().cast(pa.large_binary()), split.offsets.to_numpy()
    # an empty string also stands before white space that begins a text
    wanted = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    wanted[offsets[1:] - 1] = True
    sizes = np.diff(np.concatenate([[0], np.cumsum(wanted)]).take(offsets))
    return words if wanted.all() else words.filter(pa.array(wanted)), sizes


def _count_words(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in joined(source, COUNTED_BYTES):
        counted = words_and_ends(batch.column("text"))[0].value_counts()
        table = pa.Table.from_arrays([counted.field(0).cast(pa.binary()), counted.field(1)], names=["term", "n"])
        yield from table.to_batches(max_chunksize=20_000)


def _count(source: Iterator[pa.RecordBatch], extract: Extract) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def flush() -> Iterator[pa.RecordBatch]:
        terms, n = list(counts.keys()), list(counts.values())
        counts.clear()
        for k in range(0, len(terms), 20_000):
            arrays = [pa.array(terms[k : k + 20_000], pa.binary()), pa.array(n[k : k + 20_000], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["term", "n"])

    for batch in source:
        for t in texts_of(batch):
            counts.update(extract(t))
        if len(counts) > FLUSH_TERMS:
            yield from flush()
    yield from flush()


def count_terms(docs: DataFrame, extract: Extract) -> DataFrame:
    """(term binary, n long) over all rows of docs (text), kept in a scratch table."""
    small_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(lambda it: _count(it, extract), "term binary, n long")
    return materialize(counted.groupBy("term").agg(F.sum("n").alias("n")), "terms")


def count_words(docs: DataFrame) -> DataFrame:
    """count_terms() of words and ends."""
    small_batches(docs.sparkSession)
    counted = docs.select("text").mapInArrow(_count_words, "term binary, n long")
    return materialize(counted.groupBy("term").agg(F.sum("n").alias("n")), "terms")


def head(terms: DataFrame, most: int = HEAD_TERMS) -> DataFrame:
    """The terms whose count reaches the least count that at most `most` terms reach."""
    by_count = sorted(((r.n, r.k) for r in terms.groupBy("n").agg(F.count("*").alias("k")).collect()), reverse=True)
    total, least = 0, None
    for n, k in by_count:
        total += k
        if total > most:
            break
        least = n
    return terms.where(F.col("n") >= least) if least is not None else terms.limit(0)
