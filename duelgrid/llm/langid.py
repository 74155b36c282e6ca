"""Language identification: words by their frequency per language, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from duelgrid.llm.common import crc_mod, hash_bound, small_batches, table, texts_of

#: The classifier is fitted on about so many documents of each language (all, where there are fewer).
SAMPLE_PER_LANGUAGE = 2500
#: Words and n-grams that the model keeps over all languages: the most frequent ones.
MODEL_WORDS, MODEL_GRAMS, LONGEST_GRAM = 60_000, 80_000, 5
SMOOTHING = 0.5
#: A document's evidence counts as that of so many words at most, so that the score stays short of certainty.
EVIDENCE_WORDS = 40
MEMO = 400_000
UNKNOWN = "und"


def words_of(chunk: str) -> list[str]:
    """The runs of letters of a chunk, lower-cased."""
    low = chunk.lower()
    if low.isalpha():
        return [low]
    return "".join(c if c.isalpha() else " " for c in low).split()


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[k : k + n] for k in range(len(marked) - n + 1)]


class Model:
    """Log frequencies per language, a row per entry. A word's row is found by word, else from its longest known n-grams."""

    def __init__(self, languages: list[str], rows: np.ndarray, words: dict[str, int], tables: list[dict[str, int]]):
        self.languages, self.matrix, self.words, self.tables = languages, rows, words, tables
        self._clear()

    def __getstate__(self):
        return self.languages, self.matrix, self.words, self.tables

    def __setstate__(self, state):
        self.__init__(*state)

    def _clear(self) -> None:
        self.memo: dict[str, int] = {"": 0}
        self.rows = np.zeros((1, len(self.languages)), np.float32)

    def _entries(self, word: str) -> list[int]:
        row = self.words.get(word)
        if row is not None:
            return [row]
        marked = f"^{word}$"
        for n in range(min(LONGEST_GRAM, len(marked)), 0, -1):
            get = self.tables[n].get
            known = [r for k in range(len(marked) - n + 1) if (r := get(marked[k : k + n])) is not None]
            if known:
                return known
        return []

    def _learn(self, missing: list[str]) -> None:
        """Rows for chunks: the sum over their words, of a word's row or the mean of its n-grams' rows."""
        entries, weights, starts, used = [], [], [], []
        for chunk in missing:
            first = len(entries)
            for w in words_of(chunk):
                if found := self._entries(w):
                    entries += found
                    weights += [1 / len(found)] * len(found)
            if len(entries) > first:
                used.append(chunk)
                starts.append(first)
            else:
                self.memo[chunk] = 0
        if used:
            made = np.add.reduceat(self.matrix[entries] * np.array(weights, np.float32)[:, None], starts)
            self.memo.update(zip(used, range(len(self.rows), len(self.rows) + len(used))))
            self.rows = np.concatenate([self.rows, made])

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, probability) of each text; `und` with 0 for a text without a letter."""
        if len(self.memo) > MEMO:
            self._clear()
        chunks = [t.split() for t in texts]
        self._learn(sorted(set().union(*chunks) - self.memo.keys()))
        get, out = self.memo.__getitem__, []
        for text, words in zip(texts, chunks, strict=True):
            if not self.languages or not any(map(str.isalpha, text)):
                out.append((UNKNOWN, 0.0))
                continue
            found = np.fromiter(map(get, words), np.int64, len(words))
            total = self.rows[found].sum(0, dtype=np.float64)
            total *= min(1.0, EVIDENCE_WORDS / max(1, np.count_nonzero(found)))
            p = np.exp(total - total.max())
            best = int(p.argmax())
            out.append((self.languages[best], float(p[best] / p.sum())))
        return out


def _log_rows(counts: dict[str, Counter], languages: list[str], keep: int) -> tuple[list[str], np.ndarray]:
    total: Counter[str] = Counter()
    for c in counts.values():
        total.update(c)
    kept = [w for w, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:keep]]
    out = np.empty((len(kept), len(languages)), np.float32)
    for k, lang in enumerate(languages):
        c, n = counts[lang], sum(counts[lang].values())
        base = math.log(n + SMOOTHING * (len(kept) + 1))
        out[:, k] = np.log(np.array([c[w] for w in kept]) + SMOOTHING) - base
    return kept, out


def _count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = defaultdict(Counter)
    for batch in source:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for chunk, n in Counter((text or "").split()).items():
                for w in words_of(chunk):
                    words[lang][w] += n
    rows = [(lang, 0, w, n) for lang, c in words.items() for w, n in c.items()]
    for size in range(1, LONGEST_GRAM + 1):
        for lang, c in words.items():
            found: Counter[str] = Counter()
            for w, n in c.items():
                for g in grams(w, size):
                    found[g] += n
            rows += [(lang, size, g, n) for g, n in found.items()]
    for k in range(0, len(rows), 20_000):
        lang, size, gram, n = zip(*rows[k : k + 20_000])
        kinds = (pa.string(), pa.int32(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((lang, size, gram, n), kinds)], names=["lang", "size", "gram", "n"])


def train(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fit on rows (doc_id, text, lang) with a language: counts by Spark over the sample, the most frequent entries kept.

    The sample is chosen by a hash of doc_id and text; a null text teaches nothing, and rows without a language are left out.
    """
    small_batches(docs.sparkSession)
    labelled = docs.where("lang is not null").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 0), np.float32), {}, [{} for _ in range(LONGEST_GRAM + 1)])
    limit = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(hash_bound(per_language, sizes[k])).cast("long"))))
    # rows that repeat doc_id and text are in the sample once, so that no such row can fill it
    sample = labelled.where(F.col("h") <= limit[F.col("lang")]).dropDuplicates().select("lang", "text")
    counted = sample.mapInArrow(_count, "lang string, size int, gram string, n long")
    counted = counted.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).where("n > 1 or size < 3")
    # the sample, not the corpus, bounds these rows
    counts: list[dict[str, Counter]] = [{k: Counter() for k in languages} for _ in range(LONGEST_GRAM + 1)]
    for batch in counted.toArrow().to_batches():
        for lang, size, gram, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts[size][lang][gram] = n
    tables, rows, used = [], [], 0
    for n, keep in enumerate([MODEL_WORDS, *[MODEL_GRAMS] * LONGEST_GRAM]):
        names, made = _log_rows(counts[n], languages, keep)
        tables.append(dict(zip(names, range(used, used + len(names)))))
        rows.append(made)
        used += len(names)
    return Model(languages, np.concatenate(rows), tables[0], [{}, *tables[1:]])


def with_language(docs: DataFrame, model: Model, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with two more columns, the predicted language and its probability; other columns pass through untouched.

    Null texts and texts without a letter get `und` and 0. Of languages that are equally likely the first by name is given. A
    document is scored by itself, whatever its length, and
    rows that repeat get equal results. Existing columns of the two names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = docs.drop(language, score)
    schema = StructType([*kept.schema, StructField(language, StringType()), StructField(score, DoubleType())])
    arrow, shared = to_arrow_schema(schema), spark.sparkContext.broadcast(model)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in source:
            found = fitted.predict(texts_of(batch))
            more = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[f.name for f in arrow])

    return kept.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32 of doc_id, modulo 5, is not 0; predicts all. A null doc_id is not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.coalesce(crc_mod(F.col("doc_id"), 5), F.lit(-1))
    model = train(docs.where(remainder != 0))
    out = with_language(docs.select("doc_id", "text", (remainder == 0).alias("held_out")), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
