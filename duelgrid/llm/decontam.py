"""Benchmark decontamination: passages as BM25 queries against the test items by block-max WAND, then overlap checks."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.llm.common import materialize, small_batches, table, texts_of

K1, B = 1.2, 0.75
#: Share of an item's own BM25 score that a passage must reach, and of its word shingles that a document must hold.
THRESHOLD, OVERLAP, SHINGLE = 0.5, 0.8, 5
#: Words of a passage at least; the next begins half a passage later. Longer items make longer passages.
PASSAGE = 64
#: Items of one index and bytes of their texts, which are broadcast; more are searched in several passes.
MOST_ITEMS, MOST_BYTES = 20_000, 64 << 20
BLOCK = 32
#: A term in at most so large a share of the items is rare; its postings are summed before WAND is asked.
RARE_SHARE = 0.03
MEMO = 400_000
#: Texts whose passages are bounded together.
SEARCHED = 64
STRIP = ".,;:!?\"'()[]{}|*#$%&<>-_"


def terms_of(text: str) -> list[str]:
    """Lower-cased words without punctuation around them."""
    return [w for w in (c.strip(STRIP) for c in text.lower().split()) if w]


class Item(NamedTuple):
    item_id: int
    question: list[str]
    answer: list[str]


def split_item(item_id: int, text: str) -> Item:
    """The last sentence is the answer; of a single sentence, the last third of its words."""
    head, _, tail = text.strip().rstrip(".!?").rpartition(". ")
    question, answer = terms_of(head), terms_of(tail)
    if not question or not answer:
        words = terms_of(text)
        cut = len(words) - max(1, len(words) // 3) if len(words) > 1 else len(words)
        question, answer = words[:cut], words[cut:]
    return Item(item_id, question, answer)


class Statistics(NamedTuple):
    """Of all items, in whichever index they are: their number, mean and greatest length, and items by term."""

    items: int
    mean: float
    longest: int
    df: dict[str, int]


class Index:
    """Postings of BM25 impacts, each divided by its item's score for itself, in blocks that know their maximum."""

    def __init__(self, items: list[Item], stats: Statistics | None = None):
        self.items = items
        bags = [Counter(i.question + i.answer) for i in items]
        lengths = [sum(b.values()) for b in bags]
        if stats is None:
            stats = Statistics(len(items), sum(lengths) / max(1, len(items)), max(lengths, default=0), Counter(t for b in bags for t in b))
        df, mean = stats.df, stats.mean or 1.0
        self.longest = stats.longest
        self.term = {t: k for k, t in enumerate(sorted({t for b in bags for t in b}))}
        postings: list[list[tuple[int, float]]] = [[] for _ in self.term]
        for k, (bag, n) in enumerate(zip(bags, lengths)):
            impact = {}
            for t, f in bag.items():
                idf = math.log(1 + (stats.items - df[t] + 0.5) / (df[t] + 0.5))
                impact[t] = idf * f * (K1 + 1) / (f + K1 * (1 - B + B * n / mean))
            whole = sum(impact.values()) or 1.0
            for t, x in impact.items():
                postings[self.term[t]].append((k, x / whole))
        self.docs = [[k for k, _ in p] for p in postings]
        self.impacts = [[x for _, x in p] for p in postings]
        self.upper = np.array([max(x) for x in self.impacts] or [0.0])
        sizes = np.array([len(d) for d in self.docs] or [0])
        self.rare = sizes <= max(2, RARE_SHARE * len(items))
        self.offsets = np.cumsum(np.concatenate([[0], sizes]))
        self.flat_docs = np.array([k for d in self.docs for k in d], np.int64)
        self.flat_impacts = np.array([x for d in self.impacts for x in d])
        common = ~np.repeat(self.rare, sizes) if len(self.docs) else np.zeros(0, bool)
        #: what the terms that are not rare add to each item's score at most
        self.common_mass = np.bincount(self.flat_docs[common], self.flat_impacts[common], max(1, len(items)))
        self.blocks = [[(max(x[k : k + BLOCK]), d[min(k + BLOCK, len(d)) - 1]) for k in range(0, len(x), BLOCK)] for d, x in zip(self.docs, self.impacts)]

    def search(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """(item, score) of all items with a score of at least the threshold, by block-max WAND."""
        end, docs, impacts, blocks, upper = len(self.items), self.docs, self.impacts, self.blocks, self.upper.tolist()
        cursors = [[docs[t][0], t, 0] for t in terms]
        found = []
        while True:
            cursors.sort()
            total, pivot = 0.0, -1
            for k, c in enumerate(cursors):
                if c[0] >= end:
                    break
                total += upper[c[1]]
                if total >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return found
            target = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == target:
                pivot += 1
            # the bound of the blocks in which the pivot lies, and where the first of them ends
            bound, following = 0.0, end
            for c in cursors[: pivot + 1]:
                d = docs[c[1]]
                at = bisect_left(d, target, c[2])
                if at < len(d):
                    most, last = blocks[c[1]][at // BLOCK]
                    bound += most
                    following = min(following, last + 1)
            if bound < threshold:  # no item before the end of these blocks, or the next list, can reach it
                if pivot + 1 < len(cursors):
                    following = min(following, cursors[pivot + 1][0])
                target = max(target + 1, following)
            elif cursors[0][0] == target:
                score = sum(impacts[c[1]][c[2]] for c in cursors[: pivot + 1])
                if score >= threshold:
                    found.append((target, score))
                target += 1
            for c in cursors[: pivot + 1]:
                if c[0] < target:
                    d = docs[c[1]]
                    c[2] = bisect_left(d, target, c[2])
                    c[0] = d[c[2]] if c[2] < len(d) else end


def coverage(words: list[str], seen: set[str], size: int) -> float:
    """The share of the shingles of `words` (all of them one, if they are fewer than size) in a document's shingles."""
    if not words:
        return 1.0
    n = min(size, len(words))
    made = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]
    return sum(s in seen for s in made) / len(made)


class Matcher:
    """Search of whole documents in one worker."""

    def __init__(self, index: Index, threshold: float, overlap: float, shingle: int):
        self.index, self.threshold, self.overlap, self.shingle = index, threshold, overlap, shingle
        self.half = max(PASSAGE // 2, -(-index.longest // 2))
        self.memo: dict[str, int] = {}
        self.common_upper = np.append(np.where(index.rare, 0, index.upper) if index.docs else [], 0.0)  # last: no item's word
        self.rare = np.append(index.rare if index.docs else [], False).astype(bool)

    def _term(self, chunk: str) -> int:
        word = chunk.lower().strip(STRIP)
        t = self.memo[chunk] = self.index.term.get(word, -1) if word else -2
        return t

    def retrieve(self, texts: list[str]) -> tuple[list[dict[int, float]], int]:
        """For each text, the best score of each item over its passages; and the number of passages searched.

        Words are laid out in half passages, a text in two at least, and a passage is two neighbours of one text.
        """
        if len(self.memo) > MEMO:
            self.memo = {}
        memo, half = self.memo, self.half
        best: list[dict[int, float]] = [{} for _ in texts]
        pieces, owners = [], []
        for k, text in enumerate(texts):
            ids = [memo[c] if c in memo else self._term(c) for c in text.split()]
            ids = np.fromiter((t for t in ids if t > -2) if -2 in ids else ids, np.int64)
            blocks = max(2, -(-len(ids) // half))
            pieces += [ids, np.full(blocks * half - len(ids), -1, np.int64)]
            owners += [k] * blocks
        if not owners or not self.index.items:
            return best, 0
        laid = np.concatenate(pieces).reshape(-1, half)
        owner = np.array(owners)
        at = np.flatnonzero(owner[1:] == owner[:-1])
        passages, owner = np.concatenate([laid[at], laid[at + 1]], 1), owner[at]
        passages.sort(1)
        first = passages >= 0
        first[:, 1:] &= passages[:, 1:] != passages[:, :-1]
        row, column = np.nonzero(first)
        term = passages[row, column]
        common = np.bincount(row, self.common_upper[term], len(passages))
        bound = np.minimum(common, self.index.common_mass.max())
        # the exact score of each item by the passage's rare terms; with the bound for the others, few passages are left
        rare = self.rare[term]
        rare_row, term_ = row[rare], term[rare]
        begin, n = self.index.offsets[term_], self.index.offsets[term_ + 1] - self.index.offsets[term_]
        posting = np.arange(n.sum()) + np.repeat(begin - (np.cumsum(n) - n), n)
        key = np.repeat(rare_row, n) * len(self.index.items) + self.index.flat_docs[posting]
        if len(key):
            order = np.argsort(key)
            key, impact = key[order], self.index.flat_impacts[posting][order]
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            at, item = np.divmod(key[starts], len(self.index.items))
            score = np.add.reduceat(impact, starts) + np.minimum(common[at], self.index.common_mass[item])
            np.maximum.at(bound, at, score)
        searched = np.flatnonzero(bound >= self.threshold - 1e-9).tolist()
        for k in searched:
            found = best[owner[k]]
            for item, score in self.index.search(passages[k][first[k]].tolist(), self.threshold):
                found[item] = max(score, found.get(item, 0.0))
        return best, len(searched)

    def match(self, texts: list[str]) -> list[list[tuple[int, float, float, float]]]:
        """For each text, (item_id, score, question overlap, answer overlap) of the items that it holds."""
        out = []
        for k in range(0, len(texts), SEARCHED):
            part = texts[k : k + SEARCHED]
            out += [self.verify(t, b) if b else [] for t, b in zip(part, self.retrieve(part)[0], strict=True)]
        return out

    def verify(self, text: str, best: dict[int, float]) -> list[tuple[int, float, float, float]]:
        words, seen, out = terms_of(text), {}, []
        for k, score in sorted(best.items()):
            item = self.index.items[k]
            shares = []
            for part in (item.question, item.answer, item.question + item.answer):
                n = min(self.shingle, len(part))
                if n and n not in seen:
                    seen[n] = {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)}
                shares.append(coverage(part, seen.get(n, set()), self.shingle))
            # the item as a whole decides where a short part's only shingle is lost, as when words run together at its edge
            if min(shares[:2]) >= self.overlap or shares[2] >= self.overlap:
                out.append((item.item_id, score, *shares[:2]))
        return out


def _described(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their number of words and their different words; items without a word go."""
    for batch in source:
        items = [split_item(i, t) for i, t in zip(batch.column("item_id").to_pylist(), texts_of(batch), strict=True)]
        words = [i.question + i.answer for i in items]
        arrays = [pa.array(list(map(len, words)), pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=["item_id", "text", "n", "terms"]).filter(pa.array([bool(w) for w in words], pa.bool_()))


def indexes(benchmark: DataFrame, most: int = MOST_ITEMS, most_bytes: int = MOST_BYTES) -> Iterator[Index]:
    """Indexes of items (item_id, text), one after the other, so that each has a bounded size.

    What BM25 takes from all items, and the length of a passage, comes from all of them, so that scores do not depend on
    how many indexes there are.
    """
    usable = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    items = materialize(usable.mapInArrow(_described, "item_id long, text string, n long, terms array<string>"), "items")
    size = items.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.max("n").alias("longest"), F.sum(F.length("text")).alias("bytes")).head()
    each = items.select("item_id", "text", F.explode("terms").alias("term"))
    df = materialize(each.groupBy("term").agg(F.count("*").alias("df")), "df")
    parts = max(1, -(-size.k // most), -(-(size.bytes or 0) // most_bytes))
    shard = F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) if parts > 1 else F.lit(0)
    for k in range(parts):
        held = [split_item(r.item_id, r.text) for r in items.where(shard == k).orderBy("item_id", "text").select("item_id", "text").collect()]
        of_terms = each.where(shard == k).select("term").distinct().join(df, "term").toArrow().to_pydict()
        yield Index(held, Statistics(size.k, (size.n or 0) / max(1, size.k), size.longest or 0, dict(zip(of_terms["term"], of_terms["df"], strict=True))))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap for each document and the test items that it holds.

    Every passage of every whole document is a query; items above the threshold are then checked in the document. An
    item counts if the document holds `overlap` of the word shingles of its question and of its answer, or of both as one.

    Null and empty texts hold nothing; items with a null id or text, or without a word, are never found. A null doc_id
    stays null; repeated rows each give their rows, and items that repeat both id and text count once. Other columns are not read. An empty table on
    either side gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = None
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, threshold, overlap, shingle)
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64())
            names = ["doc_id", "item_id", "score", "question_overlap", "answer_overlap"]
            for batch in batches:
                rows = [(d, *m) for d, found in zip(batch.column("doc_id").to_pylist(), matcher.match(texts_of(batch)), strict=True) for m in found]
                columns = list(zip(*rows)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)

        part = source.mapInArrow(run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP, shingle: int = SHINGLE) -> DataFrame:
    """The documents, with all their columns, that hold no test item; see find_leaks()."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, threshold, overlap, shingle)
            for batch in batches:
                yield batch.filter(pa.array([not found for found in matcher.match(texts_of(batch))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of `benchmark` that each of `documents` holds, with their scores and overlaps; documents without one have no row."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
