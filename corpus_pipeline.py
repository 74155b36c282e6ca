"""A training corpus from documents: language, near-duplicates, repeated passages, test items, packed sequences.

Each stage takes (spark, docs, sf_dir) and returns documents with the columns it got, but for the last. run() applies them
one after the other, each on the table that the one before has written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.llm.common import crc_mod, free_names, materialize, table
from duelgrid.llm.decontam import without_leaks
from duelgrid.llm.langid import UNKNOWN, train, with_language
from duelgrid.llm.packing import pack
from duelgrid.llm.simhash import unique_documents
from duelgrid.llm.suffixdedup import without_repeats

#: A document whose best language has a lower probability is rejected.
LEAST_LANGUAGE_SCORE = 0.5
#: Bytes of a repeated passage: fifty words have more.
PASSAGE_BYTES = 200

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the labelled ones teach; texts without a letter and unclear ones go."""
    model = train(docs.where(F.coalesce(crc_mod(F.col("doc_id"), 5), F.lit(-1)) != 0))
    lang, score = free_names(docs, "lang_pred", "score")
    kept = with_language(docs, model, lang, score).where((F.col(lang) != UNKNOWN) & (F.col(score) >= LEAST_LANGUAGE_SCORE))
    return kept.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the smallest id, of each group of exact and near copies."""
    return unique_documents(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut what occurs elsewhere too out of the texts, at every place where it stands; a document of which nothing is left goes.

    Whole copies and near copies have left one document by now, so what goes are passages that different documents share.
    """
    return without_repeats(docs, PASSAGE_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold an item of `benchmark`."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences for training, with their ids."""
    return pack(docs, with_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeated_passages),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]
#: SQL has no tokenizer and no connected components; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences that all stages leave of `documents`, each stage on the written table of the one before.

    Null texts, and texts without a letter, go with the first stage; documents with a null doc_id stay; repeated rows leave
    one; an empty table gives no rows; columns beside doc_id, text and lang pass through all stages but the last.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
