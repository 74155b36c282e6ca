"""Token counts without token ids: pieces per distinct pre-token, joined to per-document pre-token frequencies."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from duelgrid.llm.common import discard, let_go, materialize, partition_id, small_batches, table, texts_of
from duelgrid.llm.terms import HEAD_TERMS, count_terms, head
from duelgrid.llm.tokens import PIECE_MODEL, PieceCounts, per_worker, pre_tokens

LIMIT = 4096
ROWS = "row long, doc_id long, n_bytes long, base long, term binary, freq long"


def _units(text: str) -> list[bytes]:
    return [u.encode() for u in pre_tokens(text)[0]]


def _pieces(source: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    counts: PieceCounts = per_worker(PieceCounts, model)
    for batch in source:
        units = [u.decode() for u in batch.column("term").to_pylist()]
        n = pa.array(counts.count(units), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("term"), batch.column("n"), n], names=["term", "n", "pieces"])


def _documents(source: Iterator[pa.RecordBatch], known, line_end: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of rare terms; a document's first row carries its id, size and the sum over its frequent terms."""
    pieces: dict[str, int] = known.value
    idle = [u.encode() for u in list(pieces)[:4096]] or [None]
    row = partition_id() << 40
    for batch in source:
        rows, docs, sizes, bases, terms, freqs = [], [], [], [], [], []
        for doc, text in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
            units, lines = pre_tokens(text)
            base, first = lines * line_end, len(rows)
            for u, f in Counter(units).items():
                p = pieces.get(u)
                if p is None:
                    terms.append(u.encode())
                    freqs.append(f)
                else:
                    base += p * f
            if len(terms) == first:  # nothing rare: any frequent term, no times
                terms.append(idle[row % len(idle)])
                freqs.append(0)
            more = len(terms) - first
            nones = [None] * (more - 1)
            rows += [row] * more
            docs += [doc, *nones]
            sizes += [len(text.encode()), *nones]
            bases += [base, *nones]
            row += 1
        columns = (rows, docs, sizes, bases, terms, freqs)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def count_tokens(docs: DataFrame, model: str = PIECE_MODEL, limit: int = LIMIT, most: int = HEAD_TERMS) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of each document (doc_id, text).

    The library runs once per distinct pre-token of the corpus. `most` bounds the frequent pre-tokens whose counts are
    broadcast; the others are joined, and the result is the same for any value.

    Null and empty texts have no tokens. A null doc_id stays null. Repeated rows are counted each by itself. Other
    columns are not read. An empty table gives no rows. A text of any length is one document.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    counted = count_terms(source, _units)
    schema = "term binary, n long, pieces int"
    pieces = materialize(counted.mapInArrow(lambda it: _pieces(it, model), schema), "pieces")
    frequent = head(pieces, most).select("term", "pieces").toArrow().to_pydict()
    known = spark.sparkContext.broadcast(
        {u.decode(): p for u, p in zip(frequent["term"], frequent["pieces"], strict=True)}
    )
    # the pieces have what the counts had, so that neither their table nor their shuffle lies beside the join's
    discard(counted)
    let_go(spark)
    line_end, arrow = PieceCounts(model).line_end, to_arrow_schema(StructType.fromDDL(ROWS))
    rows = source.mapInArrow(lambda it: _documents(it, known, line_end, arrow), ROWS)
    joined = rows.join(pieces.select("term", "pieces"), "term", "left")
    worth = F.coalesce("base", F.lit(0)) + F.col("freq") * F.coalesce("pieces", F.lit(0))
    out = joined.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum(worth).alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: doc_id, n_bytes, n_tokens by the sentencepiece model, and over_limit (more than 4096)."""
    return count_tokens(table(spark, sf_dir, "documents"))
