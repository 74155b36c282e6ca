"""Token ids in compressed blocks: one zstandard frame per document, one shared dictionary, an offset index per block."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from duelgrid.llm.common import hashed_sample, joined, partition_id, scratch_dir, small_batches, table, texts_of
from duelgrid.llm.tokens import WORD_TOKENIZER, WordIds, per_worker

END_ID = 1
#: The dictionary is trained on about so many texts, those of at most so many characters; it only changes sizes, never ids.
SAMPLE_TEXTS, SAMPLE_CHARS, DICTIONARY_BYTES = 600, 4000, 64 * 1024
LEVEL = 3
#: A block ends at so many bytes of frames or so many documents; a reader holds a few hundred blocks at once.
BLOCK_BYTES, BLOCK_DOCS = 128 * 1024, 1024

BLOCKS = (
    "part int, block int, first_doc long, last_doc long, n_docs int, start long, n_tokens long, dict_hash string, "
    "index binary, frames binary"
)
ROWS = "doc_id long, part int, start long, n_tokens long, ids_crc32 long"
#: One entry of a block's index: the document, whether its id is null, where its frame ends, its number of ids.
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("end", "<u4"), ("n", "<u4")])


def serialize(ids: bytes) -> bytes:
    """uint32 ids as they are compressed: low halves, then high halves (all zero for a vocabulary under 65,536)."""
    halves = np.frombuffer(ids, "<u2").reshape(-1, 2)
    high = halves[:, 1]
    return halves[:, 0].tobytes() + (high.tobytes() if high.any() else b"")


def deserialize(raw: bytes, n: int) -> bytes:
    out = np.zeros((n, 2), "<u2")
    halves = np.frombuffer(raw, "<u2")
    out[:, 0] = halves[:n]
    if len(halves) > n:
        out[:, 1] = halves[n:]
    return out.tobytes()


def train_dictionary(docs: DataFrame, tokenizer: str) -> bytes:
    """The shared dictionary, from the short ones among a bounded sample of documents; b'' if there are none."""
    import zstandard

    sample = hashed_sample(docs, SAMPLE_TEXTS).where(F.length("text").between(1, SAMPLE_CHARS))
    rows = sorted(sample.select("text").collect())
    if not rows:
        return b""
    samples = [serialize(x) for x in WordIds(tokenizer).encode([r.text for r in rows])]
    samples = [x for x in samples if len(x) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(raw: bytes):
    import zstandard

    return zstandard.ZstdCompressionDict(raw) if len(raw) >= 8 else None


def _write(source: Iterator[pa.RecordBatch], tokenizer: str, raw: bytes, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import zstandard

    ids_of: WordIds = per_worker(WordIds, tokenizer)
    dictionary = _dictionary(raw)
    if dictionary:
        dictionary.precompute_compress(level=LEVEL)
    packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary)
    end, dict_hash, part = np.array([END_ID], "<u4").tobytes(), hashlib.sha256(raw).hexdigest(), partition_id()
    frames, entries, size, block, start = [], [], 0, 0, 0

    def flush() -> pa.RecordBatch:
        nonlocal block, start, size
        index = np.array(entries, ENTRY)
        n = int(index["n"].sum())
        known = [e[0] for e in entries if not e[1]]
        row = [part, block, known[0] if known else None, known[-1] if known else None, len(entries), start, n, dict_hash]
        row += [index.tobytes(), b"".join(frames)]
        block, start, size = block + 1, start + n, 0
        frames.clear()
        entries.clear()
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)

    for batch in joined(source):
        for doc, ids in zip(batch.column("doc_id").to_pylist(), ids_of.encode(texts_of(batch)), strict=True):
            frames.append(packer.compress(serialize(ids + end)))
            size += len(frames[-1])
            entries.append((doc or 0, doc is None, size, len(ids) // 4 + 1))
            if size >= BLOCK_BYTES or len(entries) >= BLOCK_DOCS:
                yield flush()
    if entries:
        yield flush()


def read_frame(index: bytes, frames: bytes, raw_dictionary: bytes, position: int) -> np.ndarray:
    """The ids of one document of a block, without touching the other frames."""
    import zstandard

    entries = np.frombuffer(index, ENTRY)
    first = int(entries["end"][position - 1]) if position else 0
    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(raw_dictionary))
    raw = unpacker.decompress(frames[first : int(entries["end"][position])])
    return np.frombuffer(deserialize(raw, int(entries["n"][position])), "<u4")


def _read(source: Iterator[pa.RecordBatch], raw: bytes, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    import zstandard

    unpacker = zstandard.ZstdDecompressor(dict_data=_dictionary(raw))
    want = hashlib.sha256(raw).hexdigest()
    for batch in source:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k].as_py() for name in ("part", "start", "dict_hash", "index", "frames")}
            if row["dict_hash"] != want:
                raise ValueError("the block was written with another dictionary")
            entries, first, start = np.frombuffer(row["index"], ENTRY), 0, row["start"]
            columns: list[list] = [[], [], [], [], []]
            for doc, null, end, n in entries.tolist():
                ids = deserialize(unpacker.decompress(row["frames"][first:end]), n)
                for c, v in zip(columns, (None if null else doc, row["part"], start, len(ids) // 4, zlib.crc32(ids))):
                    c.append(v)
                first, start = end, start + n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def write_tokens(docs: DataFrame, path: str, tokenizer: str = WORD_TOKENIZER) -> None:
    """Encode documents (doc_id, text) and write them in ascending doc_id order below `path`.

    `path`/blocks holds one row per block: its place (part, block), its documents' range, the ids before it in its part,
    the dictionary's hash, the index of frame ends and the frames. `path`/dictionary holds the dictionary and its hash.
    Spark's Parquet writer commits the blocks, so retried and speculative tasks leave no half-written file, and a reader
    finds the block of a document by the statistics of first_doc and last_doc.

    A null doc_id sorts first; a null text counts as empty; repeated ids are ordered by a hash of the text and kept. Documents are
    dealt out by ranges of (doc_id, hash of the text), so that a much repeated id is still spread over partitions.
    """
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    raw = train_dictionary(source, tokenizer)
    keyed = source.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = to_arrow_schema(StructType.fromDDL(BLOCKS))
    ordered.mapInArrow(lambda it: _write(it, tokenizer, raw, schema), BLOCKS).write.parquet(f"{path}/blocks")
    row = [(hashlib.sha256(raw).hexdigest(), bytearray(raw))]
    spark.createDataFrame(row, "dict_hash string, dictionary binary").write.parquet(f"{path}/dictionary")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    small_batches(spark)
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    raw = bytes(spark.read.parquet(f"{path}/dictionary").head().dictionary)
    # one number per part, as many as there were write tasks
    totals = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, base = 0, {}
    for part, n in totals:
        base[part] = before
        before += n
    schema = to_arrow_schema(StructType.fromDDL(ROWS))

    def rows(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for b in _read(source, raw, schema):
            shift = pa.array([base[p] for p in b.column("part").to_pylist()], pa.int64())
            yield b.set_column(2, schema.field(2), pc.add(b.column("start"), shift))

    return blocks.mapInArrow(rows, ROWS).drop("part")


def op7_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of `documents`, written to the shared scratch folder and read back.

    Per document from the files: doc_id, start (ids of all documents before it), n_tokens (with the end id) and ids_crc32.
    """
    import uuid

    path = f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
