"""Packing documents into fixed windows: non-negative least squares over length combinations, then greedy residuals."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from duelgrid.llm.common import partition_id, small_batches, table, texts_of
from duelgrid.llm.tokens import WORD_TOKENIZER, WordIds, per_worker

WINDOW = 4096
END_ID = 2
#: Ids held before they are packed together (4 bytes each); the histogram that is solved is that of such a block.
BLOCK_IDS = 4_000_000
#: Lengths whose sums are tried as triples and quadruples: the most frequent ones.
TRIPLE_LENGTHS, QUAD_LENGTHS = 64, 12
NNLS_STEPS = 80

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "sequence_length long"
)
#: (document index, start, length) of one piece; a sequence is a list of them.
Piece = tuple[int, int, int]


def combinations(histogram: np.ndarray, window: int) -> np.ndarray:
    """Shallow combinations of present lengths that fill the window: rows of 2 to 4 lengths, 0 where unused."""
    present = np.flatnonzero(histogram)
    rows = []
    low = present[(present * 2 <= window) & (present > 0)]
    low = low[histogram[window - low] > 0]
    rows.append(np.stack([low, window - low, low * 0, low * 0], 1))
    order = present[np.argsort(-histogram[present], kind="stable")]
    top = np.sort(order[:TRIPLE_LENGTHS])
    a, b = (x.ravel() for x in np.meshgrid(top, top, indexing="ij"))
    c = window - a - b
    keep = (a <= b) & (c >= b)
    a, b, c = a[keep], b[keep], c[keep]
    keep = histogram[c] > 0
    rows.append(np.stack([a, b, c, a * 0], 1)[keep])
    top = np.sort(order[:QUAD_LENGTHS])
    a, b, c = (x.ravel() for x in np.meshgrid(top, top, top, indexing="ij"))
    d = window - a - b - c
    keep = (a <= b) & (b <= c) & (d >= c)
    a, b, c, d = a[keep], b[keep], c[keep], d[keep]
    rows.append(np.stack([a, b, c, d], 1)[histogram[d] > 0])
    return np.concatenate(rows)


def repeat_counts(combos: np.ndarray, histogram: np.ndarray) -> np.ndarray:
    """x >= 0 that minimises |A x - histogram|^2, A's columns being the combinations, by accelerated projected gradient."""
    h = histogram.astype(float)
    h[0] = 0
    used = combos > 0

    def made(x: np.ndarray) -> np.ndarray:
        out = np.bincount(combos.ravel(), (used * x[:, None]).ravel(), len(h))
        out[0] = 0
        return out

    x = y = np.zeros(len(combos))
    lipschitz = 1.0  # the largest column sum of A'A bounds its norm
    if len(combos):
        uses = np.bincount(combos[used], minlength=len(h)).astype(float)
        lipschitz = float((used * uses[combos]).sum(1).max())
    t = 1.0
    for _ in range(NNLS_STEPS):
        slope = made(y) - h
        fresh = np.maximum(0, y - (used * slope[combos]).sum(1) / lipschitz)
        after = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = fresh + (t - 1) / after * (fresh - x)
        x, t = fresh, after
    return x


class _Pool:
    """Pieces by length; finds the longest one that is not over a given length."""

    def __init__(self, window: int):
        self.by_length: list[list[Piece]] = [[] for _ in range(window + 1)]
        self.size = 0

    def add(self, piece: Piece) -> None:
        self.by_length[piece[2]].append(piece)
        self.size += 1

    def take(self, length: int) -> Piece:
        self.size -= 1
        return self.by_length[length].pop()

    def histogram(self) -> np.ndarray:
        return np.array([len(x) for x in self.by_length])


def pack_block(lengths: list[int], window: int = WINDOW) -> list[list[Piece]]:
    """Sequences of pieces that hold every document of a block once, in full.

    Documents of a window or more give whole windows. The rest is matched by length: combinations that fill a window
    are repeated as the least-squares solution says, rounded. What is left is packed greedily, longest first, and cut
    where it crosses a window's end. The last, partly filled window is cut at powers of two, which need no padding.
    """
    sequences: list[list[Piece]] = []
    pool = _Pool(window)
    for k, n in enumerate(lengths):
        whole = n // window * window
        sequences += [[(k, s, window)] for s in range(0, whole, window)]
        if n > whole:
            pool.add((k, whole, n - whole))

    histogram = pool.histogram()
    combos = combinations(histogram, window)
    if len(combos):
        counts = repeat_counts(combos, histogram)
        for row in np.argsort(-counts, kind="stable").tolist():
            times = round(counts[row])
            if not times:
                break
            parts = [n for n in combos[row].tolist() if n]
            need = {n: parts.count(n) for n in parts}
            times = min(times, *(len(pool.by_length[n]) // m for n, m in need.items()))
            sequences += [[pool.take(n) for n in parts] for _ in range(times)]

    # greedy residuals: the longest piece that fits, found through links to the next shorter length in stock
    shorter = list(range(window + 1))

    def longest(n: int) -> int:
        path = []
        while n and not pool.by_length[n]:
            path.append(n)
            shorter[n] = shorter[n] - 1 if shorter[n] == n else shorter[n]
            n = shorter[n]
        for p in path:
            shorter[p] = n
        return n

    current: list[Piece] = []
    room = window
    while pool.size:
        n = longest(room)
        if n:
            piece = pool.take(n)
        else:  # nothing fits: cut the shortest piece in stock
            n = next(i for i in range(room + 1, window + 1) if pool.by_length[i])
            k, s, _ = pool.take(n)
            piece = (k, s, room)
            left = n - room
            pool.add((k, s + room, left))
            for i in range(left, window + 1):  # lengths from here up may be found again
                shorter[i] = i
        current.append(piece)
        room -= piece[2]
        if not room:
            sequences.append(current)
            current, room = [], window
    sequences += power_of_two_parts(current)
    return sequences


def power_of_two_parts(pieces: list[Piece]) -> list[list[Piece]]:
    """A sequence cut into sequences whose lengths are powers of two."""
    total, out, current, room = sum(p[2] for p in pieces), [], [], 0
    for k, s, n in pieces:
        while n:
            if not room:
                room = 1 << (total.bit_length() - 1)
                total -= room
            m = min(n, room)
            current.append((k, s, m))
            s, n, room = s + m, n - m, room - m
            if not room:
                out.append(current)
                current = []
    return out


def _pack_partition(
    source: Iterator[pa.RecordBatch], tokenizer: str, window: int, with_ids: bool, schema: pa.Schema
) -> Iterator[pa.RecordBatch]:
    ids_of: WordIds = per_worker(WordIds, tokenizer)
    end = np.array([END_ID], "<u4").tobytes()
    next_id = partition_id() << 40
    docs: list[int | None] = []
    held: list[bytes] = []

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal next_id
        rows: list[tuple] = []
        for sequence in pack_block([len(x) // 4 for x in held], window):
            offset, total = 0, sum(p[2] for p in sequence)
            for k, s, n in sequence:
                part = held[k][4 * s : 4 * (s + n)]
                row = (docs[k], s, n, zlib.crc32(part), len(held[k]) // 4, next_id, offset, total)
                rows.append((*row, np.frombuffer(part, "<u4")) if with_ids else row)
                offset += n
            next_id += 1
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        docs.clear()
        held.clear()

    size = 0
    for batch in source:
        docs += batch.column("doc_id").to_pylist()
        encoded = [x + end for x in ids_of.encode(texts_of(batch))]
        held += encoded
        size += sum(map(len, encoded)) // 4
        if size >= BLOCK_IDS:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def pack(docs: DataFrame, tokenizer: str = WORD_TOKENIZER, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pack documents (doc_id, text) into sequences of at most `window` tokens, an end id after each document.

    One row per piece: doc_id, start and length (in the document's ids), ids_crc32, doc_tokens, sequence_id, offset and
    sequence_length; with_ids adds the piece's ids. Work is per partition and needs no shuffle: each block of
    BLOCK_IDS ids is packed by its own histogram, which is as long as the window whatever the input.

    Null and empty texts are documents of the end id alone. A null doc_id stays null. Repeated rows are packed each by
    itself. Other columns are not read. An empty table gives no rows. Texts of any length are cut into whole windows.
    Sequences are numbered by partition and in it as its rows come, so that their numbers follow Spark's split of the files.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    small_batches(docs.sparkSession)
    ddl = SCHEMA + (", ids array<int>" if with_ids else "")
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    return source.mapInArrow(lambda it: _pack_partition(it, tokenizer, window, with_ids, schema), ddl)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All `documents` packed into sequences of at most 4096 tokens, padded to 4096 or ending at a power of two.

    Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and sequence_length.
    """
    return pack(table(spark, sf_dir, "documents"))
