"""SimHash near-duplicates: deletion-variant signatures of wide segments, equality on them, verification, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelgrid.llm.common import free_names, materialize, small_batches, table, texts_of
from duelgrid.llm.components import components

BITS, SEED = 64, 42
SHINGLE, MOST_DIFFERING = 4, 4
#: A bucket of at most so many fingerprints is compared row against row by shifting; a larger one is searched outward.
SHIFTED = 8
#: Bits of a signature below those that name its segment and the bit left out.
TAG = 48


def fingerprint(text: str, shingle: int = SHINGLE, lanes: int = 1) -> np.ndarray:
    """The SimHash of a text's word shingles, repeats included, as `lanes` uint64: a bit is set if it is in over half the hashes.

    The first lane takes the shingles' hashes, the others scrambled ones.
    """
    import xxhash

    words = text.encode().lower().split()
    if not words:
        return np.zeros(lanes, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        hashes = np.array([digest(joined, SEED)], "<u8")
    else:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(sizes + 1) - 1
        spans = zip((ends - sizes)[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], "<u8")
    return np.concatenate([_majority(scrambled(hashes, k)) for k in range(lanes)])


def scrambled(hashes: np.ndarray, lane: int) -> np.ndarray:
    if not lane:
        return hashes
    with np.errstate(over="ignore"):
        h = hashes + np.uint64(lane) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _majority(hashes: np.ndarray) -> np.ndarray:
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(0, dtype=np.int64)
    return np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")


def _kind(lanes: int) -> str:
    return "long" if lanes == 1 else "binary"


def _column(fp: np.ndarray) -> pa.Array:
    """Fingerprints, a row each, as a column: signed longs of one lane, bytes of several."""
    fp = np.ascontiguousarray(fp)
    return pa.array(fp[:, 0].view(np.int64)) if fp.shape[1] == 1 else pa.array([r.tobytes() for r in fp], pa.binary())


def _rows(column: pa.Array, lanes: int) -> np.ndarray:
    if lanes == 1:
        return column.to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, 1)
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, lanes)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, lanes: int = 1) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long, or as bytes if it has several lanes."""
    small_batches(docs.sparkSession)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            found = np.array([fingerprint(t, shingle, lanes) for t in texts_of(batch)], np.uint64).reshape(-1, lanes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), _column(found)], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, f"doc_id long, fp {_kind(lanes)}")


def segments(cuts: int) -> list[tuple[int, int]]:
    """(first bit, bits) of the segments of a lane."""
    at = [BITS * k // cuts for k in range(cuts + 1)]
    return [(a, b - a) for a, b in zip(at, at[1:])]


def cuts_for(most: int) -> int:
    """The fewest segments of which one must differ in at most one bit when `most` bits differ."""
    return most // 2 + 1


def variants(fp: np.ndarray, cuts: int) -> np.ndarray:
    """The signatures of fingerprints, one column each: a segment without one of its bits, tagged with both.

    Segments that differ in no bit share all their variants; segments that differ in one share that bit's.
    """
    columns = []
    for lane in range(fp.shape[1]):
        for first, bits in segments(cuts):
            part = (fp[:, lane] >> np.uint64(first)) & np.uint64((1 << bits) - 1)
            for gone in range(bits):
                low = part & np.uint64((1 << gone) - 1)
                high = (part >> np.uint64(gone + 1)) << np.uint64(gone)
                columns.append((high | low) | np.uint64((lane * BITS + first + gone) << TAG))
    return np.stack(columns, 1)


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


def _spanning(members: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of a forest that joins what links join among distinct fingerprints: a search outward over who is left."""
    left = members
    while len(left) > 1:
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = _differing(left, at) <= most
            if near.any():
                found = left[near]
                yield np.repeat(at[None], len(found), 0), found
                frontier += list(found)
                left = left[~near]


def whole_runs(parts: Iterator[tuple[np.ndarray, ...]], size: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Arrays of about `size` rows out of parts whose first array comes sorted, so that equal values of it stay together."""
    held: list[tuple[np.ndarray, ...]] = []
    rows, enough = 0, size
    for part in parts:
        held.append(part)
        rows += len(part[0])
        if rows < enough:
            continue
        whole = tuple(map(np.concatenate, zip(*held)))
        cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last run may go on
        if cut:
            yield tuple(x[:cut] for x in whole)
        held, rows = [tuple(x[cut:].copy() for x in whole)], rows - cut
        enough = max(size, 2 * rows)
    if rows:
        yield tuple(map(np.concatenate, zip(*held)))


def _links(source: Iterator[pa.RecordBatch], most: int, lanes: int) -> Iterator[pa.RecordBatch]:
    """Verified links in runs of equal signatures; the rows of a partition come sorted by (key, fp)."""
    seen: set[bytes] = set()

    def resolved(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        found = []
        edges = np.flatnonzero(np.diff(key)) + 1
        starts, stops = np.concatenate([[0], edges]), np.concatenate([edges, [len(key)]])
        sizes = stops - starts
        size_of = np.repeat(sizes, sizes)
        for shift in range(1, SHIFTED):
            same = np.flatnonzero((key[shift:] == key[:-shift]) & (size_of[shift:] <= SHIFTED))
            if not len(same):
                break
            same = same[_differing(fp[same], fp[same + shift]) <= most]
            found.append(np.concatenate([fp[same], fp[same + shift]], 1))
        for k in np.flatnonzero(sizes > SHIFTED).tolist():
            found += [np.concatenate(x, 1) for x in _spanning(fp[starts[k] : stops[k]], most)]
        pairs = np.concatenate(found) if found else np.zeros((0, 2 * lanes), np.uint64)
        if len(seen) > 300_000:
            seen.clear()
        fresh = {r.tobytes() for r in pairs} - seen
        seen.update(fresh)
        if fresh:
            pairs = np.frombuffer(b"".join(sorted(fresh)), np.uint64).reshape(-1, 2 * lanes)
            yield pa.RecordBatch.from_arrays([_column(pairs[:, :lanes]), _column(pairs[:, lanes:])], names=["a", "b"])

    for key, fp in whole_runs(((b.column("key").to_numpy(zero_copy_only=False), _rows(b.column("fp"), lanes)) for b in source), 200_000):
        yield from resolved(key, fp)


def links(distinct: DataFrame, most: int = MOST_DIFFERING, lanes: int = 1, cuts: int | None = None) -> DataFrame:
    """(a, b): links that connect what all links of at most `most` differing bits connect. distinct: (fp), no repeats.

    Each fingerprint gives as many rows as it has bits. Rows with equal signatures meet; a run of them is compared bit
    by bit, and a large run gives a spanning forest in place of all its pairs. With `cuts` segments a lane, every link
    of fewer than 2 * cuts * lanes differing bits is found.
    """
    cuts = cuts or cuts_for(most)

    def keys(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            fp = _rows(batch.column("fp"), lanes)
            for k in range(0, len(fp), 2000):
                made = variants(part := fp[k : k + 2000], cuts)
                arrays = [pa.array(made.ravel().view(np.int64)), _column(np.repeat(part, made.shape[1], 0))]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "fp"])

    kind = _kind(lanes)
    dealt = distinct.select("fp").mapInArrow(keys, f"key long, fp {kind}").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(lambda it: _links(it, most, lanes), f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, shingle: int = SHINGLE, most: int = MOST_DIFFERING, lanes: int = 1, cuts: int | None = None
) -> DataFrame:
    """doc_id, fingerprint (16 hex digits a lane) and component_id of every document (doc_id, text).

    Documents whose fingerprints differ in at most `most` bits are linked, and component_id is the smallest doc_id that
    links reach. Equal fingerprints are one node, so a large group of copies costs one.

    Null and empty texts, and texts of white space, have fingerprint zero and link like any other. Rows with a null
    doc_id are kept; their component_id is that of the others, null if none has an id. Repeated rows are kept. Other
    columns are not read. An empty table gives no rows. The whole text counts, whatever its length.
    """
    made = materialize(fingerprints(docs, shingle, lanes), "fingerprints")
    distinct = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = materialize(components(links(distinct, most, lanes, cuts)), "roots")
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    least = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("of_root"))
    named = rooted.join(least, "root", "left").select("fp", F.coalesce("of_root", "least").alias("component_id"))
    # a group of copies may hold a third of the rows of this join; with plain exchanges below it, Spark splits them
    joined = made.join(materialize(named, "named"), "fp")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0") if lanes == 1 else F.hex("fp"))
    return joined.select("doc_id", digits.alias("fingerprint"), "component_id")


def unique_documents(docs: DataFrame) -> DataFrame:
    """One document, with all its columns, of each group of near copies: that of the smallest doc_id, null ones last.

    Near copies are what links of an exact five-word shingle similarity of at least 0.8 reach (`neardup.near_copies`).
    Of rows that repeat the survivor's doc_id one stays, and of a group without any doc_id too; of rows that repeat doc_id
    and text, the one whose other columns come first as JSON. Null, empty and blank texts are copies of each other. Columns
    of any names pass through. An empty table gives no rows.
    """
    from duelgrid.llm.neardup import near_copies

    doc_id, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat_ws(" ", F.coalesce(doc_id.cast("string"), F.lit("null")), text)))
    groups = near_copies(docs.select(key.alias("key"), doc_id.alias("doc_id"), text.alias("text")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key")).alias("first")
    k, o, p = free_names(docs, "key", "others", "place")
    kept = materialize(groups.groupBy("component").agg(first).select(F.col("first.key").alias(k)), "kept")
    others = F.to_json(F.struct(F.lit(0).alias(k), *(F.col(f"`{c}`") for c in docs.columns if c != "text")))
    place = F.row_number().over(Window.partitionBy(k).orderBy(o))
    rows = docs.withColumns({k: key, o: others}).join(kept, k, "left_semi").withColumn(p, place)
    return rows.where(F.col(p) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document of `documents`: doc_id, fingerprint over four-word shingles, and component_id of links at four differing bits."""
    return near_duplicates(table(spark, sf_dir, "documents"))
