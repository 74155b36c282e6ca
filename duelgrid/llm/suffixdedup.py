"""Removal of repeated byte strings by a distributed merge sort of suffixes.

A string of LENGTH bytes that occurs twice has the same k-mer of least hash in both places (its anchor), at the same
distance from its start. So only suffixes at anchors are sorted, and of these only those whose k-mer occurs again. A
task sorts its suffixes into runs, front-codes them and sends each range of keys to the task that merges it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from duelgrid.llm.common import discard, free_names, materialize, partition_id, small_batches, table
from duelgrid.llm.mergesort import Entry, common_prefix, decode_run, encode_run, merge

LENGTH, PASSAGE = 400, 200
KMER = 32
#: Bytes whose hashes are computed together, and bytes of suffixes that a task sorts into one run.
CHUNK, RUN_BYTES = 1 << 19, 32 << 20
#: In a group of at most so many surroundings each pair is looked at; in a larger one, all at each distance together.
PAIRS = 48
#: Anchors with one k-mer that meet in one group. More of them meet by half a window's bytes on either side of the anchor,
#: since one side of any window that occurs twice has so many; this deals a frequent k-mer out over many tasks.
WIDEST = 50_000
#: Bytes of anchors' surroundings that a bucket has on average at most.
BUCKET_BYTES = 8 << 20
EMPTY = hashlib.sha256(b"").hexdigest()
POSITION = np.uint64((1 << 20) - 1)
SCRAMBLE = 0x9E3779B97F4A7C15

TEXTS = (
    "doc_id long, digest binary, n_bytes long, sha string, hashes array<long>, positions array<int>, firsts array<int>"
)


def kmer_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the KMER bytes from each position on."""
    h = data.astype(np.uint64) + np.uint64(1)
    factor, width = np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while width < KMER:
            h = h[:-width] * factor + h[width:]
            factor = factor * factor
            width *= 2
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h


def anchors(data: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each window start, where the window's anchor lies; and the hashes of all positions. Fits in 2**20 bytes."""
    h = kmer_hashes(data)
    least = (h & ~POSITION) | np.arange(len(h), dtype=np.uint64)
    width, most = 1, length - KMER + 1
    while 2 * width <= most:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if most > width:
        least = np.minimum(least[: len(h) - most + 1], least[most - width : most - width + len(h) - most + 1])
    return (least & POSITION).astype(np.int64), h


def _blocks(texts: list[bytes], length: int) -> Iterator[tuple[list[tuple[int, int, int]], np.ndarray]]:
    """Parts of texts laid end to end, up to CHUNK bytes: (text, where the part begins in it, its bytes) and the data."""
    parts: list[tuple[int, int, int]] = []
    held: list[bytes] = []
    size = 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), CHUNK):
            part = t[at : at + CHUNK + length - 1]
            if size and size + len(part) > CHUNK:
                yield parts, np.frombuffer(b"".join(held), np.uint8)
                parts, held, size = [], [], 0
            parts.append((k, at, len(part)))
            held.append(part)
            size += len(part)
    if parts:
        yield parts, np.frombuffer(b"".join(held), np.uint8)


def anchor_lists(texts: list[bytes], length: int = LENGTH) -> list[list[np.ndarray]]:
    """Per text: the hashes and positions of its anchors, and the first window start of each anchor's windows."""
    found: list[list[list[np.ndarray]]] = [[[], [], []] for _ in texts]
    for parts, data in _blocks(texts, length):
        place, h = anchors(data, length)
        at = 0
        for k, begin, n in parts:
            mine = place[at : at + n - length + 1]
            starts = np.concatenate([[0], np.flatnonzero(np.diff(mine)) + 1])
            p = mine[starts]
            found[k][0].append(h[p].view(np.int64))
            found[k][1].append(p - at + begin)
            found[k][2].append(starts + begin)
            at += n
    return [[np.concatenate(c) if c else np.zeros(0, np.int64) for c in x] for x in found]


def _list_array(columns: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, columns)]).astype(np.int32)
    values = np.concatenate(columns) if columns else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _scan(source: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in source:
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        lists = anchor_lists(texts, length)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([hashlib.md5(t, usedforsecurity=False).digest() for t in texts], pa.binary()),
                pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts]),
                *(_list_array([x[k] for x in lists], kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32()))),
            ],
            names=["doc_id", "digest", "n_bytes", "sha", "hashes", "positions", "firsts"],
        )


RUNS = "bucket int, run long, first int, numbers binary, keys binary, lefts binary, doc long, digest binary, entry int, position int"


def _keys(kmer: int, right: bytes, left: bytes, length: int, wide: bool) -> Iterator[tuple[bytes, bytes]]:
    """What an anchor's surroundings are sorted by, and what stands on the other side, read outward.

    A key begins with eight bytes that are the same for all that may match; the last bit is set if sides are exchanged.
    """
    import xxhash

    mask = (1 << 64) - 1
    if not wide:
        # anchors have the least hashes, so these are scrambled before their order deals them out
        yield ((kmer * SCRAMBLE & mask) & ~1).to_bytes(8) + right, left
        return
    half = length // 2
    for turned, (a, b) in enumerate(((right, left), (left, right))):
        if len(a) >= half:
            yield (xxhash.xxh64_intdigest(a[:half], kmer & mask) & ~1 | turned).to_bytes(8) + a, b


def _runs(source: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs by bucket (rows with a bucket), and the places of their entries (rows without)."""
    base, run = partition_id() << 32, 0
    names = [c.split()[0] for c in RUNS.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32()]
    held: dict[tuple[bytes, bytes], list[tuple]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal run
        order = sorted(held)
        by_bucket: dict[int, tuple[int, list]] = {}
        places: list[tuple] = []
        for k, ctx in enumerate(order):
            bucket = int.from_bytes(ctx[0][:4]) * buckets >> 32
            by_bucket.setdefault(bucket, (k, []))[1].append((*ctx, len(held[ctx])))
            places += [(base + run, *place[:2], k, place[2]) for place in held[ctx]]
        rows = []
        for bucket, (first, entries) in by_bucket.items():
            coded = encode_run(entries)
            rows.append((bucket, base + run, first, coded["numbers"], coded["keys"], coded["lefts"], None, None, None, None))
        for k in range(0, len(rows), 16):
            part = list(zip(*rows[k : k + 16]))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds)], names=names)
        for k in range(0, len(places), 20_000):
            r, doc, digest, entry, position = zip(*places[k : k + 20_000])
            none = [None] * len(r)
            part = (none, r, none, none, none, none, doc, digest, entry, position)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(part, kinds)], names=names)
        held.clear()
        run += 1

    for batch in source:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "digest", "text", "found")]
        for doc, digest, text, found in zip(*columns, strict=True):
            data = (text or "").encode()
            for a in found:
                p, first, last = a["position"], a["first"], a["last"]
                for key, left in _keys(a["hash"], data[p : last + length], data[first:p][::-1], length, a["wide"]):
                    held.setdefault((key, left), []).append((doc, digest, p))
                    size += len(key) + len(left) + 64
        if size > RUN_BYTES:
            yield from flush()
            size = 0
    if held:
        yield from flush()


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of whole numbers that overlap or touch, as one."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def resolve(group: list[tuple[Entry, int]], length: int) -> list[tuple[int, int, int, int]]:
    """For anchors with one k-mer: (run, entry, least, most) distances from window start to anchor that occur twice.

    The group comes in the order of its keys, each with the length of its common prefix with the key before, so right
    sides are never compared again. An entry's window at distance d is d bytes of its left and length - d of its right;
    its distances run from length less its right's bytes to its left's bytes.
    """
    entries = [e for e, _ in group]
    common = [k - 8 for _, k in group]
    spans = [(length - (len(e.key) - 8), len(e.left)) for e in entries]
    hits: list[list[tuple[int, int]]] = [[s] if e.count > 1 else [] for e, s in zip(entries, spans)]
    if len(entries) <= PAIRS:
        for j in range(len(entries)):
            right = length
            for i in range(j + 1, len(entries)):
                right = min(right, common[i])
                least = max(spans[i][0], spans[j][0], length - right)
                most = min(spans[i][1], spans[j][1])
                if least <= most:
                    most = min(most, common_prefix(entries[i].left, entries[j].left))
                    if least <= most:
                        hits[i].append((least, most))
                        hits[j].append((least, most))
    else:
        _at_each_distance(entries, common, spans, hits, length)
    out = []
    for e, found in zip(entries, hits):
        turned = e.key[7] & 1
        out += [(e.run, e.number, *((length - b, length - a) if turned else (a, b))) for a, b in _merged(found)]
    return out


def _at_each_distance(entries: list[Entry], common: list[int], spans: list[tuple[int, int]], hits: list[list[tuple[int, int]]], length: int) -> None:
    """Windows at one distance are equal if their right sides, in sorted order, and their left sides, in theirs, are."""
    n = len(entries)
    low, high = np.array(spans).T
    right = np.array(common)
    order = sorted(range(n), key=lambda k: entries[k].left)
    left = np.array([0, *(common_prefix(entries[a].left, entries[b].left) for a, b in zip(order, order[1:]))])
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    since = np.full(n, -1)
    for d in range(int(low.min()), int(high.max()) + 2):
        active = np.flatnonzero((low <= d) & (d <= high))
        new = np.zeros(n, bool)
        if len(active):
            same = np.cumsum(right < length - d)[active] * (n + 1) + np.cumsum(left < d)[place[active]]
            _, at, count = np.unique(same, return_inverse=True, return_counts=True)
            new[active[count[at] > 1]] = True
        for k in np.flatnonzero(~new & (since >= 0)).tolist():
            hits[k].append((int(since[k]), d - 1))
        since = np.where(new, np.where(since < 0, d, since), -1)


def _merge_bucket(rows: pa.Table, length: int) -> pa.Table:
    runs: dict[int, list[dict]] = {}
    for row in rows.select(["run", "first", "numbers", "keys", "lefts"]).to_pylist():
        runs.setdefault(row["run"], []).append(row)
    streams = [decode_run(r["numbers"], r["keys"], r["lefts"], r["run"], r["first"]) for rs in runs.values() for r in rs]
    out: list[tuple[int, int, int, int]] = []
    group: list[tuple[Entry, int]] = []

    def settled() -> list[tuple[int, int, int, int]]:
        return resolve(group, length) if len(group) > 1 or group and group[0][0].count > 1 else []

    for entry, common in merge(streams):
        if common < 8:
            out += settled()
            group.clear()
        group.append((entry, common))
    out += settled()
    columns = list(zip(*out)) or [[], [], [], []]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32())
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds)], names=["run", "entry", "least", "most"])


def _kept(data: bytes, cuts: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(what the cuts leave, bytes removed, runs removed); cuts may overlap."""
    at, kept, removed, spans = 0, [], 0, 0
    for a, b in sorted(cuts):
        if spans and a <= at:
            removed += max(0, b - at)
        else:
            kept.append(data[at:a])
            removed += b - a
            spans += 1
        at = max(at, b)
    return b"".join([*kept, data[at:]]), removed, spans


def _cut(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        columns: list[list] = [[], [], [], [], []]
        for row in batch.to_pylist():
            rest, removed, spans = _kept((row["text"] or "").encode(), [(x["a"], x["b"]) for x in row["cuts"]])
            for c, v in zip(columns, (row["doc_id"], row["digest"], removed, spans, hashlib.sha256(rest).hexdigest())):
                c.append(v)
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "digest", "n_removed", "n_spans", "kept_sha256"])


class Found(NamedTuple):
    #: doc_id, digest, n_bytes, sha and whether the whole text occurs again, of each document.
    rows: DataFrame
    #: doc_id, digest and text of documents that may have repeats.
    candidates: DataFrame
    #: doc_id, digest and the byte ranges to cut, overlapping, of documents that occur once as a whole.
    cuts: DataFrame
    #: The written table that rows come from.
    scanned: DataFrame


def find_repeats(docs: DataFrame, length: int = LENGTH, widest: int = WIDEST) -> Found:
    spark = docs.sparkSession
    small_batches(spark)
    source = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    scanned = materialize(source.mapInArrow(lambda it: _scan(it, length), TEXTS), "scanned")

    # One row per different text, of any of its documents; copies as a whole are done with.
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    fields = F.struct("doc_id", "n_bytes", "hashes", "positions", "firsts")
    distinct = scanned.where(F.col("n_bytes") >= length).groupBy("digest").agg(F.count("*").alias("copies"), F.min_by(fields, order).alias("t"))
    distinct = materialize(distinct.select("digest", "copies", "t.*", F.monotonically_increasing_id().alias("row")), "distinct")

    # Anchors whose k-mer occurs again among different texts.
    each = distinct.select("row", F.posexplode("hashes").alias("k", "hash"))
    again = each.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash", "n", (F.col("n") > widest).alias("wide"))
    again = materialize(again, "again")  # so that the join below has plain exchanges, and a hot hash can be split
    kept = materialize(each.join(again, "hash").groupBy("row").agg(F.collect_list(F.struct("k", "wide")).alias("ks")), "kept")
    anchor = F.expr(
        "transform(ks, x -> named_struct('wide', x.wide, 'hash', hashes[x.k], 'position', positions[x.k], 'first', firsts[x.k], "
        f"'last', coalesce(get(firsts, x.k + 1) - 1, cast(n_bytes as int) - {length})))"
    )
    found = materialize(distinct.join(kept, "row").select("doc_id", "digest", anchor.alias("found")), "found")
    keyed = source.withColumn("digest", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    same = keyed["doc_id"].eqNullSafe(found["doc_id"]) & (keyed["digest"] == found["digest"])
    candidates = keyed.join(found, same).select(found["doc_id"], found["digest"], "text", "found")
    candidates = materialize(candidates, "candidates")

    anchored = again.agg(F.sum("n")).head()[0] or 0
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), anchored * length // BUCKET_BYTES)
    runs = materialize(candidates.mapInArrow(lambda it: _runs(it, length, buckets), RUNS), "runs")
    coded = runs.where("bucket is not null").select("bucket", "run", "first", "numbers", "keys", "lefts")
    merged = coded.groupBy("bucket").applyInArrow(lambda rows: _merge_bucket(rows, length), "run long, entry int, least int, most int")
    places = runs.where("bucket is null").select("run", "entry", "doc", "digest", "position")
    merged = materialize(merged, "merged")
    ranges = places.join(merged, ["run", "entry"]).select(
        F.col("doc").alias("doc_id"), "digest",
        F.struct((F.col("position") - F.col("most")).alias("a"), (F.col("position") - F.col("least") + length).alias("b")).alias("cut"),
    )
    copies = materialize(distinct.where("copies > 1").select("digest", F.lit(True).alias("copied")), "copies")
    cuts = ranges.groupBy("doc_id", "digest").agg(F.collect_set("cut").alias("cuts")).join(copies, "digest", "left_anti")
    cuts = materialize(cuts, "cuts")
    discard(distinct, again, kept, found, runs, merged)
    rows = scanned.select("doc_id", "digest", "n_bytes", "sha").join(copies, "digest", "left")
    return Found(rows.withColumn("copied", F.col("copied").isNotNull()), candidates.select("doc_id", "digest", "text"), cuts, scanned)


#: Of byte ranges `cuts`: the bytes that they cover, and the longest run of them.
COVERED = (
    "aggregate(array_sort(cuts), struct(0 at, 0 n), (acc, x) -> struct(greatest(acc.at, x.b) at, "
    "acc.n + greatest(0, x.b - greatest(acc.at, x.a)) n), acc -> acc.n)"
)
LONGEST = (
    "aggregate(array_sort(cuts), struct(-1 a, -1 b, 0 n), (acc, x) -> struct(if(x.a <= acc.b, acc.a, x.a) a, "
    "if(x.a <= acc.b, greatest(acc.b, x.b), x.b) b, "
    "greatest(acc.n, if(x.a <= acc.b, greatest(acc.b, x.b) - acc.a, x.b - x.a)) n), acc -> acc.n)"
)


def remove_repeats(docs: DataFrame, length: int = LENGTH, widest: int = WIDEST, passage: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_repeated and changed of each document (doc_id, text).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same document or another;
    overlaps count and all is judged on the input. n_repeated counts the bytes of repeated strings of `passage` bytes
    (`length`, if not given; at most `length`), and changed tells whether a byte went. The shorter strings are searched
    first; only texts where they cover `length` bytes on end can have longer ones. `widest` only decides how many tasks
    share the anchors of a frequent k-mer.

    Null and empty texts have no bytes; texts shorter than `length` are kept whole. Rows that repeat, with or without an
    id, are copies of each other, so both go where they are long enough. Rows with a null doc_id are kept. Other columns
    are not read. An empty table gives no rows. Texts of any length are scanned in overlapping chunks.
    """
    passage = passage or length
    rows, candidates, short, _ = find_repeats(docs, passage, widest)
    cuts = short
    key = ["doc_id", "digest"]

    def matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        named = right.withColumnsRenamed({c: f"other_{c}" for c in key})
        return left.join(named, left["doc_id"].eqNullSafe(named["other_doc_id"]) & (left["digest"] == named["other_digest"]), how)

    if passage < length:
        long = short.where(F.expr(LONGEST) >= length).select(*key)
        long = long.unionByName(rows.where((F.col("n_bytes") >= length) & F.col("copied")).select(*key))
        narrow = materialize(matched(candidates, long.distinct(), "left_semi"), "narrow")
        second = find_repeats(narrow, length, widest)
        cuts = second.cuts
        discard(second.scanned, second.candidates, narrow)
    cut = matched(candidates, cuts, "inner").select(*key, "text", "cuts")
    cut = materialize(cut.mapInArrow(_cut, "doc_id long, digest binary, n_removed long, n_spans long, kept_sha256 string"), "cut")
    repeated = short.select(*key, F.expr(COVERED).alias("n_repeated"))
    out = matched(matched(rows, cut, "left").drop("other_doc_id", "other_digest"), repeated, "left")
    whole = F.col("copied") & (F.col("n_bytes") >= length)
    removed = F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0)))
    return out.select(
        "doc_id", "n_bytes", removed.alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, EMPTY).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(F.col("copied"), F.col("n_bytes")).otherwise(F.coalesce("n_repeated", F.lit(0))).cast("long").alias("n_repeated"),
        (removed > 0).alias("changed"),
    )


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, with all their columns, with repeated strings of `length` bytes cut out of `text`.

    Every place of a repeated string is cut, as in remove_repeats(). A document that had bytes and has none left goes; a character of which only some bytes are left goes with them. n_chars
    follows the text where there is such a column. Documents are told apart by doc_id and text; rows that repeat both are
    copies, and go where they are long enough. Null, empty and short texts stay as they are.
    """
    rows, _, cuts, _ = find_repeats(docs, length)
    doc, key, cuts_, changed = free_names(docs, "doc", "digest", "cuts", "changed")
    one_cut = F.array(F.struct(F.lit(0).alias("a"), F.col("n_bytes").cast("int").alias("b")))
    whole = rows.where("copied").select("doc_id", "digest", one_cut.alias("cuts")).distinct()
    edits = whole.unionByName(cuts).toDF(doc, key, cuts_)
    digest = F.unhex(F.md5(F.coalesce("text", F.lit(""))))
    joined = docs.join(edits, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (digest == F.col(key)), "left")
    names, at = docs.columns, docs.columns.index("text")

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            texts, stays = batch.column("text").to_pylist(), []
            for k, cut in enumerate(batch.column(cuts_).to_pylist()):
                if cut is not None:
                    texts[k] = _kept(texts[k].encode(), [(x["a"], x["b"]) for x in cut])[0].decode("utf-8", "ignore")
                stays.append(cut is None or texts[k] != "")
            columns = [batch.column(n) for n in names]
            columns[at] = pa.array(texts, columns[at].type)
            columns.append(pa.array([c is not None for c in batch.column(cuts_).to_pylist()]))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, changed]).filter(pa.array(stays, pa.bool_()))

    schema = StructType([*docs.schema, StructField(changed, BooleanType())])
    out = joined.select(*names, cuts_).mapInArrow(run, schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col(changed), F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*names)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every byte of `documents` that a 400-byte string covers which also starts elsewhere is removed.

    Per document: doc_id, n_bytes, n_removed, n_spans and kept_sha256 of what is left; n_repeated counts the bytes of passages of
    200, which fifty words exceed.
    """
    return remove_repeats(table(spark, sf_dir, "documents"), passage=PASSAGE)
