"""Near copies by SimHash: wildcard variants of ten lanes' segments find candidates, shingle sets decide them exactly."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelgrid.llm.common import materialize, small_batches, texts_of
from duelgrid.llm.components import components
from duelgrid.llm.simhash import BITS, TAG, scrambled, segments, variants, whole_runs

SHINGLE, SEED = 5, 42
#: Two texts are linked if at least so much of what either has is in both, as a fraction.
SHARED, OF = 4, 5
#: Fingerprints of 64 bits, segments of each, and how many bits of a segment, its least certain ones, get a variant without
#: them. Bits differ with probability acos(2s / (1 + s)) / pi at a similarity of s, which is 0.15 at 0.8, and those of a
#: close vote do so first: by simulation 97.7 % of pairs at 0.8 share a variant, 99.9 % at 0.85.
LANES, CUTS, WEAK = 10, 3, 8
#: Lanes that travel with a variant, and bits in which a candidate may differ there and in all lanes: 3.1 and 2.8 standard
#: deviations above the mean of pairs at 0.8.
TRAVEL, MOST_TRAVEL, MOST_ALL = (0, 5), 32, 122
#: Runs of at most so many variants are compared by shifting all of them at once; others are taken one by one, in blocks.
SMALL, BLOCK = 8, 512
#: Pairs of a text that are decided before all of them are looked at, and lanes that are searched for the second few.
FEW, FEW_LANES = 4, 1
MEMO = 150_000
PAIRS = "a long, b long, far int"

_FACTORS = np.random.default_rng(SEED).integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.uint64(0x0101010101010101)


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    """The runs of `size` words of a text; a shorter text is one run."""
    words = (text or "").encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= size:
        return {joined}
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - size] + 1).tolist()]
    return {joined[a:b] for a, b in zip(starts, ends[size - 1 :].tolist(), strict=True)}


def similar(a: set[bytes], b: set[bytes]) -> bool:
    both = len(a & b)
    return OF * both >= SHARED * (len(a) + len(b) - both)


class Sketcher:
    """Digests of texts' words, fingerprints of their sets of shingles, and which bits have the closest votes."""

    def __init__(self):
        self.memo: dict[bytes, int] = {}

    def hashes(self, words: list[bytes]) -> np.ndarray:
        import xxhash

        memo = self.memo
        for w in set(words).difference(memo):
            memo[w] = xxhash.xxh64_intdigest(w, SEED)
        h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - SHINGLE + 1)
        with np.errstate(over="ignore"):
            mixed = np.zeros(n, np.uint64)
            for k, factor in enumerate(_FACTORS):
                part = h[k : k + n] * factor
                mixed[: len(part)] += part
        return np.unique(scrambled(mixed, 1))

    def sketch(self, texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Digests, fingerprints (texts x lanes) and masks of the bits that get a variant (texts x lanes)."""
        if len(self.memo) > MEMO:
            self.memo = {}
        digests, sets = [], []
        for text in texts:
            words = text.encode().lower().split()
            digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
            sets.append(self.hashes(words))
        votes, n = _votes(sets)
        margin = np.abs(2 * votes - n[:, None, None])
        weak = np.zeros(votes.shape, bool)
        for first, bits in segments(CUTS):
            order = np.argsort(margin[:, :, first : first + bits], axis=2, kind="stable")[:, :, :WEAK]
            np.put_along_axis(weak[:, :, first : first + bits], order, True, 2)
        return digests, _packed(2 * votes > n[:, None, None]), _packed(weak)


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=2, bitorder="little").view("<u8")[:, :, 0]


def _votes(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """How many hashes of each set have a bit set, by set, lane and bit; and the sizes of the sets."""
    n = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    # sums of up to 255 hashes fit in the eight bytes of a word
    groups = -(-n // 255)
    of_set = np.concatenate([[0], np.cumsum(groups)[:-1]])
    starts = np.repeat(np.cumsum(n) - n - 255 * of_set, groups) + 255 * np.arange(groups.sum())
    votes = np.zeros((len(sets), LANES, 8, 8), np.int64)  # the third is a bit's byte, the fourth its place in the byte
    for lane in range(LANES if len(sets) else 0):
        x = scrambled(flat, lane + 2)
        for bit in range(8):
            sums = np.add.reduceat((x >> np.uint64(bit)) & _LOW, starts)
            votes[:, lane, :, bit] = np.add.reduceat(sums.view(np.uint8).reshape(-1, 8), of_set, axis=0, dtype=np.int64)
    return votes.reshape(len(sets), LANES, BITS), n


def described(rows: DataFrame) -> DataFrame:
    """(key, doc_id, digest of the words, sketch, mask) of rows (key, doc_id, text)."""
    small_batches(rows.sparkSession)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for batch in source:
            digests, sketch, mask = sketcher.sketch(texts_of(batch))
            made = [pa.array(x, pa.binary()) for x in (digests, [s.tobytes() for s in sketch], [m.tobytes() for m in mask])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), *made], names=["key", "doc_id", "digest", "sketch", "mask"])

    return rows.select("key", "doc_id", "text").mapInArrow(run, "key binary, doc_id long, digest binary, sketch binary, mask binary")


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(len(column), -1)


def _columns(more: list[str], lanes: tuple[int, ...], masks: bool) -> list[str]:
    return ["key", "node", *more, *(f"s{lane}" for lane in lanes), *(f"m{lane}" for lane in lanes if masks)]


def _keyed(source: Iterator[pa.RecordBatch], more: list[str], lanes: tuple[int, ...], masks: bool, indexed: int) -> Iterator[pa.RecordBatch]:
    """The variants of `indexed` lanes of nodes (node, sketch, mask and `more`), each with the node, those columns, some lanes and the mask."""
    for batch in source:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            sketch, mask = _words(part.column("sketch")), _words(part.column("mask"))
            chosen = np.unpackbits(mask.view(np.uint8), axis=1, bitorder="little").astype(bool)[:, : indexed * BITS]
            at = np.nonzero(chosen)[0]
            arrays = [pa.array(variants(sketch[:, :indexed], CUTS)[chosen].view(np.int64)), *(part.column(c).take(pa.array(at)) for c in ("node", *more))]
            arrays += [pa.array(sketch[at, lane].view(np.int64)) for lane in lanes]
            arrays += [pa.array(mask[at, lane].view(np.int64)) for lane in lanes if masks]
            yield pa.RecordBatch.from_arrays(arrays, names=_columns(more, lanes, masks))


def _runs(source: Iterator[pa.RecordBatch], more: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Whole runs of equal keys, some at a time: their keys, nodes, `more` columns and the rest as fingerprints."""

    def split(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)]
        return *columns[: 2 + more], np.stack(columns[2 + more :], 1).view(np.uint64)

    return whole_runs(map(split, source), 100_000)


def _sizes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1])
    return starts, np.diff(np.concatenate([starts, [len(key)]]))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64)


class _Best:
    """The closest partner of each node so far; what was put out may come again, only with a closer one."""

    def __init__(self):
        self.of: dict[int, tuple[int, int]] = {}

    def add(self, a: np.ndarray, b: np.ndarray, far: np.ndarray) -> None:
        of = self.of
        for x, y, d in zip(a.tolist(), b.tolist(), far.tolist()):
            if y not in of or (d, x) < of[y]:
                of[y] = (d, x)

    def out(self) -> Iterator[pa.RecordBatch]:
        rows = [(a, b, far) for b, (far, a) in self.of.items()]
        for k in range(0, len(rows), 10_000):
            a, b, far = zip(*rows[k : k + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(far, pa.int32())], names=["a", "b", "far"])
        self.of = {}


def _closest(sketch: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, which of those up to two blocks before is closest, and how far it is."""
    at, far = np.zeros(len(sketch), np.int64), np.full(len(sketch), BITS * LANES)
    for k in range(0, len(sketch), BLOCK):
        first = max(0, k - BLOCK)
        mine, others = sketch[k : k + BLOCK], sketch[first : k + BLOCK]
        d = _distance(mine[:, None], others[None])
        d[np.arange(len(others))[None] >= (k - first) + np.arange(len(mine))[:, None]] = BITS * LANES
        best = d.argmin(1)
        at[k : k + BLOCK], far[k : k + BLOCK] = best + first, d[np.arange(len(mine)), best]
    return at, far


def _first_round(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, far): one of the closest to b of what b meets; b itself, where it may be a candidate of others only."""
    best = _Best()
    for key, node, sketch in _runs(source, 0):
        starts, sizes = _sizes(key)
        size_of = np.repeat(sizes, sizes)
        for shift in range(1, SMALL):
            same = np.flatnonzero((key[shift:] == key[:-shift]) & (size_of[shift:] <= SMALL))
            d = _distance(sketch[same], sketch[same + shift])
            same, d = same[d <= MOST_TRAVEL], d[d <= MOST_TRAVEL]
            best.add(node[same], node[same + shift], d)
            best.add(node[same + shift], node[same], d)
        for k in np.flatnonzero(sizes > SMALL).tolist():
            at = np.arange(starts[k], starts[k] + sizes[k])
            close, far = _closest(sketch[at])
            met = far <= MOST_TRAVEL
            best.add(node[at], node[at], np.full(len(at), BITS * LANES))  # not all of a large run are compared here
            best.add(node[at[close[met]]], node[at[met]], far[met])
        if len(best.of) > 200_000:
            yield from best.out()
    yield from best.out()


def first_shared(differing: np.ndarray, weak: np.ndarray) -> np.ndarray:
    """The place of the first variant that pairs share (-1 if none), by their differing bits and the bits both leave out."""
    shared = np.zeros_like(weak)
    for first, bits in segments(CUTS):
        part = np.uint64(((1 << bits) - 1) << first)
        inside = differing & part
        count = np.bitwise_count(inside)
        shared |= np.where(count == 0, weak & part, np.where(count == 1, weak & inside, np.uint64(0)))
    lane = (shared != 0).argmax(1)
    word = shared[np.arange(len(shared)), lane]
    with np.errstate(over="ignore"):
        low = np.bitwise_count((word & -word) - np.uint64(1)).astype(np.int64)
    return np.where(word != 0, lane * BITS + low, -1)


def _crossing(source: Iterator[pa.RecordBatch], closest: bool) -> Iterator[pa.RecordBatch]:
    """(a, b, far): candidates in runs of equal keys that no path connects yet, each once, or only the closest to each."""
    best = _Best()
    for key, node, root, n, common, words in _runs(source, 3):
        found = []
        sketch, mask, place = words[:, :LANES], words[:, LANES:], key >> TAG

        def met(a: np.ndarray, b: np.ndarray) -> None:
            # texts have no more in common than either shares with any other text
            near = (root[a] != root[b]) & ((OF + SHARED) * np.minimum(common[a], common[b]) >= SHARED * (n[a] + n[b]))
            a, b = a[near], b[near]
            far = _distance(sketch[a], sketch[b])
            a, b, far = a[far <= MOST_ALL], b[far <= MOST_ALL], far[far <= MOST_ALL]
            if closest:
                best.add(node[a], node[b], far)
                best.add(node[b], node[a], far)
                return
            once = first_shared(sketch[a] ^ sketch[b], mask[a] & mask[b]) == place[a]
            found.append(np.stack([node[a[once]], node[b[once]], far[once]], 1))

        starts, sizes = _sizes(key)
        size_of = np.repeat(sizes, sizes)
        for shift in range(1, SMALL):
            same = np.flatnonzero((key[shift:] == key[:-shift]) & (size_of[shift:] <= SMALL))
            met(same, same + shift)
        for k in np.flatnonzero(sizes > SMALL).tolist():
            at = np.arange(starts[k], starts[k] + sizes[k])
            # the largest part comes last, so that only the texts outside it are compared with all after them
            _, part, count = np.unique(root[at], return_inverse=True, return_counts=True)
            at = at[np.lexsort((part, count[part]))]
            for j in range(len(at) - int(count.max())):
                met(np.repeat(at[j], len(at) - j - 1), at[j + 1 :])
        if len(best.of) > 200_000:
            yield from best.out()
        made = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        if len(made):
            a, b = made[:, :2].min(1), made[:, :2].max(1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(made[:, 2], pa.int32())], names=["a", "b", "far"])
    yield from best.out()


def _by_variant(nodes: DataFrame, more: list[str], lanes: tuple[int, ...], masks: bool = False, indexed: int = LANES) -> DataFrame:
    """The variants of nodes, those with one key in one partition and next to each other."""
    schema = ", ".join(f"{c} long" for c in _columns(more, lanes, masks))
    dealt = nodes.select("node", *more, "sketch", "mask").mapInArrow(lambda it: _keyed(it, more, lanes, masks, indexed), schema)
    return dealt.repartition("key").sortWithinPartitions("key", "node")


def shared_shingles(texts: DataFrame) -> DataFrame:
    """(node, n, common) of texts (node, text): the number of different shingles, and of those that another text has too."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        for batch in source:
            for node, text in zip(batch.column("node").to_pylist(), texts_of(batch), strict=True):
                hashes = sketcher.hashes(text.encode().lower().split()).view(np.int64)
                for k in range(0, len(hashes), 50_000):
                    part = pa.array(hashes[k : k + 50_000])
                    yield pa.RecordBatch.from_arrays([pa.array([node] * len(part), pa.int64()), part], names=["node", "h"])

    each = texts.select("node", "text").mapInArrow(run, "node long, h long")
    # a node's number of rows is its number of shingles; of a shingle that one node has, only that node matters
    alone = each.groupBy("h").agg(F.count("*").alias("k"), F.min("node").alias("node")).where("k = 1").groupBy("node").agg(F.count("*").alias("alone"))
    sizes = each.groupBy("node").agg(F.count("*").alias("n"))
    return sizes.join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of pairs (a, b) whose texts, by texts (node, text), have similar shingle sets."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, set[bytes]] = {}

        def of(node: int, text: str | None) -> set[bytes]:
            if node not in sets:
                if len(sets) >= 32:
                    sets.pop(next(iter(sets)))
                sets[node] = shingles(text)
            return sets[node]

        for batch in source:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            keep = [similar(of(x, s), of(y, t)) for x, y, s, t in zip(a, b, ta, tb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in ("a", "b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_copies(rows: DataFrame) -> DataFrame:
    """(key, doc_id, component) of rows (key, doc_id, text), `key` naming doc_id and text: near copies share a component.

    Rows with the same words are one node. Nodes whose sets of five-word shingles have a Jaccard similarity of at least 0.8
    are linked; every candidate is decided by the sets. A component is all that links reach.

    Nodes go with a few of the closest that they meet first, and again, when they know how much of a text is in no other;
    that joins most of a large group by some pairs a text. Then all pairs that this leaves apart are looked at.
    """
    made = materialize(described(rows), "described")
    least = F.min(F.struct("key", "sketch", "mask")).alias("m")
    nodes = made.groupBy("digest").agg(least).select("digest", F.monotonically_increasing_id().alias("node"), "m.*")
    nodes = materialize(nodes, "nodes")

    def few(met: DataFrame) -> DataFrame:
        ranked = met.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct("far", "a"))), 1, FEW).alias("few"))
        pairs = ranked.select("b", F.explode("few").alias("x")).select(F.least("x.a", "b").alias("a"), F.greatest("x.a", "b").alias("b"))
        return materialize(pairs.where("a != b").distinct(), "pairs")

    def joined(roots: DataFrame, pairs: DataFrame) -> DataFrame:
        edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(pairs, texts))
        return materialize(components(edges), "roots")

    met = materialize(_by_variant(nodes, [], TRAVEL).mapInArrow(_first_round, PAIRS), "met")
    active = materialize(nodes.join(met.select(F.col("b").alias("node")).distinct(), "node").select("node", "key"), "active")
    texts = materialize(rows.join(active, "key").dropDuplicates(["key"]).select("node", "text"), "texts")
    shared = materialize(shared_shingles(texts), "shared")
    roots = materialize(components(verified(few(met), texts)), "roots")

    def crossing(closest: bool) -> DataFrame:
        open_ = nodes.join(shared, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        dealt = _by_variant(open_, ["root", "n", "common"], tuple(range(LANES)), True, FEW_LANES if closest else LANES)
        return dealt.mapInArrow(lambda it: _crossing(it, closest), PAIRS)

    roots = joined(roots, few(crossing(True)))
    roots = joined(roots, materialize(crossing(False).select("a", "b"), "pairs"))
    named = nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("component"))
    return made.select("key", "doc_id", "digest").join(materialize(named, "named"), "digest").select("key", "doc_id", "component")
