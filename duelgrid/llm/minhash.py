"""Near-duplicates by min-max hashing: both ends under every permutation, bands of them, exact shingle similarity, components."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.llm.common import materialize, small_batches, table, texts_of
from duelgrid.llm.components import components
from duelgrid.llm.neardup import shingles, similar
from duelgrid.llm.simhash import scrambled

SHINGLE, SEED = 2, 42
#: Permutations, of each of which the least and the greatest hash are kept; values of a band; bands of minima and of maxima.
#: A pair at a similarity s shares a band with probability 1 - (1 - s**6)**42: all but three in a million at 0.8.
PERMUTATIONS, BAND = 128, 6
BANDS = PERMUTATIONS // BAND
#: One bit of every minimum and maximum travels with a row, as so many longs. Such a bit differs with probability
#: (1 - s) / 2, so that pairs at 0.8 differ in 26 of 256 on average; a candidate that differs in more than this, which is four
#: standard deviations further, is refused.
LANES, MOST = 2 * PERMUTATIONS // 64, 45
#: Closest leaders of a text that are decided first.
FEW = 4
#: Bands whose keys are searched for all pairs, once leaders have joined what they join: 99.93 % of pairs at 0.8 share one,
#: 99.999 % at 0.85. Shingles of a block of a key's rows.
CROSSING, CELL_WEIGHT = 24, 1 << 20
#: Word hashes that a worker remembers, and hashes of a set that meet all permutations at once.
MEMO, CHUNK = 150_000, 2048

#: All pairs that share a shingle, as SQL for tables that are small.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) < 2 THEN words ELSE list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) END) AS shingle FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)
), r AS (
  SELECT doc_id, doc_id AS reached FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.reached
), c AS (
  SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id
)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""

_RNG = np.random.default_rng(SEED)
_FACTORS = _RNG.integers(0, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PERMUTE = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_JOIN = _RNG.integers(0, 2**63, BAND, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SKETCH = [f"s{k}" for k in range(LANES)]


class Signer:
    """Sets of shingle hashes of texts, and what min-max hashing makes of them."""

    def __init__(self, shingle: int = SHINGLE):
        self.memo: dict[bytes, int] = {}
        self.factors = np.resize(_FACTORS, shingle) + np.uint64(2) * np.arange(shingle, dtype=np.uint64)

    def hashes(self, text: str) -> np.ndarray:
        """The distinct hashes of a text's shingles, sorted; none for a text without words."""
        import xxhash

        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        for w in set(words).difference(self.memo):
            self.memo[w] = xxhash.xxh64_intdigest(w, SEED)
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        n = max(1, len(words) - len(self.factors) + 1)
        with np.errstate(over="ignore"):
            mixed = np.full(n, len(words) if len(words) < len(self.factors) else 0, np.uint64)
            for k, factor in enumerate(self.factors):
                part = h[k : k + n] * factor
                mixed[: len(part)] += part
        if len(self.memo) > MEMO:
            self.memo = {}
        return np.unique(scrambled(mixed, 1))

    @staticmethod
    def ends(hashes: np.ndarray) -> np.ndarray:
        """The least hash under each permutation, then the greatest: one multiplication serves both."""
        low, high = np.full(PERMUTATIONS, 2**64 - 1, np.uint64), np.zeros(PERMUTATIONS, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(0, len(hashes), CHUNK):
                under = hashes[k : k + CHUNK, None] * _PERMUTE
                np.minimum(low, under.min(0), out=low)
                np.maximum(high, under.max(0), out=high)
        return np.concatenate([low, high])

    def sign(self, texts: list[str]) -> tuple[list[int], list[bytes], np.ndarray, np.ndarray]:
        """Sizes and digests of the sets, sketches (texts x LANES) and band keys (texts x 2 BANDS)."""
        sizes, digests, values = [], [], np.zeros((len(texts), 2, PERMUTATIONS), np.uint64)
        for at, text in enumerate(texts):
            hashes = self.hashes(text)
            sizes.append(len(hashes))
            digests.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
            values[at] = self.ends(hashes).reshape(2, PERMUTATIONS)
        bits = (scrambled(values, 1) & np.uint64(1)).astype(np.uint8).reshape(len(texts), 2 * PERMUTATIONS)
        sketch = np.packbits(bits, axis=1, bitorder="little").view("<u8")
        banded = values[:, :, : BANDS * BAND].reshape(len(texts), 2 * BANDS, BAND)
        with np.errstate(over="ignore"):
            keys = scrambled((banded * _JOIN).sum(2, dtype=np.uint64) + np.arange(2 * BANDS, dtype=np.uint64), 2)
        return sizes, digests, sketch, keys


def described(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(key, doc_id, n, digest, bands and the sketch) of rows (key, doc_id, text)."""
    small_batches(rows.sparkSession)
    names = ["key", "doc_id", "n", "digest", "bands", *SKETCH]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(shingle)
        for batch in source:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                sizes, digests, sketch, keys = signer.sign(texts_of(part))
                offsets = pa.array(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32))
                bands = pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))
                lanes = [pa.array(np.ascontiguousarray(sketch[:, j]).view(np.int64)) for j in range(LANES)]
                made = [part.column("key"), part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), bands, *lanes]
                yield pa.RecordBatch.from_arrays(made, names=names)

    schema = "key binary, doc_id long, n long, digest binary, bands array<long>, " + ", ".join(f"{s} long" for s in SKETCH)
    return rows.select("key", "doc_id", "text").mapInArrow(run, schema)


def described_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, members) of texts (node, text): the shingles' hashes cut to 32 bits, sorted."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(shingle)
        for batch in source:
            sets = [np.sort((signer.hashes(t) >> np.uint64(32)).astype("<u4")).tobytes() for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "members"])

    return texts.select("node", "text").mapInArrow(run, "node long, members binary")


CELL = ["key", "p", "q"]


def in_cells(apart: DataFrame, weight: int = CELL_WEIGHT) -> DataFrame:
    """Rows of apart (key, root, node, n) dealt to cells (key, p, q) so that rows of a key with different roots meet once.

    A key's rows are cut into blocks of about `weight` shingles, those of its largest root apart from the others; a cell holds
    two blocks, or one, and no cell holds two blocks of the largest root. A key of one block is one cell.
    """
    by_root = apart.groupBy("key", "root").agg(F.sum("n").alias("w"))
    by_key = by_root.groupBy("key").agg(F.max(F.struct("w", "root")).alias("top"), F.sum("w").alias("all"))
    blocks = lambda w: F.ceil(w / weight).cast("int")
    one = F.col("all") <= weight
    by_key = by_key.select(
        "key", F.col("top.root").alias("top"), F.when(one, 0).otherwise(blocks(F.col("top.w"))).alias("tops"),
        F.when(one, 1).otherwise(blocks(F.col("all") - F.col("top.w"))).alias("rest"),
    )
    dealt = apart.join(by_key, "key").withColumn("dealt", F.xxhash64("node", F.lit(1)))
    is_top = (F.col("root") == F.col("top")) & (F.col("tops") > 0)
    block = F.when(is_top, F.pmod("dealt", F.col("tops"))).otherwise(F.col("tops") + F.pmod("dealt", F.col("rest"))).cast("int")
    others = F.when(is_top, F.sequence("tops", F.col("tops") + F.col("rest") - 1)).otherwise(F.sequence(F.lit(0), F.col("tops") + F.col("rest") - 1))
    dealt = dealt.withColumn("block", block).withColumn("other", F.explode(others))
    return dealt.withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("dealt", "top", "tops", "rest", "other")


def _cell_runs(source: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of one cell after the other; rows come sorted by cell."""
    now, held = None, []
    names = [*CELL, "block", "root", "node", "bands", "members", *SKETCH]
    for batch in source:
        for row in zip(*(batch.column(c).to_pylist() for c in names)):
            if row[:3] != now:
                if len(held) > 1:
                    yield held
                now, held = row[:3], []
            held.append(row)
    if len(held) > 1:
        yield held


def _met(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): of the rows of a cell whose sets overlap enough, the closest of each row and other root."""
    for rows in _cell_runs(source):
        block, root, node = (np.array([r[k] for r in rows], np.int64) for k in (3, 4, 5))
        bands = np.array([r[6] for r in rows], np.int64)
        sets = [np.frombuffer(r[7], "<u4") for r in rows]
        n = np.array([len(s) for s in sets])
        sketch = np.array([r[8:] for r in rows], np.int64).view(np.uint64)
        at_band = int(np.flatnonzero(bands[0] == rows[0][0])[0])
        # the largest root comes last: only the rows outside it are compared with all after them
        _, part, count = np.unique(root, return_inverse=True, return_counts=True)
        order = np.lexsort((part, count[part]))
        two = rows[0][1] != rows[0][2]
        out = []
        for k in range(len(rows) - int(count.max())):
            x, after = order[k], order[k + 1 :]
            fit = (root[after] != root[x]) & (5 * np.minimum(n[after], n[x]) >= 4 * np.maximum(n[after], n[x]))
            if two:
                fit &= block[after] != block[x]
            y = after[fit]
            y = y[np.bitwise_count(sketch[y] ^ sketch[x]).sum(1, dtype=np.int64) <= MOST]
            # a pair is looked at under the first key that it shares
            y = y[~(bands[y, :at_band] == bands[x, :at_band]).any(1)]
            if not len(y):
                continue
            sizes = n[y]
            both = np.add.reduceat(_within(np.concatenate([sets[j] for j in y]), sets[x]), np.cumsum(sizes) - sizes)
            close = 9 * both >= 4 * (sizes + n[x])
            best: dict[int, tuple[float, int]] = {}
            for j, share in zip(y[close].tolist(), (both / (sizes + n[x] - both))[close].tolist()):
                best[root[j]] = max(best.get(root[j], (0.0, 0)), (share, int(node[j])))
            out += [(int(node[x]), other) for _, other in best.values()]
        if out:
            a, b = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def _within(values: np.ndarray, members: np.ndarray) -> np.ndarray:
    """1 for each of values that is among members, which are sorted, else 0."""
    at = np.searchsorted(members, values)
    at[at == len(members)] = 0
    return (members[at] == values).astype(np.int64)


def verified(pairs: DataFrame, texts: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Those of pairs (a, b) whose texts, by texts (node, text), have sets of shingles with a Jaccard similarity of at least 0.8."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, set[bytes]] = {}

        def of(node: int, text: str) -> set[bytes]:
            if node not in sets:
                if len(sets) >= 32:
                    sets.pop(next(iter(sets)))
                sets[node] = shingles(text, shingle)
            return sets[node]

        for batch in source:
            a, b, ta, tb = (batch.column(c).to_pylist() for c in ("a", "b", "ta", "tb"))
            keep = [similar(of(x, s), of(y, t)) for x, y, s, t in zip(a, b, ta, tb, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    first, second = (texts.select(F.col("node").alias(c), F.col("text").alias(f"t{c}")) for c in ("a", "b"))
    return pairs.join(first, "a").join(second, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _few(met: DataFrame) -> DataFrame:
    """The few closest pairs (a, b) of each b."""
    ranked = met.groupBy("b").agg(F.slice(F.array_sort(F.collect_set(F.struct("far", "a"))), 1, FEW).alias("few"))
    pairs = ranked.select("b", F.explode("few").alias("x")).select(F.least("x.a", "b").alias("a"), F.greatest("x.a", "b").alias("b"))
    return pairs.distinct()


def similar_nodes(nodes: DataFrame, texts_by: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(node, root) of nodes (node, key, n, bands, sketch) that have a link; texts_by (key, text) has their texts.

    Rows with an equal band key meet. First each text meets the leader of each of its keys, the least by a hash of node and
    key, and its few closest leaders are decided; that joins most of a large group by some pairs a text. Then all pairs
    with a common key, in components that differ, are looked at. Both are equi-joins over plain exchanges whose conditions
    refuse a pair before it is put out, so Spark splits a key with very many rows, and no key is held in memory.
    """
    keyed = nodes.select("node", "n", *SKETCH, F.explode("bands").alias("key"))
    lead = F.min(F.struct(F.xxhash64("node", "key").alias("order"), "node", "n", *SKETCH)).alias("lead")
    shared = materialize(keyed.groupBy("key").agg(lead, F.count("*").alias("size")).where("size > 1").drop("size"), "shared")
    # only rows that meet another one go on
    met = materialize(keyed.join(shared, "key"), "met")
    far = sum((F.bit_count(F.col(s).bitwiseXOR(F.col(f"lead.{s}"))) for s in SKETCH), F.lit(0))
    near = (F.col("node") != F.col("lead.node")) & (5 * F.least("n", "lead.n") >= 4 * F.greatest("n", "lead.n"))
    led = met.where(near).select(F.col("lead.node").alias("a"), F.col("node").alias("b"), far.alias("far")).where(F.col("far") <= MOST)
    active = met.select("node").distinct().join(nodes.select("node", "key"), "node")
    texts = materialize(texts_by.join(active, "key").dropDuplicates(["key"]).select("node", "text"), "texts")
    roots = materialize(components(verified(materialize(_few(led), "pairs"), texts, shingle)), "roots")

    rooted = met.select("key", "node", "n", *SKETCH).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted, "rooted")
    torn = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    crossing = F.array_contains(F.slice("bands", 1, CROSSING), F.col("key"))
    apart = rooted.join(torn, "key").join(nodes.select("node", "bands"), "node").where(crossing)
    apart = materialize(apart.withColumn("bands", F.slice("bands", 1, CROSSING)), "apart")
    sets = materialize(described_sets(texts.join(apart.select("node").distinct(), "node"), shingle), "sets")
    cells = in_cells(apart).join(sets, "node").select(*CELL, "block", "root", "node", "bands", "members", *SKETCH)
    pairs = cells.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(_met, "a long, b long").distinct()
    edges = roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(verified(materialize(pairs, "pairs"), texts, shingle))
    return components(edges)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document (doc_id, text).

    Documents whose sets of word shingles have a Jaccard similarity of at least 0.8 are linked: bands of min-max signatures
    find candidates, whole sets decide. component_id is the smallest doc_id that links reach, kept whether it is the
    document's own. Equal sets are one node, so a large group of copies costs one.

    A text of fewer words than a shingle has is one shingle. Null texts, empty ones and ones of white space have no set,
    n_shingles 0, and are linked with nothing, not even each other. Rows with a null doc_id are kept, and count for no
    component_id; if a group has no id at all, it is null and kept is true. Repeated rows are kept, all with one result.
    Other columns are not read. An empty table gives no rows. The whole text counts, whatever its length.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    made = materialize(described(rows, shingle), "described")
    some = made.where("n > 0")
    least = F.min(F.struct("key", "n", "bands", *SKETCH)).alias("m")
    nodes = some.groupBy("digest").agg(least, F.min("doc_id").alias("least")).select("digest", "least", F.monotonically_increasing_id().alias("node"), "m.*")
    nodes = materialize(nodes, "nodes")
    roots = materialize(similar_nodes(nodes, rows.select("key", "text"), shingle), "roots")
    rooted = nodes.select("digest", "least", "node").join(roots, "node", "left")
    of_root = rooted.where("root is not null").groupBy("root").agg(F.min("least").alias("of_root"))
    named = rooted.join(of_root, "root", "left").select("digest", F.coalesce("of_root", "least").alias("component_id"))
    linked = some.select("doc_id", "n", "digest").join(materialize(named, "named"), "digest").select("doc_id", "n", "component_id")
    out = linked.unionAll(made.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of `documents` whose sets of two-word shingles have a Jaccard similarity of at least 0.8.

    Per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id that links reach) and kept.
    """
    return near_duplicates(table(spark, sf_dir, "documents"))
