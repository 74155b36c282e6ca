"""Hard negatives against SQL over all pairs, and edge cases."""

import random
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from duelgrid.llm import blocks, hardneg
from duelgrid.llm.hardneg import Limits, hard_negatives, packed, unpacked

SF = "/root/testdata/sf0.001"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
SCHEMA = "vec_id long, label int, embedding array<double>, score string, anchor_id int"


def listed(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


def test_query_is_its_sql(spark):
    duckdb.sql(f"create or replace temp view embeddings as from '{SF}/embeddings.parquet'")
    want = duckdb.sql(hardneg.SQL).df()[NAMES]
    assert listed(hardneg.op13_hard_negatives(spark, SF)) == sorted(map(tuple, want.values.tolist()))


def brute(rows, anchors, limits=Limits()):
    """Row against row, in whole numbers of any size."""
    fits = lambda r: None not in r[:3] and all(x is not None and np.isfinite(x) for x in r[2])
    whole = lambda v: [int(np.floor(256 * x)) for x in v]
    used = [(i, label, whole(v)) for i, label, v in rows if fits((i, label, v))]
    first = {}
    for i, label, v in sorted((r for r in anchors if fits(r)), key=lambda r: (r[0], r[1], r[2])):
        first.setdefault(i, (label, whole(v)))
    out = []
    for anchor, (label, v) in first.items():
        scored = sorted(((max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(v, w)))), i, other == label) for i, other, w in used if i != anchor), key=lambda x: (-x[0], x[1]))
        for p, positive, _ in [x for x in scored if x[2]][: limits.positives]:
            fit = [x for x in scored if not x[2] and limits.low * p <= 100 * x[0] <= limits.high * p]
            out += [(anchor, positive, k + 1, i, p, n) for k, (n, i, _) in enumerate(fit[: limits.negatives])]
    return sorted(out)


def test_random_rows_with_ties_repeats_and_odd_vectors(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        vector = [rng.randint(-3, 6) / 4 for _ in range(rng.choice((2, 3, 3, 3)))]
        rows.append((rng.choice((i, i, i - 1)), rng.randint(0, 3), vector))
    rows += rows[:30]
    rows += [(None, 1, [1.0]), (900, None, [1.0]), (901, 1, None), (902, 1, [None, 1.0]), (903, 1, [float("nan")]), (904, 1, [float("inf")]), (905, 1, []), (-5, 2, [0.0, 0.0])]
    rows += [(906, 1, [1e300, 1.0]), (907, 2, [1e20, 2.0]), (908, 1, [-0.001, 3.0])]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA).repartition(5)
    chosen = [r for r in rows if r[0] is None or r[0] % 9 == 0 or r[0] > 900]
    anchors = spark.createDataFrame([(*r, "x", 3) for r in chosen], SCHEMA)
    assert listed(hard_negatives(frame, anchors)) == brute(rows, chosen)
    other = Limits(2, 4, 20, 100)
    assert listed(hard_negatives(frame, anchors, other)) == brute(rows, chosen, other)


def test_a_hot_vector_and_a_hot_label(spark):
    rows = [(k, 0 if k % 3 else 1, [1.0, 0.5]) for k in range(900)] + [(k, 2, [0.7, 0.2]) for k in range(900, 1400)]
    frame = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA)
    chosen = [r for r in rows if r[0] % 50 == 0]
    assert listed(hard_negatives(frame, frame.where("vec_id % 50 = 0"))) == brute(rows, chosen)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    some = spark.createDataFrame([(1, 1, [1.0], "x", 3)], SCHEMA)
    for a, b in ((none, none), (some, none), (none, some), (some, some)):
        assert hard_negatives(a, b).collect() == []


def test_packed_keys_sort_by_anchor_descending_score_and_id():
    rng = random.Random(7)
    edge = [-(2**63), -1, 0, 1, 2**63 - 1]
    rows = [(rng.choice(edge), rng.choice(edge), rng.randint(0, 1), rng.choice(edge)) for _ in range(300)]
    a, s, n, i = (np.array(c, np.int64) for c in zip(*rows))
    keys = packed(a, s, n.astype(np.uint8), i).to_pylist()
    assert list(zip(*unpacked(keys))) == rows
    assert [r for _, r in sorted(zip(keys, rows), key=lambda x: x[0])] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))


def test_blocks_hold_each_row_once_within_their_bounds(spark):
    rows = [(k, k % 3, [float(k)] * (k % 7)) for k in range(1000)]
    made = blocks.in_blocks(spark.createDataFrame(rows, "vec_id long, label long, embedding array<double>"), 256, 64, 1 << 10, "t").collect()
    assert sorted(i for b in made for i in b.ids) == list(range(1000))
    assert all(b.rows <= 64 for b in made) and len({b.block for b in made}) == len(made)


@pytest.mark.parametrize("k", [1, 3, 50])
def test_best_takes_ties_by_id(k):
    rng = np.random.default_rng(k)
    scores, ids = rng.integers(0, 4, 40), rng.permutation(40)
    want = sorted(range(40), key=lambda x: (-scores[x], ids[x]))[:k]
    assert blocks.best(scores, ids, k).tolist() == want


def test_secondary_sort_streams_across_batches():
    rows = [(1, 100, 0, 9), (1, 95, 1, 1), (1, 60, 0, 8), (1, 57, 1, 2), (1, 50, 1, 3), (1, 50, 1, 4), (1, 30, 1, 5), (2, 10, 1, 6), (2, 0, 0, 7), (2, 0, 1, 8)]
    a, s, n, i = (np.array(c, np.int64) for c in zip(*rows))
    import pyarrow as pa

    keys = packed(a, s, n.astype(np.uint8), i)
    found = defaultdict(list)
    for size in (1, 3, 10):
        parts = [pa.RecordBatch.from_arrays([keys.slice(k, size)], names=["key"]) for k in range(0, len(rows), size)]
        for b in hardneg._mined(iter(parts), Limits()):
            found[size] += [tuple(r.values()) for r in b.to_pylist()]
    assert found[1] == found[3] == found[10]
    assert sorted(found[1]) == [(1, 8, 1, 2, 60, 57), (1, 8, 2, 3, 60, 50), (1, 8, 3, 4, 60, 50), (1, 9, 1, 1, 100, 95), (1, 9, 2, 2, 100, 57), (1, 9, 3, 3, 100, 50), (2, 7, 1, 8, 0, 0)]
