"""Min-max hashing against all pairs of whole sets, and edge cases."""

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from duelgrid.llm import minhash
from duelgrid.llm.neardup import shingles, similar

SF = "/root/testdata/sf0.001"


def set_of(text):
    return shingles(text, 2) if (text or "").encode().split() else set()


def brute(docs, roots):
    sets = {d: set_of(t) for d, t in docs.items()}
    root = roots(docs, lambda a, b: sets[a] and sets[b] and similar(sets[a], sets[b]))
    return {d: (len(sets[d]), root[d], root[d] == d) for d in docs}


def got(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_query_is_all_pairs(spark, roots):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert got(minhash.op11_minhash(spark, SF)) == brute(docs, roots)


def test_query_is_its_sql(spark):
    duckdb.sql(f"create or replace temp view documents as from '{SF}/documents.parquet'")
    want = {d: (n, c, k) for d, n, c, k in duckdb.sql(minhash.SQL).fetchall()}
    assert got(minhash.op11_minhash(spark, SF)) == want


def variants(rng, base, n, edits):
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            words[rng.randrange(len(words))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_families_around_the_threshold(spark, roots):
    rng = random.Random(3)
    word = lambda: f"v{rng.randrange(3000)}"
    texts = []
    for size, edits in ((60, 4), (40, 9), (30, 14), (5, 1)):
        texts += variants(rng, [word() for _ in range(120)], size, edits)
    for _ in range(60):
        texts += variants(rng, [word() for _ in range(rng.randint(2, 60))], 2, 3)
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    assert got(minhash.near_duplicates(frame)) == brute(docs, roots)


def test_one_large_group_costs_no_pairs(spark):
    rng = random.Random(4)
    base = [f"v{k}" for k in range(100)]
    texts = variants(rng, base, 1500, 3) + ["same text here now"] * 1500
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = minhash.near_duplicates(frame)
    assert sorted(r["count"] for r in out.groupBy("component_id").count().collect()) == [1500, 1500]
    assert out.where("kept").count() == 2


def test_nulls_blanks_ties_and_clashing_columns(spark):
    rows = [
        (None, "a b c d", 1), (7, "a b c d", 1), (7, "a b c d", 1), (9, None, 1), (8, "", 1), (6, " \t\n", 1), (5, "One", 1), (4, "oNe", 1), (3, "one two", 1),
        (2, "x " * 40_000, 1), (1, "x x", 1), (None, "lonely words", 1), (0, "É é", 1), (-1, "é É", 1),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, `component_id` int").withColumn("a.b", F.lit(1)).withColumn("key", F.lit("k"))
    out = sorted(minhash.near_duplicates(frame).collect(), key=lambda r: (r.doc_id is None, r.doc_id or 0, r.component_id or 0))
    assert [tuple(r) for r in out] == [
        (-1, 1, -1, True), (0, 1, 0, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 0, 6, True),
        (7, 3, 7, True), (7, 3, 7, True), (8, 0, 8, True), (9, 0, 9, True), (None, 1, None, True), (None, 3, 7, False),
    ]
    assert minhash.near_duplicates(frame.limit(0)).collect() == []


@pytest.mark.parametrize("share", [0.5, 0.8, 0.9])
def test_minima_and_maxima_agree_as_often_as_sets_overlap(share):
    rng = np.random.default_rng(5)
    agree = []
    for _ in range(30):
        both = rng.integers(0, 2**63, 1200, dtype=np.uint64)
        cut = int(1200 * share)
        a, b = np.concatenate([both[:cut], both[cut::2]]), np.concatenate([both[:cut], both[cut + 1 :: 2]])
        agree.append((minhash.Signer.ends(a) == minhash.Signer.ends(b)).mean())
    assert abs(np.mean(agree) - share) < 0.02


def test_signatures_are_the_plain_ends():
    signer = minhash.Signer()
    text = " ".join(f"w{k % 700}" for k in range(5000))
    hashes = signer.hashes(text)
    assert len(hashes) == len(set_of(text))
    ends = minhash.Signer.ends(hashes)
    for k in (0, 17, 127):
        under = [int(h) * int(minhash._PERMUTE[k]) % 2**64 for h in hashes]
        assert (min(under), max(under)) == (int(ends[k]), int(ends[minhash.PERMUTATIONS + k]))
