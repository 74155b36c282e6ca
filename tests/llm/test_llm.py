"""The training-data operators against brute-force versions, and on edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from duelgrid.llm import common, decontam, hmm, langid, markov, neardup, packing, quality, registry, simhash, suffixdedup, tokenbin, tokencount, topk
from duelgrid.llm.components import components
from duelgrid.llm.mergesort import Entry, common_prefix, decode_run, encode_run, merge
from duelgrid.llm.tokens import PieceCounts, WordIds, pre_tokens

SF = "/root/testdata/sf0.001"
PIECES = ["a", "the", " ", "  ", "\n", "\t", "é", "é", "'s", "don't", "<|endoftext|>", "<s>", "▁", "İ,", "क़", "ß", "\x1c", "22", "!!", "Word.", "中", "😀"]
ODD = [None, "", " ", "\n\n", "12 34", "x" * 5000, "the the the", "the the the", "ab cd " * 3000]


def odd_texts(n=300):
    rng = random.Random(1)
    return ODD + ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def frame(spark, texts, ids=None, parts=3):
    rows = [(k if ids is None else ids[k], t, "clash", "x") for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, score string").repartition(parts)


@pytest.fixture(scope="module")
def docs():
    return {d: (t or "") for d, t in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()}


@pytest.fixture(scope="module")
def library():
    return WordIds().library


def ids_of(library, text, end):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, end], "<u4")


def test_word_ids_are_the_librarys(library):
    texts = [t or "" for t in odd_texts(4000)]
    mine = WordIds()
    got = [x for k in range(0, len(texts), 500) for x in mine.encode(texts[k : k + 500])]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_piece_counts_add_up():
    counts = PieceCounts()
    for t in map(lambda t: t or "", odd_texts(4000)):
        units, lines = pre_tokens(t)
        assert sum(counts.count(units)) + lines * counts.line_end == len(counts.library.encode(t)), t


def check_packing(library, texts_by_id, rows):
    seen, sequences, padding = defaultdict(list), defaultdict(list), 0
    for r in rows:
        full = ids_of(library, texts_by_id[r.doc_id], packing.END_ID)
        assert r.doc_tokens == len(full) and r.ids_crc32 == zlib.crc32(full[r.start : r.start + r.length].tobytes())
        seen[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length, r.sequence_length))
    assert set(seen) == set(texts_by_id)
    for k, spans in seen.items():
        at = 0
        for start, n in sorted(spans):
            assert start == at and n > 0
            at += n
        assert at == len(ids_of(library, texts_by_id[k], 2))
    for spans in sequences.values():
        at = 0
        for offset, n, _ in sorted(spans):
            assert offset == at
            at += n
        assert at == spans[0][2] <= packing.WINDOW
        padding += packing.WINDOW - at if at & (at - 1) else 0
    return padding


def test_packing(spark, docs, library):
    assert check_packing(library, docs, packing.op1_packing(spark, SF).collect()) == 0


def test_packing_odd(spark, library):
    texts = odd_texts() + ["the quick fox " * 5000]
    assert check_packing(library, dict(enumerate(texts)), packing.pack(frame(spark, texts)).collect()) == 0
    assert packing.pack(frame(spark, ["a"]).limit(0)).count() == 0
    two = packing.pack(frame(spark, ["same", "same", None], [None, None, 3]), with_ids=True).collect()
    assert len(two) == 3 and sum(r.doc_id is None for r in two) == 2 and all(len(r.ids) == r.length for r in two)


@pytest.mark.parametrize("lengths", [[], [1], [4096], [4097] * 3, [2048] * 5, [5000, 1, 4095, 100, 3996] * 7, list(range(1, 400)) * 4])
def test_pack_block(lengths):
    got = packing.pack_block(lengths)
    held = Counter()
    for s in got:
        total = sum(n for _, _, n in s)
        assert 0 < total <= 4096 and (total == 4096 or total & (total - 1) == 0)
        for k, _, n in s:
            held[k] += n
    assert held == Counter(dict(enumerate(lengths)))


def test_repeat_counts_solve_the_histogram():
    h = np.zeros(4097, int)
    h[[1000, 3096, 1365, 1366, 500, 1024]] = [30, 30, 40, 20, 7, 8]
    combos = packing.combinations(h, 4096)
    x = packing.repeat_counts(combos, h)
    a = np.zeros((4097, len(combos)))
    for k, c in enumerate(combos.tolist()):
        for n in filter(None, c):
            a[n, k] += 1
    slope = a.T @ (a @ x - h)  # of half the squared error: zero where a count is positive, not negative elsewhere
    assert (x >= 0).all() and (slope > -0.05).all() and abs(slope[x > 0.01]).max() < 0.05


def test_token_files(spark, docs, library):
    at = 0
    for r in sorted(tokenbin.op7_token_binary(spark, SF).collect()):
        full = ids_of(library, docs[r.doc_id], tokenbin.END_ID)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(full), zlib.crc32(full.tobytes()))
        at += len(full)


def test_token_files_odd(spark, library, tmp_path):
    texts = odd_texts(60)
    tokenbin.write_tokens(frame(spark, texts, [None, *range(1, len(texts) - 1), 5]), f"{tmp_path}/t")
    got = tokenbin.read_tokens(spark, f"{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, *sorted([*range(1, len(texts) - 1), 5])]
    ends = np.cumsum([r.n_tokens for r in got])
    assert [r.start for r in got] == [0, *ends[:-1]] and ends[-1] == sum(len(ids_of(library, t, 1)) for t in texts)
    block = spark.read.parquet(f"{tmp_path}/t/blocks").where("first_doc <= 7 and last_doc >= 7").head()
    raw = bytes(spark.read.parquet(f"{tmp_path}/t/dictionary").head().dictionary)
    place = [e[0] for e in np.frombuffer(bytes(block["index"]), tokenbin.ENTRY).tolist()].index(7)
    assert tokenbin.read_frame(bytes(block["index"]), bytes(block.frames), raw, place).tolist() == ids_of(library, texts[7], 1).tolist()
    tokenbin.write_tokens(frame(spark, ["a"]).limit(0), f"{tmp_path}/none")
    assert tokenbin.read_tokens(spark, f"{tmp_path}/none").count() == 0
    wide = np.array([1, 70_000, 5], "<u4").tobytes()
    assert tokenbin.deserialize(tokenbin.serialize(wide), 3) == wide


@pytest.mark.parametrize("most", [tokencount.HEAD_TERMS, 3, 0])
def test_token_counts(spark, most):
    library, texts = PieceCounts().library, odd_texts()
    got = tokencount.count_tokens(frame(spark, texts), limit=100, most=most).collect()
    assert len(got) == len(texts)
    for r in got:
        t = texts[r.doc_id] or ""
        n = len(library.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100)


def test_token_counts_edges(spark):
    assert tokencount.count_tokens(frame(spark, ["a"]).limit(0)).count() == 0
    assert [r.n_tokens for r in tokencount.count_tokens(frame(spark, ["a b", "a b"], [None, None])).collect()] == [2, 2]


def brute_fingerprint(text, shingle):
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + shingle]), 42) for k in range(max(1, len(w) - shingle + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def check_simhash(texts, rows, shingle=4, most=4):
    fp = {d: brute_fingerprint(t, shingle) for d, t in texts.items()}
    want = brute_components(sorted(fp), lambda a, b: (fp[a] ^ fp[b]).bit_count() <= most)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {d: (f"{fp[d]:016x}", want[d]) for d in fp}


def test_simhash(spark, docs):
    check_simhash(docs, simhash.op6_simhash(spark, SF).collect())


def test_simhash_odd(spark):
    texts = odd_texts() + ["\x0b\x0c", "A b", "a B", "a b c d", "a b c d e", "É é"]
    check_simhash(dict(enumerate(texts)), simhash.near_duplicates(frame(spark, texts)).collect())
    assert simhash.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0
    got = simhash.near_duplicates(frame(spark, ["p q", "p q", "z"], [None, 4, None])).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("4", "4"), ("None", "4"), ("None", "None")]


def test_simhash_links_connect_what_all_pairs_connect(spark):
    rng = np.random.default_rng(0)
    fps = set()
    for base in rng.integers(0, 2**63, 60):
        for _ in range(rng.integers(1, 40)):
            x = int(base)
            for b in rng.choice(64, rng.integers(0, 6), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    signed = [int(np.uint64(x).view(np.int64)) for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r.node: r.root for r in components(simhash.links(df)).collect()}
    want = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    groups = lambda label: sorted(sorted(g) for g in _grouped(fps, label).values())
    assert groups(want.get) == groups(lambda x: root.get(int(np.uint64(x).view(np.int64)), ("alone", x)))


def _grouped(items, label):
    out = defaultdict(list)
    for x in items:
        out[label(x)].append(x)
    return out


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unique_documents(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [[word() for _ in range(120)] for _ in range(20)]
    texts = [" ".join(b) for b in base] + [" ".join([*b[:60], "changed", *b[61:]]) for b in base[:10]] + [" ".join(base[0])]
    got = simhash.unique_documents(frame(spark, texts))
    assert sorted(r.doc_id for r in got.collect()) == list(range(20)) and got.columns == ["doc_id", "text", "fingerprint", "score"]


def test_unique_documents_by_exact_similarity(spark):
    """Against all pairs, at similarities around the threshold, with a bucket of many texts that are no copies."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for like in (0.7, 0.75, 0.78, 0.79, 0.8, 0.81, 0.82, 0.85, 0.9):
        for _ in range(40):
            base = [word() for _ in range(rng.randint(150, 400))]
            n = len(base) - 4
            shared = round(2 * like * n / (1 + like))
            texts += [" ".join(base), " ".join([*base[: shared + 4], *(word() for _ in range(n - shared))])]
    common = [word() for _ in range(400)]
    texts += [" ".join([*common, *(word() for _ in range(170))]) for _ in range(30)] + [" ".join([*common, str(k)]) for k in range(30)]
    runs = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    want = brute_components(range(len(texts)), lambda a, b: 5 * len(runs[a] & runs[b]) >= 4 * len(runs[a] | runs[b]))
    got = {r.doc_id for r in simhash.unique_documents(frame(spark, texts)).collect()}
    alone = {k for k, root in want.items() if k == root}
    gone = set(want) - alone
    # nothing that is no copy goes; signatures meet with a probability, which is lowest just at the threshold
    assert alone <= got and 150 < len(gone) and len(got & gone) <= 0.02 * len(gone)


def test_votes_are_those_of_the_hashes():
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**64, n, dtype=np.uint64) for n in (1, 254, 255, 256, 1000, 3)]
    votes, n = neardup._votes(sets)
    for k, s in enumerate(sets):
        for lane in (0, neardup.LANES - 1):
            x = simhash.scrambled(s, lane + 2)
            assert n[k] == len(s) and votes[k, lane].tolist() == [int((x >> np.uint64(b) & np.uint64(1)).sum()) for b in range(64)]


@pytest.mark.parametrize("size", [1, 4, 50, 10_000])
def test_runs_of_equal_keys_stay_whole(size):
    rng = np.random.default_rng(6)
    key = np.sort(rng.integers(0, 12, 300))
    parts = [(key[k : k + 7], np.arange(k, min(k + 7, 300))) for k in range(0, 300, 7)]
    got = list(simhash.whole_runs(iter(parts), size))
    assert np.concatenate([k for k, _ in got]).tolist() == key.tolist() and np.concatenate([v for _, v in got]).tolist() == list(range(300))
    seen = [set(k.tolist()) for k, _ in got]
    assert sum(map(len, seen)) == len(set().union(*seen)) and list(simhash.whole_runs(iter([]), size)) == []


def test_first_shared_variant():
    """A pair is put out where its first shared variant meets: the same place as by comparing all variants."""
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**64, (200, neardup.LANES), dtype=np.uint64)
    flip = np.packbits(rng.random((200, neardup.LANES, 64)) < 0.06, axis=2, bitorder="little").view("<u8")[:, :, 0]
    masks = [np.packbits(rng.random((200, neardup.LANES, 64)) < 0.3, axis=2, bitorder="little").view("<u8")[:, :, 0] for _ in "ab"]
    kept = [np.unpackbits(np.ascontiguousarray(m).view(np.uint8), axis=1, bitorder="little").astype(bool) for m in masks]
    same = (simhash.variants(a, neardup.CUTS) == simhash.variants(a ^ flip, neardup.CUTS)) & kept[0] & kept[1]
    want = np.where(same.any(1), same.argmax(1), -1)
    assert neardup.first_shared(flip, masks[0] & masks[1]).tolist() == want.tolist() and (want >= 0).sum() > 100


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[k : k + length] for d in data for k in range(len(d) - length + 1))
    for d in data:
        cover = np.zeros(len(d) + 1, int)
        for k in range(len(d) - length + 1):
            if count[d[k : k + length]] > 1:
                cover[k] += 1
                cover[k + length] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        rest = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(int)])) == 1)
        yield len(d), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()


def test_suffix_dedup(spark, docs):
    rows = suffixdedup.op4_suffix_dedup(spark, SF).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == dict(zip(docs, brute_repeats(docs.values(), 400)))
    assert {r.doc_id: r.n_repeated for r in rows} == {d: x[1] for d, x in zip(docs, brute_repeats(docs.values(), 200))}
    assert all(r.changed == (r.n_removed > 0) for r in rows)


@pytest.mark.parametrize(("length", "widest", "passage"), [(400, suffixdedup.WIDEST, 200), (100, 5, None), (100, 1, 64)])
def test_suffix_dedup_odd(spark, length, widest, passage):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passages = [word(rng.choice([300, 500, 900])) for _ in range(6)]
    texts = []
    for _ in range(120):
        t = word(rng.randint(0, 700))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 200)
            t += p[a : rng.randint(a, len(p))] + word(rng.choice([0, 1, 5, 100]))
        texts.append(t)
    texts += ["ab " * 500, "ab " * 133, "be " * 3000, "x" * 401, "x" * 400, None, "", texts[5], texts[5][:450], texts[7] + texts[5]]
    rows = suffixdedup.remove_repeats(frame(spark, texts, parts=5), length, widest, passage).collect()
    assert {r.doc_id: tuple(r)[1:5] for r in rows} == dict(enumerate(brute_repeats(texts, length)))
    assert {r.doc_id: r.n_repeated for r in rows} == {d: x[1] for d, x in enumerate(brute_repeats(texts, passage or length))}


@pytest.mark.parametrize("turned", [0, 1])
def test_surroundings_of_one_anchor(turned):
    """Pairs, all at each distance, and a plain comparison of windows agree; turned entries count from the other side."""
    rng, length = random.Random(turned), 12
    for n in (2, 5, 20, 60, 300):
        made = []
        for k in range(n):
            key = bytes([1] * 7 + [turned]) + bytes(rng.choice(b"ab") for _ in range(rng.randint(1, length)))
            made.append((key, bytes(rng.choice(b"ab") for _ in range(rng.randint(0, length - 1))), rng.choice([1, 1, 1, 2]), k))
        made.sort()
        group, before = [], b""
        for key, left, count, k in made:
            group.append((Entry(key, 0, left, count, 0, k), common_prefix(before, key)))
            before = key
        windows = defaultdict(list)
        for key, left, count, k in made:
            for d in range(length - (len(key) - 8), len(left) + 1):
                windows[d, left[:d], key[8 : 8 + length - d]] += [k] * count
        want = {(k, length - w[0] if turned else w[0]) for w, ks in windows.items() if len(ks) > 1 for k in ks}
        got = [(k, d) for _, k, a, b in suffixdedup.resolve(group, length) for d in range(a, b + 1)]
        assert set(got) == want and len(got) == len(want)


def test_suffix_dedup_edges(spark):
    assert suffixdedup.remove_repeats(frame(spark, ["a"]).limit(0)).count() == 0
    t = "".join(map(chr, range(200, 700)))
    got = suffixdedup.remove_repeats(frame(spark, [t, t, "z"], [None, None, 1])).collect()
    assert sorted(r.n_removed for r in got) == [0, len(t.encode()), len(t.encode())]
    kept = suffixdedup.without_repeats(frame(spark, [t + "tail", "head" + t, "z", None]).withColumn("n_chars", F.lit(7)))
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {0: ("tail", 4), 1: ("head", 4), 2: ("z", 7), 3: (None, 7)}


def test_loser_tree_merges_front_coded_runs():
    rng = random.Random(0)
    for n in (1, 2, 3, 5, 8):
        runs, everything = [], []
        for run in range(n):
            made = sorted(("".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode(), b"l", 1) for _ in range(rng.randint(0, 40)))
            coded = encode_run(made)
            runs.append(decode_run(coded["numbers"], coded["keys"], coded["lefts"], run, 0))
            everything += [m[0] for m in made]
        before, got = b"", []
        for entry, common in merge(runs):
            assert common == common_prefix(before, entry.key)
            before = entry.key
            got.append(before)
        assert got == sorted(everything)


def test_decontamination(spark, docs):
    items = duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()
    want = {(d, i) for d, t in docs.items() for i, x in items if x in t}
    assert {(r.doc_id, r.item_id) for r in decontam.op8_decontamination(spark, SF).collect()} == want


def test_decontamination_odd(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    items = [" ".join(word() for _ in range(n)) + ". " + " ".join(word() for _ in range(6)) + "." for n in (10, 30, 60, 200)]
    bench = spark.createDataFrame([(k, t, "x") for k, t in enumerate([*items, None, ""])] + [(None, "a b c", "x")], "item_id long, text string, doc_id string")
    noise = [" ".join(word() for _ in range(500)) for _ in range(8)]
    texts = [n + " " + i.upper() + " " + n for n, i in zip(noise, items)] + noise[4:] + [None, "", items[0], items[2][:40]]
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(frame(spark, texts), bench).collect()}
    assert got == {(0, 0), (1, 1), (2, 2), (3, 3), (10, 0)}
    left = decontam.without_leaks(frame(spark, texts), bench)
    assert sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 7, 8, 9, 11] and left.columns[2] == "fingerprint"
    assert decontam.find_leaks(frame(spark, texts), bench.limit(0)).count() == 0
    assert decontam.without_leaks(frame(spark, texts), bench.limit(0)).count() == len(texts)
    assert decontam.find_leaks(frame(spark, texts).limit(0), bench).count() == 0


def test_scores_do_not_depend_on_the_number_of_indexes(spark):
    """And retrieval with verification finds what scoring and verifying every pair of passage and item finds."""
    rng = random.Random(7)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 500}"
    texts = [" ".join(word() for _ in range(rng.randint(10, 60))) + ". " + " ".join(word() for _ in range(6)) for _ in range(40)]
    bench = spark.createDataFrame(list(enumerate([*texts, texts[3]])) + [(3, texts[3])], "item_id long, text string")
    docs = []
    for k in range(60):
        held = rng.choice(texts).split()
        docs.append(" ".join([*(word() for _ in range(90)), *(w if rng.random() > 0.04 * (k % 4) else word() for w in held), *(word() for _ in range(70))]))
    found = []
    for most in (1000, 7):
        rows: list = []
        for index in decontam.indexes(bench, most):
            matcher = decontam.Matcher(index, 0.5, 0.8, 5)
            rows += [(d, *m) for d, ms in enumerate(matcher.match(docs)) for m in ms]
        found.append(sorted(rows))
    assert [r[:2] for r in found[0]] == [r[:2] for r in found[1]] and len(found[0]) > 20
    np.testing.assert_allclose([r[2] for r in found[0]], [r[2] for r in found[1]])
    items = [decontam.split_item(k, t) for k, t in enumerate([*texts, texts[3]])]
    bags = [Counter(i.question + i.answer) for i in items]
    df, mean = Counter(t for b in bags for t in b), np.mean([b.total() for b in bags])
    half = max(decontam.PASSAGE // 2, -(-max(b.total() for b in bags) // 2))

    def score(passage, bag):
        norm = decontam.K1 * (1 - decontam.B + decontam.B * bag.total() / mean)
        impact = {t: np.log(1 + (len(bags) - df[t] + 0.5) / (df[t] + 0.5)) * f * (decontam.K1 + 1) / (f + norm) for t, f in bag.items()}
        return sum(x for t, x in impact.items() if t in passage) / sum(impact.values())

    want = set()
    for d, text in enumerate(docs):
        words = decontam.terms_of(text)
        passages = [set(words[k : k + 2 * half]) for k in range(0, max(1, len(words) - half), half)]
        for item, bag in zip(items, bags):
            if max(score(p, bag) for p in passages) >= 0.5:
                seen = {" ".join(words[k : k + 5]) for k in range(len(words) - 4)}
                shares = [decontam.coverage(part, seen, 5) for part in (item.question, item.answer, item.question + item.answer)]
                if min(shares[:2]) >= 0.8 or shares[2] >= 0.8:
                    want.add((d, item.item_id))
    assert {r[:2] for r in found[0]} == want


def test_wand_finds_all_above_the_threshold():
    rng = random.Random(1)
    items = [decontam.Item(k, [f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(rng.randint(5, 60))], []) for k in range(150)]
    index = decontam.Index(items)
    for _ in range(200):
        query = list({*rng.sample(range(len(index.term)), 20), *(index.term[w] for w in rng.choice(items).question)})
        score = Counter()
        for t in query:
            for d, x in zip(index.docs[t], index.impacts[t]):
                score[d] += x
        for threshold in (0.05, 0.2, 0.5):
            got = dict(index.search(query, threshold))
            assert {d for d, x in score.items() if x >= threshold + 1e-9} <= set(got) <= {d for d, x in score.items() if x >= threshold - 1e-9}
            assert all(abs(score[d] - x) < 1e-9 for d, x in got.items())


def test_passage_bound_skips_no_item():
    rng = random.Random(5)
    items = [decontam.Item(k, [f"w{int(rng.paretovariate(0.5)) % 400}" for _ in range(rng.randint(8, 50))], []) for k in range(80)]
    matcher = decontam.Matcher(decontam.Index(items), 0.5, 0.8, 5)
    texts = [" ".join([f"w{rng.randint(0, 800)}" for _ in range(100)] + items[k].question + [f"w{rng.randint(0, 800)}" for _ in range(100)]) for k in range(80)]
    for k, found in enumerate(matcher.retrieve(texts)[0]):
        assert k in found


def test_language_id(spark, docs):
    lang = dict(duckdb.sql(f"select doc_id, lang from '{SF}/documents.parquet'").fetchall())
    got = langid.op3_language_id(spark, SF).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r.lang_pred == lang[r.doc_id] for r in got if r.held_out]
    assert np.mean(held) >= 0.95


def test_language_id_odd(spark):
    rows = [(k, t, lg) for k, (t, lg) in enumerate([("the cat is on the mat", "en"), ("die katze ist auf der matte", "de"), (None, "en"), ("x", None)] * 5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.with_language(frame(spark, ["the mat", "der die katzen", None, "", "12 !", "the mat"]), model).collect()}
    assert got[0][0] == "en" and got[1][0] == "de" and got[0] == got[5]
    assert got[2] == got[3] == got[4] == (langid.UNKNOWN, 0.0)
    none = langid.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert langid.with_language(frame(spark, ["abc"]), none).head().lang_pred == langid.UNKNOWN
    assert langid.with_language(frame(spark, ["abc"]).limit(0), model).count() == 0


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    label = dict(duckdb.sql(f"select doc_id, quality from '{sf}/labels.parquet'").fetchall())
    got = quality.op2_quality(spark, sf).collect()
    assert len(got) == 1000 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    held = [(r.predicted == label[r.doc_id]) for r in got if r.held_out and r.doc_id in label]
    assert np.mean(held) >= 0.95


def test_quality_odd(spark):
    rows = [(k, "good words here" if k % 2 else "BAD!! $$$ BAD!!", k % 2) for k in range(60)] + [(99, None, 1), (100, "x", None)]
    words, net = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    got = {r.doc_id: r.score for r in quality.with_quality(frame(spark, ["good words here", "BAD!! $$$ BAD!!", None, "", "good words here"]), words, net).collect()}
    assert got[0] > 0.5 > got[1] and got[0] == got[4] and got[2] == got[3] and 0 <= got[2] <= 1
    words, net = quality.fit(spark.createDataFrame([], "doc_id long, text string, quality int"))
    assert 0 <= quality.with_quality(frame(spark, ["a"]), words, net).head().score <= 1
    assert quality.with_quality(frame(spark, ["a"]).limit(0), words, net).count() == 0


def test_equal_texts_score_equally_in_any_batch(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["good", "bad", "$$$", "words", "Here!"]) for _ in range(rng.randint(0, 30))) for _ in range(97)]
    rows = [(k, t, k % 2) for k, t in enumerate(texts)]
    words, net = quality.fit(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    found = [{(r.doc_id, r.score) for r in quality.with_quality(frame(spark, texts * 2, parts=p), words, net).collect()} for p in (1, 3, 7)]
    assert found[0] == found[1] == found[2]
    score = dict(found[0])
    assert all(score[k] == score[k + 97] for k in range(97))
    # against the plain form: mean vectors, two layers, temperature
    pool = quality.Pool(words)
    for k, t in enumerate(texts[:20]):
        w, sh, extra = pool.reader.read(t)
        x = np.concatenate([words[w].mean(0) if len(w) else np.zeros(64), pool.shapes[sh].mean(0) if len(sh) else np.zeros(64), extra])
        z = np.tanh((x - net.mean) / net.spread @ net.p[0] + net.p[1]) @ net.p[2] + net.p[3][0]
        assert score[k] == pytest.approx(1 / (1 + np.exp(-z / net.temperature)), abs=1e-5)


def test_samples_do_not_vanish_at_any_size():
    for most, rows in ((2500, 10**10), (6000, 10**13), (600, 10**12), (400, 401)):
        bound = common.hash_bound(most, rows)
        assert -(2**63) <= bound < 2**63 and (bound + 2**63 + 1) / 2**64 * rows == pytest.approx(most, rel=1e-3)
    assert common.hash_bound(5, 5) == common.hash_bound(5, 0) == 2**63 - 1


def test_a_row_that_repeats_does_not_fill_a_sample(spark):
    df = spark.createDataFrame([(None, "same")] * 5000 + [(k, str(k)) for k in range(1000)], "doc_id long, text string")
    got = common.hashed_sample(df, 600)
    assert 30 < got.count() < 300 and got.count() == got.distinct().count()


def test_language_scores_by_hand(spark):
    """Known words by their log frequency, an unknown one by the mean of its longest known n-grams."""
    rows = [(k, t, lg) for k, (t, lg) in enumerate([("the cat the mat", "en"), ("die katze matte", "de")] * 3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    total = np.zeros(2)
    for w in ("the", "katzen"):
        found = [model.words[w]] if w in model.words else []
        for n in range(5, 0, -1) if not found else ():
            found = [model.tables[n][g] for g in langid.grams(w, n) if g in model.tables[n]]
            if found:
                break
        total += np.mean([model.matrix[r] for r in found], axis=0)
    p = np.exp(total - total.max())
    got = langid.with_language(frame(spark, ["the KATZEN!"]), model).head()
    assert (got.lang_pred, got.score) == (model.languages[int(p.argmax())], pytest.approx(p.max() / p.sum(), rel=1e-5))


def test_labels_that_disagree_teach_nothing(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"text {k}") for k in range(30)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(k, k % 2) for k in range(0, 30)] + [(k, k % 2) for k in range(10)] + [(k, 1 - k % 2) for k in range(20, 30)] + [(0, None)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = []
    monkeypatch.setattr(quality, "fit", lambda df: seen.append(df.select("doc_id", "quality").collect()) or (np.zeros((quality.WORDS, 64), np.float32), quality.Network(np.zeros((0, 132)), np.zeros(0))))
    assert quality.op2_quality(spark, str(tmp_path)).count() == 30
    assert sorted(seen[0]) == [(k, k % 2) for k in range(20) if zlib.crc32(str(k).encode()) % 3 != 1]


def brute_top(vectors, k):
    rows = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in rows:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return sorted(out)


def test_top_k(spark):
    duck = duckdb.connect()
    duck.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    got = sorted(tuple(r) for r in topk.op9_topk_search(spark, SF).collect())
    assert got == sorted(duck.sql(topk.SQL).fetchall()) and registry.llm_sql()["op9_topk_search"] == topk.SQL


def test_top_k_odd(spark):
    rng = np.random.default_rng(0)
    vectors = [(k, [float(np.float32(x)) for x in rng.normal(size=5).round(1)]) for k in range(300)]
    vectors += [(400, None), (401, [None, 1.0]), (402, [float("nan"), 1.0]), (403, [float("inf")]), (404, []), (500, [1e5, -1e5]), (None, [1.0]), (405, [2.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").withColumn("score", F.lit(1)).repartition(4)
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), rows=64, asked=2).collect())
    assert got == brute_top(vectors, 10)
    few = df.where("vec_id < 4 or vec_id = 100")
    assert topk.top_k(few, few.where("vec_id % 100 = 0")).count() == 8
    assert topk.top_k(df.limit(0), df.where("vec_id % 100 = 0")).count() == 0 == topk.top_k(df, df.limit(0)).count()


def test_top_k_repeated_ids_and_huge_components(spark):
    big = 1e30
    vectors = [(100, [1.0, 0.0]), (100, [None, 1.0]), (100, [0.0, 2.0]), (1, [3.0, 4.0]), (2, [big, 0.0]), (3, [-big, 5.0]), (200, [big, -1.0]), (4, [2.0**31, 0.5]), (5, [7.0, 8.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect())
    whole = lambda v: [int(x) * 1024 for x in v]
    clamp = lambda x: max(-(2**63), min(2**63 - 1, x))
    want = []
    for q, a in ((100, [0.0, 2.0]), (200, [big, -1.0])):
        for i, b in vectors:
            if i != q and None not in b:
                # a fraction below one is kept by the floor of 1024 times it
                b = [int(np.floor(1024 * x)) if abs(x) < 2**40 else 1024 * int(x) for x in b]
                want.append((q, i, clamp(sum(x * y for x, y in zip(whole(a), b)))))
    assert got == sorted(want)


def test_top_k_repeated_query_ids_agree_with_the_sql(spark):
    rows = [(100, [0.5, 1.0]), (100, [0.25, 4.0]), (100, [0.25, 3.0]), (1, [1.0, 1.0]), (1, [1.0, 2.0]), (7, [float("nan"), 1.0]), (9, [0.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    duck = duckdb.connect()
    duck.sql("create table embeddings (vec_id bigint, embedding double[])")
    duck.executemany("insert into embeddings values (?, ?)", rows)
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect()) == sorted(duck.sql(topk.SQL).fetchall())


def test_hmm(spark):
    sf = "/root/testdata/sf0.01"
    docs = {d: (t or "").encode().lower().split() + [b""] for d, t in duckdb.sql(f"select doc_id, text from '{sf}/documents.parquet'").fetchall()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    count = Counter(t for d, ts in docs.items() if not held[d] for t in ts)
    n, v, gain = sum(count.values()), len(count), []
    got = hmm.op10_hmm_scoring(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        base = sum(np.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in docs[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(docs[r.doc_id]), sum(count[t] > 0 for t in docs[r.doc_id]), n)
        assert r.base_score == pytest.approx(base)
        if r.held_out:
            gain.append(r.score - r.base_score)
    assert np.mean(np.array(gain) > 0) > 0.95


class Counted(dict):
    """A dictionary that counts what it is asked."""

    asked = 0

    def get(self, *a):
        self.asked += 1
        return super().get(*a)

    def __getitem__(self, key):
        self.asked += 1
        return super().__getitem__(key)


def test_a_chunk_is_looked_up_once_a_place():
    ids = WordIds()
    ids.memo = Counted(ids.memo)
    text = "alpha beta, Gamma " * 1000
    [got] = ids.encode([text])
    assert ids.memo.asked <= 3001 + 20
    assert np.frombuffer(got, "<u4").tolist() == ids.library.encode(text, add_special_tokens=False).ids


def test_count_table_goes_once_pieces_are_written(spark, monkeypatch):
    made, counted = [], tokencount.count_terms
    monkeypatch.setattr(tokencount, "count_terms", lambda *a: made.append(counted(*a)) or made[-1])
    out = tokencount.count_tokens(frame(spark, ["one two two", None, "two\nthree"]))
    folder = Path(made[0].inputFiles()[0].removeprefix("file:")).parent
    assert not folder.exists()
    assert sorted(r.doc_id for r in out.collect()) == [0, 1, 2]


def brute_expectation(model, s):
    """Starts, moves, emissions and log likelihood of one sequence, a step at a time."""
    k, n = len(model.start), len(s)
    alpha, scale = np.zeros((n, k)), np.zeros(n)
    moves, emitted, start, back = np.zeros((k, k)), np.zeros_like(model.emit), np.zeros(k), np.ones(k)
    for t in range(n):
        alpha[t] = (alpha[t - 1] @ model.move if t else model.start) * model.emit[s[t]]
        scale[t] = alpha[t].sum()
        alpha[t] /= scale[t]
    for t in range(n - 1, -1, -1):
        emitted[s[t]] += alpha[t] * back
        if t:
            moves += np.outer(alpha[t - 1], model.emit[s[t]] * back / scale[t]) * model.move
        else:
            start = alpha[0] * back
        back = model.move @ (model.emit[s[t]] * back) / scale[t]
    return start, moves, emitted, np.log(scale).sum()


def brute_sum(model, sequences):
    return [sum(x) for x in zip(*(brute_expectation(model, s) for s in sequences))]


def random_model(rng, size):
    emit, move, start = rng.random((size, hmm.STATES)), rng.random((hmm.STATES, hmm.STATES)), rng.random(hmm.STATES)
    return hmm.Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))


@pytest.mark.parametrize("steps", [3, 16, 2048])
def test_recursions_are_exact_at_any_length(steps):
    """Sequences cut into lanes of any length give what one step after the other gives."""
    rng = np.random.default_rng(0)
    model = random_model(rng, 6)
    sequences = [rng.integers(0, 6, n) for n in (1, 5, 0, 9, 16, 17, 200, 33, 3)]
    *counts, log = brute_sum(model, sequences)
    got, found = markov.expectation(model, sequences, steps)
    for x, y in zip([*got, found], [*counts, log], strict=True):
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-12)
    want = [brute_expectation(model, s)[3] / np.log(10) for s in sequences]
    np.testing.assert_allclose(markov.log10_likelihoods(model, sequences, steps), want, rtol=1e-9)
    assert markov.log10_likelihoods(model, [], steps).tolist() == []


def test_short_sequences_advance_together(monkeypatch):
    """A step takes all sequences that are not over, so there are as many steps as the longest one has, and rare symbols keep their scale."""
    rng, model = np.random.default_rng(4), random_model(np.random.default_rng(5), 6)
    model.emit[3] = 1e-30
    sequences = [rng.integers(0, 6, n) for n in range(1, 41) for _ in range(20)] + [np.full(60, 3)]
    calls, product = [], np.matmul
    monkeypatch.setattr(np, "matmul", lambda *a, **k: calls.append(1) or product(*a, **k))
    got = markov.log10_likelihoods(model, sequences)
    assert len(calls) == 60
    monkeypatch.undo()
    np.testing.assert_allclose(got, [brute_expectation(model, s)[3] / np.log(10) for s in sequences], rtol=1e-9)
    *counts, log = brute_sum(model, sequences)
    found, total = markov.expectation(model, sequences)
    for x, y in zip([*found, total], [*counts, log], strict=True):
        np.testing.assert_allclose(x, y, rtol=1e-9, atol=1e-12)


def test_rare_tokens_alone_are_looked_at_one_by_one(spark, monkeypatch):
    """Classes of frequent tokens are found once a model, not once an occurrence; scores are those without any frequent token."""
    calls, of = [], hmm.Symbols.class_of
    monkeypatch.setattr(hmm.Symbols, "class_of", lambda self, t: calls.append(t) or of(self, t))
    counted = {b"a": 5, b"b": 3, b"c": 2}
    symbols, classes = hmm.Symbols([b"a"]), np.tile([5.0, 2.0], (hmm.CLASSES, 1))
    model = random_model(np.random.default_rng(6), symbols.size)
    schema = hmm.to_arrow_schema(hmm.StructType.fromDDL(hmm.ROWS))
    batch = pa.RecordBatch.from_pydict({"doc_id": [4, None], "text": ["a b c b d " * 50, None], "held_out": [True, False]})
    shared = type("Shared", (), {"value": (symbols, model, hmm.counts_of(symbols, counted, 11, 4, classes))})
    [got] = hmm._documents(iter([batch]), shared, schema)
    assert len(calls) == 2 + 50 + 2  # b and c once, each d, the ends
    rows = got.to_pylist()
    assert [(r["doc_id"], r["held_out"], r["n_tokens"], r["known"], r["term"], r["freq"]) for r in rows if r["n_tokens"]] == [(4, True, 251, 200, b"d", 50), (None, False, 1, 0, b"", 1)]
    assert [(r["doc_id"], r["term"], r["freq"]) for r in rows if not r["n_tokens"]] == [(None, b"", 1)]
    base = 50 * np.log10(5.5) + 100 * np.log10(3.5) + 50 * np.log10(2.5) - 251 * np.log10(11 + 0.5 * 5)
    share = 100 * np.log10(3.5) + 50 * np.log10(2.5) - 201 * np.log10(5 + 0.5 * 3)
    assert rows[0]["base"] == pytest.approx(base)
    coded = symbols.encode(hmm.tokens_of("a b c b d " * 50))
    assert rows[0]["hidden"] == pytest.approx(brute_expectation(model, coded)[3] / np.log(10) + share)


SCORES: list[list[float]] = []


@pytest.mark.parametrize("most", [hmm.HEAD_TERMS, 2, 0])
def test_hmm_odd(spark, most):
    texts = ["a b c", "a b c", None, "", "new words only", "A\tb", "é É", "x " * 2000]
    df = frame(spark, texts).withColumn("held_out", F.col("doc_id") == 4)
    got = {r.doc_id: r for r in hmm.score(df, df.where("not held_out"), most).collect()}
    assert got[0].score == pytest.approx(got[1].score) and got[2].score == pytest.approx(got[3].score) and got[2].n_tokens == 1
    SCORES.append([r.score for _, r in sorted(got.items())])
    assert SCORES[0] == pytest.approx(SCORES[-1])
    assert got[4].n_known == 1 and got[7].n_tokens == 2001 and got[5].n_known == 3
    empty = hmm.score(df, df.limit(0)).collect()
    assert len(empty) == len(texts) and all(np.isfinite(r.score) and r.train_tokens == 0 for r in empty)
    assert hmm.score(df.limit(0), df).count() == 0


def test_hmm_states_come_from_all_training_documents(spark, monkeypatch):
    """Against Baum-Welch from the initial model over every token of every document, the tail of a long one included."""
    rng, made = random.Random(8), []
    texts = [" ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(rng.randint(1, 40))) for _ in range(500)] + ["aa " * 700 + "zz yy " * 900]
    train = hmm.baum_welch
    monkeypatch.setattr(hmm, "baum_welch", lambda *a, **k: made.append((train(*a, **k), a[1], a[3])) or made[-1][0])
    df = frame(spark, texts).withColumn("held_out", F.lit(False))
    scored = hmm.score(df, df).collect()
    assert len(scored) == len(texts)
    got, symbols, prior = made[0]
    sequences = [symbols.encode(hmm.tokens_of(t)) for t in texts]
    tokens = sum(map(len, sequences))
    assert prior.sum() == tokens
    model, before, gain = hmm.initial(prior), -np.inf, np.inf
    while gain >= hmm.LEAST_GAIN:
        *counts, log = brute_sum(model, sequences)
        model, gain, before = hmm.maximised(hmm.Hmm(*counts), prior), log / tokens - before, log / tokens
    for x, y in zip(got, model, strict=True):
        np.testing.assert_allclose(x, y, rtol=1e-6)
    # and the scores are those of that model, with each token's share of its class
    count = Counter(t for text in texts for t in hmm.tokens_of(text))
    own = set(symbols.own)
    in_class = defaultdict(Counter)
    for t, n in count.items():
        if t not in own:
            in_class[symbols.class_of(t)][t] = n
    for r in scored:
        words = hmm.tokens_of(texts[r.doc_id])
        share = sum(np.log10((count[t] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1))) for t in words if t not in own for c in [in_class[symbols.class_of(t)]])
        assert r.score == pytest.approx(brute_expectation(model, symbols.encode(words))[3] / np.log(10) + share, rel=1e-6)


def test_pipeline_stages(spark, docs):
    """Each stage on what its predecessor kept, against the plain form of what it decides."""
    items = [t for _, t in duckdb.sql(f"select item_id, text from '{SF}/benchmark.parquet'").fetchall()]
    now = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.materialize(stage(spark, now, SF), name)
        if name == "packing":
            check_packing(WordIds().library, {r.doc_id: r.text for r in now.collect()}, made.collect())
            break
        assert made.columns == columns
        before, seen[name], now = {r.doc_id: r.text for r in now.collect()}, {r.doc_id: r.text for r in made.collect()}, made
        after = seen[name]
        if name == "language_id":
            assert set(after) <= set(before) and len(after) >= 0.95 * len(before)
        elif name == "simhash_near_dedup":
            assert len(set(after.values())) == len(after) and all(min(d for d in before if before[d] == t) in after or t not in after.values() for t in after.values())
        elif name == "suffix_array_dedup":
            for d, (_, gone, _, _) in zip(before, brute_repeats(before.values(), corpus_pipeline.PASSAGE_BYTES)):
                assert (d not in after) if gone == len(before[d].encode()) and gone else (after[d] == before[d]) == (gone == 0)
        else:
            assert not any(i in t for t in after.values() for i in items)
            assert set(before) - set(after) == {d for d, t in before.items() if any(i in t for i in items)}


def test_pipeline_edges(spark):
    rows = [(None, None, "en", "s", 0, 1), (1, "", "en", "s", 0, 1), (2, "12", None, "s", 2, 1), (3, "the cat", "en", "s", 7, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fingerprint int")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, df, SF)
        assert made.columns == df.columns and made.count() <= 4
        assert stage(spark, df.limit(0), SF).count() == 0


def test_copies_without_an_id_of_their_own_leave_one(spark):
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(60)) for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[0]), (7, texts[1]), (7, texts[1]), (None, texts[2]), (9, texts[2]), (5, texts[3]), (6, texts[3])]
    now = frame(spark, [t for _, t in rows], [d for d, _ in rows])
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.repeated_passages):
        now = corpus_pipeline.materialize(stage(spark, now, SF), "copies")
        want = {(None, texts[0]), (7, texts[1]), (9, texts[2]), (5, texts[3])}
        assert now.count() == 4 and {(r.doc_id, r.text) for r in now.collect()} == want


def test_registry_names_every_operator():
    names = registry.llm_queries()
    assert {n.split("_")[0] for n in names} == {f"op{k}" for k in range(1, 14)} and set(registry.llm_sql()) <= set(names)
