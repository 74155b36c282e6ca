"""Conversation repair against a plain search over whole edit strings, and edge cases."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from duelgrid.llm import repair
from duelgrid.llm.grammar import Grammar, best_pairs, end_state, pair_counts, terminal

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\r\x0b\x0c"
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
KEPT = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
SCHEMA = "conv_id long, turn long, role string, text string, audit string, part int"
NOTHING = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def cheapest(rows, faults):
    """(cost, audit, repaired rows), by whole strings from the end."""
    state_of = lambda s: "user" if NEXT[s] == 2 else "assistant"

    def with_inserts(ways):
        for _ in range(3):
            for s in range(4):
                if NEXT[s] in ways:
                    c, a, left = ways[NEXT[s]]
                    way = (c + 2, "I" + a, [(state_of(s), ""), *left])
                    if s not in ways or way[:2] < ways[s][:2]:
                        ways[s] = way
        return ways

    ways = with_inserts({0: (0, "", []), 3: (0, "", [])})
    for (_, role, text), fault in list(zip(rows, faults))[::-1]:
        made = defaultdict(list)
        for s in range(4):
            if s in ways:
                c, a, left = ways[s]
                made[s].append((c + 3, "D" + a, left))
            if fault in ("", "truncated"):
                cut = fault == "truncated"
                if NEXT[s] in ways:
                    c, a, left = ways[NEXT[s]]
                    made[s].append((c + 2 + cut, "R" + a, [(state_of(s), text), *left]))
                kept = KEPT.get(role[:1], {}).get(s)
                if kept in ways:
                    c, a, left = ways[kept]
                    made[s].append((c + cut, "K" + a, [(role, text), *left]))
        ways = with_inserts({s: min(w, key=lambda x: x[:2]) for s, w in made.items()})
    return ways[0]


def brute(rows):
    seen, faults = set(), []
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    for _, role, text in rows:
        words = text.rstrip(SPACE)
        faults.append("blank" if not words else "duplicate" if (role, text) in seen else "" if words[-1] in ".!?" else "truncated")
        seen.add((role, text))
    turns = {t for t, _, _ in rows if t is not None}
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, left = cheapest(rows, faults)
    counts = (faults.count(f) for f in ("blank", "duplicate", "truncated"))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in left).encode()).hexdigest())


def by_conversation(rows):
    out = defaultdict(list)
    for c, *row in rows:
        out[c].append(tuple(row[:3]))
    return out


def results(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def random_rows(seed, n):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s2", "User"]
    texts = ["Yes.", "No!", "what", "", None, " \t", "Done?\n", "x. y", "Yes. \x0b", "é。", "ok.", "fine", "A b c."]
    return [(rng.randint(0, 40), rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"t{rng.random()}.", "x", 1) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 2, 7, 2048])
def test_any_blocks_give_the_plain_result(spark, most):
    rows = random_rows(most, 900) + [(None, 1, "user", "No id.", "x", 1), (None, 2, "assistant", "None.", "x", 1)]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert results(repair.repair(frame, most=most)) == {c: brute(r) for c, r in by_conversation(rows).items()}


def damaged(rows):
    out = {c: [] for c, *_ in rows}
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (t, "user" if kind == 4 else r, "" if kind == 1 else x.translate(str.maketrans("", "", ".!?")) if kind == 2 else x)
            out[c] += [row] * (1 + (kind == 3))
    return out


def test_query_is_the_plain_result(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert results(repair.op12_conversation_repair(spark, SF)) == {c: brute(r) for c, r in damaged(rows).items()}


def test_damage_is_the_contracts(spark):
    rows = [tuple(r)[:4] for r in random_rows(9, 600)] + [(None, None, None, None)]
    got = by_conversation([tuple(r) for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()])
    want = damaged(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    assert {c: sorted(r, key=key) for c, r in got.items()} == {c: sorted(r, key=key) for c, r in want.items() if r}


def test_conversations_without_rows_and_empty_tables(spark):
    frame = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 1), (1, 1, "assistant", "Yes.", "x", 1)], SCHEMA)
    ids = spark.createDataFrame([(1,), (2,), (2,), (None,)], "conv_id long")
    assert results(repair.repair(frame, ids)) == {1: brute([(0, "user", "Hi."), (1, "assistant", "Yes.")]), 2: NOTHING, None: NOTHING}
    assert results(repair.repair(frame.limit(0))) == {}
    assert results(repair.repair(frame.limit(0), ids))[1] == NOTHING


def test_one_hot_conversation_is_dealt_over_tasks(spark):
    rng = random.Random(11)
    rows = [(5, k // 2, "user" if k % 2 else "assistant", rng.choice(["Same.", f"t{k}.", f"cut {k}", ""]), "x", 1) for k in range(6000)]
    rows += [(5, 77, "user", "Again.", "x", 1)] * 3000 + [(k, 0, "user", "Hi.", "x", 1) for k in range(6, 100)]
    frame = spark.createDataFrame(rows, SCHEMA)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as on more data than a partition holds
    made = repair.in_blocks(frame, frame.select("conv_id"), 200)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = {r.part: r.n for r in made.where("conv_id = 5").selectExpr("part", "size(roles) n").groupBy("part").agg({"n": "sum"}).toDF("part", "n").collect()}
    assert len(sizes) >= 3 and max(sizes.values()) < 6500
    assert results(repair.repair(frame, most=200))[5] == brute([r[1:4] for r in rows if r[0] == 5])


def test_repaired_turns_have_the_hash(spark):
    rows = random_rows(12, 300)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    told = results(repair.repair(frame, most=3))
    left = defaultdict(list)
    for r in sorted(repair.repaired_turns(frame, most=3).collect(), key=lambda r: (r.conv_id, r.part, r.seq, r.place)):
        left[r.conv_id].append(r)
    for c, result in told.items():
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in left[c]).encode()).hexdigest() == result[-1]
        assert "".join(r.edit for r in left[c]) == result[-2].replace("D", "")


@pytest.mark.parametrize("seed", range(4))
def test_rules_change_nothing(seed):
    rng = random.Random(seed)
    sequences = [bytes(rng.choices(range(16), weights=[9, 1, 1, 1] * 4, k=rng.randint(1, 60))) for _ in range(60)]
    rules = []
    for _ in range(6):
        known = Grammar(rules)
        counts = pair_counts((known.encode(s), 1) for s in sequences)
        rules += best_pairs(((a, b, n) for (a, b), n in counts.items()), 2, 5)
    plain, ruled = Grammar(), Grammar(rules)
    assert sum(map(len, map(ruled.encode, sequences))) < 0.8 * sum(map(len, sequences))
    for s in sequences:
        assert plain.node(s) == ruled.node(s)
        for i in range(4):
            for j in range(4):
                if plain.node(s).cost[4 * i + j] < 1 << 60:
                    assert plain.audit(s, i, j) == ruled.audit(s, i, j)
        assert end_state(plain.node(s)) == end_state(ruled.node(s))


def test_pairs_of_equal_symbols_count_without_overlaps():
    assert pair_counts([(b"\1\1\1\1\1", 2), (b"\1\2\1", 3)]) == {(1, 1): 4, (1, 2): 3, (2, 1): 3}


def test_no_two_ways_of_a_row_begin_each_other():
    for symbol in range(16):
        strings = list(terminal(symbol)[1].values())
        assert not [(a, b) for a in strings for b in strings if a != b and b.startswith(a)]
