"""Conversation structure repair: faults of rows, a grammar of fault sequences shared by all conversations, cheapest edits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelgrid.llm.common import materialize, partition_id, small_batches, table
from duelgrid.llm.grammar import BLANK, DUPLICATE, ENDS, MOST_SYMBOLS, NEXT, OK, ROLE_OF, TERMINALS, TRUNCATED, Grammar, Node, best_pairs, end_state, fault_class, joined, pair_counts

#: Rows and characters of a block: consecutive rows of one conversation.
ROWS, CHARS = 2048, 1 << 20
#: Rounds of new rules, rules of a round, and the least count of a rule's pair. They change the work, never a result.
ROUNDS, PER_ROUND, LEAST = 8, 16, 4
#: Characters of role and text by which rows of one turn are dealt out and ordered, before the whole of them.
PREFIX = 64
SPACE, STOPS = " \t\n\r\x0b\x0c", ".!?"

BLOCKS = (
    "conv_id long, part long, seq long, turns long, first_turn long, last_turn long, symbols binary, roles array<string>, texts array<string>"
)
PLACE = ["conv_id", "part", "seq"]
RESULT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
TURNS = "conv_id long, part long, seq long, place long, edit string, role string, text string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that crc32 of `conv_id:turn` gives a row, nulls as one space."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", filled("conv_id"), filled("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(filled("text"), STOPS, "")).otherwise(filled("text"))
    role = F.when(kind == 4, "user").otherwise(filled("role"))
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    return rows.select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("col")


def fault(text: str) -> int:
    """Of a row by its text alone."""
    words = text.rstrip(SPACE)
    return BLANK if not words else OK if words[-1] in STOPS else TRUNCATED


class _Block:
    """Consecutive rows of one conversation, as they come."""

    def __init__(self, conv_id: int | None, part: int, seq: int):
        self.place = (conv_id, part, seq)
        self.turns, self.first, self.last = 0, None, None
        self.symbols, self.roles, self.texts, self.chars = bytearray(), [], [], 0
        self.seen: set[tuple[str, str]] = set()

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first, self.last = turn if self.first is None else self.first, turn
        kind = fault(text)
        if kind != BLANK:
            if (role, text) in self.seen:
                kind = DUPLICATE
            self.seen.add((role, text))
        self.symbols.append(4 * fault_class(role) + kind)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text) + len(role)

    def row(self) -> tuple:
        return (*self.place, self.turns, self.first, self.last, bytes(self.symbols), self.roles, self.texts)


def _out(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()), "boolean": pa.bool_()}
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = zip(*rows) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, t in zip(columns, types)], names=list(names))


def _cut(source: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows; a conversation without a row gives a block without one."""
    part, now, started = partition_id(), None, False
    for batch in source:
        done = []
        for conv_id, turn, role, text, n in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "n"))):
            if not started or conv_id != now.place[0]:
                if started:
                    done.append(now.row())
                now, started = _Block(conv_id, part, 0), True
            for _ in range(n):
                if now.roles and (len(now.roles) >= most or now.chars + len(text) > CHARS):
                    done.append(now.row())
                    now = _Block(conv_id, part, now.place[2] + 1)
                    if len(done) >= 64:
                        yield _out(done, BLOCKS)
                        done = []
                now.add(turn, role, text)
        for k in range(0, len(done), 200):
            yield _out(done[k : k + 200], BLOCKS)
    if started:
        yield _out([now.row()], BLOCKS)


def in_blocks(rows: DataFrame, ids: DataFrame, most: int = ROWS) -> DataFrame:
    """Rows (conv_id, turn, role, text), and the conversations of ids that have none, written as blocks in order of turn.

    Equal rows are counted before any shuffle of them, and the order is a range partitioning, so a conversation of any
    size is dealt over as many tasks as its rows need.
    """
    small_batches(rows.sparkSession)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role"), filled("text"), F.lit(1).alias("n"))
    none = ids.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(None).cast("long").alias("turn"), *(F.lit(None).cast("string").alias(c) for c in ("role", "text")), F.lit(0).alias("n"))
    counted = given.unionAll(none).groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    order: list[Column] = [F.col("conv_id"), F.col("turn"), F.substring("role", 1, PREFIX), F.substring("text", 1, PREFIX)]
    dealt = counted.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text")
    return materialize(dealt.mapInArrow(lambda it: _cut(it, most), BLOCKS), "blocks")


def learn(blocks: DataFrame) -> list[tuple[int, int]]:
    """Rules of pairs by Re-Pair over the symbols of all blocks: the most frequent pairs get symbols, again and again.

    Equal sequences are counted once. A round counts pairs in tasks and adds them up; at most a byte's values squared reach
    the driver. A round takes several pairs that share no symbol, which is what taking them one by one would do.
    """
    sequences = materialize(blocks.where(F.length("symbols") > 1).groupBy("symbols").agg(F.count("*").alias("n")), "sequences")
    rules: list[tuple[int, int]] = []
    for _ in range(ROUNDS):
        known = tuple(rules)

        def count(source: Iterator[pa.RecordBatch], known: tuple = known) -> Iterator[pa.RecordBatch]:
            grammar, total = Grammar(known), None
            for batch in source:
                given = zip(map(grammar.encode, batch.column("symbols").to_pylist()), batch.column("n").to_pylist())
                total = pair_counts(given) if total is None else total + pair_counts(given)
            yield _out([(a, b, n) for (a, b), n in (total or {}).items()], "a long, b long, n long")

        counts = sequences.mapInArrow(count, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)
        room = min(PER_ROUND, MOST_SYMBOLS - TERMINALS - len(rules))
        new = best_pairs(((r.a, r.b, r.n) for r in counts.collect()), LEAST, room)
        if not new:
            break
        rules += new
    return rules


def _same(columns: list[str], left: str, right: str) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns))


def repaired_rows(symbols: bytes, audit: bytes, state: int, roles: list[str], texts: list[str], end: bytes = b"") -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what the edits leave of rows, from a state on."""
    at = 0
    for edit in (audit + end).decode():
        if edit == "I":
            yield edit, ROLE_OF[state], ""
            state = NEXT[state]
            continue
        if edit != "D":
            role = ROLE_OF[state] if edit == "R" else roles[at]
            yield edit, role, texts[at]
            state = NEXT[state] if edit == "R" else 1 if role[0] == "s" else NEXT[state]
        at += 1


class _Digest:
    """The hash of a conversation's repaired rows as they come."""

    def __init__(self):
        self.hash, self.some = hashlib.sha256(), False

    def add(self, rows: Iterator[tuple[str, str, str]]) -> _Digest:
        for _, role, text in rows:
            self.hash.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.some = True
        return self

    def hex(self) -> str:
        return self.hash.hexdigest()


def _gaps(turns: int, first: int | None, last: int | None) -> int:
    return 0 if first is None else last - first + 1 - turns


def _values(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in names))


_BLOCK = ("conv_id", "part", "seq", "turns", "first_turn", "last_turn", "symbols", "roles", "texts")


def _whole(source: Iterator[pa.RecordBatch], rules: list[tuple[int, int]], digest: bool) -> Iterator[pa.RecordBatch]:
    """Results, or repaired rows, of conversations that are one block."""
    grammar = Grammar(rules)
    for batch in source:
        out = []
        for conv_id, part, seq, turns, first, last, symbols, roles, texts in _values(batch, *_BLOCK):
            node = grammar.node(symbols) if symbols else None
            j = end_state(node)
            audit, end = grammar.audit(symbols, 0, j) if node else b"", ENDS[j][1]
            left = repaired_rows(symbols, audit, 0, roles, texts, end)
            if not digest:
                out += [(conv_id, part, seq, k, *r) for k, r in enumerate(left)]
                continue
            counts = (node.blank, node.duplicate, node.truncated, node.illegal, node.cost[j] + ENDS[j][0]) if node else (0,) * 5
            out.append((conv_id, _gaps(turns, first, last), *counts, (audit + end).decode(), _Digest().add(left).hex()))
        for k in range(0, len(out), 1000):
            yield _out(out[k : k + 1000], RESULT if digest else TURNS)


def _cross_duplicates(blocks: DataFrame) -> DataFrame:
    """Blocks of conversations of several, their symbols knowing what stood in earlier blocks."""
    schema = "conv_id long, digest binary, part long, seq long, place long"

    def told(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for conv_id, part, seq, symbols, roles, texts in _values(batch, *PLACE, "symbols", "roles", "texts"):
                rows = []
                for k, (symbol, role, text) in enumerate(zip(symbols, roles, texts)):
                    if symbol % 4 not in (BLANK, DUPLICATE):
                        # the length tells where the role ends
                        rows.append((conv_id, hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest(), part, seq, k))
                yield _out(rows, schema)

    each = materialize(blocks.select(*PLACE, "symbols", "roles", "texts").mapInArrow(told, schema), "texts")
    first = each.groupBy("conv_id", "digest").agg(F.min(F.struct("part", "seq", "place")).alias("first"), F.count("*").alias("size")).where("size > 1")
    again = each.alias("e").join(materialize(first, "firsts").alias("f"), _same(["conv_id", "digest"], "e", "f"))
    again = again.where(F.struct("e.part", "e.seq", "e.place") != F.col("f.first"))
    places = again.groupBy("e.conv_id", "e.part", "e.seq").agg(F.collect_list("e.place").alias("again"))

    def marked(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            symbols = [bytearray(s) for s in batch.column("symbols").to_pylist()]
            for s, places in zip(symbols, batch.column("again").to_pylist()):
                for k in places or ():
                    s[k] = s[k] // 4 * 4 + DUPLICATE
            at = batch.schema.get_field_index("symbols")
            yield batch.set_column(at, "symbols", pa.array(map(bytes, symbols), pa.binary())).drop_columns(["again"])

    joined_ = blocks.alias("b").join(places.alias("p"), _same(PLACE, "b", "p"), "left").select("b.*", "p.again")
    return materialize(joined_.mapInArrow(marked, BLOCKS), "marked")


_FORWARD = "conv_id long, part long, seq long, back array<long>, counts array<long>"
_BACKWARD = "conv_id long, part long, seq long, start long, stop long, counts array<long>"


def _forward(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each block for every state after it, along the cheapest way from a conversation's start.

    After a conversation's blocks a row without a place has where its edits end, its counts and its cost. All that is held
    is one node.
    """
    now = held = None

    def summary() -> tuple:
        node, turns, first, last = held
        j = end_state(node)
        counts = [0] * 5 if node is None else [node.blank, node.duplicate, node.truncated, node.illegal, node.cost[j] + ENDS[j][0]]
        return (now[0], None, None, [j], [_gaps(turns, first, last), *counts])

    for batch in source:
        out = []
        for conv_id, part, seq, turns, first, last, values in _values(batch, *PLACE, "turns", "first_turn", "last_turn", "node"):
            if now is None or now[0] != conv_id:
                if now is not None:
                    out.append(summary())
                now, held = (conv_id,), (None, 0, None, None)
            before, before_turns, before_first, before_last = held
            node, back = (Node.of(values), (0,) * 4) if values else (before, None)
            if before is not None and values:
                node, mid = joined(before, node)
                back = mid[:4]
            again = first is not None and first == before_last
            held = (node, before_turns + turns - again, first if before_first is None else before_first, before_last if last is None else last)
            out.append((conv_id, part, seq, None if back is None else list(back), None))
        yield _out(out, _FORWARD)
    if now is not None:
        yield _out([summary()], _FORWARD)


def _backward(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and after each block, from a conversation's end to its start; the last block gets the counts."""
    state, told = 0, None
    for batch in source:
        out = []
        for conv_id, part, seq, back, counts in _values(batch, *PLACE, "back", "counts"):
            if counts is not None:
                state, told = back[0], counts
                continue
            stop, state = state, state if back is None else back[state]
            out.append((conv_id, part, seq, state, stop, told))
            told = None
        yield _out(out, _BACKWARD)


_SOLVED = "conv_id long, part long, seq long, start long, counts array<long>, audit binary, end binary, symbols binary, roles array<string>, texts array<string>"


def _several(blocks: DataFrame, rules: list[tuple[int, int]]) -> DataFrame:
    """Blocks of conversations of several with their edits."""

    def noded(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in source:
            nodes = [grammar.node(s).flat() if s else None for s in batch.column("symbols").to_pylist()]
            yield batch.drop_columns(["symbols"]).append_column("node", pa.array(nodes, pa.list_(pa.int64())))

    schema = "conv_id long, part long, seq long, turns long, first_turn long, last_turn long, node array<long>"
    nodes = blocks.select(*PLACE, "turns", "first_turn", "last_turn", "symbols").mapInArrow(noded, schema)
    ways = materialize(nodes.repartition("conv_id").sortWithinPartitions(*PLACE).mapInArrow(_forward, _FORWARD), "ways")
    back = ways.repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").desc_nulls_first(), F.col("seq").desc_nulls_first())
    states = materialize(back.mapInArrow(_backward, _BACKWARD), "states")
    placed = blocks.alias("b").join(states.alias("s"), _same(PLACE, "b", "s")).select("b.*", "s.start", "s.stop", "s.counts")

    def solved(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(rules)
        for batch in source:
            for *place, symbols, roles, texts, start, stop, counts in _values(batch, *PLACE, "symbols", "roles", "texts", "start", "stop", "counts"):
                audit = grammar.audit(symbols, start, stop) if symbols else b""
                yield _out([(*place, start, counts, audit, b"" if counts is None else ENDS[stop][1], symbols, roles, texts)], _SOLVED)

    return placed.mapInArrow(solved, _SOLVED)


def _digested(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations of several blocks, a block after the other."""
    digest, audits = _Digest(), []
    for batch in source:
        for conv_id, start, counts, audit, end, symbols, roles, texts in _values(batch, "conv_id", "start", "counts", "audit", "end", "symbols", "roles", "texts"):
            digest.add(repaired_rows(symbols, audit, start, roles, texts, end))
            audits.append(audit + end)
            if counts is not None:  # the last one
                yield _out([(conv_id, *counts, b"".join(audits).decode(), digest.hex())], RESULT)
                digest, audits = _Digest(), []


def _routes(rows: DataFrame, ids: DataFrame | None, most: int) -> tuple[DataFrame, DataFrame, list[tuple[int, int]]]:
    """Conversations that are one block, blocks of the others with their edits, and the grammar's rules."""
    blocks = in_blocks(rows, rows.select("conv_id") if ids is None else ids, most)
    rules = learn(blocks)
    many = materialize(blocks.groupBy("conv_id").agg(F.count("*").alias("size")).where("size > 1").select("conv_id"), "many")
    one = blocks.alias("b").join(many.alias("m"), _same(["conv_id"], "b", "m"), "left_anti")
    several = blocks.alias("b").join(many.alias("m"), _same(["conv_id"], "b", "m"), "left_semi").select("b.*")
    return one, _several(_cross_duplicates(materialize(several, "several")), rules), rules


def repair(rows: DataFrame, ids: DataFrame | None = None, most: int = ROWS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of the conversations of rows
    (conv_id, turn, role, text) and of ids (conv_id).

    A conversation's rows go by turn, nulls first, and within a turn by role and text (their first 64 characters, then the
    whole). A row's first fault counts: blank, a duplicate (role and text stand earlier), truncated. The cheapest edits that
    leave role initials `(s?(ua)+)?` are found: K keeps a row, R makes it user or assistant (2), D deletes it (3; a must for
    blank and duplicate rows), I inserts an empty one (2), and a truncated row that stays costs 1. Among equally cheap
    audits the least as text counts. gaps are the turns missing between the first and the last; illegal counts neighbours
    whose initials are not su, ua or au.

    Faults become symbols, one a row; the most frequent pairs of all conversations become rules, again and again (Re-Pair);
    each rule's min-plus matrix is made of two others once, with what its edits are read from. A conversation is cut into
    blocks where it is long or a partition ends. One of one block, as nearly all are, is settled where it lies; the blocks of
    the others pass a forward and a backward stream of their matrices. The hash of a long conversation is one stream of
    its rows; it holds a block at a time.

    Null roles and texts count as one space, a null conv_id is a conversation, an empty role has no initial. Repeated rows
    are duplicates. A conversation of ids without rows has zeros, an empty audit and the hash of an empty text. Other
    columns are not read; an empty table gives no rows. `most` bounds the rows of a block and changes no result.
    """
    one, several, rules = _routes(rows, ids, most)
    short = one.mapInArrow(lambda it: _whole(it, rules, True), RESULT)
    long_ = several.repartition("conv_id").sortWithinPartitions(*PLACE).mapInArrow(_digested, RESULT)
    return short.unionAll(long_)


def repaired_turns(rows: DataFrame, ids: DataFrame | None = None, most: int = ROWS) -> DataFrame:
    """The rows that repair leaves, in order of (conv_id, part, seq, place): edit (K, R or I), role and text."""
    one, several, rules = _routes(rows, ids, most)

    def left(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for *place, start, audit, end, symbols, roles, texts in _values(batch, *PLACE, "start", "audit", "end", "symbols", "roles", "texts"):
                yield _out([(*place, k, *r) for k, r in enumerate(repaired_rows(symbols, audit, start, roles, texts, end))], TURNS)

    return one.mapInArrow(lambda it: _whole(it, rules, False), TURNS).unionAll(several.mapInArrow(left, TURNS))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired hash of every conversation of `conversations` after the contract's damage.

    Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.
    """
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations.select("conv_id"))
