"""Repair of role and fault sequences: Re-Pair symbols, a min-plus transfer matrix per symbol, and audits read off the matrices.

States of the grammar `(s?(ua)+)?`: nothing yet, after s, after u, after a. A symbol is one row's role initial and fault, or a
rule that stands for two symbols. The matrix of a symbol has, for each pair of states, the least cost of edits that lead from
one to the other over the symbol's rows, insertions only before a row. The strings of edits of a matrix all hold one edit a
row and end with one, so none begins another; the least of two joined strings therefore begins with the lesser first part.
And a string with its first state tells its last state, so strings to different states differ. That is why ranks among a
state's strings suffice to settle ties, and no string is built or compared until an audit is read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from typing import NamedTuple

STATES = range(4)
#: The state after an inserted or a rewritten role.
NEXT = (2, 2, 3, 2)
ROLE_OF = {0: "user", 1: "user", 2: "assistant", 3: "user"}
CLASSES, OTHER = "sua", 3
OK, TRUNCATED, BLANK, DUPLICATE = range(4)
#: Symbols of rows: class * 4 + fault; rules follow, up to a byte's values.
TERMINALS, MOST_SYMBOLS = 16, 256
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: Cost and edits that end a sequence in each state.
ENDS = ((0, b""), (4, b"II"), (2, b"I"), (0, b""))
FAR = 1 << 60
MEMO = 50_000


def fault_class(role: str) -> int:
    """Of a role's initial: s, u, a or other."""
    return CLASSES.index(role[0]) if role and role[0] in CLASSES else OTHER


class Node(NamedTuple):
    """What a sequence of rows does: costs and ranks by 4 * from + to, counts, and the classes at its ends."""

    cost: tuple[int, ...]
    rank: tuple[int, ...]
    blank: int
    duplicate: int
    truncated: int
    illegal: int
    first: int
    last: int

    def flat(self) -> list[int]:
        return [*self.cost, *self.rank, *self[2:]]

    @staticmethod
    def of(values: list[int]) -> Node:
        return Node(tuple(values[:16]), tuple(values[16:32]), *values[32:])


def _ranked(row: dict[int, object]) -> list[int]:
    """Places of the states by their strings' sort keys."""
    out = [9] * 4
    for place, (j, _) in enumerate(sorted(row.items(), key=lambda x: x[1])):
        out[j] = place
    return out


def terminal(symbol: int) -> tuple[Node, dict[tuple[int, int], bytes]]:
    """A row's node, and its edits from state to state."""
    kind, fault = divmod(symbol, 4)
    cost, rank, edits = [FAR] * 16, [9] * 16, {}
    for i in STATES:
        found: dict[int, tuple[int, bytes]] = {}
        state = i
        for inserted in range(3):
            before, paid = b"I" * inserted, INSERT * inserted
            ways = [(DELETE, b"D", state)]
            if fault in (OK, TRUNCATED):
                cut = CUT * (fault == TRUNCATED)
                ways.append((REROLE + cut, b"R", NEXT[state]))
                kept = {0: {0: 1}, 1: {0: 2, 1: 2, 3: 2}, 2: {2: 3}}.get(kind, {}).get(state)
                if kept is not None:
                    ways.append((cut, b"K", kept))
            for more, edit, j in ways:
                way = (paid + more, before + edit)
                found[j] = min(found.get(j, way), way)
            state = NEXT[state]
        for j, (c, string) in found.items():
            cost[4 * i + j], edits[i, j] = c, string
        rank[4 * i : 4 * i + 4] = _ranked({j: s for j, (_, s) in found.items()})
    counts = (fault == BLANK, fault == DUPLICATE, fault == TRUNCATED)
    return Node(tuple(cost), tuple(rank), *map(int, counts), 0, kind, kind), edits


def joined(a: Node, b: Node) -> tuple[Node, tuple[int, ...]]:
    """The node of a's rows and then b's, and the state between them for each pair of states."""
    cost, rank, mid = [FAR] * 16, [9] * 16, [-1] * 16
    for i in STATES:
        keys: dict[int, tuple[int, int]] = {}
        for j in STATES:
            ways = [(a.cost[4 * i + k] + b.cost[4 * k + j], a.rank[4 * i + k], k) for k in STATES]
            c, _, k = min(ways)
            if c < FAR:
                cost[4 * i + j], mid[4 * i + j] = c, k
                keys[j] = (a.rank[4 * i + k], b.rank[4 * k + j])
        rank[4 * i : 4 * i + 4] = _ranked(keys)
    broken = a.illegal + b.illegal + ((a.last, b.first) not in LEGAL)
    node = Node(tuple(cost), tuple(rank), a.blank + b.blank, a.duplicate + b.duplicate, a.truncated + b.truncated, broken, a.first, b.last)
    return node, tuple(mid)


def end_state(node: Node | None) -> int:
    """The state in which the cheapest edits of a whole sequence leave its last row, before what is inserted at the end."""
    if node is None:
        return 0
    return min(STATES, key=lambda j: (node.cost[j] + ENDS[j][0], node.rank[j]))


class Grammar:
    """Rules, the node of each symbol evaluated bottom-up once, and sequences read through them."""

    def __init__(self, rules: Iterable[tuple[int, int]] = ()):
        made = [terminal(s) for s in range(TERMINALS)]
        self.nodes = [node for node, _ in made]
        #: The audit rope: edits of rows, and of a rule the state between its two symbols.
        self.edits = [edits for _, edits in made]
        self.mids: list[tuple[int, ...] | None] = [None] * TERMINALS
        self.pairs: list[tuple[int, int] | None] = [None] * TERMINALS
        self.replaced: list[tuple[bytes, bytes]] = []
        self.read: dict[bytes, tuple[Node, list[tuple[int, ...]]]] = {}
        for pair in rules:
            self.add(pair)

    def add(self, pair: tuple[int, int]) -> None:
        node, mid = joined(self.nodes[pair[0]], self.nodes[pair[1]])
        self.replaced.append((bytes(pair), bytes([len(self.nodes)])))
        self.nodes.append(node)
        self.mids.append(mid)
        self.pairs.append(pair)
        self.edits.append({})

    def encode(self, symbols: bytes) -> bytes:
        for pair, rule in self.replaced:
            symbols = symbols.replace(pair, rule)
        return symbols

    def rope(self, symbol: int, i: int, j: int) -> bytes:
        """The edits of a symbol from state i to state j; of a rule they are kept, so that sequences share them."""
        found = self.edits[symbol].get((i, j))
        if found is None:
            a, b = self.pairs[symbol]
            k = self.mids[symbol][4 * i + j]
            found = self.edits[symbol][i, j] = self.rope(a, i, k) + self.rope(b, k, j)
        return found

    def _folded(self, encoded: bytes) -> tuple[Node, list[tuple[int, ...]]]:
        """The node of a sequence, and the states before each of its symbols but the first."""
        if encoded not in self.read:
            node, mids = self.nodes[encoded[0]], []
            for symbol in encoded[1:]:
                node, mid = joined(node, self.nodes[symbol])
                mids.append(mid)
            if len(self.read) > MEMO:
                self.read = {}
            self.read[encoded] = node, mids
        return self.read[encoded]

    def node(self, symbols: bytes) -> Node:
        """The node of a sequence of at least one row."""
        return self._folded(self.encode(symbols))[0]

    def audit(self, symbols: bytes, i: int, j: int) -> bytes:
        """The cheapest edits of a sequence of at least one row from state i to state j, the least as text among equals."""
        encoded = self.encode(symbols)
        parts = []
        for symbol, mid in zip(encoded[:0:-1], self._folded(encoded)[1][::-1]):
            k = mid[4 * i + j]
            parts.append(self.rope(symbol, k, j))
            j = k
        parts.append(self.rope(encoded[0], i, j))
        return b"".join(parts[::-1])


def pair_counts(sequences: Iterable[tuple[bytes, int]]) -> Counter[tuple[int, int]]:
    """How often each pair of neighbours stands in sequences that come so many times, overlaps of equal symbols once."""
    out: Counter[tuple[int, int]] = Counter()
    for s, n in sequences:
        free = True
        for k in range(len(s) - 1):
            if k and s[k - 1] == s[k] == s[k + 1] and not free:
                free = True
                continue
            out[s[k], s[k + 1]] += n
            free = s[k] != s[k + 1]
    return out


def best_pairs(counts: Iterable[tuple[int, int, int]], least: int, most: int) -> list[tuple[int, int]]:
    """The most frequent pairs of rows (left, right, n) that come at least `least` times and share no symbol with one before."""
    taken: set[int] = set()
    out = []
    for left, right, n in sorted(counts, key=lambda x: (-x[2], x[0], x[1])):
        if n < least or len(out) == most:
            break
        if not {left, right} & taken:
            out.append((left, right))
            taken |= {left, right}
    return out
