"""Sorted runs of byte strings, front-coded, and their merge by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np


class Entry(NamedTuple):
    key: bytes
    #: Length of the prefix that the key shares with the one before it in its run.
    common: int
    #: What stands left of the sorted suffix, read backward.
    left: bytes
    count: int
    run: int
    number: int


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes are not looked at again."""
    n = min(len(a), len(b))
    if a[known:n] == b[known:n]:
        return n
    width = 8
    while a[known : known + width] == b[known : known + width]:
        known += width
        width *= 2
    while width > 1:
        width //= 2
        if a[known : known + width] == b[known : known + width]:
            known += width
    return known


def encode_run(entries: list[tuple[bytes, bytes, int]]) -> dict[str, bytes]:
    """Front-code sorted (key, left, count): each string without what it shares with the one before."""
    common, rest, left_common, left_rest, counts = [], [], [], [], []
    key = left = b""
    for k, l, n in entries:
        common.append(common_prefix(key, k))
        rest.append(k[common[-1] :])
        left_common.append(common_prefix(left, l))
        left_rest.append(l[left_common[-1] :])
        counts.append(min(n, 2))
        key, left = k, l
    numbers = np.array([common, [*map(len, rest)], left_common, [*map(len, left_rest)], counts], "<u2")
    return {"numbers": numbers.tobytes(), "keys": b"".join(rest), "lefts": b"".join(left_rest)}


def decode_run(numbers: bytes, keys: bytes, lefts: bytes, run: int, first: int) -> Iterator[Entry]:
    table = np.frombuffer(numbers, "<u2").reshape(5, -1).T.tolist()
    key = left = b""
    at = left_at = 0
    for k, (common, n, left_common, m, count) in enumerate(table):
        key = key[:common] + keys[at : at + n]
        left = left[:left_common] + lefts[left_at : left_at + m]
        at, left_at = at + n, left_at + m
        yield Entry(key, common, left, count, run, first + k)


def merge(runs: list[Iterator[Entry]]) -> Iterator[tuple[Entry, int]]:
    """All entries in the order of their keys, each with the length of its common prefix with the one put out before.

    A waiting entry keeps its common prefix with the entry that beat it. The next entry of the run that won last knows
    its own from the front-coding, and all it meets on its way up were beaten by the same entry. If the two lengths
    differ the longer one wins without a look at the strings; if they are equal, comparison goes on from there.
    """
    size = 1
    while size < len(runs):
        size *= 2
    heads: list[Entry | None] = [next(r, None) for r in runs] + [None] * (size - len(runs))
    common = [0] * size
    losers = [0] * size

    def winner(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        if common[a] != common[b]:
            return (a, b) if common[a] > common[b] else (b, a)
        k = common_prefix(x.key, y.key, common[a])
        first, second = (a, b) if x.key[k : k + 1] <= y.key[k : k + 1] else (b, a)
        common[second] = k
        return first, second

    row = list(range(size))
    node = size
    while len(row) > 1:
        node //= 2
        played = [winner(row[k], row[k + 1]) for k in range(0, len(row), 2)]
        for k, (_, lost) in enumerate(played):
            losers[node + k] = lost
        row = [won for won, _ in played]
    top = row[0]
    while (entry := heads[top]) is not None:
        yield entry, common[top]
        following = next(runs[top], None)
        heads[top] = following
        common[top] = following.common if following else 0
        node = (size + top) // 2
        while node:
            top, losers[node] = winner(top, losers[node])
            node //= 2
