"""Forward and backward recursions of a hidden Markov model over many sequences at once, exact at any length.

Sequences advance together, the longest first, so that those that are not over are always the first ones of a step and a
step is a few products of slices. A sequence longer than a block is cut into blocks; each block's product of moves and
emissions gives the messages that cross its ends, so that the cuts change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

#: Steps of a block at most, symbols that callers hand over together, and symbols and pieces that advance together.
STEPS, TOGETHER = 2048, 800_000
ABREAST, WIDTH = 800_000, 2048
#: Messages are scaled to a sum of one once in so many steps; in between they stay far above the least double.
SCALED = 8
#: Posteriors that are added up at a time.
COUNTED = 16_384


class Hmm(NamedTuple):
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states


class Piece(NamedTuple):
    sequence: int
    begin: int
    end: int


class Abreast(NamedTuple):
    """Pieces that advance together, by falling length; their symbols step by step, the pieces of a step one after the other."""

    pieces: list[Piece]
    sizes: np.ndarray
    symbols: np.ndarray
    #: Where each step begins, and after the last one the number of symbols.
    at: list[int]


def _blocks(sequences: list[np.ndarray], steps: int) -> list[list[Piece]]:
    return [[Piece(k, a, min(a + steps, len(s))) for a in range(0, len(s), steps)] for k, s in enumerate(sequences) if len(s) > steps]


def _abreast(sequences: list[np.ndarray], pieces: list[Piece]) -> Iterator[Abreast]:
    """The pieces, none of which is empty, in groups."""
    pieces = sorted(pieces, key=lambda b: b.begin - b.end)
    group, size = [], 0
    for b in pieces:
        if group and (size + b.end - b.begin > ABREAST or len(group) == WIDTH):
            yield _group(sequences, group)
            group, size = [], 0
        group.append(b)
        size += b.end - b.begin
    if group:
        yield _group(sequences, group)


def _group(sequences: list[np.ndarray], pieces: list[Piece]) -> Abreast:
    sizes = np.array([b.end - b.begin for b in pieces])
    # so many pieces have a symbol at a step
    wide = len(sizes) - np.searchsorted(sizes[::-1], np.arange(sizes[0]), side="right")
    at = np.cumsum(wide) - wide
    lane = np.arange(sizes.sum()) - np.repeat(at, wide)
    source = (np.cumsum(sizes) - sizes).take(lane) + np.repeat(np.arange(len(wide)), wide)
    symbols = np.concatenate([sequences[b.sequence][b.begin : b.end] for b in pieces]).take(source)
    return Abreast(pieces, sizes, symbols, [*at.tolist(), len(symbols)])


def boundaries(model: Hmm, sequences: list[np.ndarray], steps: int = STEPS) -> dict[Piece, tuple[np.ndarray, np.ndarray]]:
    """For each block of a long sequence: the forward message before it and the backward message after it, up to scale."""
    states, long = len(model.start), _blocks(sequences, steps)
    products: dict[Piece, np.ndarray] = {}
    # a row of emissions for each state before the block
    emit = np.tile(model.emit, states)
    for group in _abreast(sequences, [b for bs in long for b in bs]):
        at, begins = group.at, [b.begin == 0 for b in group.pieces]
        # block, state before the block, state now
        p = np.repeat(model.move[None], len(begins), 0)
        p[begins] = model.start
        for t in range(len(at) - 1):
            now = p[: at[t + 1] - at[t]]
            if t:
                now[:] = np.matmul(now.reshape(-1, states), model.move).reshape(now.shape)
            now *= emit.take(group.symbols[at[t] : at[t + 1]], 0).reshape(now.shape)
            if t % SCALED == SCALED - 1:
                now /= now.sum((1, 2), keepdims=True)
        products |= dict(zip(group.pieces, p / p.sum((1, 2), keepdims=True), strict=True))
    found = {}
    for bs in long:
        into, forward = np.full(states, 1 / states), []
        for b in bs:
            forward.append(into)
            into = into @ products[b]
            into = into / into.sum()
        back = np.ones(states)
        for b, into in zip(bs[::-1], forward[::-1], strict=True):
            found[b] = into, back
            back = products[b] @ back
            back = back / back.sum()
    return found


def groups_of(model: Hmm, sequences: list[np.ndarray], steps: int = STEPS) -> Iterator[tuple[Abreast, np.ndarray, np.ndarray]]:
    """All of the sequences in groups of pieces, with what comes into each piece and goes out of it (pieces x states).

    Zeros come into a piece that begins its sequence.
    """
    crossing = boundaries(model, sequences, steps)
    states = len(model.start)
    whole = [Piece(k, 0, len(s)) for k, s in enumerate(sequences) if 0 < len(s) <= steps]
    for group in _abreast(sequences, [*crossing, *whole]):
        into, out_of = np.zeros((len(group.pieces), states)), np.ones((len(group.pieces), states))
        for j, b in enumerate(group.pieces):
            if b in crossing:
                before, after = crossing[b]
                if b.begin:
                    into[j] = before
                if b.end < len(sequences[b.sequence]):
                    out_of[j] = after
        yield group, into, out_of


def forward(model: Hmm, group: Abreast, into: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The forward messages (symbols x states), each piece's log likelihood, and by what the messages of a step were divided."""
    at, alpha, scales = group.at, np.empty((len(group.symbols), into.shape[1])), {}
    log, before, buffer = np.zeros(len(into)), into, np.empty(into.shape)
    for t in range(len(at) - 1):
        now = alpha[at[t] : at[t + 1]]
        np.matmul(before[: len(now)], model.move, out=now)
        if not t:
            now[~into.any(1)] = model.start
        # the symbols are all below the size, so nothing is clipped, and a mode that checks would copy
        now *= model.emit.take(group.symbols[at[t] : at[t + 1]], 0, out=buffer[: len(now)], mode="clip")
        if t % SCALED == SCALED - 1:
            scales[t] = now.sum(1, keepdims=True)
            now /= scales[t]
            log[: len(now)] += np.log(scales[t][:, 0])
        before = now
    return alpha, log + np.log(alpha[_last(group)].sum(1)), scales


def _last(group: Abreast) -> np.ndarray:
    """Where the last symbol of each piece is."""
    return np.array(group.at)[group.sizes - 1] + np.arange(len(group.sizes))


def expectation(model: Hmm, sequences: list[np.ndarray], steps: int = STEPS) -> tuple[Hmm, float]:
    """The expected starts, moves and emissions of one E-step over the sequences, and their log likelihood."""
    states, size = len(model.start), len(model.emit)
    start, moves, emitted, total = np.zeros(states), np.zeros((states, states)), np.zeros((states, size)), 0.0
    back = np.ascontiguousarray(model.move.T)
    for group, into, out_of in groups_of(model, sequences, steps):
        at, buffer = group.at, np.empty(into.shape)
        alpha, log, scales = forward(model, group, into)
        total += float(log.sum())
        # what a piece's last step gets from behind, so that messages of both ways have the product one
        beta = out_of / (alpha[_last(group)] * out_of).sum(1, keepdims=True)
        for t in range(len(at) - 2, -1, -1):
            now = beta[: at[t + 1] - at[t]]
            weight = model.emit.take(group.symbols[at[t] : at[t + 1]], 0, out=buffer[: len(now)], mode="clip")
            weight *= now
            if t in scales:
                weight /= scales[t]
            moves += (alpha[at[t - 1] : at[t - 1] + len(now)] if t else into).T @ weight
            # from here on alpha is the states' posterior
            alpha[at[t] : at[t + 1]] *= now
            np.matmul(weight, back, out=now)
        start += alpha[: at[1]][~into.any(1)].sum(0)
        for k in range(0, len(alpha), COUNTED):
            symbols, columns = group.symbols[k : k + COUNTED].astype(np.intp), np.ascontiguousarray(alpha[k : k + COUNTED].T)
            emitted += [np.bincount(symbols, column, size) for column in columns]
    return Hmm(start, moves * model.move, emitted.T), total


def log10_likelihoods(model: Hmm, sequences: list[np.ndarray], steps: int = STEPS) -> np.ndarray:
    """The exact log10 probability of each sequence, by the scaled forward recursion."""
    total = np.zeros(len(sequences))
    for group, into, _ in groups_of(model, sequences, steps):
        log = forward(model, group, into)[1]
        total += np.bincount([b.sequence for b in group.pieces], log / np.log(10), len(sequences))
    return total
