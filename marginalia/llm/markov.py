"""Arithmetic of hidden Markov models over sequences of symbols: scaled forward and backward recursions, Baum-Welch counts.

Sequences are dealt with many at a time. They are cut into stretches of at most ``STRETCH`` symbols, longest first, and laid out
step by step, so that one step of all stretches is one product of matrices. A sequence of several stretches is first folded to
one matrix a stretch; chained, these give the exact states before and after each, from which its stretches are then worked
through beside all others. So a very long text takes steps and memory like a short one, and no value is approximated.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

STRETCH = 4096
#: Symbols that are worked through at once.
GROUP = 200_000
#: Steps after which scores whose scale does not matter are brought back to a sum of one.
SCALED = 8
_TINY = 1e-300


class Chain(NamedTuple):
    """States at the start, states after states (a row each), and emissions of each symbol (a row) by state. Emissions may be
    probabilities or ratios to those of another model; then likelihoods are ratios too."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray


class Counts(NamedTuple):
    """Expected numbers of starts, moves and emissions, and the logarithm of the likelihood."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    log: float


class _Layout:
    """Stretches of symbols, longest first, step by step: step t holds the t-th symbol of the first ``active[t]`` stretches."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        n = len(sizes)
        self.active = n - np.cumsum(np.bincount(sizes, minlength=1))[:-1]
        self.at = np.concatenate(([0], np.cumsum(self.active)))
        rank = np.repeat(np.arange(n), sizes)
        step = np.arange(len(rank)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        place = self.at[step] + rank
        self.symbols, self.stretch = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        self.symbols[place] = symbols[np.repeat(starts, sizes) + step]
        self.stretch[place] = rank
        #: Where the symbol before stands, for all but first symbols.
        self.before = np.arange(n, len(rank)) - np.repeat(self.active[:-1], self.active[1:])

    def steps(self, back: bool = False) -> Iterator[tuple[int, int, int]]:
        order = range(len(self.active) - 1, -1, -1) if back else range(len(self.active))
        return ((t, int(self.at[t]), int(self.active[t])) for t in order)


def _forward(chain: Chain, lay: _Layout, emitted: np.ndarray, enter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of states at each symbol, given all up to it, and the factors taken out."""
    share, factor, ones = np.empty(emitted.shape), np.empty((len(emitted), 1)), np.ones((emitted.shape[1], 1))
    now = enter
    for t, a, m in lay.steps():
        now = (now[:m] @ chain.move if t else now[:m]) * emitted[a : a + m]
        total = now @ ones + _TINY
        now = np.divide(now, total, out=share[a : a + m])
        factor[a : a + m] = total
    return share, factor[:, 0]


def _backward(chain: Chain, lay: _Layout, emitted: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to a factor: likelihood of what comes after each symbol by its state, and that times its own emission."""
    after, own, ones, turned = np.empty(emitted.shape), np.empty(emitted.shape), np.ones((emitted.shape[1], 1)), np.ascontiguousarray(chain.move.T)
    later = 0
    for t, a, m in lay.steps(back=True):
        now = after[a : a + m]
        if later:
            np.matmul(own[a + m : a + m + later], turned, out=now[:later])
            if not t % SCALED:
                now[:later] /= now[:later] @ ones + _TINY
        now[later:] = leave[later:m]
        np.multiply(now, emitted[a : a + m], out=own[a : a + m])
        later = m
    return after, own


def _folded(chain: Chain, lay: _Layout, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A matrix for each stretch, from the state at its first symbol to that at its last, emissions of both included, and the
    logarithm of the factor taken out of it."""
    k = len(chain.start)
    fold, logs, ones = np.repeat(np.eye(k)[None], n, 0), np.zeros(n), np.ones(k * k)
    for t, a, m in lay.steps():
        now = fold[:m] if not t else (fold[:m].reshape(-1, k) @ chain.move).reshape(m, k, k)
        now = np.multiply(now, chain.emit[lay.symbols[a : a + m]][:, None, :], out=fold[:m])
        if not t % SCALED:
            total = now.reshape(m, -1) @ ones + _TINY
            now /= total[:, None, None]
            logs[:m] += np.log(total)
    total = fold.reshape(n, -1) @ ones + _TINY
    return fold / total[:, None, None], logs + np.log(total)


class Sequences:
    """Sequences of symbols, none empty, flat: where each starts, one entry more than sequences."""

    def __init__(self, symbols: np.ndarray, offsets: np.ndarray, stretch: int = STRETCH, group: int = GROUP):
        self.symbols, self.offsets, self.group = symbols, offsets, group
        sizes = np.diff(offsets)
        pieces = -(-sizes // stretch)
        self.of = np.repeat(np.arange(len(sizes)), pieces)
        self.piece = np.arange(len(self.of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        self.pieces = pieces
        self.starts = offsets[:-1][self.of] + self.piece * stretch
        self.sizes = np.minimum(stretch, offsets[1:][self.of] - self.starts)

    def _groups(self, which: np.ndarray) -> Iterator[tuple[np.ndarray, _Layout]]:
        """Stretches by falling size, a bounded number of symbols at a time."""
        which = which[np.argsort(-self.sizes[which], kind="stable")]
        ends = np.cumsum(self.sizes[which]) // self.group
        for some in np.split(which, np.flatnonzero(np.diff(ends)) + 1):
            if len(some):
                yield some, _Layout(self.symbols, self.starts[some], self.sizes[some])

    def _ends(self, chain: Chain) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each stretch the shares of states it is entered with, up to a factor what comes after its last symbol by state,
        and, where its sequence has several stretches, the shares at its last symbol; for each such sequence the logarithm of
        its likelihood, else 0."""
        k, n = len(chain.start), len(self.of)
        enter, leave, last, logs = np.tile(chain.start, (n, 1)), np.ones((n, k)), np.zeros((n, k)), np.zeros(len(self.pieces))
        many = np.flatnonzero(self.pieces[self.of] > 1)
        fold, part = np.empty((n if len(many) else 0, k, k)), np.zeros(n)
        for some, lay in self._groups(many):
            fold[some], part[some] = _folded(chain, lay, len(some))
        for i in many:
            if self.piece[i]:
                enter[i] = last[i - 1] @ chain.move
            now = enter[i] @ fold[i]
            total = now.sum() + _TINY
            last[i] = now / total
            logs[self.of[i]] += np.log(total) + part[i]
        for i in many[::-1]:
            if self.piece[i]:
                back = chain.move @ (fold[i] @ leave[i])
                leave[i - 1] = back / (back.sum() + _TINY)
        return enter, leave, last, logs

    def logs(self, chain: Chain) -> np.ndarray:
        """Natural logarithm of the likelihood of each sequence."""
        enter, _, _, logs = self._ends(chain)
        for some, lay in self._groups(np.flatnonzero(self.pieces[self.of] == 1)):
            _, factor = _forward(chain, lay, chain.emit[lay.symbols], enter[some])
            logs[self.of[some]] += np.bincount(lay.stretch, np.log(factor), len(some))
        return logs

    def counts(self, chain: Chain) -> Counts:
        """Expected counts of all sequences together (Baum-Welch)."""
        symbols, k = chain.emit.shape
        start, move, emit, log = np.zeros(k), np.zeros((k, k)), np.zeros((k, symbols)), 0.0
        enter, leave, last, logs = self._ends(chain)
        log += logs.sum()
        for some, lay in self._groups(np.arange(len(self.of))):
            emitted = chain.emit[lay.symbols]
            share, factor = _forward(chain, lay, emitted, enter[some])
            after, own = _backward(chain, lay, emitted, leave[some])
            log += np.log(factor[self.pieces[self.of[some]][lay.stretch] == 1]).sum()
            here = share * after
            here /= here @ np.ones((k, 1)) + _TINY
            for s, of_state in enumerate(np.ascontiguousarray(here.T)):
                emit[s] += np.bincount(lay.symbols, of_state, symbols)
            n, piece = len(some), self.piece[some]
            start += here[:n][piece == 0].sum(0)
            move += _moves(chain, share[lay.before], own[n:])
            # moves into a stretch come from the one before it
            into = np.flatnonzero(piece > 0)
            if len(into):
                move += _moves(chain, last[some[into] - 1], own[into])
        return Counts(start, move, emit, log)


def _moves(chain: Chain, share: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Expected moves from shares of states to what the next symbol and all after it say."""
    total = ((share @ chain.move) * own) @ np.ones((own.shape[1], 1)) + _TINY
    return chain.move * (share.T @ (own / total))
