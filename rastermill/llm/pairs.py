"""Merging pairs of symbols, best pair first, for many words at once in arrays."""

from __future__ import annotations

import numpy as np

NEVER = np.int64(1 << 62)


class Pairs:
    """What pairs of symbols (numbers below 2**21) become, and in which order."""

    def __init__(self, made: dict[tuple[int, int], tuple[int, int]]):
        """made: (left, right) -> (rank, symbol), the least rank first."""
        keys = sorted(made)
        self.keys = np.array([a << 21 | b for a, b in keys], np.int64)
        self.rank = np.array([made[k][0] for k in keys], np.int64)
        self.makes = np.array([made[k][1] for k in keys], np.int64)

    def at(self, symbol: np.ndarray, begins: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The pair that the symbols at these places make with the next ones, or -1."""
        if not len(self.keys):
            return np.full(len(at), -1)
        after = np.minimum(at + 1, len(symbol) - 1)
        return np.where((at + 1 < len(symbol)) & ~begins[after], found(self.keys, symbol[at] << 21 | symbol[after]), -1)

    def join(self, symbol: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbols, the place where each began): in each round every stretch, from one mark in `begins` to the next,
        joins its best pair, of equals the first, until it has none."""
        symbol, begins, place = symbol.copy(), begins.copy(), np.arange(len(symbol))
        pair = self.at(symbol, begins, place)
        done = [(place[:0], symbol[:0])]
        while len(symbol):
            starts = np.flatnonzero(begins)
            order = np.where(pair < 0, NEVER, self.rank[pair] << 32 | np.arange(len(symbol)))
            best = np.minimum.reduceat(order, starts)
            open_ = np.repeat(best < NEVER, np.diff(np.r_[starts, len(symbol)]))
            done.append((place[~open_], symbol[~open_]))
            left = best[best < NEVER] & 0xFFFFFFFF
            symbol[left] = self.makes[pair[left]]
            open_[left + 1] = False
            moved = (np.cumsum(open_) - 1)[left]
            symbol, place, begins, pair = symbol[open_], place[open_], begins[open_], pair[open_]
            near = np.zeros(len(symbol), bool)
            near[moved] = near[moved[moved > 0] - 1] = True
            near = np.flatnonzero(near)
            pair[near] = self.at(symbol, begins, near)
        place, symbol = (np.concatenate(c) for c in zip(*done, strict=True))
        order = np.argsort(place)
        return symbol[order], place[order]


def found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in sorted keys, or -1."""
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)
