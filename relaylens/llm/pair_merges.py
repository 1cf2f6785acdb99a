"""Byte-pair merges of many words at a time: one numpy row per word, one merge per row and step."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NONE = np.int32(1 << 30)
PAD = np.uint32(0xFFFF)
_FREE = np.uint32(0xFFFFFFFF)


class PairTable:
    """Ranks and results of pairs of ids below 65535, in an open-addressed table."""

    def __init__(self, left: list[int], right: list[int], rank: list[int], merged: list[int]):
        keys = np.array(left, np.uint32) << np.uint32(16) | np.array(right, np.uint32)
        self.bits = max(12, len(keys).bit_length() + 3)
        self.keys = np.full(1 << self.bits, _FREE, np.uint32)
        self.ranks = np.full(1 << self.bits, NONE, np.int32)
        self.results = np.full(1 << self.bits, PAD, np.uint32)
        self.probes, todo = 0, np.arange(len(keys))
        while len(todo):
            slot = self._slot(keys[todo], self.probes)
            take = np.zeros(len(todo), bool)
            take[np.unique(slot, return_index=True)[1]] = True
            take &= self.keys[slot] == _FREE
            slot, chosen = slot[take], todo[take]
            self.keys[slot] = keys[chosen]
            self.ranks[slot] = np.array(rank, np.int32)[chosen]
            self.results[slot] = np.array(merged, np.uint32)[chosen]
            todo, self.probes = todo[~take], self.probes + 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        hashed = keys * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)
        return hashed + np.uint32(probe) & np.uint32((1 << self.bits) - 1)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE if the pair does not merge) and result of each pair."""
        keys = left << np.uint32(16) | right
        slot = self._slot(keys, 0)
        for probe in range(1, self.probes):
            other = (self.keys[slot] != keys) & (self.keys[slot] != _FREE)
            if not other.any():
                break
            slot = np.where(other, self._slot(keys, probe), slot)
        hit = self.keys[slot] == keys
        return np.where(hit, self.ranks[slot], NONE), np.where(hit, self.results[slot], PAD)


def merge(table: PairTable, grid: np.ndarray,
          skip: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """Rows of ids, padded with PAD, after all merges.

    Each step takes the pair of lowest rank, leftmost first, of every row that has one.  With
    ``skip(rows)``, asked once a step for the rows that have a pair, the pair can be dropped instead; it
    stays dropped until a merge beside it makes another pair.
    """
    ranks, results = table.find(grid[:, :-1], grid[:, 1:])
    out, rows = grid.copy(), np.arange(len(grid))
    columns = np.arange(grid.shape[1])
    while True:
        best = ranks.argmin(axis=1)
        go = ranks[np.arange(len(rows)), best] < NONE
        if not len(go) or not go.all():
            out[rows[~go]] = grid[~go]
            if not go.any():
                return out
            rows, grid, ranks, results, best = rows[go], grid[go], ranks[go], results[go], best[go]
        n = np.arange(len(rows))
        if skip is not None:
            drop = skip(rows)
            ranks[n[drop], best[drop]] = NONE
            n, best = n[~drop], best[~drop]
            if not len(n):
                continue
        new = results[n, best]
        after = columns > best[:, None]
        grid[n] = np.where(after, _shifted(grid[n], PAD), grid[n])
        ranks[n] = np.where(after[:, :-1], _shifted(ranks[n], NONE), ranks[n])
        results[n] = np.where(after[:, :-1], _shifted(results[n], PAD), results[n])
        grid[n, best] = new
        inner = best < grid.shape[1] - 1
        r, b = n[inner], best[inner]
        ranks[r, b], results[r, b] = table.find(grid[r, b], grid[r, b + 1])
        inner = best > 0
        r, b = n[inner], best[inner] - 1
        ranks[r, b], results[r, b] = table.find(grid[r, b], grid[r, b + 1])


def _shifted(x: np.ndarray, fill: int) -> np.ndarray:
    out = np.empty_like(x)
    out[:, :-1] = x[:, 1:]
    out[:, -1] = fill
    return out


def cut(grid: np.ndarray) -> list[bytes]:
    """The ids of each row, without padding, as little-endian 32-bit bytes."""
    width = 4 * grid.shape[1]
    data = grid.astype("<u4").tobytes()
    return [data[width * i:width * i + 4 * n] for i, n in enumerate((grid != PAD).sum(axis=1).tolist())]
