"""A bounded cache of the ids of text units, held in flat arrays so that whole slices are looked up at once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np

from .common import ragged

#: Units that a worker keeps the ids of, and characters and ids of them, at most.
CACHE_UNITS, CACHE_CHARS, CACHE_IDS = 1_500_000, 24_000_000, 12_000_000


class UnitCache:
    """``encode`` takes distinct units and returns units (those, and others that it met on the way), their ids, flat, and how many each has."""

    def __init__(self, encode: Callable[[list[str]], tuple[list[str], np.ndarray, np.ndarray]], limit: int = CACHE_UNITS):
        self.encode, self.limit = encode, limit
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        self.flat, self.n_flat = np.zeros(1 << 20, np.int32), 0
        self.begin, self.size = np.zeros(1 << 18, np.int64), np.zeros(1 << 18, np.int64)

    def _keep(self, units: list[str]) -> None:
        units, ids, sizes = self.encode(units)
        base, more = len(self.place), len(units)
        while base + more > len(self.begin):
            self.begin, self.size = np.concatenate([self.begin, self.begin]), np.concatenate([self.size, self.size])
        while self.n_flat + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.n_flat : self.n_flat + len(ids)] = ids
        self.size[base : base + more] = sizes
        self.begin[base : base + more] = self.n_flat + np.cumsum(sizes) - sizes
        self.n_flat += len(ids)
        self.chars += sum(map(len, units))
        self.place.update(zip(units, range(base, base + more), strict=True))

    def ids(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all units, flat, and where each unit begins (with the total at the end)."""
        if len(self.place) > self.limit or self.chars > CACHE_CHARS or self.n_flat > CACHE_IDS:
            self._forget()
        which = np.fromiter(map(self.place.get, units, repeat(-1)), np.int64, len(units))
        if (missing := np.flatnonzero(which < 0)).size:
            absent = [units[i] for i in missing]
            self._keep(list(dict.fromkeys(absent)))
            which[missing] = np.fromiter(map(self.place.__getitem__, absent), np.int64, len(absent))
        sizes = self.size[which]
        return self.flat[ragged(self.begin[which], sizes)], np.concatenate([[0], np.cumsum(sizes)])
