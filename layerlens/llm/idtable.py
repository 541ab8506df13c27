"""A table from byte strings to token ids, held in numpy arrays: hashes,
spans into one pool of ids, and the time of last use. A batch of strings is
looked up by its hashes at once; strings that are not there are learned
together; when the table is full, those not used for longest are forgotten,
so its memory is bounded and frequent strings stay."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class IdTable:
    def __init__(self, learn: Callable[[list[bytes]], list[np.ndarray]], kind: np.dtype, limit: int, longest: int = 64):
        """``learn`` gives the ids of each of a list of strings. At most
        ``limit`` strings of up to ``longest`` bytes are kept."""
        self.learn, self.kind, self.limit, self.longest = learn, np.dtype(kind), limit, longest
        self._reset()

    def _reset(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int32)
        self.used = np.zeros(0, np.int32)
        self.pool = np.zeros(0, self.kind)
        self.clock = 0

    def ids(self, hashes: np.ndarray, data: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all strings ``data[start:end]`` joined, and the number of
        ids of each."""
        if not len(hashes):
            return np.zeros(0, self.kind), np.zeros(0, np.int64)
        distinct, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self.hash, distinct), max(0, len(self.hash) - 1))
        found = self.hash[place] == distinct if len(self.hash) else np.zeros(len(distinct), bool)
        at = np.zeros(len(distinct), np.int64)
        size = np.zeros(len(distinct), np.int64)
        at[found], size[found] = self.at[place[found]], self.size[place[found]]
        self.clock += 1
        self.used[place[found]] = self.clock
        pool = self.pool
        if not found.all():
            miss = np.flatnonzero(~found)
            a, b = start[first[miss]], end[first[miss]]
            learned = self.learn([data[x:y] for x, y in zip(a.tolist(), b.tolist())])
            n = np.fromiter(map(len, learned), np.int64, len(learned))
            pool = np.concatenate([pool, *learned])
            at[miss] = len(self.pool) + np.cumsum(n) - n
            size[miss] = n
            self._keep(pool, distinct[miss], at[miss], n, b - a <= self.longest)
        at, size = at[back], size[back]
        ends = np.cumsum(size)
        flat = np.arange(int(ends[-1])) + np.repeat(at - (ends - size), size)
        return pool[flat], size

    def _keep(self, pool: np.ndarray, h: np.ndarray, at: np.ndarray, size: np.ndarray, short: np.ndarray) -> None:
        h, at, size = h[short], at[short], size[short]
        self.hash = np.concatenate((self.hash, h))
        self.at = np.concatenate((self.at, at))
        self.size = np.concatenate((self.size, size.astype(np.int32)))
        self.used = np.concatenate((self.used, np.full(len(h), self.clock, np.int32)))
        if len(self.hash) > self.limit:
            stay = np.argsort(-self.used, kind="stable")[: self.limit // 2]
            self.hash, self.at, self.size, self.used = self.hash[stay], self.at[stay], self.size[stay], self.used[stay]
        order = np.argsort(self.hash, kind="stable")
        self.hash, self.at, self.size, self.used = (x[order] for x in (self.hash, self.at, self.size, self.used))
        self.pool = pool
        if len(pool) > 2 * self.size.sum() + 65_536:
            ends = np.cumsum(self.size, dtype=np.int64)
            flat = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.at - (ends - self.size), self.size)
            self.pool, self.at = pool[flat], ends - self.size
