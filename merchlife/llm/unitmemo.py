"""Encodes text units once and remembers the pieces, within a fixed number of units."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from merchlife.llm.bytescan import U64, mix, span_hashes


class UnitMemo:
    """``encode(units, salts)`` gives, for distinct units (bytes), all their ids and how many each has.

    A worker that has met ``limit`` units forgets them all and starts anew, so its memory is bounded.
    """

    def __init__(self, encode: Callable[[list[bytes], np.ndarray], tuple[np.ndarray, np.ndarray]], limit: int = 250_000):
        self.encode, self.limit = encode, limit
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.start, self.length, self.pool = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)

    def ids(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units data[start:end], one after the other, and how many each unit has."""
        if not len(start):
            return np.empty(0, np.int32), np.empty(0, np.int64)
        salt = np.zeros(len(start), U64) if salt is None else salt
        keys = mix(span_hashes(data, start, end) + salt)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > self.limit:
            self.clear()
        at = np.fromiter((self.known.get(k, -1) for k in distinct.tolist()), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            raw, where = data.tobytes(), first[new]
            flat, lengths = self.encode([raw[a:b] for a, b in zip(start[where].tolist(), end[where].tolist(), strict=True)], salt[where])
            at[new] = np.arange(len(new)) + len(self.start)
            self.known.update(zip(distinct[new].tolist(), at[new].tolist(), strict=True))
            self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(lengths) - lengths])
            self.length = np.concatenate([self.length, lengths])
            self.pool = np.concatenate([self.pool, flat.astype(np.int32)])
        where = at[inverse]
        lengths = self.length[where]
        before = np.cumsum(lengths) - lengths
        return self.pool[np.arange(int(lengths.sum())) + np.repeat(self.start[where] - before, lengths)], lengths
