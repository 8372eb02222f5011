"""Texts of an Arrow batch as flat byte arrays: spans and their hashes, without a Python object for each word."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

U64 = np.uint64
PART = 256 << 10  # bytes of text that operators look at together
SEGMENT = 1 << 18  # bytes looked at together; a longer single span is taken whole
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes as numbers above 0 and up to 1."""
    return ((x >> U64(11)).astype(np.float64) + 1.0) / float(1 << 53)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if not _POWERS or len(_POWERS[0]) <= n:
        size = max(n, SEGMENT) + 1
        inverse = pow(BASE, -1, 1 << 64)
        _POWERS[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(size, b, U64)])) for b in (BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; spans are in order and do not overlap."""
    out = np.empty(len(start), U64)
    i = 0
    while i < len(start):
        low = start[i]
        j = max(i + 1, int(np.searchsorted(end, low + SEGMENT, "right")))
        power, inverse = _powers(int(end[j - 1] - low))
        piece = data[low : end[j - 1]].astype(U64)
        piece += U64(1)
        piece *= power[: len(piece)]
        total = np.concatenate([np.zeros(1, U64), np.cumsum(piece, dtype=U64)])
        s, e = start[i:j] - low, end[i:j] - low
        out[i:j] = mix((total[e] - total[s]) * inverse[s] + (e - s).astype(U64))
        i = j
    return out


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each text starts (one more entry than rows); null is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] if len(offsets) else 0 :] if len(column) else np.empty(0, np.uint8)
    offsets = offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)
    return data[: offsets[-1]], offsets


def release() -> None:
    """Hand freed memory back to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PART) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that each holds about ``limit`` bytes of text, or one longer text."""
    for batch in batches:
        sizes = np.cumsum(np.asarray(pa.compute.binary_length(batch.column(column).fill_null("")), dtype=np.int64)) if len(batch) else []
        i = 0
        while i < len(batch):
            below = sizes[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(sizes, below + limit, "right")))
            yield batch.slice(i, j - i)
            i = j
    release()


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, ended also where a text ends."""
    if not len(inside):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.zeros(len(inside) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside])
    after = np.concatenate([inside, [False]])
    return np.flatnonzero(after & (~before | cut)), np.flatnonzero(before & (~after | cut))
