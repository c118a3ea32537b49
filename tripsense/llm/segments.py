"""Whole-batch text arrays: words and byte segments of many documents hashed at once with numpy.

A segment's hash is ``sum(T[byte] * P**i)`` over its bytes modulo 2**64, read from one
running sum over the batch and finished by a mixing step, so equal byte strings have equal
hashes wherever they stand. ``T`` and ``P`` are fixed, derived from a counter by the same mixer.
"""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: bytes of text handled at once inside a task (a single longer document is handled alone)
SLICE_BYTES = 2 << 20


def release() -> None:
    """Give freed memory back to the machine: workers live on between tasks and stages."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the finaliser of the public-domain splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class SegmentHasher:
    """Hashes of byte ranges; keeps the powers of the multiplier between batches."""

    def __init__(self, seed: int = 1):
        with np.errstate(over="ignore"):
            rnd = mix64(np.arange(1, 258, dtype=np.uint64) * _STEP + np.uint64(seed))
        self.table, self.base = rnd[:256], int(rnd[256]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        n = len(data)
        if len(self.up) <= n:
            size = max(n + 1, min(2 * n, SLICE_BYTES + 1))
            self.up, self.down = _powers(self.base, size), _powers(self.inverse, size)
        run = np.zeros(n + 1, np.uint64)
        np.cumsum(self.table[data] * self.up[:n], out=run[1:])
        return mix64((run[ends] - run[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _STEP)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a list of texts: byte ranges in ``data`` and the first word of every text."""

    def __init__(self, texts: list[bytes], lower: bool = False):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.data = _LOWER[data] if lower else data
        space = _SPACE[data]
        edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
        self.starts = np.flatnonzero(edge == -1)
        self.ends = np.flatnonzero(edge == 1)
        begins = np.cumsum([0] + [len(t) + 1 for t in texts])
        #: words of text k: first[k] to first[k + 1]
        self.first = np.searchsorted(self.starts, begins)
        self.counts = np.diff(self.first)

    def hashes(self, hasher: SegmentHasher) -> np.ndarray:
        return hasher(self.data, self.starts, self.ends)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` consecutive words (by their hashes); runs may cross texts."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += words[k:k + n]
    return mix64(out)


def slices(texts: list[bytes], limit: int = SLICE_BYTES):
    """Consecutive ``(from, to)`` ranges of texts of about ``limit`` bytes each, one text at least."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > limit:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``starts[0] .. starts[0] + counts[0] - 1, starts[1] ..`` as one array."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(starts - before, counts)
