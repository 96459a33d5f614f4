"""Word places and hashes of whole Arrow batches, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

BASE = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1 << 21


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse, both modulo 2^64."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    up, down = np.full(n, BASE, np.uint64), np.full(n, inverse, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than texts, from 0) of a string column without nulls."""
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def blocks(batch: pa.RecordBatch, place: int, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``most`` bytes in the string column at ``place``, one row at least."""
    at = 0
    while at < batch.num_rows:
        off = buffers(batch.column(place).slice(at))[1]
        take = max(1, int(np.searchsorted(off, most, "right")) - 1)
        yield batch.slice(at, take)
        at += take


class Alphabet:
    """Which bytes make words, and what each counts as. Bytes over 0x7F always do."""

    def __init__(self, is_word, lower: bool):
        self.is_word = np.array([b >= 0x80 or bool(is_word(b)) for b in range(256)])
        self.low = np.arange(256, dtype=np.uint8)
        if lower:
            self.low[ord("A") : ord("Z") + 1] += 32

    def words(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text number of every word."""
        inside = self.is_word[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        cuts = at[1:-1]
        cuts = cuts[cuts < len(raw)]
        first[cuts] = inside[cuts]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        ends = cuts[cuts > 0] - 1
        last[ends] = inside[ends]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        return begin, end, np.searchsorted(at[1:], begin, "right")

    def hashes(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word, block by block so that memory stays small."""
        out = np.empty(len(begin), np.uint64)
        up, down = powers(BLOCK)
        i = 0
        while i < len(begin):
            start = begin[i]
            j = max(i + 1, int(np.searchsorted(end, start + BLOCK, "right")))
            stop = end[j - 1]
            size = stop - start
            u, d = (up, down) if size <= BLOCK else powers.__wrapped__(int(size))
            low = self.low[raw[start:stop]].astype(np.uint64) + np.uint64(1)
            sums = np.zeros(size + 1, np.uint64)
            np.cumsum(low * u[:size], out=sums[1:])
            b, e = begin[i:j] - start, end[i:j] - start
            out[i:j] = mix((sums[e] - sums[b]) * d[b] + (e - b).astype(np.uint64))
            i = j
        return out


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words; the last ``k`` - 1 words begin none."""
    n = max(len(h) - k + 1, 0)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * BASE + h[i : i + n])
    return out
