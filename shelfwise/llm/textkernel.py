"""Vectorised word, shingle and window hashing over Arrow text columns, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_RNG = np.random.Generator(np.random.PCG64(20240229))
#: One random odd-free 64-bit value a byte; folded: A-Z as a-z.
BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64)
FOLDED = BYTE.copy()
FOLDED[65:91] = BYTE[97:123]
_K = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 2**64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, at least n of each."""
    global _pow, _inv
    if len(_pow) < n:
        size = max(n, 1 << 20)
        a, b = np.full(size, _B, np.uint64), np.full(size, _BINV, np.uint64)
        a[0] = b[0] = 1
        _pow, _inv = np.cumprod(a), np.cumprod(b)
    return _pow[:n], _inv[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that hold about limit bytes of text, or one longer row."""
    sizes = np.diff(flat(batch.column(column))[1])
    first, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > limit:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    if first < batch.num_rows:
        yield batch.slice(first)


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows on end and the rows' offsets; null counts as empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    n = len(column)
    off = np.frombuffer(off, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word [^\\x20\\x09-\\x0D]+, and each row's first word; rows never share a word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    word = ~SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, word[:-1]
    before[off[:-1][off[:-1] < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, word[1:]
    after[off[1:] - 1] = False
    s, e = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    return s, e, np.searchsorted(s, off)


def span_hash(data: np.ndarray, s: np.ndarray, e: np.ndarray, table: np.ndarray = BYTE) -> np.ndarray:
    """A 64-bit hash of data[s:e] for each pair."""
    p, q = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * p[: len(data)], out=total[1:])
    return mix((total[e] - total[s]) * q[s] + (e - s).astype(np.uint64) * _K[63])


def windows(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words, and each row's first window; a shorter row, if not empty, is one window."""
    lens = np.diff(first)
    n = len(h)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
    w = max(n - k + 1, 0)
    g = np.zeros(w, np.uint64)
    for j in range(min(k, n) if w else 0):
        g += h[j : j + w] * _K[j % 62]
    g = mix(g)
    counts = np.where(lens >= k, lens - k + 1, (lens > 0).astype(np.int64))
    out = np.zeros(len(first), np.int64)
    np.cumsum(counts, out=out[1:])
    at = np.repeat(first[:-1] - out[:-1], counts) + np.arange(out[-1])
    short = np.repeat(lens < k, counts)
    res = np.empty(out[-1], np.uint64)
    res[~short] = g[at[~short]]
    if short.any():
        for r in np.flatnonzero((lens < k) & (lens > 0)):
            part = h[first[r] : first[r + 1]]
            x = np.sum(part * _K[: len(part)], keepdims=True) + np.full(1, len(part), np.uint64) * _K[62]
            res[out[r]] = mix(x)[0]
    return res, out
