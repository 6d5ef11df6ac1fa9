"""Word, shingle and window hashing over whole Arrow string columns, vectorised.

A word is a maximal run of bytes other than space and 0x09-0x0D. Texts are hashed in
slices of bounded size, so one very long text needs no more working memory than its
own words; hashes depend on the words only, never on slice or batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
U = np.uint64
_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
WS = np.zeros(256, bool)
WS[[9, 10, 11, 12, 13, 32]] = True
BYTE[WS] = 0
LOWER = BYTE.copy()
LOWER[65:91] = BYTE[97:123]
BASE, STEP = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)
_pow = np.ones(1, np.uint64)


def lean(run: Callable) -> Callable:
    """run, giving freed memory back to the system after each batch: workers outlive tasks and share an executor's limit."""

    def trim() -> None:
        pa.default_memory_pool().release_unused()
        if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
            libc.malloc_trim(0)

    def spaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b
            del b
            trim()

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(spaced(batches))
        trim()

    return wrapped


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (new array)."""
    x = x ^ (x >> U(32))
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(29)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(32)
    return x


def powers(n: int) -> np.ndarray:
    global _pow
    if len(_pow) < n:
        with np.errstate(over="ignore"):
            _pow = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(n, 1024) - 1, BASE)]))
    return _pow


def column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is an empty text."""
    a = batch.column(batch.schema.get_field_index(name))
    if a.null_count:
        a = a.fill_null("")
    large = pa.types.is_large_string(a.type)
    off = np.frombuffer(a.buffers()[1], np.int64 if large else np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64) if len(a) else np.zeros(1, np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = CHUNK, rows: int = 4096) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes and `rows` rows, one row at least."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1), i + rows, n)
        yield i, j
        i = j


def _hash(data: np.ndarray, doc_start: np.ndarray, lower: bool, where: bool) -> tuple:
    ws = WS[data]
    first = ~ws
    first[1:] &= ws[:-1] | doc_start[1:]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    at = np.zeros(len(data), np.int32)
    at[starts[1:]] = np.diff(starts)
    at[starts[0]] = starts[0]
    np.cumsum(at, out=at)
    at = np.arange(len(data), dtype=np.int32) - at
    at[: starts[0]] = 0
    last = ~ws
    last[:-1] &= ws[1:] | doc_start[1:]
    ends = np.flatnonzero(last) + 1
    p = powers(int((ends - starts).max()))
    np.minimum(at, len(p) - 1, out=at)
    v = (LOWER if lower else BYTE)[data]
    v *= p[at]
    h = np.add.reduceat(v, starts)
    return mix(h + (ends - starts).astype(np.uint64) * STEP), starts, ends if where else starts


def words(data: np.ndarray, off: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and for each text where its words begin (one more entry than texts)."""
    doc_start = np.zeros(len(data) + 1, bool)
    doc_start[off] = True
    doc_start = doc_start[: len(data)]
    hs, ss, i = [], [], 0
    while i < len(data):
        j = min(i + CHUNK, len(data))
        while j < len(data) and not (WS[data[j]] or doc_start[j]):
            step = np.flatnonzero(WS[data[j : j + 65536]] | doc_start[j : j + 65536])
            j = j + int(step[0]) if len(step) else min(j + 65536, len(data))
        h, s, _ = _hash(data[i:j], doc_start[i:j], lower, False)
        hs.append(h)
        ss.append(s + i)
        i = j
    if not hs:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    return np.concatenate(hs), np.searchsorted(np.concatenate(ss), off).astype(np.int64)


def roll(h: np.ndarray, k: int) -> np.ndarray:
    """Unmixed hash of each run of k consecutive words, in O(log k) passes; len(h) - k + 1 entries."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out, have, power, run, c = None, 0, h, 1, STEP
    scale = U(1)
    with np.errstate(over="ignore"):
        while True:
            if k & run:
                part = power[have : have + len(h) - k + 1] * scale
                out = part if out is None else out + part
                have += run
                scale = scale * c
            if have == k:
                return out
            power = power[: len(power) - run] + power[run:] * c
            c = c * c
            run *= 2


def owner(first: np.ndarray) -> np.ndarray:
    """For each word the number of its text."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def whole(first: np.ndarray, k: int) -> np.ndarray:
    """Start positions of the k-word windows that lie within one text."""
    n = int(first[-1])
    if n < k:
        return np.zeros(0, np.int64)
    end = np.repeat(first[1:], np.diff(first))[: n - k + 1]
    return np.flatnonzero(np.arange(k, n + 1) <= end)
