"""Vectorised access to Arrow string columns: UTF-8 buffers and word hashes.

Words are maximal runs of bytes outside a separator set; bytes of A-Z count as
a-z. Each word gets a 64-bit polynomial hash over random byte values, mixed
with its length, so equal words have equal hashes on every machine, and two
different words collide with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..session import WORKER_MEMORY

_M = (1 << 64) - 1
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
#: Bytes handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 19


def _byte_values() -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(20240229))
    v = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    v[65:91] = v[97:123]
    return v


BYTE_VALUES = _byte_values()
#: White space of the Jaccard contract: space and 0x09-0x0D.
SPACE_WORDS = np.ones(256, dtype=bool)
SPACE_WORDS[[0x20, *range(0x09, 0x0E)]] = False
#: Letters, digits and all of non-ASCII.
ALNUM_WORDS = np.zeros(256, dtype=bool)
ALNUM_WORDS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_caches: dict[str, dict] = {}
_libc = ctypes.CDLL(None)
#: Bytes of an array with pages of its own, and of freed ones that stay, within a task that is ``lean``.
TASK_MAPPED, TASK_KEPT = 8 << 20, 32 << 20


def cache(name: str) -> dict:
    """What a worker keeps between tasks, by name."""
    return _caches.setdefault(name, {})


def release(but: str = "") -> None:
    """Lets go of what the worker keeps, save under one name: workers live on into other operators' stages."""
    for name, kept in _caches.items():
        if name != but:
            kept.clear()


def _allocator(mapped: int, kept: int) -> None:
    """Arrays of ``mapped`` bytes get pages of their own; of others that are freed, ``kept`` bytes stay with the worker. (glibc alone)"""
    if hasattr(_libc, "malloc_trim"):
        _libc.mallopt(-3, mapped)
        _libc.mallopt(-1, kept)
        _libc.malloc_trim(0)


def lean(run):
    """A task that keeps freed arrays for its next ones, as new pages cost more than the sums on them, and gives all back at its end."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        _allocator(TASK_MAPPED, TASK_KEPT)
        try:
            yield from run(batches)
        finally:
            _allocator(int(WORKER_MEMORY["MALLOC_MMAP_THRESHOLD_"]), int(WORKER_MEMORY["MALLOC_TRIM_THRESHOLD_"]))

    return task


_powers: dict[str, np.ndarray] = cache("powers")


def _pow(base: int, n: int, name: str) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def utf8(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(offsets) == 0:
        offsets = np.zeros(1, np.int64)
    return buf[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes at most, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """(hash, start byte, end byte, first word of each row + total) of rows' words."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = np.empty(n, bool)
    first[0] = True
    np.logical_not(inside[:-1], out=first[1:])
    heads = offsets[:-1]
    first[heads[heads < n]] = True
    first &= inside
    last = np.empty(n, bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    tails = offsets[1:] - 1
    last[tails[tails >= 0]] = True
    last &= inside
    start = np.flatnonzero(first)
    end = np.flatnonzero(last) + 1
    h = range_hash(prefix_sums(data), start, end)
    return h, start, end, np.searchsorted(start, offsets)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which ``range_hash`` takes the hash of any range of the bytes."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * _pow(_P, len(data), "p"), out=sums[1:])
    return sums


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the bytes of [start, end); equal bytes, equal hash, wherever they stand."""
    h = (sums[end] - sums[start]) * _pow(_PINV, len(sums) - 1, "i")[start]
    return mix(h ^ ((end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))


def shingles(h: np.ndarray, first: np.ndarray, k: int):
    """Hashes of every k consecutive words within a row, and the word each starts at.

    A row with fewer words, but not none, gives one shingle of all its words.
    """
    n = len(h)
    counts = np.diff(first)
    if n >= k:
        m = n - k + 1
        s = np.zeros(m, np.uint64)
        for j in range(k):
            s = mix(s * np.uint64(3) + h[j : j + m])
        row = np.repeat(np.arange(len(counts)), counts)
        good = np.flatnonzero(row[:m] == row[k - 1 :])
        s = s[good]
    else:
        row, good, s = np.repeat(np.arange(len(counts)), counts), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            has = counts[short] > j
            extra[has] = mix(extra[has] * np.uint64(3) + h[first[short[has]] + j])
        extra = mix(extra ^ counts[short].astype(np.uint64))
        good = np.concatenate([good, first[short]])
        s = np.concatenate([s, extra])
        order = np.argsort(good, kind="stable")
        good, s = good[order], s[order]
    return s, good


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + len) one after the other."""
    total = int(lens.sum())
    before = np.cumsum(lens) - lens
    return np.arange(total, dtype=np.int64) + np.repeat(starts - before, lens)
