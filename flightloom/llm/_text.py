"""Vectorised reading of text columns: words, spans and their hashes, piece by piece.

A piece is a run of rows whose texts hold about ``PIECE`` bytes together, or one longer text, so the
memory of a task is bounded by the longest single text. Words are ``[^\\x20\\x09-\\x0D]+``.
"""

from __future__ import annotations

import ctypes
import functools

import numpy as np
import pyarrow as pa

PIECE = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256).astype(np.uint64)
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least n of each."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, PIECE + (1 << 16))
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row)
    return _powers["up"], _powers["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over a 64-bit word."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def pieces(column: pa.Array, limit: int = PIECE):
    """Yields (first row, past-the-last row) of each piece of a large_string column."""
    sizes = np.diff(offsets(column))
    lo, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if held and held + size > limit:
            yield lo, i
            lo, held = i, 0
        held += size
    if lo < len(sizes):
        yield lo, len(sizes)


def strings(column) -> pa.Array:
    """The column as large_string without nulls (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_string()).fill_null("")


def offsets(column: pa.Array) -> np.ndarray:
    if len(column) == 0:
        return np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]


class Scan:
    """Bytes of a piece with the hash of any span in constant time."""

    def __init__(self, column: pa.Array, lower: bool = False):
        at = offsets(column)
        buffer = column.buffers()[2] if len(column) else None
        self.data = np.frombuffer(buffer, np.uint8)[at[0] : at[-1]] if buffer else np.zeros(0, np.uint8)
        self.offsets = at - at[0]
        if lower:
            self.data = _LOWER[self.data]
        self._sums = None
        fresh = np.zeros(len(self.data) + 1, bool)
        fresh[self.offsets] = True
        self.fresh = fresh

    def rows(self, positions: np.ndarray) -> np.ndarray:
        """The row in which each byte position lies."""
        return np.searchsorted(self.offsets, positions, "right") - 1

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximal runs of true bytes that don't cross a row: starts and ends."""
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = np.empty_like(inside)
        before[0] = False
        before[1:] = inside[:-1]
        starts = np.flatnonzero(inside & (~before | self.fresh[:-1]))
        after = np.empty_like(inside)
        after[-1] = False
        after[:-1] = inside[1:]
        ends = np.flatnonzero(inside & (~after | self.fresh[1:])) + 1
        return starts, ends

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.spans(~_SPACE[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each span's bytes."""
        if self._sums is None:
            up, _ = _power(len(self.data) + 1)
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_CODE[self.data] * up[: len(self.data)], out=self._sums[1:])
        _, down = _power(len(self.data) + 1)
        return mix((self._sums[ends] - self._sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n hashes; the last n-1 runs are missing."""
    m = max(0, len(h) - n + 1)
    out = np.full(m, n, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(_BASE) + h[k : k + m])
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of range(s, s + c)."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return np.arange(total, dtype=np.int64) + shift


def trim() -> None:
    """Gives this process' free memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not every C library has it
        pass


def tidy(run):
    """A function for mapInArrow or mapInPandas that gives its memory back to the system when its task ends.

    Python workers stay for later tasks, beside the heap of their executor.
    """

    @functools.wraps(run)
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return inner
