"""Vectorised text kernels over Arrow batches: words, hashes and grouped counts with numpy.

A text column's Arrow buffers are viewed as one byte array with document offsets, and worked on in
slices of a few MB, so memory does not follow the batch. A document longer than a slice is a slice
of its own. Hashes of byte ranges come from prefix sums of a polynomial modulo 2**64, finished by a
mixer; they are the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 512 << 10
U = np.uint64
_P = 0x9E3779B97F4A7C15 | 1
_P_INVERSE = pow(_P, -1, 1 << 64)
#: The bytes 0x20 and 0x09 to 0x0D.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits all depend on all bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@lru_cache(maxsize=1)
def byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U) * U(_P))


_powers = (np.ones(1, dtype=U), np.ones(1, dtype=U))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_P**i and its inverse for i < n. What is kept stays near a slice's size."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + (64 << 10))
        with np.errstate(over="ignore"):
            made = tuple(np.concatenate([np.ones(1, dtype=U), np.cumprod(np.full(size, p, dtype=U))]) for p in (U(_P), U(_P_INVERSE)))
        if size > 4 * SLICE_BYTES:
            return made
        _powers = made
    return _powers


class Ranges:
    """Hashes of any byte ranges of data."""

    def __init__(self, data: np.ndarray):
        up, self.down = powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=U)
        np.cumsum(byte_values()[data] * up[: len(data)], out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def all_of(self, k: int) -> np.ndarray:
        """Hashes of every k bytes in a row, by start."""
        n = len(self.sums) - k
        return mix((self.sums[k:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, dtype=U)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) ^ ((end - start).astype(U) * U(0xD6E8FEB86659FD93)))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and its offsets. Null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    bytes_ = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First and last document (exclusive), bytes and offsets of each slice."""
    data, at = buffers(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + SLICE_BYTES, "right")) - 1)
        yield first, last, data[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def starts_ends(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True that do not cross documents."""
    n = len(inside)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before[at[at < n]] = False
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after[at[at > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def per_document(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of flags over the bytes of each document."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


class Words:
    """The words (runs without white space) of the documents of a slice."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False):
        self.data, self.at = LOWER[data] if lower else data, at
        self.space = SPACE[data]
        self.start, self.end = starts_ends(~self.space, at)
        #: Of each document, its first word's number; one more at the end.
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.ranges = Ranges(self.data)

    def hashes(self) -> np.ndarray:
        return self.ranges.of(self.start, self.end)

    def grams(self, n: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n words in a row within a document, by the first; and each one's document."""
        total = len(hashes) - n + 1
        document = np.repeat(np.arange(len(self.count)), self.count)
        if total <= 0:
            return np.zeros(0, dtype=U), np.zeros(0, dtype=np.int64)
        out = hashes[:total].copy()
        for j in range(1, n):
            out = mix(out * U(0xA0761D6478BD642F) + hashes[j : j + total])
        whole = document[:total] == document[n - 1 :]
        return out, np.where(whole, document[:total], -1)


def order_by_group(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """An order by group, then value."""
    order = np.argsort(values, kind="stable")
    return order[np.argsort(group[order], kind="stable")]
