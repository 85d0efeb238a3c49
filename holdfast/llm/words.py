"""Words of whole Arrow string columns at once, as numpy arrays.

Hashes are polynomials over a table of random 64-bit values per byte, taken from
prefix sums, so a word's hash does not depend on where it stands.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The bytes of [\x20\x09-\x0D], and of [\x00-\x2F\x3A-\x60\x7B-\x7F] once
# A-Z is lower-cased.
WHITE = tuple(range(0x09, 0x0E)) + (0x20,)
MARKS = tuple(range(0x00, 0x30)) + tuple(range(0x3A, 0x41)) + tuple(range(0x5B, 0x61)) + tuple(range(0x7B, 0x80))
SLICE_BYTES = 1 << 20


def separators(values: tuple[int, ...]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(values)] = True
    return table


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every input bit over the 64 bits (multiply and shift rounds)."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, text_col: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most ``most`` text bytes, or one row that has more."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    at, n = 0, len(sizes)
    ends = np.cumsum(sizes, dtype=np.int64)
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


@dataclass
class Words:
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # of each row: index of its first word; one more entry at the end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and row offsets; null is empty."""
    if pa.types.is_binary(column.type):
        column = column.cast(pa.string())
    column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    _, where, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def find_words(column: pa.Array, breaks: np.ndarray, lower: bool) -> Words:
    data, rows = utf8(column)
    if lower:
        table = np.arange(256, dtype=np.uint8)
        table[0x41:0x5B] += 0x20
        data = table[data]
    inside = ~breaks[data]
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        heads = rows[:-1][rows[:-1] < rows[1:]]
        start[heads] = inside[heads]
        tails = rows[1:][rows[:-1] < rows[1:]] - 1
        end[tails] = inside[tails]
    starts = np.flatnonzero(start)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, rows))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as many as were needed yet."""

    def __init__(self, seed: int = 0):
        self.base = (0x9E3779B97F4A7C15 + 0x6A09E667F3BCC908 * seed | 1) & (1 << 64) - 1
        self.up = self.down = np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            with np.errstate(over="ignore"):
                size = 1 << (n - 1).bit_length()
                for name, value in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                    powers = np.full(size, value, np.uint64)
                    powers[0] = 1
                    setattr(self, name, np.cumprod(powers, dtype=np.uint64))


class RunHash:
    """64-bit hashes of runs of values, from prefix sums of value times power."""

    def __init__(self, values: np.ndarray, powers: Powers | None = None):
        n = len(values)
        self.powers = powers or Powers()
        self.powers.grow(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(values * self.powers.up[:n], dtype=np.uint64, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            size = (end - start).astype(np.uint64)
            return mix((self.sums[end] - self.sums[start]) * self.powers.down[start] + size)


def byte_values() -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def span_hash(data: np.ndarray, powers: Powers | None = None) -> RunHash:
    """Hashes of byte ranges."""
    return RunHash(byte_values()[data], powers)


def word_hashes(words: Words, powers: Powers | None = None) -> np.ndarray:
    return span_hash(words.data, powers).of(words.start, words.end)


def run_hashes(hashes: np.ndarray, k: int, powers: Powers | None = None) -> np.ndarray:
    """Hash of every k consecutive entries (len - k + 1 of them)."""
    at = np.arange(max(0, len(hashes) - k + 1))
    return RunHash(hashes, powers).of(at, at + k)
