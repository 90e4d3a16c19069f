"""Words and word windows of Arrow text columns as numpy arrays, without a Python object per word.

A word is a run of bytes other than space, tab, LF, VT, FF and CR, so words equal
``[^\\x20\\x09-\\x0D]+`` on the text. Hashes of word windows come from prefix sums of a
polynomial modulo 2**64 (the base is odd, hence invertible), then a final mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
_HASHED_BYTES = 128 << 10
_BASE = {0: (0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93), 1: (0xC2B2AE3D27D4EB4F, 0xA0761D6478BD642F)}
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=4)
def _byte_values(seed: int, fold: bool) -> np.ndarray:
    ids = np.arange(256, dtype=np.uint64)
    if fold:
        ids[65:91] += np.uint64(32)
    return mix(ids + np.uint64(1 + 1000 * (seed + 1)))


class _Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = np.uint64(base), np.uint64(pow(base, -1, 1 << 64))
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, size: int) -> _Powers:
        if len(self.up) < size:
            size = max(size, 1 << 16)
            for name, factor in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        return self


@lru_cache(maxsize=8)
def _powers(base: int) -> _Powers:
    return _Powers(base)


def rolling(values: np.ndarray, base: int) -> tuple[np.ndarray, _Powers]:
    """Prefix sums H with H[j] - H[i] = base**i * hash(values[i:j])."""
    powers = _powers(base).to(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers.up[: len(values)], out=sums[1:])
    return sums, powers


@dataclass
class Words:
    """Words of a block of texts: text ``i`` has the words ``first[i]:first[i + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @cached_property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @cached_property
    def text_of(self) -> np.ndarray:
        """Text number of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self, seed: int = 0, fold: bool = False) -> np.ndarray:
        """One 64-bit hash per word; ``fold`` takes A-Z as a-z."""
        values, raw, low = _byte_values(seed, fold), np.empty(len(self.start), np.uint64), 0
        # The hash of a word does not depend on its place, so a few bytes at a time do; the sums take eight bytes for each.
        while low < len(raw):
            from_byte = self.start[low]
            high = max(int(np.searchsorted(self.end, from_byte + _HASHED_BYTES, "right")), low + 1)
            start, end = self.start[low:high] - from_byte, self.end[low:high] - from_byte
            sums, powers = rolling(values[self.data[from_byte : self.end[high - 1]]], _BASE[seed][0])
            raw[low:high] = (sums[end] - sums[start]) * powers.down[start]
            low = high
        return mix(raw + (self.end - self.start).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))

    def windows(self, hashes: np.ndarray, width: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions (word numbers in the block) and hashes of all windows of ``width`` words inside one text."""
        if len(self.start) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        sums, powers = rolling(hashes, _BASE[seed][1])
        raw = (sums[width:] - sums[:-width]) * powers.down[: len(hashes) - width + 1]
        inside = self.text_of[width - 1 :] == self.text_of[: len(hashes) - width + 1]
        at = np.flatnonzero(inside)
        return at, mix(raw[at] + np.uint64(width))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64))
    inside = ~_SPACE[data]
    filled = np.flatnonzero(np.diff(offsets))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    at = offsets[:-1][filled]
    starts[at] = inside[at]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    at = offsets[1:][filled] - 1
    ends[at] = inside[at]
    start = np.flatnonzero(starts)
    return Words(data, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    ends = ends[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def blocks(batches, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Cut record batches into runs of rows of about ``limit`` text bytes: (rows, bytes, offsets).

    A single longer text is a run of its own, so working memory follows the longest text.
    """
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        low = 0
        while low < batch.num_rows:
            high = int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1
            high = min(max(high, low + 1), batch.num_rows)
            yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
            low = high
