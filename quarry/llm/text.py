"""Bytes, words and folds of Arrow batches, as NumPy arrays inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what separates words, as a Java regular expression for a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text handled at a time inside a task; arrays of eight bytes per text byte stay small.
PIECE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
LOWER = _LOWER.tobytes()
_BASE = np.uint64(0x9E3779B97F4A7C55)


def fold(doc_id: Column, parts: int = 5) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(parts)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column, and where each row begins and ends; a null row is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(offsets: np.ndarray, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes together, or one longer row."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def mixed(h: np.ndarray) -> np.ndarray:
    """The finishing step of splitmix64: every bit of the result depends on every bit given."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, count: int) -> np.ndarray:
    """1, base, base², … modulo 2^64."""
    known = _POWERS.get(base)
    if known is None or len(known) < count:
        known = np.full(max(count, PIECE + 1), base, np.uint64)
        known[0] = 1
        known = np.multiply.accumulate(known)
        if count <= 4 * PIECE:
            _POWERS[base] = known
    return known[:count]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def prefix_hash(data: np.ndarray, base: int) -> np.ndarray:
    """P with P[i] = sum of (byte + 1) * base^k over the first i bytes, modulo 2^64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def range_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of the bytes from each start to each end."""
    back = powers(inverse(base), len(prefix))
    plain = (prefix[ends] - prefix[starts]) * back[starts]
    return mixed(plain ^ ((ends - starts).astype(np.uint64) * _BASE))


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of every word, and where each row's words begin; words never cross rows."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before, after = np.empty_like(space), np.empty_like(space)
    before[0] = after[-1] = True
    before[1:], after[:-1] = space[:-1], space[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = True
    after[edges[edges > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, base: int = 0xD6E8FEB86659FD93) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word with A-Z lower-cased, and where each row's words begin."""
    starts, ends, rows = words(data, offsets)
    out = np.empty(len(starts), np.uint64)
    low = _LOWER[data]
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, side="right")))
        a, b = starts[first], ends[last - 1]
        prefix = prefix_hash(low[a:b], base)
        out[first:last] = range_hash(prefix, starts[first:last] - a, ends[first:last] - a, base)
        first = last
    return out, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of disjoint spans in order, made from stretches of about PIECE bytes."""
    out, first = np.empty(len(starts), np.uint64), 0
    while first < len(out):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + PIECE, side="right")))
        a, b = starts[first], ends[last - 1]
        prefix = prefix_hash(data[a:b], base)
        out[first:last] = range_hash(prefix, starts[first:last] - a, ends[first:last] - a, base)
        first = last
    return out
