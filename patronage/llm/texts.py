"""Reading tables and turning Arrow text columns into arrays of words and hashes.

The array helpers work on one Arrow batch at a time inside a task. Hashes are a polynomial over
random byte values modulo 2**64 with a finishing mix: the same on every machine, and independent
of where in a buffer a word stands.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PIECE_BYTES = 1 << 20

# What separates words when text is cut at white space, and what A-Z become.
SPACES = b"\x09\x0a\x0b\x0c\x0d\x20"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[list(SPACES)] = False

_BASE = 0x9E3779B97F4A7C15 | 1
_WRAP = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[str, np.ndarray] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit value over the whole value."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BYTE_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = len(_powers["up"]) if _powers else 0
    if have < n:
        n = max(n, PIECE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(n, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"], _powers["down"]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the bounds of its texts; a null is an empty text."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)
    bounds = bounds[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[bounds[0]:bounds[-1]], bounds - bounds[0]


def pieces(bounds: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with at most ``limit`` bytes together, or one longer text."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def word_hashes(data: np.ndarray, bounds: np.ndarray, word_byte: np.ndarray = NOT_SPACE,
                fold: np.ndarray = FOLD) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for every word, and where each text's words begin (one bound more).

    A word is a longest run of bytes marked in ``word_byte`` inside one text.
    """
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(bounds), np.int64)
    inside = np.zeros(n + 2, np.int8)
    inside[1:-1] = word_byte[data]
    begins = inside[1:-1] > inside[:-2]
    ends = inside[1:-1] > inside[2:]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    begins[cuts] |= inside[cuts + 1] > 0
    ends[cuts - 1] |= inside[cuts] > 0
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    return span_hashes(data, start, end + 1, fold), np.searchsorted(start, bounds)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray,
                fold: np.ndarray | None = None) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span stands."""
    n = len(data)
    up, down = _power_tables(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    value = _BYTE_VALUE if fold is None else _BYTE_VALUE[fold]
    np.cumsum(value[data] * up[:n], out=total[1:])
    return mix64((total[end] - total[start]) * down[start])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans (start, length), one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def shingle_hashes(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words of each text; a shorter text is one run of all its words."""
    counts = np.diff(bounds)
    sizes = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    text_of = np.repeat(np.arange(len(counts)), sizes)
    at = bounds[text_of] + (np.arange(out_bounds[-1]) - out_bounds[text_of])
    length = np.minimum(counts, size)[text_of]
    out = length.astype(np.uint64)
    for j in range(size):
        has = j < length
        step = words[np.minimum(at + j, max(len(words) - 1, 0))] if len(words) else out
        out = np.where(has, mix64(out * np.uint64(_BASE) + step), out)
    return out, out_bounds
