"""Words of many texts at once: Arrow text columns scanned as one byte array with NumPy."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are taken in runs of about this many bytes, which bounds the memory of a scan. A longer
#: text is a run of its own.
RUN_BYTES = 2 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads all bits (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64))


@cache
def _powers(bits: int) -> np.ndarray:
    return np.cumprod(np.full(1 << bits, _ODD), dtype=np.uint64)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


def space_table() -> np.ndarray:
    """Bytes between words: ASCII white space."""
    table = np.zeros(256, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


def gap_table() -> np.ndarray:
    """Bytes between words: ASCII other than letters and digits."""
    table = np.zeros(256, bool)
    table[:128] = [not chr(i).isalnum() for i in range(128)]
    return table


def text_runs(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of the rows in them) over runs of rows. Null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + RUN_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(column))
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total): words never cross texts."""
    inside = ~gaps[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    stops[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(stops) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: a polynomial over its bytes, mixed with its length."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    powers = _powers(max(4, int(lengths.max()).bit_length()))
    total = int(lengths.sum())
    first = np.cumsum(lengths) - lengths
    inner = np.arange(total) - np.repeat(first, lengths)
    terms = _byte_values()[data[np.repeat(starts, lengths) + inner]] * powers[inner]
    return mix(np.add.reduceat(terms, first) + lengths.astype(np.uint64))


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k words, one per start; fewer than k words have none."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(k):
        total = (total ^ words[i : i + n]) * _ODD + np.uint64(i + 1)
    return mix(total)
