"""Words and word shingles of whole texts as 64-bit fingerprints.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``; only A-Z are lower-cased. The
functions run inside Spark tasks on Arrow columns, a few MB of text at a time, and see
every byte of a text however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 500_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that looks random; another one for each salt."""
    h = h + np.uint64((salt * 0xD1B54A32D192ED03) & 0xFFFFFFFFFFFFFFFF)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(buffers[2], np.uint8)[offsets[0] : offsets[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, min(last, n)
        first = min(last, n)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, and for each row the index of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    begins[edges] |= inside[edges]
    at = np.flatnonzero(begins)
    rows = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), rows
    lengths = np.diff(np.append(at, len(data)))
    place = np.arange(at[0], len(data), dtype=np.int64)
    place -= np.repeat(at, lengths)
    place *= inside[at[0] :]
    powers = np.full(int(place.max()) + 1, _BASE, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    terms = (_LOWER[data[at[0] :]] + np.uint64(1)) * powers[place]
    terms *= inside[at[0] :]
    return mix(np.add.reduceat(terms, at - at[0])), rows


def _chain(words: np.ndarray, n: int, count: int) -> np.ndarray:
    h = words[:count] + np.uint64(n)
    for j in range(1, n):
        h = mix(h) * _BASE + words[j : j + count]
    return mix(h)


def shingles(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, n-word shingles of some rows in order, where each row's begin).

    A row of fewer than n words, but one at least, has its whole sequence as one shingle.
    """
    data, offsets = raw(column)
    for first, last in slices(offsets):
        part = offsets[first : last + 1]
        words, rows = word_hashes(data[part[0] : part[-1]], part - part[0])
        counts = np.diff(rows)
        grams = _chain(words, n, max(0, len(words) - n + 1))
        kept = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        bounds = np.concatenate(([0], np.cumsum(kept)))
        out = np.empty(bounds[-1], np.uint64)
        whole = counts >= n
        if whole.any():
            source = np.repeat(rows[:-1][whole] - bounds[:-1][whole], kept[whole])
            target = np.repeat(bounds[:-1][whole], kept[whole])
            target += np.arange(len(target)) - np.repeat(np.cumsum(kept[whole]) - kept[whole], kept[whole])
            out[target] = grams[source + target]
        for i in np.flatnonzero((counts > 0) & ~whole):
            out[bounds[i]] = _chain(words[rows[i] : rows[i + 1]], int(counts[i]), 1)[0]
        yield first, out, bounds


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingles) of every row, in order."""
    for first, grams, bounds in shingles(column, n):
        for i in range(len(bounds) - 1):
            yield first + i, np.unique(grams[bounds[i] : bounds[i + 1]])
