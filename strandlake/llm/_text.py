"""Vectorised text kernels: whole Arrow batches as one byte buffer, without a Python loop per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time, so that the temporaries of a kernel stay in the cache.
BLOCK = 1 << 21

_U = np.uint64


def splitmix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix64, on an array of unsigned 64-bit integers."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n odd 64-bit multipliers that depend on the seed only."""
    start = _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
    with np.errstate(over="ignore"):
        return splitmix(start + np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


BYTE = stream(1, 256)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_LOWER = np.where(SPACE, _U(0), BYTE[LOWER])
_places = stream(2, 256)


def places(n: int) -> np.ndarray:
    """A multiplier for each place within a word; the table grows to the longest word met."""
    global _places
    if n > len(_places):
        _places = stream(2, 1 << int(n - 1).bit_length())
    return _places


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = BYTE_LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each white-space separated word, its row, and its first byte, over all rows of a buffer."""
    n = len(data)
    if not n:
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    text = ~SPACE[data]
    first = text.copy()
    first[1:] &= ~text[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = text[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, _U), np.zeros(0, np.int64), starts
    gaps = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n, dtype=np.int64) - np.repeat(starts, gaps)
    value = table[data[starts[0] :]]
    longest = int(place[text[starts[0] :]].max()) + 1
    np.minimum(place, longest - 1, out=place)
    value *= places(longest)[place]
    hashes = splitmix(np.add.reduceat(value, starts - starts[0]))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, rows, starts


_STEP = stream(3, 64)


def shingles(word: np.ndarray, rows: np.ndarray, n_rows: int, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each row in order, and their bounds by row.

    A row of fewer words than k (but one at least) has its whole word sequence as one shingle.
    """
    counts = np.bincount(rows, minlength=n_rows)
    ends = np.cumsum(counts)
    n_shingles = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(n_shingles)])
    out = np.zeros(bounds[-1], dtype=_U)
    long = counts >= k
    if long.any():
        mixed = np.zeros(max(len(word) - k + 1, 0), dtype=_U)
        for i in range(k):
            mixed += word[i : len(word) - k + 1 + i] * _STEP[i]
        keep = np.zeros(len(word), dtype=bool)
        keep[: len(mixed)] = rows[: len(mixed)] == rows[k - 1 :]
        place = np.repeat(long, n_shingles)
        out[place] = splitmix(mixed[keep[: len(mixed)]])
    for r in np.flatnonzero((counts > 0) & ~long):
        w = word[ends[r] - counts[r] : ends[r]]
        h = (w * _STEP[: len(w)]).sum(dtype=_U, keepdims=True) + _STEP[32 + len(w)]
        out[bounds[r]] = splitmix(h)[0]
    return out, bounds


def list_column(values: np.ndarray, sizes: list[int] | np.ndarray) -> pa.Array:
    """An Arrow list<int64> column of the given row sizes."""
    offsets = np.concatenate([[0], np.cumsum(np.asarray(sizes, dtype=np.int64))]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
