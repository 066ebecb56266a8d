"""Vectorised word splitting and 64-bit hashing over Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Texts are handled in slices of about so many bytes, which bounds a worker's memory.
SLICE_BYTES = 1 << 19

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(kind: str) -> np.ndarray:
    """256 bytes: 0 for a separator, else the byte with A-Z in lower case.

    ``space``: words are runs without U+0020 and U+0009 to U+000D.
    ``alnum``: words are runs of 0-9, a-z and everything from U+0080.
    """
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    if kind == "space":
        t[[32, *range(9, 14)]] = 0
        t[0] = 255  # NUL belongs to a word; 255 doesn't occur in UTF-8
    else:
        keep = np.zeros(256, bool)
        keep[48:58] = keep[65:91] = keep[97:123] = keep[128:] = True
        t[~keep] = 0
    return t


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    p = np.uint64(0x5851F42D4C957F2D)
    inverse = np.uint64(pow(int(p), -1, 1 << 64))
    up, down = np.full(n, p), np.full(n, inverse)
    up[0] = down[0] = 1
    letters = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    return np.multiply.accumulate(up), np.multiply.accumulate(down), letters


def hash_words(data: np.ndarray, bounds: np.ndarray, lut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends, first word of each text and the total).

    ``data`` holds the texts one after another, ``bounds`` their byte offsets
    (one more than texts).  A word's hash is a polynomial over its bytes, made
    from prefix sums modulo 2**64 and finalised with its length.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 2, np.zeros(len(bounds), np.int64)
    up, down, letters = _powers(max(2 * SLICE_BYTES, 1 << int(n).bit_length()))
    low = lut[data]
    inside = low != 0
    cut = np.zeros(n + 1, bool)
    cut[bounds] = True
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1] | cut[1:-1]
    ends[:-1] &= ~inside[1:] | cut[1:-1]
    s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(letters[low] * up[:n], out=sums[1:])
    h = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _ODD)
    return h, s, e, np.searchsorted(s, bounds)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None and o[-1] > o[0] else np.zeros(0, np.uint8)
    return d, o - o[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Row ranges of about ``size`` bytes of text: (rows, bytes, offsets)."""
    for batch in batches:
        data, offsets = utf8(batch.column(column))
        row, n = 0, batch.num_rows
        while row < n:
            last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
            last = min(last, n)
            yield batch.slice(row, last - row), data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
            row = last


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Row ranges of bounded size, so that Python objects are made for a few rows at a time."""
    for rows, _, _ in slices(batches, column):
        yield rows
