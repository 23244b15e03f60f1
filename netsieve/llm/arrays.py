"""Arrow text batches as byte arrays: word bounds, line bounds and rolling hashes in numpy.

Words are runs of anything but space, tab, LF, VT, FF and CR. Those six bytes
never occur inside a UTF-8 sequence, so all bounds are found on raw bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes handled at a time (a longer single text is taken whole).
SLICE_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """64-bit finaliser (splitmix); ``salt`` makes independent hashes."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE_CODE = mix(np.arange(256, dtype=np.uint64), 77)


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES)
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if size <= 4 * SLICE_BYTES:
            _powers[base] = have
    return have[:n]


class RangeHash:
    """Hash of any byte range of one buffer: prefix sums of a polynomial over random byte codes."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * _power(_BASE, n), out=self.prefix[1:])
        self.back = _power(_INVERSE, n + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.prefix[end] - self.prefix[start]) * self.back[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """``of`` each range of ``width`` codes, by where it starts."""
        n = max(0, len(self.prefix) - width)
        raw = (self.prefix[width:] - self.prefix[:n]) * self.back[:n]
        return mix(raw + np.uint64(width * 0xD6E8FEB86659FD93 & _MASK))


def byte_hash(buf: np.ndarray) -> RangeHash:
    return RangeHash(_BYTE_CODE[buf])


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and n + 1 offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf, off


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes each."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def text_slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES):
    """(batch slice, buffer, offsets from 0) for each run of rows of about ``limit`` bytes."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        buf, off = text_bytes(batch.column(batch.schema.get_field_index(text)))
        for i, j in slices(off, limit):
            yield batch.slice(i, j - i), buf[off[i]: off[j]], off[i: j + 1] - off[i]


def word_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word."""
    n = len(buf)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    solid = ~SPACE[buf]
    first = np.zeros(n + 1, bool)
    first[off] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | first[1:n]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:] | first[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def line_bounds(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (without the newline) and row of each newline-split line; an empty text has one empty line."""
    newline = np.flatnonzero(buf == 10)
    row = np.searchsorted(off, newline, side="right") - 1
    start = np.concatenate([off[:-1], newline + 1])
    end = np.concatenate([newline, off[1:]])
    row_s = np.concatenate([np.arange(len(off) - 1), row])
    row_e = np.concatenate([row, np.arange(len(off) - 1)])
    start = start[np.lexsort((start, row_s))]
    order = np.lexsort((end, row_e))
    return start, end[order], row_e[order]


def word_grams(words: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within one row, and the index of its first word."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[: len(words) - n + 1] == row[n - 1:])
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = total * np.uint64(0xA0761D6478BD642F) + words[at + k]
    return mix(total, n), at


def per_row(row: np.ndarray, rows: int) -> np.ndarray:
    """Offsets of each row's run in an array sorted by row."""
    return np.searchsorted(row, np.arange(rows + 1))


def list_array(values: np.ndarray, offsets: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), pa.int32()), pa.array(values, kind))
