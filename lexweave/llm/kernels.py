"""Vectorised byte kernels shared by the document operators.

Everything here works on one *slice*: the UTF-8 bytes of some documents laid end to end in a numpy array,
with offsets.  A slice holds about a megabyte; a longer document is a slice of its own, which the operators
walk in windows, so memory stays bounded whatever the Arrow batch size is.

Hashes are 64 bits wide and read eight bytes at a time; each step scrambles the state before the next bytes
enter, so no sum or polynomial over the bytes is left in which regular texts cancel out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1_000_000
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 2048
_M1, _M2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: A-Z to a-z, other bytes as they are.
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    y = x >> np.uint64(30)
    y ^= x
    y *= _M1
    y ^= y >> np.uint64(27)
    y *= _M2
    y ^= y >> np.uint64(31)
    return y


def joined(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The state after value; the order counts."""
    out = state * _STEP
    out += value
    return mix(out)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; zeros follow the last byte."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes have equal hashes wherever they stand."""
    view, size = eights(data), ends - starts
    out = joined(size.astype(np.uint64), view[starts] & _KEEP[np.minimum(size, 8)])
    for k in np.flatnonzero(size > LONG_SPAN):
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8).digest(), "little")
    more = np.flatnonzero((size > 8) & (size <= LONG_SPAN))
    done = 8
    while len(more):
        out[more] = joined(out[more], view[starts[more] + done] & _KEEP[np.minimum(size[more] - done, 8)])
        done += 8
        more = more[size[more] > done]
    return out


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of data[i : i + width] for each i < len(data) - width + 1, with width >= 8."""
    return widened(mix(eights(data)[: max(0, len(data) - 7)]), 8, width)


def widened(hashes: np.ndarray, have: int, width: int) -> np.ndarray:
    """window_hashes() of a greater width from those of a smaller one: each is made of two."""
    while have < width and len(hashes):
        step = min(have, width - have)
        hashes = joined(hashes[: max(0, len(hashes) - step)], hashes[step:])
        have += step
    return hashes


def word_table(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes inside each document, and the count by document."""
    inside = table[data]
    before, after = np.empty_like(inside), np.empty_like(inside)
    if len(data):
        before[0] = after[-1] = False
        before[1:], after[:-1] = inside[:-1], inside[1:]
        lo, hi = offsets[:-1], offsets[1:]
        full = hi > lo
        before[lo[full]] = False
        after[hi[full] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def windows(data: np.ndarray, table: np.ndarray) -> Iterator[tuple[int, int]]:
    """(from, to) of pieces of one document of about SLICE_BYTES that cut no word; a piece ends with a longer word."""
    at, n, limit = 0, len(data), SLICE_BYTES
    while at < n:
        to = min(n, at + limit)
        while to < n and table[data[to]] and table[data[to - 1]]:
            gap = np.flatnonzero(~table[data[to : to + limit]])
            to = to + int(gap[0]) if len(gap) else min(n, to + limit)
        yield at, to
        at = to


def hashed_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, fold: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the count by document."""

    def each(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, counts = words(data, offsets, table)
        return span_hashes(FOLD[data] if fold else data, starts, ends), counts

    if len(data) <= 2 * SLICE_BYTES or len(offsets) > 2:
        return each(data, offsets)
    parts = [each(data[a:b], np.array([0, b - a])) for a, b in windows(data, table)]
    return np.concatenate([p[0] for p in parts]), sum(p[1] for p in parts)


def slices(column: pa.Array | pa.ChunkedArray, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, one past the last row, bytes, offsets from 0) for runs of rows; nulls are empty; a longer text is a run of its own."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.empty(0, np.uint8)
    at, limit = 0, limit or SLICE_BYTES
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        to = min(to, n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to
