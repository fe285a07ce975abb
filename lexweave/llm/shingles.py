"""Word-shingle sets and HyperMinHash registers of documents, computed a slice at a time."""

from __future__ import annotations

import numpy as np

from lexweave.llm.kernels import SLICE_BYTES, hashed_words, joined, mix, word_table

#: Words are maximal runs of other bytes than these (a fixed value of the contract).
SPACES = word_table(b"\x20\x09\x0a\x0b\x0c\x0d")
MANTISSA_BITS = 4
EMPTY = np.uint8(0xFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of the distinct shingles, sorted by both.

    A document with fewer words than width, but not none, has its whole word sequence as one shingle.
    """
    coded, counts = hashed_words(data, offsets, SPACES, fold=True)
    if not len(coded):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    if len(counts) == 1 and len(coded) > SLICE_BYTES:  # a long document: piece by piece
        parts = [coded[k : k + SLICE_BYTES + width - 1] for k in range(0, len(coded) - width + 1, SLICE_BYTES)]
        value = np.unique(np.concatenate([np.unique(shingles(part, np.array([len(part)]), width)[1]) for part in parts]))
        return np.zeros(len(value), np.int64), value
    doc, value = shingles(coded, counts, width)
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def shingles(coded: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(document index, hash) of all shingles of the words with these hashes."""
    first = np.cumsum(counts) - counts
    taken = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(counts)), taken)
    at = np.arange(taken.sum()) - np.repeat(np.cumsum(taken) - taken, taken) + first[doc]
    span = np.minimum(counts, width)[doc]
    short = (counts[counts > 0] < width).any()
    value = mix(span.astype(np.uint64))
    for k in range(width):
        longer = joined(value, coded[np.minimum(at + k, len(coded) - 1)])
        value = np.where(k < span, longer, value) if short else longer
    return doc, value


def registers(doc: np.ndarray, value: np.ndarray, n_docs: int, buckets: int) -> np.ndarray:
    """HyperMinHash registers, a byte each: by bucket of a document the leading zeros of its least value (4 bits) and the bits after the first one (4 bits).

    doc and value are sorted, so the least value of a bucket (the top bits) is the first of its run.
    """
    bits = buckets.bit_length() - 1
    out = np.full((n_docs, buckets), EMPTY)
    if not len(doc):
        return out
    cell = doc * buckets + (value >> np.uint64(64 - bits)).astype(np.int64)
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]
    cell, rest = cell[new], value[new] << np.uint64(bits)
    high = (rest >> np.uint64(32)).astype(np.float64)
    zeros = np.minimum(32 - np.frexp(high)[1], 14)  # 32 bits are enough for documents of 2**14 * buckets shingles
    mantissa = (rest << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA_BITS)
    out.reshape(-1)[cell] = (zeros.astype(np.uint8) << np.uint8(MANTISSA_BITS)) | mantissa.astype(np.uint8)
    return out


_borrowed: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def dense(regs: np.ndarray, columns: int, tries: int = 24) -> np.ndarray:
    """The first columns registers, empty ones filled from others: each has its own random order of all buckets and borrows from the first filled one.

    The order is some draws, made at once for all documents, and past them a permutation for those that are
    still empty.  No two registers share an order, so those of a small set fail to agree independently, too,
    and the chance that two documents agree in one is their similarity.
    """
    buckets = regs.shape[1]
    if buckets not in _borrowed:
        rnd = np.random.default_rng(77)
        draws = rnd.integers(0, buckets, (tries, buckets))
        _borrowed[buckets] = draws, rnd.permuted(np.tile(np.arange(buckets, dtype=np.uint16)[:, None], (1, buckets)), axis=0)
    draws, place = _borrowed[buckets]  # place[bucket, register]: where the bucket stands in the register's order
    out = regs[:, :columns].copy()
    for order in draws[:, :columns]:
        gap = out == EMPTY
        if not gap.any():
            return out
        out = np.where(gap, regs[:, order], out)
    filled = regs != EMPTY
    count = filled.sum(axis=1)
    late = np.flatnonzero((out == EMPTY).any(axis=1) & (count > 0))
    for n in np.unique(count[late]):
        step = max(1, (1 << 21) // (int(n) * columns))
        same = late[count[late] == n]
        for k in range(0, len(same), step):
            rows = same[k : k + step]
            have = np.nonzero(filled[rows])[1].reshape(len(rows), n)
            first = np.take_along_axis(have, place[have, :columns].argmin(axis=1), axis=1)
            out[rows] = np.where(out[rows] == EMPTY, np.take_along_axis(regs[rows], first, axis=1), out[rows])
    return out


def band_keys(regs: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(documents x bands) keys of bands of densified registers; documents without shingles have keys that mean nothing."""
    parts = dense(regs, bands * rows).reshape(len(regs), bands, rows)
    total = np.tile(np.arange(bands, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93), (len(regs), 1))
    for k in range(rows):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k].astype(np.uint64) + np.uint64(k + 1))
    return total.view(np.int64)
