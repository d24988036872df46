"""Whole texts as numpy arrays: words, lines and their 64-bit hashes, for many documents at once.

A slice of an Arrow string column is one run of UTF-8 bytes with offsets.
Hashes are polynomial sums modulo 2**64: the hash of any span is a difference
of two prefix sums, divided by the power at its start (the base is odd, so it
has an inverse), so a word, a line or an n-gram costs O(1) whatever its length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
GRAM_BASE = 0xC2B2AE3D27D4EB4F | 1
#: bytes of text worked on at once; a longer document makes a slice of its own
SLICE_BYTES = 1 << 19

_rng = np.random.default_rng(20240229)
BYTE_CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**i (or its inverse) modulo 2**64 for i < n; kept and grown by doubling."""
    have = _powers.get((base, inverse))
    if have is None or len(have) < n:
        b = pow(base, -1, 2**64) if inverse else base
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, b, dtype=np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[(base, inverse)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (splitmix64's finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values) + 1, dtype=values.dtype if values.dtype != bool else np.int64)
    np.cumsum(values, out=out[1:])
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (counts[0] of them), starts[1], ..."""
    before = prefix(counts)
    return np.arange(before[-1]) + np.repeat(starts - before[:-1], counts)


def span_hash(codes: np.ndarray, base: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of codes[start:end] for each span, independent of where it lies."""
    sums = prefix(codes * powers(base, len(codes)))
    raw = (sums[ends] - sums[starts]) * powers(base, len(codes) + 1, True)[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


class Texts:
    """Words of a run of documents: ``start`` and ``end`` bytes, ``doc`` and ``hash`` of each word;
    ``first`` has the index of every document's first word (one more entry than documents)."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool, gaps: np.ndarray = SPACE):
        self.data, self.offsets, self.n = (LOWER[data] if lower else data), offsets, len(offsets) - 1
        filled = ~gaps[self.data]
        begins, stops = filled.copy(), filled.copy()
        if len(data):
            begins[1:] &= ~filled[:-1]
            stops[:-1] &= ~filled[1:]
            inner = offsets[(offsets > 0) & (offsets < len(data))]
            begins[inner] = filled[inner]  # a word never runs over the end of its document
            stops[inner - 1] = filled[inner - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(stops) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.doc = np.repeat(np.arange(self.n), np.diff(self.first))
        self.hash = span_hash(BYTE_CODE[self.data], BASE, self.start, self.end)

    def per_doc(self, byte_mask: np.ndarray) -> np.ndarray:
        """How many bytes of each document the mask has."""
        return np.diff(prefix(byte_mask)[self.offsets])

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first word, hash) of every n-word window inside a document."""
        if len(self.hash) < n:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
        at = np.flatnonzero(self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :])
        return at, span_hash(self.hash, GRAM_BASE, at, at + n)


def slices(column: pa.Array | pa.ChunkedArray, lower: bool = False, limit: int = SLICE_BYTES, gaps: np.ndarray = SPACE) -> Iterator[tuple[int, int, Texts]]:
    """(first row, row after the last, their Texts); null is an empty text; ``gaps``: the bytes between words."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], dtype=width)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, dtype=np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, to, Texts(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], lower, gaps)
        at = to
    release()


def release() -> None:
    """Gives freed memory back to the system: Python workers live on between stages, beside the next one's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: the key occurs twice or more; the key occurred earlier."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice, later = np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=bool)
    later[order[1:]] = same
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    return twice, later


def cover(n: int, at: np.ndarray, length: int) -> np.ndarray:
    """Mask of positions inside any window [at, at + length)."""
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + length, -1)
    return np.cumsum(change[:-1]) > 0
