"""Vectorised words, lines and hashes over Arrow string batches.

A *word* is a maximal run of bytes other than space and U+0009..U+000D.  Those separators are ASCII, so byte
positions and code points cut UTF-8 text at the same places.  Hashes are 64-bit polynomial prefix hashes (one
cumulative sum per batch, so any span is hashed in constant time) finished with a splitmix64 mix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK_BYTES = 256 << 10  # some hundred bytes of arrays for each byte of text


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


BYTE_CODES = mix(np.arange(1, 257, dtype=_U) * _U(0xD1342543DE82EF95)) | _U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_CODES = BYTE_CODES[LOWER]
NON_SPACE = np.ones(256, dtype=bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False

_powers = np.ones(1, dtype=_U)
_inverses = np.ones(1, dtype=_U)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, _BASE, dtype=_U)
        steps[0] = 1
        _powers = np.cumprod(steps)
        steps[1:] = _INVERSE
        _inverses = np.cumprod(steps)
    return _powers, _inverses


@dataclass
class Texts:
    """Bytes of a run of documents; ``bounds[i]:bounds[i + 1]`` is document i."""

    data: np.ndarray
    bounds: np.ndarray

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i] : self.bounds[i + 1]].tobytes()


@dataclass
class Words:
    """Byte spans of words; words of document i are ``first[i]:first[i + 1]``."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """(from, to, texts) for runs of rows of about ``limit`` bytes; a longer text is a run of its own. Null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, Texts(raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
        lo = hi


def spans(texts: Texts, inside: np.ndarray) -> Words:
    """Maximal runs of positions where ``inside``, cut at document bounds."""
    n = len(texts.data)
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    cut = texts.bounds[:-1]
    before[cut[cut < n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    cut = texts.bounds[1:]
    after[cut[cut > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    return Words(start, end, np.searchsorted(start, texts.bounds))


def words(texts: Texts) -> Words:
    return spans(texts, NON_SPACE[texts.data])


def lines(texts: Texts) -> Words:
    """Lines split at newlines; lines without bytes are left out, which none of the uses here counts."""
    return spans(texts, texts.data != 10)


class SpanHash:
    """Hash of any byte span of one run of documents."""

    def __init__(self, texts: Texts, codes: np.ndarray = BYTE_CODES):
        n = len(texts.data)
        powers, self.inverses = _power_tables(n + 1)
        self.sums = np.zeros(n + 1, dtype=_U)
        np.cumsum(codes[texts.data] * powers[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverses[start])


def windows(hashes: np.ndarray, of: Words, size: int, short_whole: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows: (hash, position of first word, windows of document i at ``first[i]:first[i + 1]``).

    With ``short_whole`` a document of 1..size-1 words has its whole word sequence as its one window.
    """
    counts = of.counts
    full = np.maximum(counts - size + 1, 0)
    number = np.where((full == 0) & (counts > 0), 1, full) if short_whole else full
    first = np.concatenate([[0], np.cumsum(number)])
    at = np.arange(first[-1]) - np.repeat(first[:-1] - of.first[:-1], number)
    left = np.repeat(counts, number) - (np.arange(first[-1]) - np.repeat(first[:-1], number))
    total = np.zeros(len(at), dtype=_U)
    factor = 1
    for k in range(size):
        factor = factor * 0xC2B2AE3D27D4EB4F + 0x165667B19E3779F9 & (2**64 - 1) | 1
        if short_whole:
            there = left > k
            total[there] += hashes[at[there] + k] * _U(factor)
        else:
            total += hashes[at + k] * _U(factor)
    return mix(total), at, first


def per_document(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a 0/1 or integer array over consecutive ranges, empty ones included."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[bounds[1:]] - total[bounds[:-1]]
