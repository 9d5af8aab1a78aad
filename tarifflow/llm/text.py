"""Vectorised hashing of words and word n-grams over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D`` after lower-casing A-Z.
Whole texts are read; null texts count as empty.  Hashes are 64 bits wide: two
different n-grams of one document pair agree by chance with probability below 2**-40
even for texts of a million words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SHINGLE_WORDS = 5
#: Arrays over a slice take about 50 bytes for each of its bytes.
SLICE_BYTES = 1 << 19

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTES[_SPACE] = 0
_BASE = np.uint64(0xD6E8FEB86659FD93)
_ORDER = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def _powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n, 1), _BASE, dtype=np.uint64))))


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string or binary column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    n = len(column)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], data


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `most` bytes; a longer text stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j


def pieces(batch: pa.RecordBatch, text: int | str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of whole rows with about `most` bytes of text each, so that what a task makes of them is bounded."""
    offsets, _ = string_buffers(batch.column(text))
    for i, j in slices(offsets, most):
        yield batch.slice(i, j - i)


def word_spans(offsets: np.ndarray, data: np.ndarray, more: np.ndarray | None = None):
    """(hash, first byte and size of each word, first word of each text with the total last).

    `more`: bytes at which a word begins although no white space precedes.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n == 0:
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    low = _LOWER[data]
    space = _SPACE[low]
    cut = np.zeros(n, bool) if more is None else more.copy()
    cut[offsets[:-1][offsets[:-1] < n]] = True
    first = ~space
    first[1:] &= space[:-1] | cut[1:]
    starts = np.flatnonzero(first)
    if len(starts) == 0:
        return np.zeros(0, np.uint64), none, none, np.zeros(len(offsets), np.int64)
    spans = np.diff(np.append(starts, n))
    place = np.arange(starts[0], n, dtype=np.int64) - np.repeat(starts, spans)
    letters = (~space[starts[0] :]).astype(np.int64)
    sizes = np.add.reduceat(letters, starts - starts[0])
    place *= letters
    value = _BYTES[low[starts[0] :]] * _powers(int(sizes.max()))[place]
    hashes = mix(np.add.reduceat(value, starts - starts[0]) + sizes.astype(np.uint64))
    return hashes, starts, sizes, np.searchsorted(starts, offsets)


def word_hashes(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text with the total last)."""
    hashes, _, _, at = word_spans(offsets, data)
    return hashes, at


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every window of n words, across texts too: the caller drops those that cross."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        out += words[i : len(words) - n + 1 + i] * _ORDER[i]
    return mix(out + np.uint64(n))


def shingle_sets(column: pa.Array, n: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct n-word shingles of each text; fewer words make one shingle, none make none."""
    offsets, data = string_buffers(column)
    for i, j in slices(offsets):
        part = offsets[i : j + 1]
        words, at = word_hashes(part - part[0], data[part[0] : part[-1]])
        grams = gram_hashes(words, n)
        for a, b in zip(at[:-1], at[1:]):
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                yield gram_hashes(words[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)


def crc_bucket(ids, modulus: int):
    """crc32(doc_id as text) mod `modulus` as a Column."""
    from pyspark.sql import functions as F

    return F.crc32(ids.cast("string").cast("binary")) % modulus
