"""Sums over keys that blocks of documents hold, sent as packed arrays.

A block (some millions of tokens, handled by one task at a time) sends its sorted
distinct keys with a value each, cut into buckets by key range.  A bucket adds up the
values of equal keys of all blocks and answers each block with the sums of its own keys,
in its order.  A key occurs once a block however often its documents hold it, so no key
makes a bucket large, and a row is sent per (block, bucket) instead of per key.
"""

from __future__ import annotations

import numpy as np
import zstandard

PARTS = "block bigint, kind int, bucket int, keys binary, amounts binary"
ANSWERS = "block bigint, kind int, bucket int, answer binary"


def pack(values: np.ndarray) -> bytes:
    """Bytes by place, compressed; small numbers cost little."""
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), -1).T.tobytes()) if len(values) else b""


def unpack(data: bytes, kind) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return planes.reshape(size, -1).T.copy().view(kind).ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def bucket_cuts(keys: np.ndarray, bits: int, buckets: int) -> np.ndarray:
    """Where each of `buckets` equal ranges of `bits`-bit keys begins in sorted `keys`, and the end."""
    width = -(-(1 << bits) // buckets)
    return np.append(np.searchsorted(keys, np.arange(buckets, dtype=np.uint64) * np.uint64(width)), len(keys))


def parts(block: int, kind: int, keys: np.ndarray, amounts: np.ndarray, bits: int, buckets: int):
    """Rows of PARTS for one block's sorted distinct keys."""
    cuts = bucket_cuts(keys, bits, buckets)
    for b in np.flatnonzero(np.diff(cuts)):
        s = slice(cuts[b], cuts[b + 1])
        yield block, kind, int(b), pack_sorted(keys[s]), pack(amounts[s])


def add_up(keys: list[bytes], amounts: list[bytes], kind) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """(sums by distinct key, each part's indices into them, each part's amounts)."""
    unpacked = [unpack_sorted(k) for k in keys]
    values = [unpack(a, kind) for a in amounts]
    _, inverse = np.unique(np.concatenate(unpacked), return_inverse=True)
    sums = np.bincount(inverse, np.concatenate(values).astype(np.float64))
    at = np.cumsum([len(k) for k in unpacked])[:-1]
    return sums, np.split(inverse, at), values
