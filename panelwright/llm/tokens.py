"""Words and their hashes, read straight from Arrow's UTF-8 buffers with numpy.

Everything here works on one Arrow batch inside a Spark task.  A word is a maximal run of bytes
outside a separator table; since separators are ASCII, cutting the UTF-8 bytes is the same as
cutting the code points.  Long texts are hashed in blocks, so memory follows the number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_C1, _C2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * _C1
    x = (x ^ (x >> np.uint64(27))) * _C2
    return x ^ (x >> np.uint64(31))


def texts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, is null) of a string or binary Arrow column, with nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    null = np.asarray(column.is_null().to_numpy(zero_copy_only=False), bool)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    raw = column.buffers()
    if len(column) == 0 or raw[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64), null
    off = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None and raw[2].size else np.zeros(0, np.uint8)
    data, off = data[off[0] : off[-1]], off - off[0]
    if null.any() and (np.diff(off)[null] > 0).any():
        keep = np.repeat(~null, np.diff(off))
        data, off = data[keep], np.concatenate([[0], np.cumsum(np.where(null, 0, np.diff(off)))])
    return data, off, null


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each text) for all words; words never cross a text's bounds."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~gap[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    start = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.concatenate([inside[1:], [False]])
    end = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit hash of each word: the sum over its bytes of a hash of (place, byte), mixed."""
    out = np.zeros(len(start), np.uint64)
    salt = np.uint64(salt * 0x632BE59BD9B4E019 % 2**64)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + BLOCK, side="right")))
        s, size = start[lo:hi], end[lo:hi] - start[lo:hi]
        first = np.cumsum(size) - size
        place = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
        byte = data[np.repeat(s, size) + place]
        cell = mix(((place << 8) | byte).astype(np.uint64) * _GOLD + salt)
        out[lo:hi] = mix(np.add.reduceat(cell, first) + size.astype(np.uint64) * _GOLD)
        lo = hi
    return out


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` consecutive entries (they may cross texts: mask with `inner`)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD1342543DE82EF95) + words[k : k + n]
    return mix(out)


def inner(first: np.ndarray, size: int) -> np.ndarray:
    """Which runs of `size` words lie within one text."""
    total = int(first[-1]) if len(first) else 0
    ok = np.ones(max(0, total - size + 1), bool)
    for f in np.unique(first[1:-1]):
        ok[max(0, f - size + 1) : f] = False
    return ok


def text_of(first: np.ndarray, n: int) -> np.ndarray:
    """The text each of the first n words belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))[:n]
