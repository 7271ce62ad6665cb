"""Words and word shingles as 64-bit hashes, a batch of texts at a time (helpers inside tasks)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are hashed at a time.
CHUNK = 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every bit of x over all bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * _U(0xD1B54A32D192ED03))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20
#: Keeps the first 0 to 8 bytes of a number read from bytes in order.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], _U)
#: Longer words are hashed one by one.
LONG_WORD = 256


class _Powers:
    """Powers of an odd number modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.values = _U(base), np.ones(1, _U)

    def upto(self, n: int) -> np.ndarray:
        while len(self.values) < n:
            step = self.values[-1:] * self.base
            self.values = np.concatenate([self.values, self.values * step])
        return self.values[:n]


_UP, _DOWN = _Powers(_BASE), _Powers(_BASE_INVERSE)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column (nulls: none) and the n + 1 offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    return data[first:last], (offsets - first if len(offsets) else np.zeros(1, np.int64))


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of whole rows of about ``size`` bytes; a longer row is a run of its own."""
    data, offsets = as_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first and end bytes of the words of rows, and the n + 1 offsets of each row's words.

    Words are runs of bytes other than 0x20 and 0x09-0x0D; ``lower`` folds A-Z.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, _U), none, none, np.zeros(len(offsets), np.int64)
    word = np.zeros(n + 1, bool)
    np.logical_not(_SPACE[data], out=word[:n])
    fresh = np.zeros(n + 1, bool)
    fresh[offsets] = True
    before = np.empty(n + 1, bool)
    before[0], before[1:] = False, word[:-1]
    starts = np.flatnonzero(word & (~before | fresh))
    ends = np.flatnonzero(before & (~word | fresh))
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _FOLD[data] if lower else data
    return _word_hashes(padded, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def _word_hashes(padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Takes in eight bytes of every word at a time and mixes after each, so that no two words meet by arithmetic."""
    eight = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    left = ends - starts
    hashes = mix(left.astype(_U) + _U(0x51ED270B))
    long = np.flatnonzero(left > LONG_WORD)
    for i in long.tolist():
        hashes[i] = int.from_bytes(hashlib.blake2b(padded[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    left[long] = 0
    live, at = np.flatnonzero(left), 0
    while len(live):
        read = eight[starts[live] + at] & _FIRST[np.minimum(left[live] - at, 8)]
        hashes[live] = mix(hashes[live] * _U(0xC2B2AE3D27D4EB4F) ^ read)
        at += 8
        live = live[left[live] > at]
    return hashes


def join_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each k words in a row."""
    out = np.zeros(max(0, len(words) - k + 1), _U)
    for i in range(k):
        out = out * _U(0xC2B2AE3D27D4EB4F) + (words[i : len(words) - k + 1 + i] ^ _U(0x165667B19E3779F9 * (i + 1) & (1 << 64) - 1))
    return mix(out)


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct k-word shingles, hashed; fewer words than k are one shingle, none are none."""
    for _, data, offsets in chunks(column):
        words, _, _, rows = word_hashes(data, offsets)
        joined = join_hashes(words, k)
        for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(joined[a : b - k + 1])
            elif b > a:
                yield join_hashes(words[a:b], b - a) ^ _U(b - a)
            else:
                yield words[:0]
