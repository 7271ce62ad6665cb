"""A run-length index of a bounded block of texts: run-compressed Burrows-Wheeler transform with sampled run ends."""

from __future__ import annotations

import numpy as np

from .hashing import _BYTE, _DOWN, _UP, mix

_U = np.uint64
#: Symbols of nine bits that fit a sort key.
_PACK = 7


class Text:
    """Hashes of any substrings of a text, from running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.data, self.n, self.sums, self.down = data, n, np.zeros(n + 1, _U), _DOWN.upto(n + 1)
        np.cumsum(_BYTE[data] * _UP.upto(n), out=self.sums[1:])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.down[starts] + (ends - starts).astype(_U))

    def grams(self, k: int) -> np.ndarray:
        return mix((self.sums[k:] - self.sums[: self.n + 1 - k]) * self.down[: self.n + 1 - k])


def _firsts(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first element of each element's run, and the size of that run; ``new`` marks the first elements."""
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(new)))
    return np.repeat(first, size), np.repeat(size, size)


def _changes(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])


def suffix_ranks(symbols: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The rank of each suffix, by prefix doubling of those that are still tied.

    ``stop`` is the place of the mark (symbol 0) that ends the text of each place; marks rank by place, before all bytes.
    """
    n = len(symbols)
    place = np.arange(n)
    key = np.zeros(n, np.int64)
    for j in range(_PACK):
        key = key << 9 | symbols[np.minimum(place + j, stop)]
    order = np.argsort(key, kind="stable")
    first, size = _firsts(_changes(key[order]))
    rank = np.empty(n, np.int64)
    rank[order] = first
    marks = np.flatnonzero(symbols == 0)
    rank[marks] = np.arange(len(marks))
    tied, depth = order[(size > 1) & (symbols[order] > 0)], _PACK
    while len(tied):
        key = rank[tied] * n + rank[np.minimum(tied + depth, stop[tied])]
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        group, _ = _firsts(_changes(key // n))
        first, size = _firsts(_changes(key))
        rank[tied] += first - group
        tied, depth = tied[size > 1], 2 * depth
    return rank


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of texts, with the suffixes at both ends of each run.

    Args: the bytes of all texts and the n + 1 offsets of the texts.  Texts are told apart by marks of their own, so no
    match crosses them.  Kept are the runs' symbols and lengths, the suffix at the first and last place of each run and
    the length that neighbours share across each boundary of runs; everything else follows from these samples.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        k = len(offsets) - 1
        length = np.diff(offsets)
        text = np.repeat(np.arange(k), length + 1)
        end = offsets[1:] + np.arange(k)
        self.n, self.starts = len(data) + k, end - length
        symbols = np.zeros(self.n, np.int64)
        inside = np.ones(self.n, bool)
        inside[end] = False
        symbols[inside] = data.astype(np.int64) + 1
        suffixes = np.empty(self.n, np.int64)
        suffixes[suffix_ranks(symbols, end[text])] = np.arange(self.n)
        before = np.concatenate([symbols[-1:], symbols[:-1]])
        before[self.starts] = -1 - np.arange(k)
        transform = before[suffixes]
        heads = np.flatnonzero(_changes(transform))
        self.symbols, self.lengths = transform[heads], np.diff(np.append(heads, self.n))
        self.first, self.last = suffixes[heads], suffixes[np.append(heads[1:], self.n) - 1]
        # Places in the text without marks, and how far each text goes on from there.
        a, b = self.last[:-1], self.first[1:]
        left = np.minimum(end[text[a]] - a, end[text[b]] - b)
        a, b = a - text[a], b - text[b]
        hashes, shared = Text(data).hashes, np.zeros(len(a), np.int64)
        for step in [1 << s for s in reversed(range(int(left.max(initial=0)).bit_length()))]:
            more = shared + step
            fits = np.flatnonzero(more <= left)
            same = fits[hashes(a[fits], a[fits] + more[fits]) == hashes(b[fits], b[fits] + more[fits])]
            shared[same] = more[same]
        self.shared = shared

    def _stream(self, places: np.ndarray, shared: np.ndarray) -> np.ndarray:
        """A neighbour's shared length at every place: it falls by one a place from each sample to the next."""
        order = np.argsort(places)
        places, shared = places[order], shared[order]
        size = np.diff(np.append(places, self.n))
        return np.repeat(shared + places, size) - np.arange(self.n)

    def matching_statistics(self) -> np.ndarray:
        """For each byte, the longest string from it on, inside its text, that starts anywhere else in the block too."""
        if not self.n:
            return np.zeros(0, np.int64)
        up = self._stream(self.first, np.concatenate([[0], self.shared]))
        down = self._stream(self.last, np.concatenate([self.shared, [0]]))
        keep = np.ones(self.n, bool)
        keep[self.starts[1:] - 1] = False
        keep[-1] = False
        return np.maximum(np.maximum(up, down), 0)[keep]
