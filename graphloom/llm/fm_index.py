"""An FM-index over sequences of numbers: the Burrows-Wheeler transform in a wavelet matrix of packed bits,
searched backward for many sequences at once. It holds what a task was given, and nothing of Spark."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """A sequence of numbers below 1 << levels, a packed row of bits for each of their bits, with counts of ones before each 64 of them."""

    def __init__(self, sequence: np.ndarray, levels: int):
        self.levels, self.rows = levels, []
        for level in range(levels - 1, -1, -1):
            bits = ((sequence >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate((bits, np.zeros(64 + -len(bits) % 64, bool))), bitorder="little").view(np.uint64)
            before = np.concatenate(([0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)))
            self.rows.append((level, packed, before, len(bits) - int(bits.sum())))
            sequence = np.concatenate((sequence[~bits], sequence[bits]))

    def follow(self, numbers: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Where the place before which a prefix ends comes to lie when the sequence is sorted by bits: what it says of number is how often that occurs in the prefix."""
        for level, packed, before, zeros in self.rows:
            word = places >> 6
            ones = before[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)))
            places = np.where((numbers >> level) & 1, zeros + ones, places - ones)
        return places


class FMIndex:
    """sequences, each of an owner, in compressed form; matches are followed up to threshold numbers.

    Sequences are joined behind separators that no search names. Suffixes are ordered by their first 2 * threshold numbers at least,
    which is as deep as searches go.
    """

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, threshold: int):
        text = np.concatenate([np.concatenate((s + 1, [0])) for s in sequences]).astype(np.int64)
        self.threshold, self.n, self.symbols = threshold, len(text), int(text.max()) + 1
        ranks = [text]  # by the first 1, 2, 4, ... numbers
        while 1 << (len(ranks) - 1) <= threshold:
            far = np.roll(ranks[-1], -(1 << (len(ranks) - 1)))
            ranks.append(np.unique(ranks[-1] * (int(ranks[-1].max()) + 1) + far, return_inverse=True)[1])
        suffixes = np.argsort(ranks[-1], kind="stable")
        self.common = self._common(ranks, suffixes)
        # suffixes that share threshold numbers stand side by side: a block
        first = np.flatnonzero(self.common[:-1] < threshold)
        self.block = np.repeat(np.arange(len(first)), np.diff(np.append(first, self.n)))
        self.block_edges = np.append(first, self.n)
        self.least = np.minimum.reduceat(np.repeat(owners, [len(s) + 1 for s in sequences])[suffixes], first)
        self.tree = WaveletMatrix(text[suffixes - 1], self.symbols.bit_length())
        every = np.arange(self.symbols)
        counts = np.bincount(text, minlength=self.symbols)
        self.shift = np.cumsum(counts) - counts - self.tree.follow(every, np.zeros(self.symbols, np.int64))
        self._lows: list[np.ndarray] | None = None

    @staticmethod
    def _common(ranks: list[np.ndarray], suffixes: np.ndarray) -> np.ndarray:
        """How many first numbers each suffix shares with the one ordered before it, as far as ranks tell; 0 at both ends."""
        a, b, n = suffixes[:-1].copy(), suffixes[1:].copy(), len(suffixes)
        shared = np.zeros(n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            same = ranks[k][a] == ranks[k][b]
            for x in (a, b):
                x[same] = (x[same] + (1 << k)) % n
            shared[same] += 1 << k
        return np.concatenate(([0], shared, [0]))

    def _widen(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest ranges around [low, high) whose suffixes share depth numbers."""
        if self._lows is None:  # least of the 1, 2, 4, ... values from each place
            self._lows = [self.common]
            while 2 << (len(self._lows) - 1) <= self.n:
                half = self._lows[-1]
                self._lows.append(np.minimum(half[: len(half) - (1 << (len(self._lows) - 1))], half[1 << (len(self._lows) - 1) :]))
        for k in range(len(self._lows) - 1, -1, -1):
            values, size = self._lows[k], 1 << k
            at = low - size + 1
            low = np.where((at > 0) & (values[np.clip(at, 0, len(values) - 1)] >= depth), low - size, low)
            high = np.where((high + size <= self.n) & (values[np.clip(high, 0, len(values) - 1)] >= depth), high + size, high)
        return low, high

    def matches(self, queries: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each place of each query: how many numbers from there on, up to threshold, stand somewhere in the index, and, where that is threshold, their smallest owner (else -1).

        Numbers the index lacks may be -1 or beyond. Queries are read from their ends: a step adds the number before what is
        matched, and where that occurs nowhere, drops numbers from the end until it does.
        """
        order = sorted(range(len(queries)), key=lambda k: -len(queries[k]))
        sizes = np.array([len(queries[k]) for k in order])
        longest = int(sizes[0]) if len(sizes) else 0
        numbers = np.full((len(order), longest), -1, np.int64)  # by distance from the end
        for row, k in enumerate(order):
            numbers[row, : sizes[row]] = queries[k][::-1] + 1
        numbers[(numbers <= 0) | (numbers >= self.symbols)] = -1
        lengths, owners = np.zeros((len(order), longest), np.int64), np.full((len(order), longest), -1, np.int64)
        low, high, depth = np.zeros(len(order), np.int64), np.full(len(order), self.n), np.zeros(len(order), np.int64)
        for step in range(longest):
            active = int(np.searchsorted(-sizes, -step, side="left"))
            todo = np.arange(active)
            unknown = todo[numbers[todo, step] < 0]
            low[unknown], high[unknown], depth[unknown] = 0, self.n, 0
            todo = todo[numbers[todo, step] >= 0]
            while len(todo):
                c = numbers[todo, step]
                ends = self.tree.follow(np.concatenate((c, c)), np.concatenate((low[todo], high[todo]))) + np.tile(self.shift[c], 2)
                a, b = ends[: len(todo)], ends[len(todo) :]
                found = a < b
                done = todo[found]
                low[done], high[done] = a[found], b[found]
                depth[done] += 1
                todo = todo[~found]
                todo = todo[depth[todo] > 0]
                if len(todo):  # up to the longest shorter match with more places
                    depth[todo] = np.maximum(self.common[low[todo]], self.common[high[todo]])
                    low[todo], high[todo] = self._widen(low[todo], high[todo], depth[todo])
            deep = np.flatnonzero(depth[:active] > self.threshold)
            blocks = self.block[low[deep]]
            low[deep], high[deep], depth[deep] = self.block_edges[blocks], self.block_edges[blocks + 1], self.threshold
            lengths[:active, step] = depth[:active]
            full = np.flatnonzero(depth[:active] == self.threshold)
            owners[full, step] = self.least[self.block[low[full]]]
        out: list = [None] * len(queries)
        for row, k in enumerate(order):
            out[k] = (lengths[row, : sizes[row]][::-1], owners[row, : sizes[row]][::-1])
        return out
