"""An FM-index over integer sequences: backward search through wavelet ranks, locating by sampled suffix positions."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with ranks: the bits in words of 64, and the ones before each word."""

    def __init__(self, bits: np.ndarray) -> None:
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words) + 1, np.int32)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ones stand before each position."""
        word, rest = at >> 6, (at & 63).astype(np.uint64)
        inside = self.words[word] & ((np.uint64(1) << rest) - np.uint64(1))
        return self.before[word] + np.bitwise_count(inside).astype(np.int64)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(bool)


class WaveletMatrix:
    """Ranks of symbols in a sequence, one bit vector for each bit, for whole arrays of queries at once."""

    def __init__(self, values: np.ndarray, largest: int) -> None:
        self.levels: list[tuple[int, Bits, int]] = []
        now = values
        for bit in range(max(1, int(largest).bit_length()) - 1, -1, -1):
            ones = ((now >> bit) & 1).astype(bool)
            self.levels.append((bit, Bits(ones), len(now) - int(np.count_nonzero(ones))))
            now = np.concatenate([now[~ones], now[ones]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        start, end = np.zeros_like(at), at
        for bit, bits, zeros in self.levels:
            one = ((symbols >> bit) & 1).astype(bool)
            a, b = bits.rank(start), bits.rank(end)
            start = np.where(one, zeros + a, start - a)
            end = np.where(one, zeros + b, end - b)
        return end - start

    def access(self, at: np.ndarray) -> np.ndarray:
        value = np.zeros_like(at)
        for bit, bits, zeros in self.levels:
            one, before = bits.get(at), bits.rank(at)
            value = value | (one.astype(value.dtype) << bit)
            at = np.where(one, zeros + before, at - before)
        return value


def _ranked(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of each suffix of sorted keys: the place of the first suffix with its key."""
    new = np.empty(len(keys), bool)
    new[:1] = True
    np.not_equal(keys[1:], keys[:-1], out=new[1:])
    return np.maximum.accumulate(np.where(new, at, 0))


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of a text in which every 0 ends a sequence and sorts by its position (the last symbol is 0).

    The first sort compares as many symbols as fit one 63-bit key; then prefix doubling, where after each round only the
    suffixes whose rank is still shared are sorted again."""
    n = len(text)
    ends = np.flatnonzero(text == 0)
    symbols = text.astype(np.int64) + len(ends)
    symbols[ends] = np.arange(len(ends))
    bits = max(1, int(symbols.max(initial=1)).bit_length())
    step = max(1, 63 // bits)
    keys = symbols.copy()
    for k in range(1, step):  # what follows an end can't matter: ends differ
        keys <<= bits
        keys[: max(0, n - k)] |= symbols[k:]
    order = np.argsort(keys)
    places = _ranked(keys[order], np.arange(n))
    rank = np.empty(n, np.int64)
    rank[order] = places
    del keys, symbols
    while True:
        shared = np.empty(n, bool)
        shared[-1:] = False
        np.equal(places[1:], places[:-1], out=shared[:-1])
        shared[1:] |= shared[:-1].copy()
        at = np.flatnonzero(shared)
        if not len(at):
            return order
        own = order[at]
        # A shared suffix can't meet an end within the compared length (ends differ), so own + step is in range.
        keys = places[at] * np.int64(n + 1) + rank[own + step]
        sort = np.argsort(keys)
        order[at] = own[sort]
        places[at] = _ranked(keys[sort], at)
        rank[order[at]] = places[at]
        step *= 2


class FMIndex:
    """Of a text of symbols 1..largest in which 0 ends every sequence (the last symbol is 0)."""

    def __init__(self, text: np.ndarray, largest: int, sample: int = 16) -> None:
        order = suffix_order(text)
        n = len(text)
        self.bwt = WaveletMatrix(text[order - 1], largest)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=largest + 1))]).astype(np.int64)
        # Every sample-th position is kept, and every sequence's start: walking back never leaves a sequence.
        keep = np.zeros(n, bool)
        keep[::sample] = True
        keep[0] = True
        keep[1:][text[:-1] == 0] = True
        marked = keep[order]
        self.marks = Bits(marked)
        self.samples = order[marked].astype(np.int32)

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of rows whose suffixes start with each pattern (rows of one length), by backward search."""
        count = len(patterns)
        low, high = np.zeros(count, np.int64), np.full(count, self.first[-1], np.int64)
        live = np.arange(count)
        for k in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[live, k]
            low[live] = self.first[c] + self.bwt.rank(c, low[live])
            high[live] = self.first[c] + self.bwt.rank(c, high[live])
            live = live[low[live] < high[live]]
        dead = np.ones(count, bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows: steps back until a sampled position, all rows at once."""
        at, steps = rows.astype(np.int64).copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while True:
            todo = todo[~self.marks.get(at[todo])]
            if not len(todo):
                return self.samples[self.marks.rank(at)] + steps
            now = at[todo]
            c = self.bwt.access(now)
            at[todo] = self.first[c] + self.bwt.rank(c, now)
            steps[todo] += 1
