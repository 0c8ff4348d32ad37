"""A compressed full-text index over sequences of word numbers: BWT in a wavelet matrix of packed bits, backward search.

One shard's sequences are concatenated, each closed by number 0. Suffixes are sorted to a fixed depth, which is enough for
patterns up to that length. All steps work on arrays of patterns at once.
"""

from __future__ import annotations

import numpy as np

#: Pattern that the search follows at least, and the depth to which suffixes are sorted where windows are no longer.
DEPTH = 64


class PackedRank:
    """Bits in 64-bit words, with the number of ones before each word."""

    __slots__ = ("words", "before", "zeros")

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        padded = np.zeros((n // 64 + 1) * 64, np.uint8)
        padded[:n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32)
        self.zeros = n - int(ones.sum())

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)


def suffix_order(text: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """Suffixes of ``text`` sorted by their first ``depth`` numbers, by prefix doubling."""
    n = len(text)
    rank = text.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    length = 1
    while length < depth:
        next_rank = np.zeros(n, np.int64)
        next_rank[: max(0, n - length)] = rank[length:] + 1
        key = rank * (int(next_rank.max(initial=0)) + 1) + next_rank
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        steps = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = steps
        length *= 2
        if n and steps[-1] == n - 1:
            break
    return order


class FMIndex:
    """Counts occurrences of patterns, extended by one number to the left at a time."""

    def __init__(self, text: np.ndarray, depth: int = DEPTH):
        """``text``: numbers from 0 up; 0 closes a sequence and occurs in no pattern."""
        self.size = len(text)
        symbols = int(text.max(initial=0)) + 1
        order = suffix_order(text, depth)
        current = text[order - 1]  # the number before each suffix; before the first stands the last, a 0
        counts = np.bincount(text, minlength=symbols)
        first = np.cumsum(counts) - counts
        self.levels: list[tuple[int, PackedRank]] = []
        for bit in reversed(range(max(1, (symbols - 1).bit_length()))):
            bits = (current >> bit) & 1
            self.levels.append((bit, PackedRank(bits.astype(np.uint8))))
            ones = bits.astype(bool)
            current = np.concatenate([current[~ones], current[ones]])
        numbers = np.arange(symbols, dtype=np.int64)
        self.shift = first - self._down(numbers, np.zeros(symbols, np.int64))

    def _down(self, number: np.ndarray, at: np.ndarray) -> np.ndarray:
        for bit, rank in self.levels:
            ones = rank.ones(at)
            at = np.where((number >> bit) & 1, rank.zeros + ones, at - ones)
        return at

    def extend(self, number: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns ``number`` + pattern, from the intervals [low, high) of the patterns."""
        both = self._down(np.concatenate([number, number]), np.concatenate([low, high]))
        shift = self.shift[number]
        return both[: len(number)] + shift, both[len(number) :] + shift


def repeated_windows(index: FMIndex, text: np.ndarray, starts: np.ndarray, counts: np.ndarray, window: int) -> np.ndarray:
    """Which windows occur at least twice in the index.

    Query i asks for the ``counts[i]`` windows of ``window`` numbers that begin at ``starts[i]`` and the places after it in
    ``text``. Returns one flag per window, query after query. Each query is matched backward from an end as far as
    matches of two or more go. A match that reaches the first undecided window settles all windows in it at once; a
    mismatch shows that everything containing the unmatched part is unique, and moves the query past it.
    """
    flags = np.zeros(int(counts.sum()) + 1, np.int32)  # +1 where a run of repeated windows begins, -1 after its end
    slot = np.cumsum(counts) - counts
    reach = max(window, DEPTH)
    lane = np.arange(len(starts))
    first = starts.astype(np.int64).copy()  # the first undecided window
    last = starts + counts  # one past the last window
    end = np.minimum(first + reach, last + window - 1)
    at = end.copy()
    low = np.zeros(len(lane), np.int64)
    high = np.full(len(lane), index.size, np.int64)
    while len(lane):
        low, high = index.extend(text[at - 1], low, high)
        fits = high - low >= 2
        at = at - fits
        done = fits & (at == first)
        if done.any():
            begin = slot[lane[done]] + first[done] - starts[lane[done]]
            np.add.at(flags, begin, 1)
            np.add.at(flags, begin + end[done] - window + 1 - first[done], -1)
        missed = ~fits
        single = missed & (end - first == window)
        narrowed = missed & ~single
        moved = done | single
        first = np.where(done, end - window + 1, np.where(single, at, first))
        end = np.where(moved, np.minimum(first + reach, last + window - 1), np.where(narrowed, np.maximum(first + window, at - 1), end))
        restart = moved | narrowed
        at = np.where(restart, end, at)
        low = np.where(restart, 0, low)
        high = np.where(restart, index.size, high)
        open_ = first < last
        if not open_.all():
            lane, first, last, end, at, low, high = (x[open_] for x in (lane, first, last, end, at, low, high))
    return np.cumsum(flags[:-1]) > 0
